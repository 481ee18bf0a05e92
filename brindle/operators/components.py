"""Connected components of an undirected graph by alternating large-star and small-star rounds.

Each round only joins edges with minima that were aggregated before the shuffle; a hub's edges are joined, never collected.
Lineage is cut through tables in the shared folder, so that a lost executor costs one round; only the last round's is kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from brindle.session import checkpoint


def _large_star(e: DataFrame) -> DataFrame:
    both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    low = e.groupBy("u").agg(F.min("v").alias("m"))
    return e.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) of every node with an edge; component is the least node of it.

    Null ends, loops and repeated edges are ignored; no edges give no rows.
    """
    e = edges.select(F.col(a).cast("long").alias("x"), F.col(b).cast("long").alias("y")).where("x <> y")
    e = checkpoint(e.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct())
    state = None
    while True:
        e = checkpoint(_small_star(_large_star(e)), instead_of=e)
        now = e.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long"))).first()
        if now == state:
            break
        state = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select("v", "v").distinct())
