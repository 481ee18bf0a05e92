"""Idempotent appends and latest rows on Parquet tables; the stores behind streams and reviews."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from brindle.session import checkpoint


def first_per_key(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The first row of each key; of a hot key only one row of each partition is shuffled."""
    cols = [c for c in rows.columns if c != key]
    best = rows.groupBy(key).agg(F.min_by(F.struct(*cols), F.struct(*order)).alias("_r"))
    return best.select(key, *(F.col(f"_r.{c}").alias(c) for c in cols)).select(*rows.columns)


def latest_per_key(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The row with the greatest `order` of each key."""
    cols = [c for c in rows.columns if c != key]
    best = rows.groupBy(key).agg(F.max_by(F.struct(*cols), order).alias("_r"))
    return best.select(key, *(F.col(f"_r.{c}").alias(c) for c in cols)).select(*rows.columns)


def new_rows(incoming: DataFrame, stored: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key isn't stored: insert-or-ignore as an anti join."""
    return incoming.join(stored.select(*key), key, "left_anti")


def save_once(incoming: DataFrame, path: str, key: str, *order: str) -> int:
    """Append the rows whose key the Parquet table at `path` hasn't yet, one a key; the number appended."""
    spark = incoming.sparkSession
    once = first_per_key(incoming, key, *order)
    try:
        once = new_rows(once, spark.read.schema(incoming.schema).parquet(path), [key])
    except Exception as e:  # no table yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
    once = once.persist()
    n = once.count()
    if n:
        once.write.mode("append").parquet(path)
    once.unpersist()
    return n


def running_sums(units: DataFrame, weights: list[str], order: list[str]) -> tuple[DataFrame, dict[str, float]]:
    """`units` with running_<weight> up to and with each row in `order` (columns, or "-column" for descending), and the totals.

    Exact and distributed: rows are ranged by their order, partition totals are summed on the driver (one row a partition)
    and added to each partition's own running sums. No window spans the whole input.
    """
    n = int(units.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.desc(c[1:]) if c.startswith("-") else F.asc(c) for c in order]
    parted = checkpoint(units.repartitionByRange(n, *keys).withColumn("_p", F.spark_partition_id()))
    totals = {r["_p"]: r for r in parted.groupBy("_p").agg(*(F.sum(w).alias(w) for w in weights)).collect()}
    w_ = W.partitionBy("_p").orderBy(*keys).rowsBetween(W.unboundedPreceding, W.currentRow)
    sums = {}
    out = parted
    for w in weights:
        before, run = {}, 0
        for p in sorted(totals):
            before[p] = run
            run += totals[p][w] or 0
        start = F.create_map(*(F.lit(x) for p, b in before.items() for x in (p, b)))[F.col("_p")] if before else F.lit(0)
        out = out.withColumn(f"running_{w}", F.sum(w).over(w_) + start)
        sums[w] = run
    return out.drop("_p"), sums


def running_split(units: DataFrame, weight: str, order: list[str], shares: list[tuple[str, float]], last: str) -> DataFrame:
    """`split` by the running share of weight up to and with each unit: the first name whose share it doesn't exceed, else `last`."""
    out, totals = running_sums(units, [weight], order)
    share = F.col(f"running_{weight}") / F.lit(float(totals[weight] or 1))
    name = F.lit(last)
    for label, limit in reversed(shares):
        name = F.when(share <= limit, label).otherwise(name)
    return out.withColumn("split", name).withColumnRenamed(f"running_{weight}", "running")
