"""Construction of labelled pairs: labels by precedence, top-ups, near-duplicate clusters, leak-free splits."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from brindle.functions.text import dedup_form
from brindle.operators.components import connected_components
from brindle.session import bounded, checkpoint

WORD, MAX_DF, MIN_SHARED, MIN_RATIO, RATIO_CHARACTERS = 3, 15, 3, 0.75, 300
HOT_WORD, BROADCAST_WORDS = 10_000, 500_000


def pair_labels(correct: DataFrame, local: DataFrame, upstream: DataFrame) -> DataFrame:
    """(message_id, code, label, negative_type) of the union of three code sets, by precedence."""
    tagged = correct.select("message_id", "code", F.lit(0).alias("p")).union(local.select("message_id", "code", F.lit(1))).union(upstream.select("message_id", "code", F.lit(2)))
    first = tagged.groupBy("message_id", "code").agg(F.min("p").alias("p"))
    return first.select("message_id", "code", (F.col("p") == 0).cast("int").alias("label"), F.when(F.col("p") == 1, "hard_rule").when(F.col("p") == 2, "hard_upstream").otherwise("").alias("negative_type"))


def top_up(labelled: DataFrame, codes: DataFrame, least: int = 3) -> DataFrame:
    """Negatives from unused codes, so that each positive message has `least` negatives.

    `codes` is a registry of (code, ord). Each message takes the first unused codes of an order that starts at a place of its
    own; at most `least` + its own labels are looked at, so nothing is crossed with the whole registry.
    """
    n = codes.count()
    if not n:
        return labelled.limit(0).select("message_id", "code")
    m = labelled.groupBy("message_id").agg(F.max("label").alias("positive"), F.count_if(F.col("label") == 0).alias("negatives"), F.count("*").alias("have"), F.collect_set("code").alias("used")).where(f"positive = 1 and negatives < {least}")
    look = F.least(F.lit(n), F.lit(least) + F.col("have")).cast("int")
    tries = m.select("message_id", "used", (F.lit(least) - F.col("negatives")).alias("want"), F.posexplode(F.sequence(F.lit(0), look - 1)).alias("nth", "_x")).select("message_id", "used", "want", "nth", F.pmod(F.col("message_id") * 31 + F.col("nth") * 7919, F.lit(n)).alias("ord"))
    hit = tries.join(bounded(codes, 100_000), "ord").where(~F.array_contains("used", F.col("code")))
    picked = hit.groupBy("message_id").agg(F.max("want").cast("int").alias("want"), F.array_sort(F.collect_set(F.struct("nth", "code"))).alias("c"))  # a few codes a message
    codes_in_order = F.array_distinct(F.transform("c", lambda x: x["code"]))
    return picked.select("message_id", F.explode(F.slice(codes_in_order, F.lit(1), F.col("want"))).alias("code"))


def rare_word_pairs(texts: DataFrame, key: str, form: str) -> DataFrame:
    """(a, b, shared): pairs that share at least MIN_SHARED words of WORD or more characters which at most MAX_DF texts have."""
    each = texts.select(F.col(key).alias("id"), F.explode(F.array_distinct(F.filter(F.split(form, " "), lambda w: F.length(w) >= WORD))).alias("word"))
    df = checkpoint(each.groupBy("word").agg(F.count("*").alias("df")).where("df > 1"))
    hot = df.where(f"df > {HOT_WORD}").select("word")  # none of these is rare; they are left out before anything is shuffled by word
    kept = each.join(bounded(hot, BROADCAST_WORDS), "word", "left_anti").join(bounded(df.where(f"df <= {MAX_DF}").select("word"), BROADCAST_WORDS), "word")
    return kept.alias("x").join(kept.alias("y"), "word").where("x.id < y.id").groupBy(F.col("x.id").alias("a"), F.col("y.id").alias("b")).agg(F.count("*").alias("shared")).where(f"shared >= {MIN_SHARED}")


def ratio_edges(pairs: DataFrame, texts: DataFrame, key: str, form: str, codes: str) -> DataFrame:
    """Pairs with compatible codes (both none, or one in common) whose sequence ratio is at least MIN_RATIO."""
    t = texts.select(F.col(key).alias("id"), F.substring(form, 1, RATIO_CHARACTERS).alias("f"), F.col(codes).alias("c"))
    met = pairs.join(t.toDF("a", "fa", "ca"), "a").join(t.toDF("b", "fb", "cb"), "b")
    short, both = F.least(F.length("fa"), F.length("fb")), F.length("fa") + F.length("fb")
    met = met.where(2 * short >= MIN_RATIO * both)  # the ratio is 2 * matches / both, and matches are at most the shorter text
    met = met.where(((F.size("ca") == 0) & (F.size("cb") == 0)) | F.arrays_overlap("ca", "cb"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            # the characters in common bound the ratio; only what they allow is aligned
            matchers = [difflib.SequenceMatcher(None, x, y) for x, y in zip(f["fa"], f["fb"])]
            keep = [m.quick_ratio() >= MIN_RATIO and m.ratio() >= MIN_RATIO for m in matchers]
            yield f.loc[keep, ["a", "b"]]

    return met.select("a", "b", "fa", "fb").mapInPandas(run, "a long, b long")


def clusters(texts: DataFrame, key: str, text: str, codes: str) -> DataFrame:
    """(id, cluster): texts of one normalised form and verified near-duplicates together; cluster is the least id."""
    t = checkpoint(texts.select(F.col(key).cast("long").alias("id"), dedup_form(F.col(text)).alias("form"), F.col(codes).alias("codes")))
    same = t.groupBy("form").agg(F.min("id").alias("rep"))
    exact = t.join(same, "form").where("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b"))
    near = ratio_edges(rare_word_pairs(t, "id", "form"), t, "id", "form", "codes")
    parts = connected_components(exact.union(near), "a", "b")
    return t.select("id").join(parts.toDF("id", "cluster"), "id", "left").select("id", F.coalesce("cluster", "id").alias("cluster"))
