"""Records of evaluation splits that also stand, exactly or almost, in the training split.

Minwise hashes of word shingles (one word and its occurrence number each, as near-duplicates are defined without order) are
banded into buckets; a bucket only pairs training rows with evaluation rows; the pairs are verified by exact word overlap.

Cases: rows without id, split or words are no case; a message of many rows counts once, with each of its texts; a message whose rows stand in both
kinds of split never pairs with itself; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from brindle.llm.nearwords import classes, near_links, text_elements
from brindle.session import checkpoint

TRAIN, HELD_OUT = "train", ("val", "test")


def split_overlaps(rows: DataFrame, key: str = "message_id", text: str = "message_text", split: str = "split") -> DataFrame:
    """Each pair (id_1 < id_2) of messages, one in training and the other held out, with near-duplicate texts."""
    flat = rows.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"), (F.col(split) == TRAIN).alias("side0"), F.col(split).isin(*HELD_OUT).alias("side1")).where("id is not null and (side0 or side1)")
    # a message's rows have one text as a rule; where they have several, each is compared
    one = flat.groupBy("id", "text").agg(F.max("side0").alias("side0"), F.max("side1").alias("side1"))
    texts = one.select(F.xxhash64("id", "text").alias("text_id"), F.col("id").alias("message"), "text", "side0", "side1")
    reps, members = classes(checkpoint(text_elements(texts, "text_id", "text", "message", "side0", "side1")), "side0", "side1", carry=("message",))
    as_ = lambda i, rep: members.select(F.col("message").alias(f"m{i}"), F.col("rep").alias(rep), F.col("side0").alias(f"train{i}"), F.col("side1").alias(f"held{i}"))
    across = near_links(reps, sided=True).join(as_(1, "a"), "a").join(as_(2, "b"), "b").where("(train1 and held2 or held1 and train2) and m1 <> m2").select("m1", "m2")
    within = as_(1, "a").where("train1").join(as_(2, "b").where("held2"), F.col("a") == F.col("b")).where("m1 <> m2").select("m1", "m2")
    return across.union(within).select(F.least("m1", "m2").alias("id_1"), F.greatest("m1", "m2").alias("id_2")).distinct()


def overlap_report(rows: DataFrame) -> DataFrame:
    """Per held-out split and source: messages, messages with a training overlap, and confirmed pairs."""
    held = rows.where(F.col("split").isin(*HELD_OUT)).groupBy("message_id").agg(F.min("split").alias("split"), F.min("source_type").alias("source_type"))
    pairs = split_overlaps(rows)
    ends = pairs.select(F.col("id_1").alias("message_id")).union(pairs.select("id_2")).groupBy("message_id").agg(F.count("*").alias("pairs"))
    return held.join(ends, "message_id", "left").groupBy("split", "source_type").agg(F.count("*").alias("messages"), F.count("pairs").alias("overlapping"), F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs"))
