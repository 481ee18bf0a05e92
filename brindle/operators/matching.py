"""Mentions of registered companies in messages, by token blocking and verification.

A Latin keyword only matches between non-alphanumeric neighbours, so its first alphanumeric run is a whole token of the message:
messages' distinct tokens are joined with the terms' first tokens, and the whole pattern is only checked on what meets. An
ideographic keyword, or one that starts with another sign, is found by two of its characters in the same way. Terms are broadcast while they are few.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from brindle.functions.text import contains_keyword, has_cjk, latin_pattern, ustrip, without_urls
from brindle.session import widened

BROADCAST_TERMS = 100_000


def prepared(messages: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """(message_id, text) of messages with a text, stripped and without web addresses."""
    m = messages.select(F.col(key).alias("message_id"), ustrip(F.coalesce(F.col(text), F.lit(""))).alias("t")).where("t <> ''")
    return m.select("message_id", without_urls(F.col("t")).alias("text"))


def term_hits(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """(message_id, and the columns of the term) of every term that occurs in a message."""
    k = F.col("keyword")
    first = F.when(has_cjk(k), F.regexp_extract(F.lower(k), "([一-鿿].?)", 1)).when(k.rlike("^[A-Za-z0-9]"), F.lower(F.regexp_extract(k, "^([A-Za-z0-9]+)", 1))).otherwise(F.substring(F.lower(k), 1, 2))
    t = terms.withColumn("block", first)
    tokens = F.regexp_extract_all(F.lower("text"), F.lit("([a-z0-9]+)"), 1)
    signs = F.split(F.lower("text"), "")
    pairs = F.filter(F.arrays_zip(signs.alias("a"), F.slice(signs, F.lit(2), F.length("text")).alias("b")), lambda x: ~F.contains(F.lit("abcdefghijklmnopqrstuvwxyz0123456789 \t\r\n"), x["a"]))  # no outer column inside the lambda: it would be evaluated for each element
    blocks = F.array_distinct(F.concat(tokens, F.transform(pairs, lambda x: F.concat(x["a"], F.coalesce(x["b"], F.lit("")))), F.transform(pairs, lambda x: x["a"])))
    spread = widened(texts)
    if t.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS:
        met = spread.select("message_id", "text", F.explode(blocks).alias("block")).join(F.broadcast(t), "block").drop("block")
    else:  # the join is a shuffle: blocks travel without their texts, which come back for the messages that have any
        met = spread.select("message_id", F.explode(blocks).alias("block")).join(t, "block").drop("block").join(spread, "message_id")
    ok = F.when(F.col("kind") == "ticker", F.when(F.length(k) > 1, F.rlike(F.col("text"), latin_pattern(k, False))).otherwise(F.rlike(F.col("text"), F.concat(F.lit(r"(?<![A-Za-z0-9])\$\Q"), k, F.lit(r"\E(?![A-Za-z0-9])"))))).otherwise(contains_keyword(F.col("text"), k))
    return met.where(ok).select("message_id", *terms.columns)


def identify(messages: DataFrame, terms: DataFrame) -> DataFrame:
    """(message_id, canonical_code, mention, match_type, confidence, place): the best mention of each company that no context
    vetoes, and the company's place in the registry."""
    hits = term_hits(prepared(messages), terms)
    vetoed = F.max((F.col("kind") == "negative").cast("int")).alias("veto")
    grouped = hits.groupBy("message_id", "canonical_code").agg(vetoed, F.max(F.when(F.col("kind") != "negative", F.struct("confidence", F.length("keyword").alias("n"), (-F.col("term_ord")).alias("o"), F.col("keyword").alias("mention"), F.col("kind").alias("match_type")))).alias("b"), F.min("place").alias("place"))
    return grouped.where("veto = 0 and b is not null").select("message_id", "canonical_code", "b.mention", "b.match_type", "b.confidence", "place")


def folded(matches: DataFrame) -> DataFrame:
    """One row per message with its matches by confidence; equal ones in the order of the registry."""
    item = F.struct((-F.col("confidence")).alias("_c"), "place", "canonical_code", "mention", "match_type", "confidence")
    return matches.groupBy("message_id").agg(F.array_sort(F.collect_list(item)).alias("m")).select("message_id", F.transform("m", lambda x: x["canonical_code"]).alias("codes"), F.transform("m", lambda x: x["mention"]).alias("mentions"))
