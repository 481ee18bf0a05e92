"""Queries of the text problems and their SQL, by name."""

from __future__ import annotations

import secrets

from pyspark.sql import DataFrame, SparkSession, functions as F

from brindle.llm import bpe, canonical, codepoints, leakage, nearwords, privacy, shapes, splits
from brindle.session import table


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    return canonical.map_to_canonical(table(spark, root, "upstream_candidates"), table(spark, root, "binance_tradfi_instruments")).toDF("candidate_id", "canonical_code")


def p1_unmatched(spark: SparkSession, root: str) -> DataFrame:
    return canonical.unmatched_values(table(spark, root, "upstream_candidates"), table(spark, root, "binance_tradfi_instruments"))


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    return splits.split_overlaps(table(spark, root, "candidate_pairs")).toDF("message_id_1", "message_id_2")


def p2_report(spark: SparkSession, root: str) -> DataFrame:
    return splits.overlap_report(table(spark, root, "candidate_pairs"))


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    return nearwords.near_duplicates(table(spark, root, "messages"), "id", "text").toDF("message_id_1", "message_id_2")


def p3_groups(spark: SparkSession, root: str) -> DataFrame:
    return nearwords.near_duplicate_groups(table(spark, root, "messages"), "id", "text").toDF("message_id", "group_id", "links")


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    return privacy.find_items(table(spark, root, "messages"), "id", "text").toDF("message_id", "pii_type", "pii_key")


def p4_text(spark: SparkSession, root: str) -> DataFrame:
    """The secret is the owner's, by `spark.brindle.secret`; without one, surrogates only hold within this call."""
    secret = spark.conf.get("spark.brindle.secret", None) or secrets.token_hex(32)
    return privacy.pseudonymise(table(spark, root, "messages"), "id", "text", secret).toDF("message_id", "text")


def p7_found(spark: SparkSession, root: str) -> DataFrame:
    named = lambda t, key, column: codepoints.suspicious_rows(table(spark, root, t), key, column).select(F.lit(t).alias("table_name"), F.col("key").cast("string").alias("row_key"))
    return named("messages", "id", "text").union(named("companies", "company_id", "aliases"))


def p7_text(spark: SparkSession, root: str) -> DataFrame:
    return codepoints.normalise_text(table(spark, root, "messages"), "id", "text").toDF("message_id", "text", "found")


def p8_ids(spark: SparkSession, root: str) -> DataFrame:
    return bpe.encode(table(spark, root, "documents"), "doc_id", "text").toDF("doc_id", "ids")


def p8_volume(spark: SparkSession, root: str) -> DataFrame:
    """Documents, tokens and characters by language and source."""
    docs = table(spark, root, "documents")
    tokens = bpe.encode(docs, "doc_id", "text").select(F.col("key").alias("doc_id"), F.size("ids").alias("tokens"))
    return docs.select("doc_id", "lang", "source", "n_chars").join(tokens, "doc_id").groupBy("lang", "source").agg(F.count("*").alias("documents"), F.sum("tokens").alias("tokens"), F.sum("n_chars").alias("characters"))


def p9_found(spark: SparkSession, root: str) -> DataFrame:
    return leakage.leaked_passages(table(spark, root, "documents"), table(spark, root, "eval_items"))


def p9_report(spark: SparkSession, root: str) -> DataFrame:
    return leakage.leak_report(table(spark, root, "documents"), table(spark, root, "eval_items"))


def p10_found(spark: SparkSession, root: str) -> DataFrame:
    return shapes.stuffed_pages(table(spark, root, "documents"), "doc_id", "text").select(F.col("key").alias("doc_id"))


def p10_shapes(spark: SparkSession, root: str) -> DataFrame:
    return shapes.shape_groups(table(spark, root, "documents"), "text")


def queries():
    return {f.__name__: f for f in (p1_found, p1_unmatched, p2_found, p2_report, p3_found, p3_groups, p4_found, p4_text, p7_found, p7_text, p8_ids, p8_volume, p9_found, p9_report, p10_found, p10_shapes)}


def oracle_sql():
    return {}
