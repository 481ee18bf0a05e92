"""Queries of the record-level problems of the core: timestamps and nested records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from brindle.operators.nested import item_table, stock_items, subtype_table
from brindle.operators.timestamps import message_times
from brindle.session import table


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    return message_times(table(spark, root, "messages"))


def p5_delay(spark: SparkSession, root: str) -> DataFrame:
    """Messages by whole days between publication and receipt."""
    t = message_times(table(spark, root, "messages")).groupBy("message_id").agg(*(F.max(F.when(F.col("field") == f, F.to_timestamp(F.col("utc_time")))).alias(f) for f in ("published_at", "received_at")))
    return t.where("published_at is not null and received_at is not null").groupBy(F.expr("cast(floor((unix_micros(received_at) - unix_micros(published_at)) / 86400000000) as long)").alias("days")).agg(F.count("*").alias("messages"))


def _items(spark: SparkSession, root: str) -> DataFrame:
    return stock_items(table(spark, root, "messages"), table(spark, root, "upstream_candidates"))


def p6_found(spark: SparkSession, root: str) -> DataFrame:
    return _items(spark, root).select("origin", "parent_id", "item_path", "alias_no", "alias")


def p6_items(spark: SparkSession, root: str) -> DataFrame:
    return item_table(_items(spark, root))


def p6_object_aliases(spark: SparkSession, root: str) -> DataFrame:
    return subtype_table(_items(spark, root), "objects")


def queries():
    return {f.__name__: f for f in (p5_found, p5_delay, p6_found, p6_items, p6_object_aliases)}


def oracle_sql():
    return {}
