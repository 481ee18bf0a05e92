"""All queries of the core with their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from brindle.plans import events, mentions, models, pairs, records, reviews, streams

FLAGSHIP = "identify_matches"
_PARTS = [mentions, events, pairs, reviews, models, streams, records]

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {name: run for part in _PARTS for name, run in part.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in _PARTS for name, sql in part.oracle_sql().items()}
