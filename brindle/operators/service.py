"""What a service around the tables answers, as functions; its transport and pages are left out.

Requests are few rows; each function is one small job over the stores.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession, functions as F

from brindle.operators import matching as M, review as V


class UnknownCode(ValueError):
    """A code that no enabled company has."""


def identify(spark: SparkSession, text: str, terms: DataFrame) -> list[dict]:
    """Matches of one message by confidence, then in the order of the registry."""
    one = spark.createDataFrame([(0, text)], "id long, text string")
    found = M.identify(one, terms).orderBy(F.desc("confidence"), "place")
    return [r.asDict() for r in found.drop("message_id", "place").collect()]


def items(messages: DataFrame, annotations: DataFrame, limit: int = 100, offset: int = 0, unlabelled_only: bool = True) -> dict:
    """A page of messages to annotate, and how far annotation has come."""
    page = [r.asDict(recursive=True) for r in V.items(messages, annotations, limit, offset, unlabelled_only).collect()]
    done = V.progress(messages.where("trim(text) <> ''").withColumnRenamed("id", "message_id"), annotations).first()
    return {"items": page, "summary": done.asDict()}


def review_items(predictions: DataFrame, versions: list[str], annotations: DataFrame, limit: int = 100, offset: int = 0, unreviewed_only: bool = True) -> dict:
    """A page of the review queue, and how far the review has come."""
    page = [r.asDict(recursive=True) for r in V.review_items(predictions, versions, annotations, limit, offset, unreviewed_only).collect()]
    return {"items": page, "summary": V.review_progress(V.eligible(predictions, versions), annotations).first().asDict()}


def annotate(request: dict, messages: DataFrame, codes: DataFrame, stored: DataFrame, annotator: str = "annotator") -> DataFrame:
    """The annotation to append for a request (source_key, correct_codes, confidence); UnknownCode or KeyError where it names an
    unknown code or message. `annotator` is the workflow that asks."""
    scope = [r["code"] for r in codes.select("code").distinct().orderBy("code").collect()]  # a registry has a few hundred
    if unknown := sorted(set(request["correct_codes"]) - set(scope)):
        raise UnknownCode(", ".join(unknown))
    row = (request["source_key"], None, list(request["correct_codes"]), scope, annotator, request.get("confidence", "high"))
    kind = "source_key string, source_ref string, correct_codes array<string>, scope_codes array<string>, annotator string, confidence string"
    kept, missing = V.record(messages.sparkSession.createDataFrame([row], kind), messages, stored)
    if missing.count():
        raise KeyError(request["source_key"])
    return kept


def converse(lines: Iterable[str], answer: Callable[[str], list[dict]]) -> Iterator[str]:
    """A terminal session: one answer a line, until `exit` or `quit`."""
    for line in lines:
        text = line.strip()
        if text.lower() in ("exit", "quit"):
            return
        if text:
            found = answer(text)
            yield "; ".join(f"{m['canonical_code']} ({m['mention']}, {m['confidence']})" for m in found) or "no match"


def latencies(spark: SparkSession, texts: list[str], run: Callable[[str], int], warm_up: int = 10, clock: Callable[[], float] = time.perf_counter) -> DataFrame:
    """p50, p95 and p99 milliseconds of `run`, one message at a time, by how many candidates it returns (none, one, several) and
    in all; the first `warm_up` messages also run before, untimed."""
    for t in texts[:warm_up]:
        run(t)
    rows = []
    for t in texts:
        began = clock()
        n = run(t)
        took = float((clock() - began) * 1000)
        rows += [("all", took), ("none" if n == 0 else "one" if n == 1 else "several", took)]
    times = spark.createDataFrame(rows, "bucket string, ms double")
    return times.groupBy("bucket").agg(F.count("*").alias("n"), *(F.percentile("ms", q).alias(f"p{round(q * 100)}") for q in (0.5, 0.95, 0.99)))
