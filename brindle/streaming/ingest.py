"""Continuous ingest: raw event files to stored messages and mentions, once each, with side outputs of other matchers."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from brindle.operators import ingest as I, matching as M
from brindle.operators.store import save_once
from brindle.session import checkpoint_dir

RAW = "id long, raw_event_json string, received_at string"


def raw_stream(spark: SparkSession, path: str, schema: str = RAW, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def frame_stream(spark: SparkSession, path: str, binary: bool = False) -> DataFrame:
    """Frames as they come from a connector, one a line of text files or one a binary file, as raw events. Bytes are UTF-8 text,
    with what isn't replaced; the id of a frame is a hash of it; blank lines are no frames."""
    reader = spark.readStream
    value = F.make_valid_utf8(F.col("content").cast("string")) if binary else F.col("value")
    frames = reader.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(path) if binary else reader.text(path)
    told = frames.select(value.alias("raw_event_json")).where("trim(raw_event_json) <> ''")
    return told.select(F.xxhash64("raw_event_json").alias("id"), "raw_event_json", F.lit(None).cast("string").alias("received_at"))


def stream_records(raw: DataFrame) -> DataFrame:
    """Normalised records of a stream or a table of raw events; control frames and invalid JSON give none."""
    return I.records(I.parsed(I.envelope_events(raw)))


def once_within(records: DataFrame, delay: str = "1 hour") -> DataFrame:
    """One record a key within the watermark: state is bounded by the delay, durable uniqueness is the store's."""
    return records.withWatermark("seen_at", delay).dropDuplicatesWithinWatermark(["source_key"])


def run_ingest(raw: DataFrame, store: str, checkpoint: str, side: dict[str, Callable[[DataFrame], DataFrame]] | None = None, errors: list | None = None, backup: str | None = None) -> StreamingQuery:
    """Store new records at `store`/messages, each side output at `store`/<name>; a failing side output never stops the store.

    With `backup`, every batch's records also go there as JSONL, before they are stored, one folder a batch.

    Restarted with the same checkpoint, it goes on where it was; a batch that is run again stores nothing twice.
    """

    def batch(df: DataFrame, n: int) -> None:
        rows = df.persist()
        try:
            if backup:
                rows.write.mode("overwrite").json(f"{backup}/batch={n}")
            save_once(rows, f"{store}/messages", "source_key", "message_id", "place")
            for name, of in (side or {}).items():
                try:
                    save_once(of(rows), f"{store}/{name}", "source_key", "source_key")
                except Exception as e:  # isolated by contract
                    if errors is not None:
                        errors.append((name, str(e)[:200]))
        finally:
            rows.unpersist()

    return stream_records(raw).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def mentions_of(terms: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """Side output of the matcher: the codes of each record."""

    def of(rows: DataFrame) -> DataFrame:
        keyed = rows.select(F.xxhash64("source_key").alias("id"), "text", "source_key").dropDuplicates(["source_key"])
        codes = M.folded(M.identify(keyed, terms)).select(F.col("message_id").alias("id"), F.array_join("codes", ",").alias("codes"))
        return keyed.join(codes, "id").select("source_key", "codes")

    return of


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for a sink or a checkpoint in the shared folder."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
