"""Queries of the streaming ingest, run to the end of what is there."""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle.operators import registry as R
from brindle.plans.events import _EVENTS, _ID, _WS
from brindle.plans.mentions import registry
from brindle.session import table
from brindle.streaming import ingest as S


def _ingested(spark, root, side=None):
    store = S.scratch(spark, "store")
    raw = S.raw_stream(spark, f"{root}/messages.parquet*")
    S.run_ingest(raw, store, S.scratch(spark, "offsets"), side).awaitTermination()
    return store


def stream_ingest(spark, root):
    store = _ingested(spark, root)
    return spark.read.parquet(f"{store}/messages").where("source_key like 'id:%'").select("source_key", "message_id")


def stream_side_output(spark, root):
    store = _ingested(spark, root, {"mentions": S.mentions_of(R.terms(registry(spark, root)))})
    return spark.read.parquet(f"{store}/mentions").select("source_key", "codes")


def stream_dedup(spark, root):
    raw = S.raw_stream(spark, f"{root}/messages.parquet*")
    made = table(spark, root, "messages").select(F.col("id").alias("message_id"), F.to_timestamp("created_at").alias("seen_at"))
    seen = S.once_within(S.stream_records(raw).join(made, "message_id"))  # the stream's own time of each event
    out, where = S.scratch(spark, "unique"), S.scratch(spark, "offsets")
    seen.select("source_key").writeStream.format("parquet").option("path", out).option("checkpointLocation", where).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("source_key string").parquet(out).where("source_key like 'id:%'").groupBy("source_key").agg(F.count("*").alias("n"))


def stream_windows(spark, root):
    """Hourly counts of events by type over a watermarked stream."""
    e = spark.readStream.schema(table(spark, root, "events").schema).parquet(f"{root}/events.parquet*")
    counts = e.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", "1 day").groupBy(F.window("at", "1 hour"), "event_type").agg(F.count("*").alias("n"))
    out = S.scratch(spark, "windows")

    def batch(df, n):  # only the windows that this batch has changed
        df.select("window.start", "event_type", "n").withColumn("batch", F.lit(n)).write.mode("append").parquet(out)

    counts.writeStream.foreachBatch(batch).outputMode("update").option("checkpointLocation", S.scratch(spark, "offsets")).trigger(availableNow=True).start().awaitTermination()
    last = spark.read.parquet(out).groupBy("start", "event_type").agg(F.max_by("n", "batch").alias("n"))
    return last.groupBy("event_type").agg(F.count("*").alias("hours"), F.sum("n").alias("n"))


def queries():
    return {f.__name__: f for f in (stream_ingest, stream_side_output, stream_dedup, stream_windows)}


def oracle_sql():
    keyed = f"with {_EVENTS}, k as (select message_id, place, 'id:' || trim({_ID}, {_WS}) source_key from events_ where trim({_ID}, {_WS}) <> '')"
    return {
        "stream_ingest": f"{keyed} select source_key, min_by(message_id, (message_id, place)) message_id from k group by source_key",
        "stream_dedup": f"{keyed} select source_key, 1 n from k group by source_key",
        "stream_windows": "select event_type, count(distinct date_trunc('hour', ts)) as hours, count(*) n from events group by event_type",
    }
