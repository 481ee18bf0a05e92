"""File sources and sinks: records, annotations, pairs, snapshots."""

from __future__ import annotations

import datetime
import hashlib
import json
import os
import re
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from brindle.functions.text import ustrip

# Columns of pair and prediction files.
PAIR = "message_id long, source_id string, source_type string, message_text string, candidate_code string, candidate_profile string, label int, negative_type string, annotation_confidence string, real_candidate_count int, split string"
PREDICTION = "message_id long, candidate_code string, label int, negative_type string, score double"


def plain_name(name: str) -> bool:
    """Whether a name is one folder of its own: ASCII letters, digits, dots, dashes and underscores, and not hidden."""
    return name.isascii() and name[:1].isalnum() and not name.replace("-", "").replace("_", "").replace(".", "").strip("".join(map(chr, range(48, 58))) + "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")


class BadLine(ValueError):
    """A line of a JSONL file that is no JSON."""


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of a JSONL file with their line numbers (`line`, from 1, one file) and blank lines left out; BadLine on bad JSON."""
    raw = spark.read.option("wholetext", False).text(path).select(F.col("value"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_i"))
    kind = T.StructType.fromDDL(f"{schema}, _bad string")
    rows = raw.where(ustrip(F.col("value")) != "").select("_b", "_i", F.from_json("value", kind, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    bad = rows.where("r._bad is not null").orderBy("_b", "_i").select("_b", "_i", "r._bad").limit(1).collect()
    if bad:
        before = raw.where((F.col("_b") < bad[0]["_b"]) | ((F.col("_b") == bad[0]["_b"]) & (F.col("_i") < bad[0]["_i"]))).count()
        raise BadLine(f"{path}:{before + 1}: {bad[0]['_bad'][:200]}")
    return rows.select(F.struct("_b", "_i").alias("line"), *(F.col(f"r.{f.name}").alias(f.name) for f in kind if f.name != "_bad"))


def records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records whose text isn't blank."""
    return jsonl(spark, path, schema).where(ustrip(F.coalesce(F.col("text"), F.lit(""))) != "").drop("line")


def last_per_key(spark: SparkSession, path: str, schema: str, key: str) -> DataFrame:
    """The last line of each key."""
    rows = jsonl(spark, path, schema)
    cols = [c for c in rows.columns if c not in (key, "line")]
    return rows.groupBy(key).agg(F.max_by(F.struct(*cols), "line").alias("_r")).select(key, *(F.col(f"_r.{c}").alias(c) for c in cols))


def pairs(spark: SparkSession, path: str) -> DataFrame:
    return jsonl(spark, path, PAIR).drop("line").withColumn("real_candidate_count", F.coalesce("real_candidate_count", F.lit(1)))


def predictions(spark: SparkSession, path: str) -> DataFrame:
    return jsonl(spark, path, PREDICTION).drop("line")


def nested_list(spark: SparkSession, path: str, field: str, schema: str) -> DataFrame:
    """Distinct rows of a list at `field` (such as a.b) of one JSON document."""
    parts = field.split(".")
    ddl = f"array<struct<{schema}>>"
    for p in reversed(parts):
        ddl = f"struct<{p}:{ddl}>"
    doc = spark.read.text(path, wholetext=True).select(F.from_json("value", ddl).alias("d"))
    return doc.select(F.explode(F.col("d." + field)).alias("x")).select("x.*").distinct()


def columnar_payload(spark: SparkSession, path: str) -> DataFrame:
    """Rows {fields, data} of a columnar JSON payload as maps; a row of another length is an error."""
    doc = spark.read.text(path, wholetext=True).select(F.from_json("value", "struct<fields:array<string>,data:array<array<string>>>").alias("d"))
    rows = doc.select("d.fields", F.explode("d.data").alias("row"))
    checked = F.when(F.size("fields") == F.size("row"), F.map_from_arrays("fields", "row")).otherwise(F.raise_error(F.lit("a row has another length than the fields")))
    return rows.select(checked.alias("row"))


def registry_csv(spark: SparkSession, path: str) -> DataFrame:
    """Manual rows of the registry as they stand; `operators.registry.manual_companies` splits their lists."""
    kind = "company_id string, company_name string, exchange string, ticker string, aliases string, brands string, negative_contexts string"
    return spark.read.schema(kind).csv(path, header=True, encoding="UTF-8", quote='"', escape='"', multiLine=True)


def id_list(spark: SparkSession, path: str, field: str = "message_ids") -> DataFrame:
    """Distinct ids of a list in one JSON document, such as frozen test messages."""
    doc = spark.read.text(path, wholetext=True).select(F.from_json("value", f"struct<{field}:array<long>>")[field].alias("ids"))
    return doc.select(F.explode("ids").alias("message_id")).distinct()


def news_records(news: DataFrame, tag: str) -> DataFrame:
    """Records of news rows with a title, tagged with their import."""
    title = ustrip(F.coalesce(F.col("title_cn"), F.lit("")))
    return news.where(title != "").select(F.concat(F.lit("id:"), F.col("id")).alias("source_key"), F.col("id").cast("string").alias("source_id"), F.lit("news").alias("source_type"), title.alias("text"), F.lit(tag).alias("import_batch"))


def news_csv(spark: SparkSession, path: str) -> DataFrame:
    """News rows in the order of their number, with or without a byte order mark."""
    df = spark.read.csv(path, header=True, encoding="UTF-8", multiLine=True)
    return df.toDF(*(c.lstrip("﻿") for c in df.columns)).withColumn("id", F.col("id").cast("int")).orderBy("id")


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """Fixed columns with a header."""
    df.select(*columns).write.mode("overwrite").csv(path, header=True)


def write_pairs(df: DataFrame, path: str) -> None:
    """Pairs as JSONL, one folder a split."""
    df.write.mode("overwrite").partitionBy("split").json(path)


def write_jsonl(df: DataFrame, path: str, mode: str = "append") -> None:
    df.write.mode(mode).json(path)


def write_predictions(df: DataFrame, path: str) -> None:
    """Scored pairs as JSONL with the columns of a prediction file."""
    write_jsonl(df.select(*(f.name for f in T.StructType.fromDDL(PREDICTION))), path, "overwrite")


def header_fields(values: list[str], defaults: dict[str, str | None] | None = None) -> dict[str, str]:
    """Connector headers from `NAME=VALUE` texts; non-empty `defaults` (such as secrets of the environment) win."""
    out = {}
    for v in values:
        name, mark, value = v.partition("=")
        if not mark or not name.strip():
            raise ValueError(f"a header is NAME=VALUE, not {v!r}")
        out[name.strip()] = value.strip()
    return out | {k: v for k, v in (defaults or {}).items() if v}


def filled_url(url: str, token: str | None) -> str:
    """The address with its `{token}` filled in; an error where it has one and no token is given."""
    if "{token}" in url and not token:
        raise ValueError("the address needs a token")
    return url.replace("{token}", token or "")


def utc_now(clock=None) -> str:
    """ISO time in UTC; `clock` stands in for the system's in tests."""
    return (clock or (lambda: datetime.datetime.now(datetime.timezone.utc)))().isoformat()


def digest(path: str) -> str:
    """SHA-256 of a file, read in blocks."""
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while block := f.read(1 << 20):
            h.update(block)
    return h.hexdigest()


def snapshot(tables: dict[str, DataFrame], root: str, name: str, created_at: str) -> dict:
    """Immutable snapshot of tables as Parquet with a manifest of counts and digests; refuses an existing or odd name, leaves
    nothing behind on failure. `root` is a folder that driver and executors share."""
    if not plain_name(name):
        raise ValueError(f"no name of a snapshot: {name!r}")
    final = os.path.join(root, name)
    if os.path.exists(final):
        raise FileExistsError(final)
    temporary = f"{final}.{uuid.uuid4().hex}.tmp"
    os.makedirs(temporary)
    try:
        manifest = {"name": name, "created_at": created_at, "tables": {}}
        for t, df in tables.items():
            where = os.path.join(temporary, f"{t}.parquet")
            df.write.parquet("file://" + os.path.abspath(where))
            files = sorted(f for f in os.listdir(where) if f.endswith(".parquet"))
            manifest["tables"][t] = {"rows": df.sparkSession.read.parquet("file://" + os.path.abspath(where)).count(), "files": {f: digest(os.path.join(where, f)) for f in files}}
        with open(os.path.join(temporary, "manifest.json"), "w") as f:
            json.dump(manifest, f, indent=1, sort_keys=True)
        os.replace(temporary, final)
        return manifest
    finally:
        if os.path.exists(temporary):
            import shutil

            shutil.rmtree(temporary)


def resolve_snapshot(spark: SparkSession, root: str, name: str) -> dict[str, DataFrame]:
    """Tables of a snapshot; a missing table or a changed file is an error."""
    folder = os.path.join(root, name)
    with open(os.path.join(folder, "manifest.json")) as f:
        manifest = json.load(f)
    for t, of in manifest["tables"].items():
        for file, want in of["files"].items():
            if digest(os.path.join(folder, f"{t}.parquet", file)) != want:
                raise ValueError(f"{t}/{file} isn't the snapshot's")
    return {t: spark.read.parquet("file://" + os.path.abspath(os.path.join(folder, f"{t}.parquet"))) for t in manifest["tables"]}
