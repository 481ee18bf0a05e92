"""Append-only annotations and the views on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from brindle.operators.store import first_per_key, latest_per_key, new_rows


def decision(correct: Column, predicted: Column) -> Column:
    """no_tracked_company without codes, accepted where they equal the prediction in order, else corrected."""
    return F.when(F.size(correct) == 0, "no_tracked_company").when(correct == predicted, "accepted").otherwise("corrected")


def append(annotations: DataFrame, messages: DataFrame, codes: DataFrame, stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) of incoming annotations (message_id, source_ref, correct_codes): unknown messages and codes are
    rejected, known references ignored."""
    known = codes.select("code").distinct()
    bad = annotations.select("source_ref", F.explode("correct_codes").alias("code")).join(known, "code", "left_anti").select("source_ref").distinct()
    valid = annotations.join(messages.select("message_id"), "message_id", "left_semi").join(bad, "source_ref", "left_anti")
    rejected = annotations.join(valid.select("source_ref"), "source_ref", "left_anti")
    return new_rows(valid, stored, ["source_ref"]), rejected


def record(incoming: DataFrame, messages: DataFrame, stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(annotations to append, rows of unknown messages) of incoming ones (source_key, source_ref, correct_codes, scope_codes,
    annotator, confidence): codes without repeats in order, scopes sorted, the message's prediction at that time and the
    decision; a known `source_ref` is ignored, one without is always new."""
    known = messages.select("source_key", F.col("id").alias("message_id"), "predicted_codes")
    joined = incoming.withColumn("correct_codes", F.array_distinct("correct_codes")).withColumn("scope_codes", F.array_sort("scope_codes")).join(known, "source_key", "left")
    fresh = joined.where("message_id is not null").withColumn("decision", decision(F.col("correct_codes"), F.col("predicted_codes")))
    once = fresh.where("source_ref is not null").dropDuplicates(["source_ref"]).join(stored.select("source_ref"), "source_ref", "left_anti")
    return once.unionByName(fresh.where("source_ref is null")), joined.where("message_id is null").select(*incoming.columns)


def legacy_annotations(lines: DataFrame) -> DataFrame:
    """Annotations of a legacy JSONL file (line, value; numbered from 1) as `record` takes them. Their reference is made of line
    and content, so that a second import of the file adds nothing."""
    kind = "struct<record_key:string,correct_codes:array<string>,scope_codes:array<string>,annotator:string,confidence:string,annotated_at:string>"
    r = lines.where("trim(value) <> ''").select("line", "value", F.from_json("value", kind).alias("r"))
    none, text = F.array().cast("array<string>"), lambda f: F.coalesce(F.col(f"r.{f}"), F.lit("legacy"))
    ref = F.concat(F.lit("legacy:"), F.col("line").cast("string"), F.lit(":"), F.sha2(F.col("value"), 256))
    return r.select(F.col("r.record_key").alias("source_key"), ref.alias("source_ref"), F.coalesce("r.correct_codes", none).alias("correct_codes"), F.coalesce("r.scope_codes", none).alias("scope_codes"), text("annotator").alias("annotator"), text("confidence").alias("confidence"))


def migrate(events: DataFrame, lines: DataFrame, messages: DataFrame, stored: DataFrame) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """(new messages, new annotations, counters) of legacy records (source_key, ...) and annotation lines. `messages` and `stored`
    are what is there; annotations of unknown messages are skipped and counted."""
    fresh = first_per_key(new_rows(events, messages, ["source_key"]), "source_key", "id")
    kept, unknown = record(legacy_annotations(lines), messages.unionByName(fresh.select(*messages.columns)), stored)
    return fresh, kept, {"imported_messages": fresh.count(), "imported_annotations": kept.count(), "skipped_annotations": unknown.count()}


def clamped(limit: int, offset: int) -> tuple[int, int]:
    """A page of 1 to 500 rows that begins at 0 or later."""
    return max(1, min(limit, 500)), max(0, offset)


def with_latest(messages: DataFrame, annotations: DataFrame) -> DataFrame:
    """Messages with their latest annotation as a struct, or null."""
    last = latest_per_key(annotations, "message_id", "id")
    return messages.join(last.select("message_id", F.struct(*[c for c in last.columns if c != "message_id"]).alias("annotation")), "message_id", "left")


def items(messages: DataFrame, annotations: DataFrame, limit: int = 100, offset: int = 0, unlabelled_only: bool = True) -> DataFrame:
    """A page of messages with a text in the order of their ids, each with its latest annotation as a struct or null."""
    limit, offset = clamped(limit, offset)
    seen = with_latest(messages.where("trim(text) <> ''").withColumnRenamed("id", "message_id"), annotations)
    return (seen.where("annotation is null") if unlabelled_only else seen).orderBy("message_id").offset(offset).limit(limit)


def labelled(messages: DataFrame, annotations: DataFrame) -> DataFrame:
    """Messages with a text and their latest annotation's columns; those without one are left out."""
    last = latest_per_key(annotations, "message_id", "id")
    return messages.where("trim(text) <> ''").withColumnRenamed("id", "message_id").join(last.drop("id"), "message_id")


def append_predictions(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """Shadow predictions (message_id, model_version, rule_codes, model_codes, ...) to append, with their agreement: equal as
    multisets. One row a message and version; those stored are ignored."""
    key = ["message_id", "model_version"]
    agrees = (F.array_sort("rule_codes") == F.array_sort("model_codes")).cast("int")
    return new_rows(incoming.dropDuplicates(key), stored, key).withColumn("agrees", agrees)


def eligible(predictions: DataFrame, versions: list[str]) -> DataFrame:
    """(message_id, last_shadow_at, priority_group) of messages that all versions have scored and one disagrees with the rule on;
    group 0 where the models agree with each other."""
    some = predictions.where(F.col("model_version").isin(*versions))
    g = some.groupBy("message_id").agg(F.countDistinct("model_version").alias("n"), F.min("agrees").alias("agrees"), F.countDistinct(F.array_sort("model_codes")).alias("answers"), F.max("created_at").alias("last_shadow_at"))
    return g.where((F.col("n") == len(set(versions))) & (F.col("agrees") == 0)).select("message_id", "last_shadow_at", F.when(F.col("answers") == 1, 0).otherwise(1).alias("priority_group"))


def review_progress(queue: DataFrame, annotations: DataFrame) -> DataFrame:
    """Messages up for review, those with an annotation and those without."""
    seen = queue.join(annotations.select("message_id").distinct().withColumn("seen", F.lit(1)), "message_id", "left")
    return seen.agg(F.count("*").alias("total"), F.count("seen").alias("reviewed"), F.count_if(F.col("seen").isNull()).alias("pending"))


def review_items(predictions: DataFrame, versions: list[str], annotations: DataFrame, limit: int = 100, offset: int = 0, unreviewed_only: bool = True) -> DataFrame:
    """A page of the review queue: one row a message with its versions' predictions nested, reasons, priority and annotation.

    The page is cut before the predictions are joined. Priority: 100 where the models agree, else 90, and 5 more with several
    candidates; sorted by priority and time, latest first.
    """
    limit, offset = clamped(limit, offset)
    queue = eligible(predictions, versions)
    if unreviewed_only:
        queue = queue.join(annotations.select("message_id"), "message_id", "left_anti")
    page = queue.orderBy("priority_group", F.desc("last_shadow_at"), F.desc("message_id")).offset(offset).limit(limit)
    some = predictions.where(F.col("model_version").isin(*versions)).join(F.broadcast(page), "message_id")  # a page has at most 500 rows
    nested = F.array_sort(F.collect_list(F.struct("model_version", F.array_sort("model_codes").alias("model_codes"), "candidates", "agrees")))
    g = some.groupBy("message_id", "last_shadow_at", "priority_group").agg(nested.alias("predictions"))
    several = F.size(F.array_distinct(F.flatten(F.col("predictions.candidates")))) > 1
    why = reasons(F.col("predictions.model_codes"), F.transform(F.filter("predictions", lambda p: p["agrees"] == 0), lambda p: p["model_version"]), F.flatten(F.col("predictions.candidates")))
    priority = F.when(F.col("priority_group") == 0, 100).otherwise(90) + several.cast("int") * 5
    return with_latest(g.select("message_id", "last_shadow_at", "predictions", why.alias("reasons"), priority.alias("priority")), annotations).orderBy(F.desc("priority"), F.desc("last_shadow_at"), F.desc("message_id"))


def progress(messages: DataFrame, annotations: DataFrame) -> DataFrame:
    return with_latest(messages, annotations).agg(F.count("*").alias("total"), F.count("annotation").alias("labelled"), F.count_if(F.col("annotation").isNull()).alias("remaining"))


def reasons(model_codes: Column, disagreeing: Column, candidates: Column) -> Column:
    """Why a message is up for review, from its models' answers, the versions that disagree with the rule, and its candidates."""
    return F.array_compact(F.array(F.when(F.size(F.array_distinct(model_codes)) == 1, "models agree, rule differs").otherwise("models differ"), F.when(F.size(disagreeing) > 0, F.concat(F.lit("rule differs from "), F.array_join(F.array_sort(disagreeing), ", "))), F.when(F.size(F.array_distinct(candidates)) > 1, "several candidates")))
