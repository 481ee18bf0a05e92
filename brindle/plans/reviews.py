"""Queries of annotation, of the review of model versions, and of imports.

The test tables hold no annotations: a message's rows of candidate_pairs with one confidence stand for an annotation whose codes
are those labelled 1, higher confidences being later. Shadow predictions are those of plans.pairs, made when the message was.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle.operators import review as V, store as S
from brindle.plans.mentions import _MATCHES, matches
from brindle.plans.pairs import _SHADOW, _shadow
from brindle.session import table

VERSIONS = ["v1", "v2"]


def _messages(spark, root):
    codes = F.coalesce(F.from_json("predicted_codes_json", "array<string>"), F.array().cast("array<string>"))
    return table(spark, root, "messages").select("id", "source_key", "source_type", "text", "created_at", codes.alias("predicted_codes"))


def _annotations(spark, root):
    rank = F.when(F.col("confidence") == "high", 3).when(F.col("confidence") == "medium", 2).otherwise(1)
    codes = F.array_sort(F.collect_set(F.when(F.col("label") == 1, F.col("candidate_code"))))
    a = table(spark, root, "candidate_pairs").where("annotation_confidence is not null").groupBy("message_id", F.col("annotation_confidence").alias("confidence")).agg(codes.alias("correct_codes"))
    m = _messages(spark, root).select(F.col("id").alias("message_id"), F.col("created_at").alias("annotated_at"), "predicted_codes")
    return a.join(m, "message_id").select((F.col("message_id") * 4 + rank).alias("id"), "message_id", "annotated_at", "confidence", "correct_codes", V.decision(F.col("correct_codes"), F.col("predicted_codes")).alias("decision"))


def _predictions(spark, root):
    at = table(spark, root, "messages").select(F.col("id").alias("message_id"), "created_at")
    lists = lambda c: F.filter(F.split(c, ","), lambda x: x != "")
    codes = table(spark, root, "candidate_pairs").groupBy("message_id").agg(F.array_sort(F.collect_set("candidate_code")).alias("candidates"))
    p = _shadow(spark, root).select("message_id", "model_version", lists("rule_codes").alias("rule_codes"), lists("model_codes").alias("model_codes"))
    return V.append_predictions(p, p.limit(0)).join(at, "message_id").join(codes, "message_id")


def annotation_decision(spark, root):
    return _annotations(spark, root).select("id", "message_id", "decision", F.array_join("correct_codes", ",").alias("codes"))


def latest_annotation(spark, root):
    return S.latest_per_key(_annotations(spark, root), "message_id", "id").select("message_id", "id", "confidence", "decision")


def annotation_summary(spark, root):
    m = _messages(spark, root).where("trim(text) <> ''").select(F.col("id").alias("message_id"))
    return V.progress(m, _annotations(spark, root))


def annotation_items(spark, root):
    """The third page of 50 messages, annotated or not."""
    i = V.items(_messages(spark, root), _annotations(spark, root), 50, 100, unlabelled_only=False)
    return i.select("message_id", "source_type", F.col("annotation.id").alias("annotation_id"), F.col("annotation.decision").alias("decision"), F.array_join("annotation.correct_codes", ",").alias("codes"))


def unlabelled_items(spark, root):
    return V.items(_messages(spark, root), _annotations(spark, root), 1000, -5).select("message_id", "source_type")


def labelled_messages(spark, root):
    return V.labelled(_messages(spark, root), _annotations(spark, root)).select("message_id", "source_type", "confidence", "decision", F.array_join("correct_codes", ",").alias("codes"))


def training_summary(spark, root):
    """Messages with a text by what their latest annotation says, the span they arrived in, and the last annotation's time."""
    m = table(spark, root, "messages").where("trim(text) <> ''").select("id", "text", "received_at")
    last = V.labelled(m, _annotations(spark, root)).select(F.col("message_id").alias("id"), "correct_codes", "annotated_at")
    j = m.select("id", "received_at").join(last, "id", "left")
    return j.agg(F.count("*").alias("valid"), F.count("correct_codes").alias("labelled"), F.count_if(F.col("correct_codes").isNull()).alias("unlabelled"), F.count_if(F.size("correct_codes") > 0).alias("positive"), F.min("received_at").alias("first_at"), F.max("received_at").alias("last_at"), F.max("annotated_at").alias("annotated_at"))


def shadow_store(spark, root):
    """Predictions to append where those of v1 on news are stored."""
    p = _predictions(spark, root)
    stored = p.where("model_version = 'v1'").join(table(spark, root, "messages").where("source_type = 'news'").select(F.col("id").alias("message_id")), "message_id", "left_semi")
    return V.append_predictions(p.drop("agrees"), stored).groupBy("model_version", "agrees").agg(F.count("*").alias("n"))


def review_summary(spark, root):
    return V.review_progress(V.eligible(_predictions(spark, root), VERSIONS), _annotations(spark, root))


def review_items(spark, root):
    i = V.review_items(_predictions(spark, root), VERSIONS, _annotations(spark, root), 60, 0)
    answers = F.array_join(F.transform("predictions", lambda p: F.concat(p["model_version"], F.lit("="), F.array_join(p["model_codes"], ","))), ";")
    return i.select("message_id", "last_shadow_at", "priority", answers.alias("answers"), F.array_join("reasons", "; ").alias("reasons"))


def shadow_report(spark, root):
    """Agreement of every version that has predictions."""
    p = _predictions(spark, root)
    return p.groupBy("model_version").agg(F.count("*").alias("total"), F.sum("agrees").alias("agreeing"), F.max("created_at").alias("last_at"))


def import_counters(spark, root):
    """News deliveries as an import: rows, those without text, repeats of a key, new ones and those that name a company."""
    m = table(spark, root, "messages").where("source_type = 'news'").select("id", "source_key", "text")
    full = m.where("trim(text) <> ''")
    once = S.first_per_key(full, "source_key", "id")
    named = once.join(matches(spark, root).select(F.col("message_id").alias("id")).distinct().withColumn("named", F.lit(1)), "id", "left")
    n = m.agg(F.count("*").alias("rows"), F.count_if(F.expr("coalesce(trim(text), '') = ''")).alias("empty"))
    return n.join(named.agg(F.count("*").alias("inserted"), F.count("named").alias("with_candidate"))).select("rows", "empty", (F.col("rows") - F.col("empty") - F.col("inserted")).alias("repeated"), "inserted", "with_candidate")


def sample_messages(spark, root):
    """200 messages in a pseudo-random order that is the same in every run, as a latency harness draws them."""
    return table(spark, root, "messages").where("trim(text) <> ''").select("id").orderBy(F.sha2(F.col("id").cast("string"), 256), "id").limit(200)


def queries():
    return {f.__name__: f for f in (annotation_decision, latest_annotation, annotation_summary, annotation_items, unlabelled_items, labelled_messages, training_summary, shadow_store, review_summary, review_items, shadow_report, import_counters, sample_messages)}


_ANNOTATIONS = """said as (select message_id, annotation_confidence confidence, coalesce(list_sort(list(distinct candidate_code) filter (label = 1)), []) codes from candidate_pairs where annotation_confidence is not null group by 1, 2),
annotations as (select message_id * 4 + case confidence when 'high' then 3 when 'medium' then 2 else 1 end id, message_id, m.created_at annotated_at, confidence, codes, case when len(codes) = 0 then 'no_tracked_company' when codes = from_json(m.predicted_codes_json, '["VARCHAR"]') then 'accepted' else 'corrected' end decision from said join messages m on m.id = message_id),
latest as (select * from annotations a where id = (select max(id) from annotations b where b.message_id = a.message_id)),
valid as (select * from messages where trim(text) <> '')"""
_QUEUE = f"""{_ANNOTATIONS}, {_SHADOW}, predictions as (select s.*, m.created_at from shadow s join messages m on m.id = s.message_id),
queue as (select message_id, max(created_at) last_shadow_at, case when count(distinct model_codes) = 1 then 0 else 1 end priority_group from predictions group by message_id having count(distinct model_version) = 2 and min(agrees) = 0)"""


def oracle_sql():
    codes = "array_to_string(codes, ',') codes"
    return {
        "annotation_decision": f"with {_ANNOTATIONS} select id, message_id, decision, {codes} from annotations",
        "latest_annotation": f"with {_ANNOTATIONS} select message_id, id, confidence, decision from latest",
        "annotation_summary": f"with {_ANNOTATIONS} select count(*) total, count(l.id) labelled, count(*) - count(l.id) remaining from valid v left join latest l on l.message_id = v.id",
        "annotation_items": f"with {_ANNOTATIONS} select v.id message_id, source_type, l.id annotation_id, decision, {codes} from valid v left join latest l on l.message_id = v.id order by v.id limit 50 offset 100",
        "unlabelled_items": f"with {_ANNOTATIONS} select v.id message_id, source_type from valid v where v.id not in (select message_id from annotations) order by v.id limit 500",
        "labelled_messages": f"with {_ANNOTATIONS} select message_id, source_type, confidence, decision, {codes} from latest join valid v on v.id = message_id",
        "training_summary": f"with {_ANNOTATIONS} select count(*) as valid, count(l.id) labelled, count(*) - count(l.id) unlabelled, count(*) filter (len(codes) > 0) positive, min(received_at) first_at, max(received_at) last_at, max(annotated_at) annotated_at from valid v left join latest l on l.message_id = v.id",
        "shadow_store": f"with {_QUEUE} select model_version, agrees, count(*) n from predictions p join messages m on m.id = p.message_id where not (model_version = 'v1' and m.source_type = 'news') group by 1, 2",
        "review_summary": f"with {_QUEUE} select count(*) total, count(l.id) reviewed, count(*) - count(l.id) pending from queue q left join latest l on l.message_id = q.message_id",
        "review_items": f"""with {_QUEUE}, page as (select * from queue where message_id not in (select message_id from annotations) order by priority_group, last_shadow_at desc, message_id desc limit 60),
 cand as (select message_id, count(distinct candidate_code) n from candidate_pairs group by message_id),
 g as (select p.message_id, any_value(last_shadow_at) last_shadow_at, any_value(priority_group) priority_group, string_agg(model_version || '=' || model_codes, ';' order by model_version) answers, string_agg(case when agrees = 0 then model_version end, ', ' order by model_version) apart from page p join shadow s on s.message_id = p.message_id group by p.message_id)
 select g.message_id, last_shadow_at, case priority_group when 0 then 100 else 90 end + case when n > 1 then 5 else 0 end priority, answers, case priority_group when 0 then 'models agree, rule differs' else 'models differ' end || coalesce('; rule differs from ' || apart, '') || case when n > 1 then '; several candidates' else '' end reasons from g join cand on cand.message_id = g.message_id""",
        "shadow_report": f"with {_QUEUE} select model_version, count(*) total, sum(agrees)::bigint agreeing, max(created_at) last_at from predictions group by model_version",
        "import_counters": f"with {_MATCHES}, n as (select * from messages where source_type = 'news'), f as (select source_key, min(id) id from n where trim(text) <> '' group by source_key) select (select count(*) from n) as rows, (select count(*) from n where coalesce(trim(text), '') = '') as empty, (select count(*) from n where trim(text) <> '') - (select count(*) from f) repeated, (select count(*) from f) inserted, (select count(*) from f where id in (select message_id from matches)) with_candidate",
        "sample_messages": "select id from messages where trim(text) <> '' order by sha256(id::varchar), id limit 200",
    }
