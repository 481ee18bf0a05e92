"""Queries of audit, dataset construction, evaluation and model comparison over candidate pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle.functions import text as T
from brindle.operators import dataset as D, evaluate as E, registry as R, store as S
from brindle.operators.timestamps import message_times
from brindle.plans.events import _WS, FORM
from brindle.plans.mentions import _MATCHES, matches, registry
from brindle.session import bounded, checkpoint, table


def _pairs(spark, root):
    """One row per message and code."""
    return table(spark, root, "candidate_pairs").groupBy("message_id", F.col("candidate_code").alias("code")).agg(F.max("label").alias("label"), F.min("split").alias("split"), F.min("source_type").alias("source_type"), F.min("message_text").alias("message_text"), F.max("real_candidate_count").alias("real_count"))


def _correct(spark, root):
    return _pairs(spark, root).where("label = 1").select("message_id", "code")


def _local(spark, root):
    """The codes that the matcher finds in each message; a table, as queries read it more than once."""
    return checkpoint(matches(spark, root).select("message_id", F.col("canonical_code").alias("code")))


def _registry(spark, root):
    return registry(spark, root).select(F.col("canonical_code").alias("code"), "company_name").distinct()


def _upstream(spark, root):
    """The companies of the merged registry that upstream rows name by ticker or full code, which event parsing trims and upper-cases."""
    r = registry(spark, root)
    known = R.ticker_codes(r).select(F.col("ticker").alias("typed"), F.col("canonical_code").alias("code")).union(r.select("canonical_code", "canonical_code")).distinct()
    u = table(spark, root, "upstream_candidates").select("message_id", F.upper(T.ustrip(F.col("stocker_code"))).alias("typed")).distinct()
    return u.join(bounded(checkpoint(known), 100_000), "typed").select("message_id", "code").distinct()


def upstream_code_join(spark, root):
    return _upstream(spark, root)


def unknown_codes(spark, root):
    return _pairs(spark, root).select("code").distinct().join(_registry(spark, root), "code", "left_anti")


def stale_codes(spark, root):
    return _correct(spark, root).join(_registry(spark, root), "code", "left_anti").groupBy("code").agg(F.count("*").alias("n"))


def company_coverage(spark, root):
    n = _correct(spark, root).groupBy("code").agg(F.count("*").alias("n"))
    return _registry(spark, root).join(n, "code", "left").select("code", F.coalesce("n", F.lit(0)).alias("n"))


def audit_distributions(spark, root):
    p = _pairs(spark, root)
    m = p.groupBy("message_id").agg(F.min("source_type").alias("source_type"), F.min("split").alias("split"), F.max("label").cast("string").alias("positive"))
    return m.groupingSets([["source_type"], ["split"], ["positive"]], "source_type", "split", "positive").agg(F.count("*").alias("n"))


def duplicate_text_groups(spark, root):
    g = table(spark, root, "messages").where("trim(text) <> ''").groupBy("text").agg(F.count("*").alias("n")).where("n > 1")
    return g.agg(F.count("*").alias("text_groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("messages"))


def candidate_recall(spark, root):
    mark = lambda df, c: df.withColumn(c, F.lit(True))
    j = _correct(spark, root).join(mark(_local(spark, root), "l"), ["message_id", "code"], "left").join(mark(_upstream(spark, root), "u"), ["message_id", "code"], "left")
    return j.agg(F.count("*").alias("pairs"), F.count("l").alias("local_hits"), F.count("u").alias("upstream_hits"), F.count(F.coalesce("l", "u")).alias("combined_hits"))


def missed_pairs(spark, root):
    return _correct(spark, root).join(_local(spark, root), ["message_id", "code"], "left_anti").join(_upstream(spark, root), ["message_id", "code"], "left_anti")


def false_positive_top(spark, root):
    fp = _local(spark, root).join(_correct(spark, root), ["message_id", "code"], "left_anti")
    return fp.groupBy("code").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "code").limit(30)


def false_positive_detail(spark, root):
    only = _upstream(spark, root).join(_correct(spark, root), ["message_id", "code"], "left_anti").join(_local(spark, root), ["message_id", "code"], "left_anti")
    return only.groupBy("code").agg(F.count("*").alias("n"))


def pair_counts_raw_dedup(spark, root):
    p = _pairs(spark, root)
    first = p.groupBy("message_text").agg(F.min("message_id").alias("message_id"))
    kept = p.join(first, ["message_text", "message_id"], "left_semi")
    n = lambda df, k: df.agg(F.lit(k).alias("counted"), F.count("*").alias("pairs"), F.sum("label").alias("positives"))
    return n(p, "raw").union(n(kept, "deduplicated"))


def set_relations(spark, root):
    """How each message's local and correct code sets relate."""
    a, b = (df.groupBy("message_id").agg(F.array_sort(F.collect_set("code")).alias(c)) for df, c in ((_local(spark, root), "l"), (_correct(spark, root), "c")))
    none = F.array().cast("array<string>")
    j = a.join(b, "message_id", "full_outer").select("message_id", F.coalesce("l", none).alias("l"), F.coalesce("c", none).alias("c"))
    return j.select("message_id", (F.col("l") == F.col("c")).cast("int").alias("equal"), (F.size(F.array_except("c", "l")) == 0).cast("int").alias("covered"), F.arrays_overlap("l", "c").cast("int").alias("overlap"), F.size(F.array_union("l", "c")).alias("union_size"))


def pair_labels(spark, root):
    return D.pair_labels(_correct(spark, root), _local(spark, root), _upstream(spark, root))


def real_candidate_count(spark, root):
    local, upstream = _local(spark, root), _upstream(spark, root)
    both = local.union(upstream).distinct().groupBy("message_id").agg(F.count("*").alias("serving"))
    allc = D.pair_labels(_correct(spark, root), local, upstream).groupBy("message_id").agg(F.count("*").alias("training"))
    return allc.join(both, "message_id", "left").select("message_id", "training", F.coalesce("serving", F.lit(0)).alias("serving"))


def random_topup(spark, root):
    from pyspark.sql import Window as W

    codes = _registry(spark, root).select("code").withColumn("ord", (F.row_number().over(W.orderBy("code")) - 1).cast("long"))
    return D.top_up(pair_labels(spark, root), codes).groupBy("message_id").agg(F.count("*").alias("added"))


def background_negatives(spark, root):
    """100 messages without any candidate, in a fixed pseudo-random order, each with one code of the registry."""
    from pyspark.sql import Window as W

    free = table(spark, root, "messages").where("trim(text) <> ''").select(F.col("id").alias("message_id")).join(_pairs(spark, root), "message_id", "left_anti").orderBy(F.pmod(F.col("message_id") * 7919, F.lit(10007)), "message_id").limit(100)
    reg = _registry(spark, root).select("code")
    codes = reg.withColumn("ord", (F.row_number().over(W.orderBy("code")) - 1).cast("long"))
    n = reg.count()
    return free.withColumn("ord", F.pmod(F.col("message_id") * 31, F.lit(n))).join(F.broadcast(codes), "ord").select("message_id", "code")


def pair_summary(spark, root):
    return _pairs(spark, root).groupBy("label").pivot("split", ["train", "val", "test"]).agg(F.count(F.lit(1))).na.fill(0)


def _units(spark, root):
    """Clusters of messages of one text, with their time and number of pairs."""
    p = _pairs(spark, root)
    m = p.groupBy("message_id").agg(F.min("message_text").alias("t"), F.count("*").alias("pairs"))
    at = table(spark, root, "messages").select(F.col("id").alias("message_id"), "created_at")
    return m.join(at, "message_id").groupBy("t").agg(F.min("message_id").alias("cluster"), F.sum("pairs").alias("pairs"), F.max("created_at").alias("at"))


def time_split(spark, root):
    return S.running_split(_units(spark, root).drop("t"), "pairs", ["at", "cluster"], [("train", 0.70), ("val", 0.85)], "test").select("cluster", "split")


def frozen_split(spark, root):
    """As time_split, with the clusters that hold a frozen test message as test and the rest split at 70 to 15."""
    u = _units(spark, root)
    frozen = _pairs(spark, root).where("split = 'test'").select(F.col("message_text").alias("t")).distinct()
    rest = S.running_split(u.join(frozen, "t", "left_anti").drop("t"), "pairs", ["at", "cluster"], [("train", 0.70 / 0.85)], "val").select("cluster", "split")
    return rest.union(u.join(frozen, "t", "left_semi").select("cluster", F.lit("test")))


def _forms(spark, root):
    return table(spark, root, "messages").where("text is not null").select("id", T.dedup_form(F.col("text")).alias("form"))


def rare_word_pairs(spark, root):
    return D.rare_word_pairs(_forms(spark, root), "id", "form")


def _with_codes(spark, root):
    c = _correct(spark, root).groupBy(F.col("message_id").alias("id")).agg(F.collect_set("code").alias("codes"))
    return table(spark, root, "messages").where("trim(text) <> ''").select("id", "text").join(c, "id", "left").withColumn("codes", F.coalesce("codes", F.array().cast("array<string>")))


def near_dup_edges(spark, root):
    t = _with_codes(spark, root).select("id", T.dedup_form(F.col("text")).alias("form"), "codes")
    return D.ratio_edges(D.rare_word_pairs(t, "id", "form"), t, "id", "form", "codes")


def exact_dup_clusters(spark, root):
    f = _forms(spark, root)
    return f.join(f.groupBy("form").agg(F.min("id").alias("cluster")), "form").select("id", "cluster")


def near_dup_clusters(spark, root):
    return D.clusters(_with_codes(spark, root), "id", "text", "codes")


def _clusters(spark, root):
    """Clusters of near-duplicate messages with their latest message time and number of pairs, and the cluster of each message."""
    c = checkpoint(near_dup_clusters(spark, root))
    t = message_times(table(spark, root, "messages")).groupBy("message_id").agg(F.max(F.when(F.col("field") == "published_at", F.col("utc_time"))).alias("p"), F.max(F.when(F.col("field") == "received_at", F.col("utc_time"))).alias("r"))
    m = _pairs(spark, root).groupBy(F.col("message_id").alias("id")).agg(F.count("*").alias("pairs"), F.max((F.col("split") == "test").cast("int")).alias("frozen"))
    each = c.join(m, "id").join(t.select(F.col("message_id").alias("id"), F.coalesce("p", "r", F.lit("")).alias("at")), "id", "left")
    return each.groupBy("cluster").agg(F.sum("pairs").alias("pairs"), F.max(F.coalesce("at", F.lit(""))).alias("at"), F.max("frozen").alias("frozen")), c.join(m, "id", "left_semi")


def leak_free_split(spark, root):
    """time_split over clusters of near-duplicates: none has messages in two splits."""
    u, members = _clusters(spark, root)
    split = S.running_split(u.drop("frozen"), "pairs", ["at", "cluster"], [("train", 0.70), ("val", 0.85)], "test").select("cluster", "split")
    return members.join(split, "cluster").select(F.col("id").alias("message_id"), "cluster", "split")


def leak_free_frozen_split(spark, root):
    """frozen_split over clusters of near-duplicates: a cluster with a frozen test message is test as a whole."""
    u, members = _clusters(spark, root)
    u = checkpoint(u)
    rest = S.running_split(u.where("frozen = 0").drop("frozen"), "pairs", ["at", "cluster"], [("train", 0.70 / 0.85)], "val").select("cluster", "split")
    split = rest.union(u.where("frozen = 1").select("cluster", F.lit("test")))
    return members.join(split, "cluster").select(F.col("id").alias("message_id"), "cluster", "split")


def _scored(spark, root):
    """Pairs with the score of a model fitted on the training split: the smoothed rate of correct pairs by company and by
    whether the message has its ticker, or by the latter alone for a company without training pairs."""
    named = F.coalesce(F.contains("message_text", F.substring_index("code", ":", -1)), F.lit(False))
    p = checkpoint(_pairs(spark, root).withColumn("named", named))
    rate = ((F.sum("label") + 1).cast("double") / (F.count("*") + 2).cast("double")).alias
    train = p.where("split = 'train'")
    by_code = train.groupBy("code", "named").agg(rate("_a"))
    by_name = train.groupBy("named").agg(rate("_b"))
    joined = p.join(bounded(by_code, 100_000), ["code", "named"], "left").join(F.broadcast(by_name), "named", "left")  # two rows
    return joined.withColumn("score", F.coalesce("_a", "_b", F.lit(0.5))).drop("_a", "_b", "named")


def binary_metrics(spark, root):
    return E.binary_metrics(_scored(spark, root), F.col("score") >= 0.5, "label", "split")


def threshold_sweep(spark, root):
    return E.threshold_sweep(_scored(spark, root).where("split = 'val'"))


def threshold_pick(spark, root):
    return E.picks(E.threshold_sweep(_scored(spark, root).where("split = 'val'")))


def variant_pick(spark, root):
    """The better of two variants by its best f1 on the validation split."""
    s = _scored(spark, root).where("split = 'val'")
    best = None
    for name, score in (("plain", F.col("score")), ("flat", F.round("score", 1))):
        one = E.picks(E.threshold_sweep(s.withColumn("score", score))).where("policy = 'f1'").select(F.lit(name).alias("variant"), "threshold", "value")
        best = one if best is None else best.union(one)
    return best.orderBy(F.desc("value"), "variant").limit(1)


def frozen_test_eval(spark, root):
    """Thresholds chosen on the validation split, applied to the test split."""
    s = _scored(spark, root)
    chosen = E.picks(E.threshold_sweep(s.where("split = 'val'"))).where("threshold is not null").collect()  # at most four policies
    each = F.array(*(F.struct(F.lit(r["policy"]).alias("policy"), F.lit(r["threshold"]).alias("threshold")) for r in chosen))
    tried = s.where("split = 'test'").select("*", F.explode(each).alias("t")).select("label", "score", "t.policy", "t.threshold")
    return E.binary_metrics(tried, F.col("score") >= F.col("threshold"), "label", "policy")


def rule_baseline(spark, root):
    rule = _local(spark, root).withColumn("hit", F.lit(True))
    return E.binary_metrics(_pairs(spark, root).join(rule, ["message_id", "code"], "left"), F.coalesce("hit", F.lit(False)), "label", "split")


def message_metrics(spark, root):
    return E.message_metrics(_scored(spark, root), F.col("score") >= 0.5)


def latency_percentiles(spark, root):
    e = table(spark, root, "events").where("value is not null").groupBy((F.col("user_id") % 3).alias("bucket"))
    return e.agg(F.count("*").alias("n"), *(F.round(F.percentile("value", q), 6).alias(f"p{round(q * 100)}") for q in (0.5, 0.95, 0.99)))


def _shadow(spark, root):
    """Predictions of two model versions with the labelled codes and their agreement: v1 keeps the codes whose ticker the
    message has; v2, which only saw news, those whose name it has."""
    p = table(spark, root, "candidate_pairs").where("message_text is not null").select("message_id", "source_type", "message_text", F.col("candidate_code").alias("code"), "label", F.lower(F.substring_index("candidate_profile", " | ", 1)).alias("name"))
    kept = {"v1": F.contains("message_text", F.substring_index("code", ":", -1)), "v2": F.contains(F.lower("message_text"), F.col("name"))}
    codes = lambda c: F.array_join(F.array_sort(F.collect_set(F.when(c, F.col("code")))), ",")
    parts = [(p if v == "v1" else p.where("source_type = 'news'")).groupBy("message_id").agg(F.lit(v).alias("model_version"), codes(k).alias("model_codes"), codes(F.col("label") == 1).alias("rule_codes")) for v, k in kept.items()]
    return parts[0].union(parts[1]).withColumn("agrees", (F.col("model_codes") == F.col("rule_codes")).cast("int"))


def shadow_agreement(spark, root):
    return _shadow(spark, root).select("message_id", "model_version", "agrees")


def shadow_summary(spark, root):
    return _shadow(spark, root).groupBy("model_version").agg(F.count("*").alias("total"), F.sum("agrees").alias("agreeing"), F.count_if(F.col("agrees") == 0).alias("disagreeing"))


def shadow_disagreements(spark, root):
    return _shadow(spark, root).where("agrees = 0").join(table(spark, root, "messages").select(F.col("id").alias("message_id"), "source_type"), "message_id").orderBy(F.desc("message_id"), "model_version").limit(50)


def review_eligible(spark, root):
    g = _shadow(spark, root).groupBy("message_id").agg(F.countDistinct("model_version").alias("versions"), F.min("agrees").alias("agrees"), F.countDistinct("model_codes").alias("answers"))
    return g.where("versions = 2 and agrees = 0").select("message_id", F.when(F.col("answers") == 1, 0).otherwise(1).alias("priority_group"))


def review_queue(spark, root):
    """The first 40 eligible messages that no annotator was sure of, limited before the fan-out join."""
    sure = table(spark, root, "candidate_pairs").where("annotation_confidence = 'high'").select("message_id")
    top = review_eligible(spark, root).join(sure, "message_id", "left_anti").orderBy("priority_group", F.desc("message_id")).limit(40)
    return top.join(_shadow(spark, root), "message_id").select("message_id", "priority_group", "model_version", "model_codes")


def queries():
    names = (upstream_code_join, unknown_codes, stale_codes, company_coverage, audit_distributions, duplicate_text_groups, candidate_recall, missed_pairs, false_positive_top, false_positive_detail, pair_counts_raw_dedup, set_relations, pair_labels, real_candidate_count, random_topup, background_negatives, pair_summary, time_split, frozen_split, rare_word_pairs, near_dup_edges, exact_dup_clusters, near_dup_clusters, leak_free_split, leak_free_frozen_split, binary_metrics, threshold_sweep, threshold_pick, variant_pick, frozen_test_eval, rule_baseline, message_metrics, latency_percentiles, shadow_agreement, shadow_summary, shadow_disagreements, review_eligible, review_queue)
    return {f.__name__: f for f in names}


_P = "pairs as (select message_id, candidate_code code, max(label) label, min(split) split, min(source_type) source_type, min(message_text) message_text, max(real_candidate_count) real_count from candidate_pairs group by message_id, candidate_code)"
_SETS = f"""{_MATCHES}, {_P}, correct as (select message_id, code from pairs where label = 1), loc as materialized (select message_id, canonical_code code from matches),
reg as (select distinct canonical_code code, company_name from registry), typed as (select max_by(canonical_code, place) code, ticker sign from registry group by ticker union select canonical_code, canonical_code from registry),
up as materialized (select distinct u.message_id, t.code from upstream_candidates u join typed t on t.sign = upper(trim(u.stocker_code, {_WS})))"""
_LABELS = f"{_SETS}, tagged as (select message_id, code, 0 p from correct union all select message_id, code, 1 from loc union all select message_id, code, 2 from up), labelled as (select message_id, code, (min(p) = 0)::int label, case min(p) when 1 then 'hard_rule' when 2 then 'hard_upstream' else '' end negative_type from tagged group by message_id, code)"
_UNITS = f"{_P}, m as (select message_id, min(message_text) t, count(*) pairs from pairs group by message_id), units as (select t, min(m.message_id) \"cluster\", sum(m.pairs) pairs, max(x.created_at) at_ from m join messages x on x.id = m.message_id group by t)"
_SCORED = f"""{_P}, named as (select *, coalesce(contains(message_text, split_part(code, ':', -1)), false) named from pairs),
by_code as (select code, named, (sum(label) + 1)::double / (count(*) + 2)::double rate from named where split = 'train' group by 1, 2), by_name as (select named, (sum(label) + 1)::double / (count(*) + 2)::double rate from named where split = 'train' group by 1),
scored as (select p.* exclude (named), coalesce(c.rate, n.rate, 0.5::double) score from named p left join by_code c on c.code = p.code and c.named = p.named left join by_name n on n.named = p.named)"""
_RATES = "coalesce(tp / nullif(tp + fp, 0)::double, 0) as precision, coalesce(tp / nullif(tp + fn, 0)::double, 0) recall, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::double, 0) f1"
_COUNTS = "count(*) filter ({p} and label = 1) tp, count(*) filter ({p} and label <> 1) fp, count(*) filter (not ({p}) and label = 1) fn, count(*) filter (not ({p}) and label <> 1) tn"
_SWEEP = "val as (select {s} score, label from scored where split = 'val'), grid as (select distinct score threshold from val union select 0.0 union select 1.0), sw as (select threshold, count(*) filter (score >= threshold and label = 1) tp, count(*) filter (score >= threshold and label <> 1) fp, count(*) filter (score < threshold and label = 1) fn from grid, val group by threshold), sweep as (select threshold::double threshold, tp, fp, fn, " + _RATES + " from sw)"
_PICKS = "picks as (select 'f1' policy, max_by(threshold, (f1, -threshold)) threshold, max(f1) \"value\" from sweep union all select 'precision_at_recall', max_by(threshold, (\"precision\", -threshold)), max(\"precision\") from sweep where recall >= 0.95 union all select 'recall_at_precision', max_by(threshold, (recall, -threshold)), max(recall) from sweep where \"precision\" >= 0.98 union all select 'f1_at_both', max_by(threshold, (f1, -threshold)), max(f1) from sweep where recall >= 0.95 and \"precision\" >= 0.98)"
_FORMS = f"forms as (select id, {FORM} form from messages where text is not null)"
_SHADOW = """sp as (select message_id, source_type, message_text, candidate_code code, label, lower(split_part(candidate_profile, ' | ', 1)) name from candidate_pairs where message_text is not null),
both_ as (select 'v1' model_version, *, contains(message_text, split_part(code, ':', -1)) keep from sp union all select 'v2', *, contains(lower(message_text), name) from sp where source_type = 'news'),
sh as (select message_id, model_version, coalesce(string_agg(distinct case when keep then code end, ',' order by case when keep then code end), '') model_codes, coalesce(string_agg(distinct case when label = 1 then code end, ',' order by case when label = 1 then code end), '') rule_codes from both_ group by message_id, model_version),
shadow as (select *, (model_codes = rule_codes)::int agrees from sh)"""
_ELIGIBLE = f"{_SHADOW}, eligible as (select message_id, case when count(distinct model_codes) = 1 then 0 else 1 end priority_group from shadow group by message_id having count(distinct model_version) = 2 and min(agrees) = 0)"


def oracle_sql():
    both = "(select message_id, code from loc union select message_id, code from up)"
    return {
        "upstream_code_join": f"with {_SETS} select message_id, code from up",
        "unknown_codes": f"with {_SETS} select distinct code from pairs where code not in (select code from reg)",
        "stale_codes": f"with {_SETS} select code, count(*) n from correct where code not in (select code from reg) group by code",
        "company_coverage": f"with {_SETS} select reg.code, count(correct.code) n from reg left join correct on correct.code = reg.code group by reg.code",
        "audit_distributions": f"with {_P}, m as (select message_id, min(source_type) source_type, min(split) split, max(label)::varchar positive from pairs group by message_id) select source_type, split, positive, count(*) n from m group by grouping sets ((source_type), (split), (positive))",
        "duplicate_text_groups": "select count(*) text_groups, coalesce(sum(n), 0)::bigint messages from (select count(*) n from messages where trim(text) <> '' group by text having count(*) > 1)",
        "candidate_recall": f"with {_SETS} select count(*) pairs, count(l.code) local_hits, count(u.code) upstream_hits, count(coalesce(l.code, u.code)) combined_hits from correct c left join loc l on l.message_id = c.message_id and l.code = c.code left join up u on u.message_id = c.message_id and u.code = c.code",
        "missed_pairs": f"with {_SETS} select message_id, code from correct except select message_id, code from {both}",
        "false_positive_top": f"with {_SETS} select code, count(*) n from (select message_id, code from loc except select message_id, code from correct) group by code order by n desc, code limit 30",
        "false_positive_detail": f"with {_SETS} select code, count(*) n from (select message_id, code from up except select message_id, code from correct except select message_id, code from loc) group by code",
        "pair_counts_raw_dedup": f"with {_P} select 'raw' counted, count(*) pairs, sum(label)::bigint positives from pairs union all select 'deduplicated', count(*), sum(label)::bigint from pairs p where message_id = (select min(message_id) from pairs q where q.message_text = p.message_text)",
        "set_relations": f"""with {_SETS}, l as (select message_id, list_sort(list(distinct code)) l from loc group by message_id), c as (select message_id, list_sort(list(distinct code)) c from correct group by message_id), j as (select coalesce(l.message_id, c.message_id) message_id, coalesce(l, []) l, coalesce(c, []) c from l full outer join c on l.message_id = c.message_id)
 select message_id, (l = c)::int equal, list_has_all(l, c)::int covered, list_has_any(l, c)::int overlap, length(list_distinct(list_concat(l, c)))::int union_size from j""",
        "pair_labels": f"with {_LABELS} select message_id, code, label, negative_type from labelled",
        "real_candidate_count": f"with {_LABELS}, s as (select message_id, count(*) serving from {both} group by message_id), t as (select message_id, count(*) training from labelled group by message_id) select t.message_id, training, coalesce(serving, 0) serving from t left join s on s.message_id = t.message_id",
        "random_topup": f"with {_LABELS} select message_id, 3 - count(*) filter (label = 0) added from labelled group by message_id having max(label) = 1 and count(*) filter (label = 0) < 3",
        "background_negatives": f"with {_SETS}, free as (select id message_id from messages where trim(text) <> '' and id not in (select message_id from pairs) order by (id * 7919) % 10007, id limit 100), codes as (select code, row_number() over (order by code) - 1 ord from (select distinct code from reg)) select message_id, code from free join codes on ord = (message_id * 31) % (select count(*) from reg)",
        "pair_summary": f"with {_P} select label, count(*) filter (split = 'train') train, count(*) filter (split = 'val') val, count(*) filter (split = 'test') test from pairs group by label",
        "time_split": f"with {_UNITS}, r as (select *, sum(pairs) over (order by at_, \"cluster\" rows unbounded preceding) / (select sum(pairs) from units)::double share from units) select \"cluster\", case when share <= 0.70 then 'train' when share <= 0.85 then 'val' else 'test' end split from r",
        "frozen_split": f"with {_UNITS}, f as (select distinct message_text t from pairs where split = 'test'), k as (select * from units where t not in (select t from f)), r as (select *, sum(pairs) over (order by at_, \"cluster\" rows unbounded preceding) / (select sum(pairs) from k)::double share from k) select \"cluster\", case when share <= 0.70 / 0.85 then 'train' else 'val' end split from r union all select \"cluster\", 'test' from units where t in (select t from f)",
        "rare_word_pairs": f"with {_FORMS}, each as (select distinct id, unnest(string_split(form, ' ')) word from forms), kept as (select * from each where length(word) >= 3 and word in (select word from each where length(word) >= 3 group by word having count(*) between 2 and 15)) select x.id a, y.id b, count(*) shared from kept x join kept y on x.word = y.word and x.id < y.id group by 1, 2 having count(*) >= 3",
        "exact_dup_clusters": f"with {_FORMS} select id, min(id) over (partition by form) \"cluster\" from forms",
        "binary_metrics": f"with {_SCORED}, c as (select split, {_COUNTS.format(p='score >= 0.5')} from scored group by split) select *, {_RATES} from c",
        "threshold_sweep": f"with {_SCORED}, {_SWEEP.format(s='score')} select * from sweep",
        "threshold_pick": f"with {_SCORED}, {_SWEEP.format(s='score')}, {_PICKS} select * from picks",
        "variant_pick": f"with {_SCORED}, {_SWEEP.format(s='score')}, flat as (with {_SWEEP.format(s='round(score, 1)')} select * from sweep) select * from (select 'plain' variant, max_by(threshold, (f1, -threshold)) threshold, max(f1) \"value\" from sweep union all select 'flat', max_by(threshold, (f1, -threshold)), max(f1) from flat) order by \"value\" desc, variant limit 1",
        "frozen_test_eval": f"with {_SCORED}, {_SWEEP.format(s='score')}, {_PICKS}, c as (select policy, {_COUNTS.format(p='score >= threshold')} from scored, picks where split = 'test' and threshold is not null group by policy) select *, {_RATES} from c",
        "rule_baseline": f"with {_SETS}, c as (select split, {_COUNTS.format(p='hit')} from (select p.*, l.code is not null hit from pairs p left join loc l on l.message_id = p.message_id and l.code = p.code) group by split) select *, {_RATES} from c",
        "message_metrics": f"with {_SCORED}, m as (select message_id, bool_and((score >= 0.5) = (label = 1)) exact, bool_or(label = 1 and score < 0.5) missed, bool_or(score >= 0.5) any_p, count(*) filter (label = 1) n from scored group by message_id) select count(*) filter (exact) / count(*)::double exact_rate, count(*) filter (exact and n > 1) / nullif(count(*) filter (n > 1), 0)::double multi_exact_rate, count(*) filter (missed and n > 0) / nullif(count(*) filter (n > 0), 0)::double missed_rate, count(*) filter (any_p and n = 0) / nullif(count(*) filter (n = 0), 0)::double false_alarm_rate from m",
        "latency_percentiles": "select user_id % 3 bucket, count(*) n, round(quantile_cont(value, 0.5), 6) p50, round(quantile_cont(value, 0.95), 6) p95, round(quantile_cont(value, 0.99), 6) p99 from events where value is not null group by 1",
        "shadow_agreement": f"with {_SHADOW} select message_id, model_version, agrees from shadow",
        "shadow_summary": f"with {_SHADOW} select model_version, count(*) total, sum(agrees)::bigint agreeing, count(*) filter (agrees = 0) disagreeing from shadow group by model_version",
        "shadow_disagreements": f"with {_SHADOW} select s.message_id, model_version, model_codes, rule_codes, agrees, m.source_type from shadow s join messages m on m.id = s.message_id where agrees = 0 order by s.message_id desc, model_version limit 50",
        "review_eligible": f"with {_ELIGIBLE} select message_id, priority_group from eligible",
        "review_queue": f"with {_ELIGIBLE}, top as (select * from eligible where message_id not in (select message_id from candidate_pairs where annotation_confidence = 'high') order by priority_group, message_id desc limit 40) select t.message_id, priority_group, model_version, model_codes from top t join shadow s on s.message_id = t.message_id",
    }
