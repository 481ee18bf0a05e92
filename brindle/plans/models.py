"""Queries of features and models."""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle.operators import evaluate as E, features as X
from brindle.plans.mentions import _REG, registry
from brindle.session import checkpoint, table


def _pairs(spark, root):
    """One row per message and registered candidate with its texts, counts and registry lists."""
    p = table(spark, root, "candidate_pairs").groupBy("message_id", F.col("candidate_code").alias("code")).agg(F.max("label").alias("label"), F.min("split").alias("split"), F.min("source_type").alias("source_type"), F.min("message_text").alias("message_text"), F.min("candidate_profile").alias("profile"), F.max("real_candidate_count").alias("real_count"))
    r = registry(spark, root).withColumnRenamed("canonical_code", "code").dropDuplicates(["code"]).select("code", "ticker", "aliases", "brands", "negative_contexts")
    return p.where("message_text is not null").join(r, "code")


def structured_features(spark, root):
    return X.structured(_pairs(spark, root)).select("message_id", "code", *(F.col(n) for n in X.STRUCTURED))


def _docs(spark, root):
    return table(spark, root, "candidate_pairs").where("message_text is not null").groupBy(F.col("message_id").alias("id")).agg(F.min("message_text").alias("text"))


def word_ngrams(spark, root):
    g = _docs(spark, root).select("id", F.explode(F.array_distinct(X.word_grams(F.col("text")))).alias("gram"))
    return g.groupBy("gram").agg(F.count("*").alias("df")).where("df >= 2")


def char_ngrams(spark, root):
    g = _docs(spark, root).select("id", F.explode(F.array_distinct(X.char_grams(F.col("text")))).alias("gram"))
    return g.groupBy(F.length("gram").alias("size")).agg(F.countDistinct("gram").alias("grams"), F.count("*").alias("uses"))


def tfidf_word_weights(spark, root):
    w = X.gram_weights(_docs(spark, root), X.word_grams(F.col("text")))
    return w.groupBy("id").agg(F.count("*").alias("grams"), F.round(F.max("weight"), 6).alias("largest"), F.round(F.sum(F.col("weight") * F.col("weight")), 6).alias("squared"))


def _featured(spark, root):
    """Rows with their grams, which are made where they are read: a table of them would be many times the texts."""
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))  # else few rows are one task's
    return X.with_grams(checkpoint(X.structured(_pairs(spark, root).repartition(parts))))


def _quality(spark, root, kind):
    rows = _featured(spark, root)
    scored = checkpoint(X.score(X.fit(rows.where("split = 'train'"), kind), rows.where("split <> 'train'")).select("split", "label", "score"))
    t = E.picks(E.threshold_sweep(scored.where("split = 'val'"))).where("policy = 'f1'").first()["threshold"]
    return E.binary_metrics(scored, F.col("score") >= F.lit(t), "label", "split")


def train_lr(spark, root):
    return _quality(spark, root, "lr")


def train_ablation(spark, root):
    """Test metrics at 0.5 of the regression with and without structured features, balanced and not."""
    rows = _featured(spark, root)
    rows = X.with_counts(rows, X.counted(rows.where("split = 'train'")))  # once for all variants
    out = None
    for structured in (False, True):
        for weighted in (True, False):
            scored = X.score(X.fit(rows.where("split = 'train'"), "lr", weighted=weighted, with_structured=structured), rows.where("split = 'test'")).select("label", "score")
            name = f"{'tfidf_structured' if structured else 'tfidf'}/{'balanced' if weighted else 'unweighted'}"
            one = checkpoint(E.binary_metrics(scored, F.col("score") >= 0.5).withColumn("variant", F.lit(name)))
            out = one if out is None else out.unionByName(one)
    return out


def train_gbt(spark, root):
    return _quality(spark, root, "gbt")


def score_messages(spark, root):
    rows = _featured(spark, root)
    model = X.fit(rows.where("split = 'train'"), "gbt")
    return X.score(model, rows.where("split = 'test'")).select("message_id", "code", F.round("score", 6).alias("score"), (F.col("score") >= 0.64).cast("int").alias("predicted"))


def svd_features(spark, root):
    s = X.singular_values(_featured(spark, root))
    return spark.createDataFrame([(i, round(x, 6)) for i, x in enumerate(s)], "component int, singular_value double")


def queries():
    return {f.__name__: f for f in (structured_features, word_ngrams, char_ngrams, tfidf_word_weights, train_lr, train_ablation, train_gbt, score_messages, svd_features)}


_ESC = "regexp_replace({k}, '([!-/:-@\\[-`{{-~])', '\\\\\\1', 'g')"
_HAS = "case when regexp_matches({k}, '[一-鿿]') then contains(lower(t), lower({k})) else contains(lower(t), lower({k})) and regexp_matches(t, '(?i)(^|[^A-Za-z0-9])' || " + _ESC + " || '([^A-Za-z0-9]|$)') end"
_DOCS = "docs as (select message_id id, min(message_text) as text from candidate_pairs where message_text is not null group by 1)"
_GRAMS = _DOCS + ", w as (select id, regexp_extract_all(lower(text), '[A-Za-z0-9]+|[一-鿿]') w from docs), g as (select id, unnest(list_concat(w, list_transform(generate_series(1, length(w) - 1), lambda i: w[i] || ' ' || w[i + 1]))) gram from w)"


def oracle_sql():
    context = " or ".join(_HAS.format(k=f"'{k}'") for k in X.CONTEXT)
    alias = _HAS.format(k="k")
    return {
        "structured_features": f"""with {_REG}, p as (select message_id, candidate_code code, min(source_type) source_type, regexp_replace(min(message_text), 'https?://[^ \\t\\n\\r]+', ' ', 'g') t, max(real_candidate_count) n from candidate_pairs where message_text is not null group by 1, 2),
 r as (select canonical_code code, any_value(ticker) ticker, any_value(aliases) a, any_value(brands) b, any_value(negative_contexts) neg from registry group by 1),
 j as (select p.*, r.ticker, list_concat(a, b) terms, neg from p join r on r.code = p.code),
 h as (select message_id, code, count(*) hits, min(length(k)) shortest from (select message_id, code, t, unnest(terms) k from j) where {alias} group by 1, 2), v as (select message_id, code from (select message_id, code, t, unnest(neg) k from j) where {alias} group by 1, 2)
 select j.message_id, j.code, regexp_matches(t, '\\$' || ticker || '([^A-Za-z0-9]|$)')::int::double has_dollar_ticker, regexp_matches(t, case when length(ticker) > 1 then '(^|[^A-Za-z0-9])' else '(^|[^A-Za-z0-9])\\$' end || ticker || '([^A-Za-z0-9]|$)')::int::double has_bare_ticker,
 (h.hits is not null)::int::double has_alias, coalesce(shortest, 0)::double shortest_hit_len, coalesce(hits, 0)::double num_alias_hits, (v.code is not null)::int::double has_negative_context, ({context})::int::double context_present, length(ticker)::double ticker_len, length(terms)::double alias_count_total, length(t)::double message_len, (source_type = 'news')::int::double is_news, coalesce(n, 1)::double candidates_in_message
 from j left join h on h.message_id = j.message_id and h.code = j.code left join v on v.message_id = j.message_id and v.code = j.code""",
        "word_ngrams": f"with {_GRAMS} select gram, count(distinct id) df from g group by gram having count(distinct id) >= 2",
        "char_ngrams": f"with {_DOCS}, g as (select distinct id, n, substr(text, i, n) gram from (select id, text, n, unnest(generate_series(1, length(text) - n + 1)) i from docs, (values (2), (3), (4), (5)) k(n))) select n size, count(distinct gram) grams, count(*) uses from g group by n",
        "tfidf_word_weights": f"with {_GRAMS}, tf as (select id, gram, count(*) tf from g group by 1, 2), d as (select gram, count(*) df from tf group by 1 having count(*) >= 2), weighted as (select id, tf * (ln((1.0 + (select count(*) from docs)) / (1.0 + df)) + 1) w from tf join d on d.gram = tf.gram) select id, count(*) grams, round(max(w) / sqrt(sum(w * w)), 6) largest, round(sum(w * w) / sum(w * w), 6) squared from weighted group by id",
    }
