"""Features and classifiers of (message, candidate company) pairs on MLlib."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.common import _py2java
from pyspark.ml.feature import IDF, CountVectorizerModel, ElementwiseProduct, Normalizer, PCAModel, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, functions as F

from brindle.functions.text import contains_keyword, latin_pattern, without_urls
from brindle.operators.boosting import GBTClassifier
from brindle.operators.decompose import components as components_of, vocabularies
from brindle.session import checkpoint

# Words that show a business context; names of the structured features.
CONTEXT = ("stock", "share", "shares", "company", "earnings", "revenue", "CEO", "IPO", "股票", "公司", "财报", "营收", "股价", "收购", "上市", "季度")
STRUCTURED = ("has_dollar_ticker", "has_bare_ticker", "has_alias", "shortest_hit_len", "num_alias_hits", "has_negative_context", "context_present", "ticker_len", "alias_count_total", "message_len", "is_news", "candidates_in_message")
TOKEN = "([A-Za-z0-9]+|[一-鿿])"


def structured(pairs: DataFrame) -> DataFrame:
    """Adds the structured features to rows with message_text, source_type, real_count, ticker, aliases, brands, negative_contexts."""
    t = without_urls(F.coalesce(F.col("message_text"), F.lit("")))
    terms = F.concat("aliases", "brands")
    hits = F.filter(terms, lambda k: contains_keyword(t, k))
    ticker = F.col("ticker")
    dollar = F.rlike(t, F.concat(F.lit(r"\$\Q"), ticker, F.lit(r"\E(?![A-Za-z0-9])")))
    single = F.rlike(t, F.concat(F.lit(r"(?<![A-Za-z0-9])\$\Q"), ticker, F.lit(r"\E(?![A-Za-z0-9])")))
    bare = F.when(F.length(ticker) > 1, F.rlike(t, latin_pattern(ticker, False))).otherwise(single)
    context = F.exists(F.array(*map(F.lit, CONTEXT)), lambda k: contains_keyword(t, k))
    with_hits = pairs.withColumn("_hits", hits)
    h = F.col("_hits")
    values = [dollar, bare, F.size(h) > 0, F.coalesce(F.array_min(F.transform(h, F.length)), F.lit(0)), F.size(h), F.exists("negative_contexts", lambda k: contains_keyword(t, k)), context, F.length(ticker), F.size(terms), F.length(t), F.col("source_type") == "news", F.coalesce(F.col("real_count"), F.lit(1))]
    return with_hits.withColumns({n: v.cast("double") for n, v in zip(STRUCTURED, values)}).drop("_hits")


def word_grams(text: Column) -> Column:
    """Words and pairs of neighbouring words, lower case; an ideograph is a word."""
    w = F.regexp_extract_all(F.lower(text), F.lit(TOKEN), 1)
    zipped = F.arrays_zip(w.alias("a"), F.slice(w, F.lit(2), F.greatest(F.size(w), F.lit(1))).alias("b"))  # no outer column inside the lambdas
    return F.concat(w, F.transform(F.filter(zipped, lambda x: x["b"].isNotNull()), lambda x: F.concat_ws(" ", x["a"], x["b"])))


def char_grams(text: Column, low: int = 2, high: int = 5) -> Column:
    """Substrings of `low` to `high` characters, case kept."""
    signs = F.split(text, "")
    names = "abcdefghijklmnop"[:high]
    zipped = F.arrays_zip(*(F.slice(signs, F.lit(i + 1), F.greatest(F.length(text), F.lit(1))).alias(c) for i, c in enumerate(names)))

    def of(k: int) -> Column:
        return F.transform(F.filter(zipped, lambda x: x[names[k - 1]].isNotNull()), lambda x: F.concat(*(x[c] for c in names[:k])))

    return F.concat(*(of(k) for k in range(low, high + 1)))


def gram_weights(docs: DataFrame, grams: Column, min_df: int = 2) -> DataFrame:
    """(id, gram, weight): tf times smooth idf ln((1 + n) / (1 + df)) + 1, each document of length 1."""
    each = docs.select("id", F.explode(grams).alias("gram")).groupBy("id", "gram").agg(F.count("*").alias("tf"))
    n = docs.count()  # of the documents alone: their grams aren't computed for it
    df = each.groupBy("gram").agg(F.count("*").alias("df")).where(F.col("df") >= min_df)
    w = each.join(df, "gram").select("id", "gram", (F.col("tf") * (F.log(F.lit(1.0 + n) / (1.0 + F.col("df"))) + 1)).alias("w"))
    norm = w.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return w.join(norm, "id").select("id", "gram", (F.col("w") / F.col("norm")).alias("weight"))


def _text() -> Column:
    return F.concat_ws(" \n[CANDIDATE]\n ", F.col("message_text"), F.col("profile"))


def with_grams(pairs: DataFrame) -> DataFrame:
    """Adds `words` and `characters`, the grams of word_grams and char_grams; overlapping matches are many times faster than lambdas."""
    text = _text()
    characters = F.concat(*(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}})).")) for n in range(2, 6)))
    return pairs.withColumn("words", word_grams(text)).withColumn("characters", characters)


def counted(pairs: DataFrame, vocabulary: int = 20_000) -> PipelineModel:
    """Stages that give words_tf and characters_tf, the counts of the most frequent grams."""
    return PipelineModel(_vectors(pairs, vocabulary)[::3])


def with_counts(pairs: DataFrame, counts: PipelineModel) -> DataFrame:
    """`pairs` with their counts instead of their grams, kept as a table: many times smaller than the grams, which are made once for it."""
    return checkpoint(counts.transform(pairs).drop("words", "characters"))


def _weighted(block: str, idf: np.ndarray) -> list:
    return [ElementwiseProduct(scalingVec=Vectors.dense(idf), inputCol=f"{block}_tf", outputCol=f"{block}_idf"), Normalizer(inputCol=f"{block}_idf", outputCol=f"{block}_v")]


def _vectors(rows: DataFrame, vocabulary: int | None = None) -> list:
    """Stages that give words_v and characters_v: tf times smooth idf ln((1 + n) / (1 + df)) + 1, each of length 1. `rows` have counts
    or, with the size of a vocabulary, texts; then the stages begin with the counts of the block."""
    blocks = ("words", "characters")
    if vocabulary is None:
        return [s for c in blocks for s in _weighted(c, IDF(inputCol=f"{c}_tf", outputCol=f"{c}_idf").fit(rows).idf.toArray() + 1)]  # Spark's IDF goes without the 1
    found, n = vocabularies(rows.select(_text()), vocabulary)
    stages = []
    for c, (grams, df) in zip(blocks, found):
        stages += [CountVectorizerModel.from_vocabulary(grams, inputCol=c, outputCol=f"{c}_tf"), *_weighted(c, np.log((1 + n) / (1 + np.array(df))) + 1)]
    return stages


def balanced(pairs: DataFrame) -> DataFrame:
    """Adds `weight`: rows of a label weigh as much in all as those of the other."""
    n = pairs.agg(F.count("*").alias("n"), F.sum("label").alias("p")).first()
    p = n["p"] or 0
    return pairs.withColumn("weight", F.when(F.col("label") == 1, n["n"] / (2 * max(p, 1))).otherwise(n["n"] / (2 * max(n["n"] - p, 1))).cast("double"))


def _svd(rows: DataFrame, k: int, vocabulary: int) -> tuple[list, DataFrame]:
    """Stages that give `grams_v`, the word and character TF-IDF of rows with texts, and its leading components without centring.
    No table of grams, counts or vectors is kept."""
    stages = _vectors(rows, vocabulary)
    found = components_of(rows.select(_text()), [stages[i].vocabulary for i in (0, 3)], [stages[i].getScalingVec().toArray() for i in (1, 4)], k)
    return [*stages, VectorAssembler(inputCols=["words_v", "characters_v"], outputCol="grams_v")], found


def _projection(found: DataFrame) -> PCAModel:
    """A stage that gives `svd`, the product of `grams_v` with the components' vectors, which stay in the JVM; only PCA's fit would centre."""
    sc = found.sparkSession.sparkContext
    rows = sorted(found.select("component", "value", array_to_vector("vector"))._jdf.collectAsList(), key=lambda r: r.getInt(0))
    k, m = len(rows), rows[0].get(2).size()
    array = sc._gateway.new_array(sc._jvm.double, m * k)
    for i, r in enumerate(rows):
        sc._jvm.System.arraycopy(r.get(2).values(), 0, array, i * m, m)
    ml = sc._jvm.org.apache.spark.ml
    made = ml.feature.PCAModel(f"svd_{uuid.uuid4().hex[:12]}", ml.linalg.DenseMatrix(m, k, array), _py2java(sc, Vectors.dense([r.getDouble(1) for r in rows])))
    made.set(made.k().w(k))
    return PCAModel(made).setInputCol("grams_v").setOutputCol("svd")


def fit(pairs: DataFrame, kind: str = "lr", vocabulary: int = 20_000, trees: int = 300, components: int = 100, weighted: bool = True, with_structured: bool = True) -> PipelineModel:
    """TF-IDF and structured features under a logistic regression ("lr", balanced unless `weighted` is off), or boosted trees of up
    to 32 leaves on the SVD of the TF-IDF and the structured features ("gbt"). `pairs` have texts and grams, or for "lr" counts if
    already made; so do the rows that the model scores."""
    if kind == "gbt":
        stages, found = _svd(pairs, components, vocabulary)
        stages += [_projection(found), VectorAssembler(inputCols=["svd", *STRUCTURED], outputCol="features")]
        counts, rows = None, pairs
        trainer = GBTClassifier(labelCol="label", weightCol="weight", maxIter=trees, maxDepth=5, stepSize=0.05)
    else:
        counts = None if "words_tf" in pairs.columns else counted(pairs, vocabulary)
        rows = pairs if counts is None else with_counts(pairs.select("label", "words", "characters", *STRUCTURED), counts)
        stages = [*_vectors(rows), VectorAssembler(inputCols=["words_v", "characters_v", *(STRUCTURED if with_structured else ())], outputCol="features")]
        trainer = LogisticRegression(labelCol="label", weightCol="weight", regParam=1e-3, maxIter=60)
    rows = balanced(rows) if weighted else rows.withColumn("weight", F.lit(1.0))
    features = PipelineModel(stages).transform(rows).select("label", "weight", "features")
    if kind == "gbt":  # a failed task of the trees' stage reads it again, without the SVD's components and vocabularies
        features = checkpoint(features)
    return PipelineModel([*(counts.stages if counts else ()), *stages, trainer.fit(features)])


def score(model: PipelineModel, pairs: DataFrame) -> DataFrame:
    return model.transform(pairs).withColumn("score", vector_to_array("probability")[1])


def singular_values(pairs: DataFrame, k: int = 100, vocabulary: int = 20_000) -> list[float]:
    """Leading singular values of the word and character TF-IDF matrix, without centring."""
    return [r["value"] for r in sorted(_svd(pairs, k, vocabulary)[1].select("component", "value").collect())]
