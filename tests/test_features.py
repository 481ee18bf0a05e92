import math
import re
from collections import Counter

from pyspark.sql import functions as F

from brindle.operators import features as X


def test_structured(spark):
    rows = [("$NVDA up, Nvidia shares https://x.test/NVDA", "news", 2, "NVDA", ["NVIDIA", "英伟达"], ["CUDA"], ["flip"]), ("花旗 $C flip 季度", "twitter", None, "C", ["花旗"], [], ["flip"]), (None, None, None, "C", [], [], [])]
    df = spark.createDataFrame(rows, "message_text string, source_type string, real_count int, ticker string, aliases array<string>, brands array<string>, negative_contexts array<string>")
    got = [[r[n] for n in X.STRUCTURED] for r in X.structured(df).collect()]
    assert got[0] == [1, 1, 1, 6, 1, 0, 1, 4, 3, len("$NVDA up, Nvidia shares  "), 1, 2]
    assert got[1] == [1, 1, 1, 2, 1, 1, 1, 1, 1, len("花旗 $C flip 季度"), 0, 1]
    assert got[2][:2] == [0, 0] and got[2][9] == 0


def plain(text):
    w = re.findall("[A-Za-z0-9]+|[一-鿿]", text.lower())
    return w + [" ".join(p) for p in zip(w, w[1:])]


def test_grams_and_weights(spark):
    texts = {1: "A b, 中文 b", 2: "a B c", 3: "", 4: "x", 5: "a b c d"}
    df = spark.createDataFrame(list(texts.items()), "id long, text string")
    grams = {r["id"]: (r["w"], r["c"]) for r in df.select("id", X.word_grams(F.col("text")).alias("w"), X.char_grams(F.col("text"), 2, 3).alias("c")).collect()}
    for i, t in texts.items():
        assert Counter(grams[i][0]) == Counter(plain(t))
        assert Counter(grams[i][1]) == Counter(t[k : k + n] for n in (2, 3) for k in range(len(t) - n + 1))
    df_ = Counter(g for t in texts.values() for g in set(plain(t)))
    got = {(r["id"], r["gram"]): r["weight"] for r in X.gram_weights(df, X.word_grams(F.col("text"))).collect()}
    for i, t in texts.items():
        w = {g: n * (math.log((1 + len(texts)) / (1 + df_[g])) + 1) for g, n in Counter(plain(t)).items() if df_[g] >= 2}
        norm = math.sqrt(sum(x * x for x in w.values()))
        for g, x in w.items():
            assert abs(got[i, g] - x / norm) < 1e-9


def test_models_separate_what_can_be_separated(spark):
    rows = []
    for i in range(120):
        good = i % 2
        rows.append((i, good, f"{'$NVDA earnings of Nvidia' if good else 'the custard was fine'} {i % 7}", "news", 1, "NVDA", ["NVIDIA"], [], ["custard"], "英伟达 | NASDAQ:NVDA"))
    df = spark.createDataFrame(rows, "message_id long, label int, message_text string, source_type string, real_count int, ticker string, aliases array<string>, brands array<string>, negative_contexts array<string>, profile string")
    full = X.with_grams(X.structured(df)).persist()
    for kind in ("lr", "gbt"):
        s = X.score(X.fit(full, kind, 200), full).select("label", "score").collect()
        assert min(r["score"] for r in s if r["label"]) > max(r["score"] for r in s if not r["label"])
    assert len(X.singular_values(full, 3, 100)) == 3


def _made(spark, n=60):
    rows = [(i, i % 2, f"{'$NVDA earnings of Nvidia' if i % 2 else 'the custard was fine'} {i % 7}", "news", 1, "NVDA", ["NVIDIA"], [], ["custard"], "英伟达") for i in range(n)]
    df = spark.createDataFrame(rows, "message_id long, label int, message_text string, source_type string, real_count int, ticker string, aliases array<string>, brands array<string>, negative_contexts array<string>, profile string")
    return X.with_grams(X.structured(df))


def test_trees_are_grown_on_a_table(spark, monkeypatch):
    """What is sent with each of the many jobs of boosting has no SVD and no vocabulary in it."""
    plans, fit = [], X.GBTClassifier.fit
    monkeypatch.setattr(X.GBTClassifier, "fit", lambda self, df: plans.append((df.columns, df._jdf.queryExecution().optimizedPlan().toString())) or fit(self, df))
    X.fit(_made(spark), "gbt", 200, trees=2)
    assert plans[0][0] == ["label", "weight", "features"] and plans[0][1].startswith("Relation") and "UDF" not in plans[0][1]


def test_counts_once_give_the_same_scores(spark):
    """A model of rows whose counts were made before scores them like a model of their grams, and no grams are kept in a table."""
    full = _made(spark)
    rows = X.with_counts(full, X.counted(full, 200))
    assert "words" not in rows.columns and "characters" not in rows.columns
    got = {r["message_id"]: r["score"] for r in X.score(X.fit(rows), rows).collect()}
    want = {r["message_id"]: r["score"] for r in X.score(X.fit(full, vocabulary=200), full).collect()}
    assert len(got) == 60 and all(abs(got[i] - want[i]) < 1e-6 for i in want)


def test_singular_values_from_small_cached_batches(spark):
    import numpy as np

    full = _made(spark)
    stages = X.counted(full, 20_000)  # all grams: which of equally frequent ones a smaller vocabulary has is open
    rows = X.with_counts(full, stages)
    from pyspark.ml import PipelineModel

    v = PipelineModel(X._vectors(rows)).transform(rows).select("words_v", "characters_v").collect()
    dense = np.array([np.concatenate([r[0].toArray(), r[1].toArray()]) for r in v])
    before = spark.conf.get("spark.sql.inMemoryColumnarStorage.batchSize")
    assert np.allclose(X.singular_values(full, 5), np.linalg.svd(dense, compute_uv=False)[:5], atol=1e-6)
    assert spark.conf.get("spark.sql.inMemoryColumnarStorage.batchSize") == before
