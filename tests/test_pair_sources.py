import inspect
import math

import numpy as np
import pytest
from pyspark.ml import PipelineModel

from brindle.operators import features as X
from brindle.plans import models as M, pairs as P


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    """A registry of Nvidia and Citigroup by hand and Palantir, Micron (HK by hand, NASDAQ by the master) from the master; five messages."""
    folder = str(tmp_path_factory.mktemp("tables"))
    write = lambda name, rows, schema: spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    write("companies", [("c1", "英伟达", "NASDAQ", "NVDA", "Nvidia|英伟达", "GeForce", ""), ("c2", "花旗", "NYSE", "C", "Citigroup", "", "flip")], "company_id string, company_name string, exchange string, ticker string, aliases string, brands string, negative_contexts string")
    write("binance_tradfi_instruments", [("NYSE:PLTR", "US", "NYSE", "PLTR", "Palantir Technologies Inc", "", "stock", 1), ("NASDAQ:MU", "US", "NASDAQ", "MU", "Micron Technology", "美光", "stock", 1)], "canonical_code string, market string, exchange string, ticker string, name_en string, name_cn string, asset_type string, mapper_candidate int")
    write("messages", [(1, "Nvidia rises"), (2, "Citigroup flip"), (3, "a GeForce card and Palantir Technologies"), (4, "XNVDAX"), (5, "  ")], "id long, text string")
    write("candidate_pairs", [(m, c, y, "train", "news", t, p, 1) for m, c, y, t, p in [(1, "NASDAQ:NVDA", 1, "Nvidia rises", "a"), (2, "NYSE:C", 0, "Citigroup flip", "b"), (3, "NYSE:PLTR", 1, "a GeForce card and Palantir Technologies", "c"), (4, "NASDAQ:NVDA", 0, "XNVDAX", "a"), (4, "NYSE:GONE", 1, "XNVDAX", "d")]], "message_id long, candidate_code string, label int, split string, source_type string, message_text string, candidate_profile string, real_candidate_count int")
    write("upstream_candidates", [(1, "NVDA"), (1, " nvda "), (1, "NASDAQ:NVDA"), (2, "MU"), (3, "NYSE:PLTR"), (3, "PLT"), (4, ""), (4, None), (5, "C")], "message_id long, stocker_code string")
    return folder


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_local_codes_are_those_of_the_matcher(spark, root):
    assert rows(P._local(spark, root)) == [(1, "NASDAQ:NVDA"), (3, "NASDAQ:NVDA"), (3, "NYSE:PLTR")]
    assert rows(P.pair_labels(spark, root).where("negative_type = 'hard_rule'").select("message_id", "code")) == [(3, "NASDAQ:NVDA")]
    assert P.candidate_recall(spark, root).first()["local_hits"] == 2


def test_upstream_codes_join_by_ticker_and_full_code(spark, root):
    assert rows(P.upstream_code_join(spark, root)) == [(1, "NASDAQ:NVDA"), (2, "NASDAQ:MU"), (3, "NYSE:PLTR"), (5, "NYSE:C")]


def test_pairs_of_the_master_have_features_and_are_known(spark, root):
    got = {(r["message_id"], r["code"]): r for r in M.structured_features(spark, root).collect()}
    assert sorted(got) == [(1, "NASDAQ:NVDA"), (2, "NYSE:C"), (3, "NYSE:PLTR"), (4, "NASDAQ:NVDA")]
    assert (got[3, "NYSE:PLTR"]["has_alias"], got[3, "NYSE:PLTR"]["num_alias_hits"], got[3, "NYSE:PLTR"]["alias_count_total"]) == (1, 1, 2)
    assert [r["code"] for r in P.unknown_codes(spark, root).collect()] == ["NYSE:GONE"] == [r["code"] for r in P.stale_codes(spark, root).collect()]


def test_model_grams_and_smooth_idf(spark):
    texts = ["abcde", "abcde", "abcxy"]
    df = X.with_grams(spark.createDataFrame([(t, None) for t in texts], "message_text string, profile string"))
    assert max(len(g) for g in df.first()["characters"]) == 5 and "abcde" in df.first()["characters"]
    stages = X._vectors(df, 100)
    m = PipelineModel(stages).transform(df).first()
    w = {g: math.log(4 / (1 + n)) + 1 for g, n in {"ab": 3, "bc": 3, "abc": 3, "cd": 2, "de": 2, "bcd": 2, "cde": 2, "abcd": 2, "bcde": 2, "abcde": 2}.items()}
    norm = math.sqrt(sum(x * x for x in w.values()))
    got = dict(zip(stages[3].vocabulary, m["characters_v"].toArray()))
    assert set(got) == set(w) and all(abs(got[g] - x / norm) < 1e-9 for g, x in w.items())


def test_boosted_trees_read_the_svd_of_both_blocks(spark):
    texts = [f"{'gold mine opens' if i % 2 else 'old wine list'} {i % 5}" for i in range(40)]
    rows_ = [(t, "p", i % 2, *[0.0] * len(X.STRUCTURED)) for i, t in enumerate(texts)]
    df = X.with_grams(spark.createDataFrame(rows_, f"message_text string, profile string, label int, {', '.join(f'{n} double' for n in X.STRUCTURED)}")).persist()
    model = X.fit(df, "gbt", 500, trees=2, components=4)
    got = X.score(model, df).select("words_v", "characters_v", "svd", "features", "score", "label").collect()
    assert all(len(r["svd"]) == 4 and len(r["features"]) == 4 + len(X.STRUCTURED) for r in got)
    a = np.array([np.concatenate([r["words_v"].toArray(), r["characters_v"].toArray()]) for r in got])
    s = np.linalg.svd(a, compute_uv=False)[:4]
    assert np.allclose(X.singular_values(df, 4, 500), s) and np.allclose(np.linalg.norm(np.array([r["svd"].toArray() for r in got]), axis=0), s)
    assert min(r["score"] for r in got if r["label"]) > max(r["score"] for r in got if not r["label"])  # structured features alone are equal
    assert inspect.signature(X.fit).parameters["trees"].default == 300
