import json

import pytest

from pyspark.sql import functions as F

from brindle.operators import review as V
from brindle.sources import files as S, reports as R


def test_annotations(spark):
    m = spark.createDataFrame([(1,), (2,), (3,)], "message_id long")
    a = spark.createDataFrame([(1, 1, "r1", ["x"]), (2, 1, "r2", []), (3, 2, "r3", ["y"])], "id long, message_id long, source_ref string, correct_codes array<string>")
    assert tuple(V.progress(m, a).first()) == (3, 2, 1)
    assert {r["message_id"]: r["annotation"] and r["annotation"]["id"] for r in V.with_latest(m, a).collect()} == {1: 2, 2: 3, 3: None}
    new = spark.createDataFrame([(1, "r1", ["x"]), (2, "r9", ["x"]), (9, "r8", []), (3, "r7", ["?"])], "message_id long, source_ref string, correct_codes array<string>")
    ok, bad = V.append(new, m, spark.createDataFrame([("x",), ("y",)], "code string"), a)
    assert [r["source_ref"] for r in ok.collect()] == ["r9"] and sorted(r["source_ref"] for r in bad.collect()) == ["r7", "r8"]
    d = spark.createDataFrame([([], ["a"]), (["a", "b"], ["a", "b"]), (["b", "a"], ["a", "b"])], "c array<string>, p array<string>")
    assert [r[0] for r in d.select(V.decision(F.col("c"), F.col("p"))).collect()] == ["no_tracked_company", "accepted", "corrected"]
    why = spark.createDataFrame([(["a", "a"], ["v2", "v1"], ["a", "b"]), (["a", "b"], [], ["a"])], "m array<string>, d array<string>, c array<string>").select(V.reasons(F.col("m"), F.col("d"), F.col("c"))).collect()
    assert why[0][0] == ["models agree, rule differs", "rule differs from v1, v2", "several candidates"] and why[1][0] == ["models differ"]


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([("a|b", 1, None), ("c", 2, 0.5)], "k string, n int, x double")
    assert json.loads(R.audit_json({"t": df}))["t"][1] == {"k": "c", "n": 2, "x": 0.5}
    assert "| a\\|b | 1 | n/a |" in R.markdown("T", {"t": df}) and R.percent(1, 3) == "33.3%" and R.percent(1, 0) == "n/a"
    with pytest.raises(ValueError):
        R.rows_of(spark.range(R.MAX_ROWS + 1))
    p = spark.createDataFrame([("f1_at_both", None, None), ("f1", 0.4, 0.9)], "policy string, threshold double, value double")
    assert R.threshold_json(p, str(tmp_path / "t.json"))["policy"] == "f1"


def test_more_sources(spark, tmp_path):
    (tmp_path / "r.csv").write_text('company_id,company_name,exchange,ticker,aliases,brands,negative_contexts\na,"A, Inc",NYSE,A,x|y,,\n', encoding="utf-8")
    assert S.registry_csv(spark, f"file://{tmp_path}/r.csv").first()["company_name"] == "A, Inc"
    (tmp_path / "i.json").write_text('{"message_ids":[3,1,3]}')
    assert sorted(r[0] for r in S.id_list(spark, f"file://{tmp_path}/i.json").collect()) == [1, 3]
    news = spark.createDataFrame([(2, " t "), (3, " "), (4, None)], "id int, title_cn string")
    assert [r["source_key"] for r in S.news_records(news, "b1").collect()] == ["id:2"]
    S.write_pairs(spark.createDataFrame([(1, "train"), (2, "test")], "message_id long, split string"), f"file://{tmp_path}/pairs")
    assert (tmp_path / "pairs" / "split=train").exists()


def test_model_bundle(spark, tmp_path):
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import SQLTransformer

    model = Pipeline(stages=[SQLTransformer(statement="SELECT *, v + 1 AS w FROM __THIS__")]).fit(spark.range(1).withColumnRenamed("id", "v"))
    R.save_model(model, str(tmp_path / "m"), {"version": "1"})
    again, meta = R.load_model(str(tmp_path / "m"))
    assert meta == {"version": "1"} and again.transform(spark.range(1).withColumnRenamed("id", "v")).first()["w"] == 1
