import json

import pytest

from brindle.sources import files as S
from brindle.streaming import ingest as G


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return f"file://{path}"


def test_jsonl(spark, tmp_path):
    p = write(tmp_path / "a.jsonl", '{"k":"x","v":1,"text":"t"}\n\n  \n{"k":"y","v":2,"text":" "}\n{"k":"x","v":3,"text":"u"}\n')
    assert S.records(spark, p, "k string, v int, text string").count() == 2
    assert sorted(map(tuple, S.last_per_key(spark, p, "k string, v int", "k").collect())) == [("x", 3), ("y", 2)]
    with pytest.raises(S.BadLine):
        S.jsonl(spark, write(tmp_path / "b.jsonl", '{"k":"x"}\n{"k":\n'), "k string")
    assert S.pairs(spark, write(tmp_path / "c.jsonl", '{"message_id":1,"label":1}\n')).first()["real_candidate_count"] == 1


def test_documents(spark, tmp_path):
    p = write(tmp_path / "d.json", json.dumps({"a": {"b": [{"i": 1, "c": "x"}, {"i": 1, "c": "x"}]}}, indent=1))
    assert [tuple(r) for r in S.nested_list(spark, p, "a.b", "i long, c string").collect()] == [(1, "x")]
    p = write(tmp_path / "e.json", '{"fields":["a","b"],"data":[["1","2"],["3","4"]]}')
    assert [r["row"]["b"] for r in S.columnar_payload(spark, p).collect()] == ["2", "4"]
    with pytest.raises(Exception, match="another length"):
        S.columnar_payload(spark, write(tmp_path / "f.json", '{"fields":["a","b"],"data":[["1"]]}')).collect()
    news = S.news_csv(spark, write(tmp_path / "n.csv", "﻿id,title_cn\n10,b\n9,a\n"))
    assert [r["id"] for r in news.collect()] == [9, 10]


def test_snapshots(spark, tmp_path):
    df = spark.range(5)
    S.snapshot({"t": df}, str(tmp_path), "v1", "2026-01-01")
    assert S.resolve_snapshot(spark, str(tmp_path), "v1")["t"].count() == 5
    for bad in ("v1", "../x"):
        with pytest.raises((FileExistsError, ValueError)):
            S.snapshot({"t": df}, str(tmp_path), bad, "")
    part = next((tmp_path / "v1" / "t.parquet").glob("*.parquet"))
    part.write_bytes(part.read_bytes() + b"x")
    with pytest.raises(ValueError):
        S.resolve_snapshot(spark, str(tmp_path), "v1")


def test_stream_equals_batch_and_restarts(spark, tmp_path):
    raws = [(1, '{"id":"1","content":"a"}', "t"), (2, '{"data":[{"id":"2"},{"id":"1"}]}', "t"), (3, '{"type":"ping"}', "t"), (4, None, "t")]
    more = [(5, '{"id":"2","content":"again"}', "t"), (6, '{"id":"3"}', "t")]
    src, store, at = f"{tmp_path}/in", f"file://{tmp_path}/store", f"file://{tmp_path}/at"
    errors = []

    def broken(rows):
        raise RuntimeError("no model")

    for rows in (raws, more):
        spark.createDataFrame(rows, G.RAW).coalesce(1).write.mode("append").parquet(src)
        G.run_ingest(G.raw_stream(spark, src), store, at, {"broken": broken}, errors).awaitTermination()
    got = sorted((r["source_key"], r["message_id"]) for r in spark.read.parquet(f"{store}/messages").collect())
    assert got == [("id:1", 1), ("id:2", 2), ("id:3", 6)] and {n for n, _ in errors} == {"broken"}
