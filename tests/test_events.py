import json

from pyspark.sql import functions as F

from brindle.functions import text as T
from brindle.operators import ingest as I, store as S


def frame(spark, raws):
    return spark.createDataFrame(list(enumerate(raws)), "id long, raw_event_json string")


def test_envelopes(spark):
    raws = ['{"type":"ping"}', '{"type":"ping","data":{"id":"1"}}', '{"data":[{"id":"2"},{"id":"3"}]}', '{"result":{"id":4}}', '[{"id":"5"},7,{"id":"6"}]', '{"id":"8"}', '{"id":', "", None, "null", "3", "{}"]
    got = sorted((r["message_id"], r["place"], json.loads(r["event"]).get("id")) for r in I.envelope_events(frame(spark, raws)).collect())
    assert got == [(1, 0, "1"), (2, 0, "2"), (2, 1, "3"), (3, 0, 4), (4, 0, "5"), (4, 2, "6"), (5, 0, "8"), (11, 0, None)]


def test_text_source_and_key(spark):
    events = [{"content": " a ", "title": "a", "text": "b", "content_cn": "null"}, {"id_str": "7", "content": "x"}, {"content_url": "http://netflix.com/1"}, {"b": 1, "a": 2}, {"a": 2, "b": 1}, {"source_type": " News "}, {}]
    e = I.parsed(I.envelope_events(frame(spark, [json.dumps(x) for x in events])))
    r = {x["message_id"]: x for x in I.records(e).collect()}
    assert r[0]["text"] == "a\nb" and r[1]["source_key"] == "id:7" and r[1]["source_type"] == "twitter" and r[2]["source_type"] == "twitter" and r[5]["source_type"] == "news"
    assert r[3]["source_key"] == r[4]["source_key"] and r[3]["source_key"].startswith("event:") and r[6]["source_key"].startswith("text:")


def test_candidates(spark):
    raws = [{"stoks": [{"stocker_code": " nvda ", "stocker_name": "N"}, {"stocker_code": "NVDA", "stocker_name": "N"}, {}], "stocks": [{"stocker_code": "x"}]}, {"stoks": [], "stocks": [{"stocker_code": "x"}]}, {"stocks": '[{"stocker_code":"y"}]'}, {"stocks": None}]
    e = I.parsed(I.envelope_events(frame(spark, [json.dumps(x) for x in raws])))
    assert sorted((r["message_id"], r["stocker_code"]) for r in I.candidates(e).collect()) == [(0, "NVDA"), (2, "Y")]


def test_sanitise(spark):
    rows = ["see https://a.test/1 now", "mail a.b@c.test x", "hi @Foo_bar and @apple", "id 1234567 and $1234567 and 688825", "代码688825123", "", "@英伟达 好"]
    handles = F.create_map(F.lit("apple"), F.lit("苹果公司"))
    df = spark.createDataFrame([(t,) for t in rows], "t string")
    got = [r[0] for r in df.select(T.sanitise(F.col("t"), ["688825"], handles)).collect()]
    assert got == ["see  [URL]  now", "mail  [EMAIL]  x", "hi [HANDLE] and 苹果公司", "id [ID] and $1234567 and 688825", "代码688825123", "", "[HANDLE] 好"]


def test_stores(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "id long, k string")
    where = f"file://{tmp_path}/t"
    assert S.save_once(df, where, "k", "id") == 2 and S.save_once(df, where, "k", "id") == 0
    assert sorted(map(tuple, spark.read.parquet(where).select("id", "k").collect())) == [(1, "a"), (3, "b")]
    assert sorted(map(tuple, S.latest_per_key(df, "k", "id").collect())) == [(2, "a"), (3, "b")]


def test_running_split_equals_a_plain_sum(spark):
    rows = [(i, (i * 37) % 11 + 1, (i * 13) % 50) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, w long, at long")
    got = {r["id"]: r["split"] for r in S.running_split(df, "w", ["at", "id"], [("train", 0.7), ("val", 0.85)], "test").collect()}
    total, run = sum(w for _, w, _ in rows), 0
    for i, w, _ in sorted(rows, key=lambda r: (r[2], r[0])):
        run += w
        assert got[i] == ("train" if run / total <= 0.7 else "val" if run / total <= 0.85 else "test")
    assert S.running_split(df.limit(0), "w", ["at", "id"], [("train", 0.7)], "test").count() == 0
