import json

from pyspark.sql import functions as F

from brindle.operators import ingest as I, matching as M, registry as R, review as V

KIND = "company_id string, company_name string, exchange string, ticker string, aliases string, brands string, negative_contexts string"
MASTER = "canonical_code string, market string, exchange string, ticker string, name_en string, name_cn string"


def events(spark, raws):
    df = spark.createDataFrame([(i, r if isinstance(r, str) else json.dumps(r)) for i, r in enumerate(raws)], "id long, raw_event_json string")
    return I.parsed(I.envelope_events(df))


def test_equal_matches_in_the_order_of_the_registry(spark):
    manual = spark.createDataFrame([("b", "乙", "NYSE", "BBB", "Beta", "", ""), ("a", "甲", "HKEX", "AAA", "Alpha", "", "")], KIND)
    master = spark.createDataFrame([("HKEX:9992", "HK", "HKEX", "9992", "Pop Mart International", "泡泡玛特"), ("SSE:688825", "CN", "SSE", "688825", "CXMT Corporation", "长鑫科技")], MASTER)
    r = R.merge_registry(R.manual_companies(manual), master)
    m = spark.createDataFrame([(1, "泡泡玛特与长鑫科技发布新消息"), (2, "Beta, Alpha 与泡泡玛特")], "id long, text string")
    got = {x["message_id"]: x["codes"] for x in M.folded(M.identify(m, R.terms(r))).collect()}
    assert got == {1: ["SSE:688825", "HKEX:9992"], 2: ["HKEX:9992", "HKEX:AAA", "NYSE:BBB"]}


def test_first_and_last_rows(spark):
    manual = spark.createDataFrame([("a", "First", "NYSE", "AAA", "shared", "", ""), ("b", "Second", "NASDAQ", "BBB", "Shared!", "", ""), ("c", "Third", "ASE", "AAA", "", "", "")], KIND)
    r = R.merge_registry(R.manual_companies(manual), spark.createDataFrame([], MASTER))
    assert {x["handle"]: x["company_name"] for x in R.handle_names(r).collect()}["shared"] == "First"
    assert {x["ticker"]: x["canonical_code"] for x in R.ticker_codes(r).collect()} == {"AAA": "ASE:AAA", "BBB": "NASDAQ:BBB"}


def test_envelopes_hand_down_their_candidates(spark):
    offer = [{"stocker_code": "nvda"}]
    raws = [
        {"stoks": offer, "data": {"id": 1}}, {"stoks": offer, "result": [{"id": 2}, {"id": 3, "stoks": None}, 4]}, {"stoks": offer, "data": {"id": 5, "stoks": []}}, {"stoks": json.dumps(offer), "data": {}},
        {"type": "ping", "data": None}, {"type": "pong"}, {"data": "text", "result": {"id": 6}, "id": 7}, {"id": 8, "stocker_code": " tsla ", "aliases": "T", "type": "x"}, {"data": {"id": 9, "stocker_code": "mu", "aliases": [" a ", "", 5]}},
    ]
    e = events(spark, raws)
    assert sorted((r["message_id"], r["place"], r["e"]["id"]) for r in e.collect()) == [(0, 0, "1"), (1, 0, "2"), (1, 1, "3"), (2, 0, "5"), (3, 0, None), (4, 0, None), (6, 0, "7"), (7, 0, "8"), (8, 0, "9")]
    got = sorted((r["message_id"], r["place"], r["stocker_code"], r["aliases"], r["type"]) for r in I.candidates(e).collect())
    assert got == [(0, 0, "NVDA", [], ""), (1, 0, "NVDA", [], ""), (3, 0, "NVDA", [], ""), (7, 0, "TSLA", ["T"], "x"), (8, 0, "MU", ["a", "5"], "")]


def test_only_texts_are_text_and_ids_are_stripped(spark):
    r = {x["message_id"]: x for x in I.records(events(spark, [{"content": 5, "title": {"a": 1}, "text": " t ", "full_text": ["x"], "id": " 7　"}, {"content": "[]", "title": "NULL", "text": None}])).collect()}
    assert r[0]["text"] == "t" and r[0]["source_key"] == "id:7" and r[1]["text"] == ""


def test_annotations_are_recorded_once(spark):
    m = spark.createDataFrame([(1, "k1", ["A", "B"], "t"), (2, "k2", [], "u")], "id long, source_key string, predicted_codes array<string>, text string")
    kind = "source_key string, source_ref string, correct_codes array<string>, scope_codes array<string>, annotator string, confidence string"
    new = spark.createDataFrame([("k1", "r1", ["A", "B", "A"], ["Z", "C"], "x", "high"), ("k1", "r2", ["B", "A"], [], "x", "low"), ("k2", None, [], [], "x", "low"), ("k9", "r3", [], [], "x", "low"), ("k2", "r0", ["A"], [], "x", "low")], kind)
    rows, unknown = V.record(new, m, spark.createDataFrame([("r0",)], "source_ref string"))
    assert sorted((r["message_id"], r["source_ref"] or "", r["decision"], r["correct_codes"], r["scope_codes"]) for r in rows.collect()) == [(1, "r1", "accepted", ["A", "B"], ["C", "Z"]), (1, "r2", "corrected", ["B", "A"], []), (2, "", "no_tracked_company", [], [])]
    assert [r["source_key"] for r in unknown.collect()] == ["k9"]
    assert V.clamped(0, -3) == (1, 0) and V.clamped(9999, 4) == (500, 4)


def test_review_queue(spark):
    kind = "message_id long, model_version string, rule_codes array<string>, model_codes array<string>, candidates array<string>, created_at string"
    p = spark.createDataFrame([
        (1, "a", ["X"], ["Y", "Z"], ["Y", "Z"], "t1"), (1, "b", ["X"], ["Z", "Y"], ["Y"], "t2"), (2, "a", ["X"], ["X"], ["X"], "t5"), (2, "b", ["X"], [], ["X"], "t3"),
        (3, "a", ["X"], [], ["X"], "t9"), (4, "a", ["X", "X"], ["X", "X"], [], "t1"), (4, "b", ["X", "X"], ["X", "X"], [], "t1"), (4, "b", ["X", "X"], ["X"], [], "t7"),
    ], kind)
    stored = V.append_predictions(p.limit(7), p.limit(0))
    assert V.append_predictions(p, stored).count() == 0
    assert {(r["message_id"], r["model_version"]): r["agrees"] for r in stored.collect()}[4, "a"] == 1
    none = spark.createDataFrame([], "id long, message_id long, annotated_at string")
    got = [(r["message_id"], r["priority"], r["reasons"], len(r["predictions"]), r["annotation"]) for r in V.review_items(stored, ["a", "b"], none).collect()]
    assert got == [(1, 105, ["models agree, rule differs", "rule differs from a, b", "several candidates"], 2, None), (2, 90, ["models differ", "rule differs from b"], 2, None)]
    done = spark.createDataFrame([(7, 1, "t")], "id long, message_id long, annotated_at string")
    assert [r["message_id"] for r in V.review_items(stored, ["a", "b"], done).collect()] == [2]
    assert [r["annotation"] and r["annotation"]["id"] for r in V.review_items(stored, ["a", "b"], done, unreviewed_only=False).collect()] == [7, None]
    assert tuple(V.review_progress(V.eligible(stored, ["a", "b"]), done).first()) == (2, 1, 1)
    m = spark.createDataFrame([(1, "x", ["A"]), (2, " ", []), (3, "y", [])], "id long, text string, predicted_codes array<string>")
    assert [r["message_id"] for r in V.items(m, done).collect()] == [3] and [r["message_id"] for r in V.items(m, done, unlabelled_only=False).collect()] == [1, 3]
    assert [r["message_id"] for r in V.labelled(m, done).collect()] == [1]
