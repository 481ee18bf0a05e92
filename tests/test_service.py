import datetime

import pytest

from brindle.operators import registry as R, review as V, service as A
from brindle.sources import files as S

KIND = "company_id string, company_name string, exchange string, ticker string, aliases string, brands string, negative_contexts string"


def test_identify_and_converse(spark):
    manual = spark.createDataFrame([("a", "英伟达", "NASDAQ", "NVDA", "Nvidia", "CUDA", "")], KIND)
    terms = R.terms(R.merge_registry(R.manual_companies(manual), spark.createDataFrame([], "canonical_code string, market string, exchange string, ticker string, name_en string, name_cn string")))
    answer = lambda t: A.identify(spark, t, terms)
    assert answer("CUDA by nvidia") == [{"canonical_code": "NASDAQ:NVDA", "mention": "Nvidia", "match_type": "alias", "confidence": 0.98}] and answer("") == []
    assert list(A.converse(["CUDA", " ", "nothing", "EXIT", "CUDA"], answer)) == ["NASDAQ:NVDA (CUDA, 0.9)", "no match"]


def test_pages_and_annotations(spark):
    m = spark.createDataFrame([(1, "k1", "x", ["A"]), (2, "k2", "y", []), (3, "k3", " ", [])], "id long, source_key string, text string, predicted_codes array<string>")
    a = spark.createDataFrame([(7, 1, "r", ["A"])], "id long, message_id long, source_ref string, correct_codes array<string>")
    page = A.items(m, a)
    assert [r["message_id"] for r in page["items"]] == [2] and page["summary"] == {"total": 2, "labelled": 1, "remaining": 1}
    codes = spark.createDataFrame([("B",), ("A",)], "code string")
    new = A.annotate({"source_key": "k1", "correct_codes": ["A", "A"], "confidence": "low"}, m, codes, a, "shadow_review").first()
    assert (new["message_id"], new["decision"], new["scope_codes"], new["annotator"], new["confidence"]) == (1, "accepted", ["A", "B"], "shadow_review", "low")
    with pytest.raises(A.UnknownCode):
        A.annotate({"source_key": "k1", "correct_codes": ["?"]}, m, codes, a)
    with pytest.raises(KeyError):
        A.annotate({"source_key": "k9", "correct_codes": []}, m, codes, a)


def test_migration_twice(spark):
    m = spark.createDataFrame([(1, "k1", [])], "id long, source_key string, predicted_codes array<string>")
    events = spark.createDataFrame([(10, "k1", []), (11, "k2", []), (12, "k2", [])], "id long, source_key string, predicted_codes array<string>")
    lines = spark.createDataFrame([(1, '{"record_key":"k2","correct_codes":["A"]}'), (2, " "), (3, '{"record_key":"k2","correct_codes":["A"]}'), (4, '{"record_key":"gone"}')], "line int, value string")
    fresh, kept, n = V.migrate(events, lines, m, spark.createDataFrame([], "source_ref string"))
    assert n == {"imported_messages": 1, "imported_annotations": 2, "skipped_annotations": 1} and fresh.first()["id"] == 11
    assert {r["annotator"] for r in kept.collect()} == {"legacy"}
    again = V.migrate(events, lines, m.unionByName(fresh), kept)[2]
    assert again == {"imported_messages": 0, "imported_annotations": 0, "skipped_annotations": 1}


def test_options_and_predictions(spark, tmp_path):
    assert S.header_fields(["A = b=c ", "X="], {"Cookie": "s", "Authorization": None}) == {"A": "b=c", "X": "", "Cookie": "s"}
    for bad in ("A", "=x"):
        with pytest.raises(ValueError):
            S.header_fields([bad])
    assert S.filled_url("wss://h.test/{token}/x", "t") == "wss://h.test/t/x" and S.filled_url("wss://h.test", None) == "wss://h.test"
    with pytest.raises(ValueError):
        S.filled_url("wss://h.test/{token}", "")
    assert S.utc_now(lambda: datetime.datetime(2026, 1, 2, tzinfo=datetime.timezone.utc)) == "2026-01-02T00:00:00+00:00"
    p = spark.createDataFrame([(1, "A", 1, None, 0.5, "extra")], "message_id long, candidate_code string, label int, negative_type string, score double, other string")
    S.write_predictions(p, f"file://{tmp_path}/p")
    assert S.jsonl(spark, f"file://{tmp_path}/p", S.PREDICTION).drop("line").first().asDict() == {"message_id": 1, "candidate_code": "A", "label": 1, "negative_type": None, "score": 0.5}
    assert [S.plain_name(x) for x in ("v1", "a.b-c_d", ".x", "", "a/b", "é")] == [True, True, False, False, False, False]


def test_latencies(spark):
    ticks = iter(range(1000))
    rows = {r["bucket"]: (r["n"], r["p50"]) for r in A.latencies(spark, ["", "a", "ab", "abc"], len, 2, lambda: next(ticks)).collect()}
    assert rows == {"all": (4, 1000.0), "none": (1, 1000.0), "one": (1, 1000.0), "several": (2, 1000.0)}
