import unicodedata

import pytest

from brindle.llm.codepoints import normalise_text, suspicious_rows, tables

CASES = [
    ("plain", "plain", 0), ("", "", 0), (None, None, 0), ("ＡＢ１", "AB1", 3), ("a​b", "ab", 1), ("a b", "a b", 1), ("Рынок открыт", "Рынок открыт", 0),
    ("Соrp", "Corp", 2), ("Καλή αρχή", "Καλή αρχή", 0), ("café", "café", 1), ("café", "café", 0), ("中文（简），好：", "中文（简），好：", 0), ("⼈", "人", 1),
    ("👨‍👩‍👧 ❤️", "👨‍👩‍👧 ❤️", 0), ("a‍👧", "a👧", 1), ("ﬁne", "fine", 1), ("co‑op", "co-op", 1), ("a͏́", "á", 2), ("́", "́", 0), ("T​ВЕV", "TBEV", 3),
    ("½ ² ™ …", "½ ² ™ …", 0), ("\U0002f800", unicodedata.normalize("NFC", "\U0002f800"), 1),
]


def test_cases(spark):
    df = spark.createDataFrame([(i, t, 0) for i, (t, _, _) in enumerate(CASES)], "id long, text string, key int")
    rows = {r["key"]: (r["text"], r["found"]) for r in normalise_text(df, "id", "text").collect()}
    assert [rows[i] for i in range(len(CASES))] == [(form, n) for _, form, n in CASES]
    assert {r[0] for r in suspicious_rows(df, "id", "text").collect()} == {i for i, c in enumerate(CASES) if c[2]}


def test_rows_dont_touch(spark):
    df = spark.createDataFrame([(1, "e"), (2, "́x"), (3, "A"), (4, "Рынок"), (5, "x" * 100000 + "​")], "id long, text string").coalesce(1)
    rows = {r["key"]: r["text"] for r in normalise_text(df, "id", "text").collect()}
    assert rows == {1: "e", 2: "́x", 3: "A", 4: "Рынок", 5: "x" * 100000}
    assert suspicious_rows(df.limit(0), "id", "text").count() == 0


@pytest.mark.parametrize("text", ["Ａ́b", "가나다", "ال", "ｶﾞ"])
def test_form_is_stable(spark, text):
    once = normalise_text(spark.createDataFrame([(1, text)], "id long, text string"), "id", "text").first()["text"]
    assert normalise_text(spark.createDataFrame([(1, once)], "id long, text string"), "id", "text").first()["text"] == once


def test_composition_pairs_equal_the_standard():
    t = tables()
    for key, c in zip(t["pairs"].tolist(), t["composed"].tolist()):
        assert unicodedata.normalize("NFC", chr(key >> 21) + chr(key & 0x1FFFFF)) == chr(c)
