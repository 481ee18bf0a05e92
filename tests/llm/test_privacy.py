import re

import pytest

from brindle.llm.privacy import find_items, items, key_of, pseudonymise, replace, surrogate

CASES = [
    ("Write to ann.lee+x@mail.foo.test.", [("email", "annleexmailfootest")]), ("(ann_lee [at] foo [dot] test)", [("email", "annleeatfoodottest")]), ("mailto:ann at www dot foo dot test now", [("email", "annatwwwdotfoodottest")]),
    ("Yield at NYSE sank. via @ann_fan12", []), ("http://x.test/a@b?c=1", []),
    ("Call +1 (729) 555-0176 1304 Elm Court, X", [("phone", "17295550176"), ("street_address", "1304elmcourt")]), ("tel (436) 555 0137", [("phone", "4365550137")]), ("020 7946 0756 1405 Elm Road, Y", [("phone", "02079460756"), ("street_address", "1405elmroad")]),
    ("来电010-00007358咨询。", [("phone", "01000007358")]), ("手机 17900002501 无人接听。", [("phone", "17900002501")]), ("0049 30 23125 505", [("phone", "00493023125505")]), ("来电+86 138 0000 8605咨询", [("phone", "8613800008605")]),
    ("Block 00967750 landed. Ref ORD-1238-8769. ticket #4982818 Traded 1,186,776 lots. ISIN ZZ0062409214. Build 11.17.139", []), ("单号40287422", []),
    ("SSN 000-94-4830", [("id_number", "000944830")]), ("ID QQ 33 72 95 B", [("id_number", "qq337295b")]), ("passport ZP6603632", [("id_number", "zp6603632")]), ("身份证号99629719681127872X被写进附件。", [("id_number", "99629719681127872x")]), ("号 992516 19711226 3368。", [("id_number", "992516197112263368")]),
    ("寄往晗汀路205弄18号，二楼收。", [("street_address", "晗汀路205弄18号")]), ("Calle Rahanmere 34, Yord", [("street_address", "callerahanmere34")]), ("Sent to Hanridgestraße 138, Y", [("street_address", "hanridgestraße138")]), ("rue Denn 68. 145C Ury Mews", [("street_address", "ruedenn68"), ("street_address", "145curymews")]),
    ("Dr. Wen Corra chairs it. Signed, Brayorez, Drimvosis\nThe", [("person_name", "wencorra"), ("person_name", "brayorezdrimvosis")]), ("SIGNED, ANN LEE", [("person_name", "annlee")]), ("Thanks to Marbra S. for", [("person_name", "marbras")]),
    ("祁听微女士来信投诉。 联系人：晏岑 署名卓书宁", [("person_name", "祁听微"), ("person_name", "晏岑"), ("person_name", "卓书宁")]), ("", []), ("ＳＳＮ ０00​-94-4830", [("id_number", "０00944830")]),
]


@pytest.mark.parametrize("text,want", CASES)
def test_items(text, want):
    assert [(k, key_of(text[a:b])) for a, b, k in items(text)] == want


def test_surrogates_keep_type_format_and_coreference():
    secret = b"k"
    text = "Thanks to Ann Vosette for 020 7946 0756. Signed, Ann Vosette, 号 992516 19711226 336X, 祁听微女士, ann@b.test"
    new = replace(text, "surrogate", secret)
    shape = lambda s: re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub(r"\d", "9", re.sub("[一-鿿]", "汉", s))))
    assert shape(new) == shape(text) and new == replace(text, "surrogate", secret) != replace(text, "surrogate", b"j")
    first, second = re.search(r"to (\w+ \w+)", new)[1], re.search(r"Signed, (\w+ \w+)", new)[1]
    assert first == second != "Ann Vosette" and first.endswith("e")
    assert not {key_of(text[a:b]) for a, b, _ in items(text)} & {key_of(new[a:b]) for a, b, _ in items(new)}
    assert replace("Signed, Ann Lee", "type", secret) == "Signed, [PERSON_NAME]"
    assert surrogate("1A", "street_address", secret)[0].isdigit()


def test_distinct_items_stay_distinct():
    text = " ".join(f"SSN 000-94-48{i:02d}" for i in range(100))
    new = replace(text, "surrogate", b"s")
    assert len(set(re.findall(r"SSN (\S+)", new))) == 100


def test_columns(spark):
    rows = [(1, "Signed, Ann Lee and Signed, Ann Lee", 0), (2, None, 0), (3, "", 0), (1, "x" * 200000 + " SSN 000-94-4830", 0)]
    df = spark.createDataFrame(rows, "id long, text string, key int")
    assert sorted(map(tuple, find_items(df, "id", "text").collect())) == [(1, "id_number", "000944830"), (1, "person_name", "annlee")]
    out = sorted((r["key"], r["text"]) for r in pseudonymise(df, "id", "text", "s", "type").collect() if r["text"] is not None)
    assert out[0][1] == "Signed, [PERSON_NAME] and Signed, [PERSON_NAME]" and out[1][1].endswith(" SSN [ID_NUMBER]") and out[2] == (3, "")
    assert find_items(df.limit(0), "id", "text").count() == 0
