import json

from brindle.operators.nested import TreeAutomaton, aliases_of, decode, flatten_items, item_table, items_of, subtype_table


def found(spark, texts, bare=False):
    df = spark.createDataFrame(list(enumerate(texts)), "id long, j string")
    return flatten_items(df, "id", "j", "x", bare)


def test_items_and_aliases(spark):
    item = {"stocker_code": "A", "aliases": ["a", None, " ", [" b"], {"name": "c"}, {"name": None}, 5]}
    texts = [
        json.dumps({"k": [0, {"q": item}]}), json.dumps(json.dumps({"k": json.dumps([item])})), json.dumps(item)[:-1], "", None, "null", "{}",
        json.dumps({"stocker_code": None, "kids": [{"stocker_code": "B", "aliases": '["x","\\"y\\""]'}]}), "NaN", "[" * 100000,
    ]
    rows = sorted(tuple(r) for r in found(spark, texts).select("parent_id", "item_path", "alias_no", "alias").collect())
    four = [(1, "a"), (2, " b"), (3, "c"), (4, "5")]
    assert rows == [(0, "$.k[1].q", n, a) for n, a in four] + [(1, "$.k[0]", n, a) for n, a in four] + [(7, "$", 0, ""), (7, "$.kids[0]", 1, "x"), (7, "$.kids[0]", 2, '"y"')]


def test_bare_lists(spark):
    texts = ['["a",["b"]]', "[]", "null", '""', '"a"', '"[\\"a\\"]"', "[", None, '{"name":"n"}']
    rows = sorted(tuple(r) for r in found(spark, texts, True).select("parent_id", "item_path", "alias_no", "alias").collect())
    assert rows == [(0, "$", 1, "a"), (0, "$", 2, "b"), (4, "$", 1, "a"), (5, "$", 1, "a"), (8, "$", 1, "n")]


def test_variants_and_subtypes(spark):
    texts = [json.dumps({"stocker_code": "A", "aliases": x}) for x in (["p"], ["q", "r"], "s", [{"name": "t"}], None)] + ['{"stocker_code":"A"}']
    flat = found(spark, texts)
    items = {r["parent_id"]: r for r in item_table(flat).collect()}
    assert items[0]["variant"] == items[1]["variant"] != items[2]["variant"] and items[1]["aliases"] == 2
    assert [items[i]["form"] for i in range(6)] == ["texts", "texts", "text", "objects", "null", "absent"]
    assert [r["alias"] for r in subtype_table(flat, "objects").collect()] == ["t"]
    assert found(spark, []).count() == 0


def test_automaton_states_are_those_of_shapes():
    a, b = TreeAutomaton(), TreeAutomaton()
    assert a.classify({"x": [1, 2], "y": "s"}) == b.classify({"y": "t", "x": [3]})
    assert a.classify({"x": [1]}) != a.classify({"x": ["1"]})
    deep = decode("[" * 400 + "]" * 400)
    assert aliases_of(deep) == [] and list(items_of(deep)) == []
