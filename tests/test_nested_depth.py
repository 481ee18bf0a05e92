from brindle.operators import nested as N


def test_deep_values_are_classified():
    for depth in (1_100, 5_000):
        assert N.TreeAutomaton().classify(N.decode("[" * depth + "1" + "]" * depth)) == N.TreeAutomaton().classify(N.decode("[" * depth + "2" + "]" * depth))
        assert isinstance(N.TreeAutomaton().classify(N.decode('{"a":' * depth + "1" + "}" * depth)), int)
        assert N._text(N.decode("[" * depth + "]" * depth)).count("[") == depth


def test_records_of_any_depth(spark):
    depth = 60_000
    text = '{"a":' * depth + '{"stocker_code":"X","aliases":["y"]}' + "}" * depth
    df = spark.createDataFrame([(1, text), (2, text[:-1]), (3, "[" * depth + '{"stocker_code":1}' + "]" * depth + "x")], "id long, j string")
    got = [(r["parent_id"], len(r["item_path"]), r["alias"]) for r in N.flatten_items(df, "id", "j", "x").collect()]
    assert got == [(1, 1 + 2 * depth, "y")]


def test_deep_decoder_equals_the_standard_one():
    import json

    good = ['{"a": [1, -2.5e3, true, null, "x\\n\\"y"], "b": {}, "c": [ ], "a": {"d": [[], {"e": false}]}}', "[]", "{}", " 7 ", '"s"', "[[1],[2,[3]]]"]
    assert all(N.decode_deep(x) == json.loads(x) for x in good)
    for bad in ("", "[", "[1,]", "{,}", '{"a"}', '{"a":1,}', "[1 2]", "01", "nul", "[1]]", '{"a":1 "b":2}', "{1:2}", '"x'):
        try:
            N.decode_deep(bad)
        except ValueError:
            continue
        raise AssertionError(bad)
