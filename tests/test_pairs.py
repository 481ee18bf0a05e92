import random

from pyspark.sql import functions as F

from brindle.operators import dataset as D, evaluate as E


def test_sweep_equals_brute_force(spark):
    rng = random.Random(3)
    rows = [(round(rng.random(), 2), rng.randrange(2)) for _ in range(300)]
    df = spark.createDataFrame(rows, "score double, label int")
    got = {r["threshold"]: (r["tp"], r["fp"], r["fn"]) for r in E.threshold_sweep(df).collect()}
    for t in {s for s, _ in rows} | {0.0, 1.0}:
        assert got[t] == (sum(s >= t and y == 1 for s, y in rows), sum(s >= t and y == 0 for s, y in rows), sum(s < t and y == 1 for s, y in rows))
    picks = {r["policy"]: r for r in E.picks(E.threshold_sweep(df), 0.2, 0.2).collect()}
    assert set(picks) == {"f1", "precision_at_recall", "recall_at_precision", "f1_at_both"} and picks["recall_at_precision"]["value"] <= 1.0


def test_labels_and_top_up(spark):
    s = lambda rows: spark.createDataFrame(rows, "message_id long, code string")
    labelled = D.pair_labels(s([(1, "a"), (2, "b")]), s([(1, "a"), (1, "c"), (3, "d")]), s([(1, "c"), (1, "e")]))
    rows = sorted(map(tuple, labelled.collect()))
    assert rows == [(1, "a", 1, ""), (1, "c", 0, "hard_rule"), (1, "e", 0, "hard_upstream"), (2, "b", 1, ""), (3, "d", 0, "hard_rule")]
    codes = spark.createDataFrame([(c, i) for i, c in enumerate("abcdefgh")], "code string, ord long")
    added = [tuple(r) for r in D.top_up(labelled, codes).collect()]
    assert len([x for x in added if x[0] == 1]) == 1 and len([x for x in added if x[0] == 2]) == 3 and len(added) == len(set(added)) == 4
    assert not {(1, "a"), (1, "c"), (1, "e"), (2, "b")} & set(added)


def test_clusters(spark):
    base = "Velmora shipped nine lorries of zinc to Brant harbour before the strike began on Friday"
    rows = [(1, base, ["x"]), (2, base.upper() + "!", ["y"]), (3, base.replace("nine", "ten"), ["x"]), (4, base.replace("nine", "six"), ["z"]), (5, "something else entirely different", []), (6, "", []), (7, "  ", [])]
    df = spark.createDataFrame(rows, "id long, text string, codes array<string>")
    got = dict(map(tuple, D.clusters(df, "id", "text", "codes").collect()))
    assert got[1] == got[2] == got[3] == 1 and got[4] == 4 and got[5] == 5 and got[6] == got[7] == 6


def test_message_metrics(spark):
    rows = [(1, 1, 0.9), (1, 0, 0.1), (2, 1, 0.2), (2, 1, 0.8), (3, 0, 0.7), (4, 0, 0.1)]
    m = E.message_metrics(spark.createDataFrame(rows, "message_id long, label int, score double"), F.col("score") >= 0.5).first()
    assert (m["exact_rate"], m["multi_exact_rate"], m["missed_rate"], m["false_alarm_rate"]) == (0.5, 0.0, 0.5, 0.5)
