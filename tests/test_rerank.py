import math

from brindle.operators.rerank import rerank


def load():
    import numpy as np

    return lambda q, p: np.array([float(len(set(a.split()) & set(b.split()))) for a, b in zip(q.ravel(), p.ravel())], dtype=np.float32)


def test_scores(spark):
    rows = [(1, "a b c", "b c d"), (2, None, "x"), (3, "", "")]
    df = spark.createDataFrame(rows, "message_id long, message_text string, profile string")
    got = {r["message_id"]: r["score"] for r in rerank(df, load, batch=2).collect()}
    assert abs(got[1] - 1 / (1 + math.exp(-2))) < 1e-6 and got[2] == got[3] == 0.5
