import random

from brindle.operators.components import connected_components


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)] + [(500, 500), (None, 3), (7, 7)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            parent[max(find(a), find(b))] = min(find(a), find(b))
    df = spark.createDataFrame(edges, "a long, b long")
    got = [tuple(r) for r in connected_components(df, "a", "b").collect()]
    assert len(got) == len(dict(got)) and dict(got) == {x: find(x) for x in parent if x not in (500,)}
    assert connected_components(df.limit(0), "a", "b").count() == 0
