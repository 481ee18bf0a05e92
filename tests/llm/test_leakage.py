import random

import numpy as np
import pytest

from brindle.llm import leakage as L


def test_common_subsequence_equals_brute_force():
    rng = random.Random(1)
    for _ in range(200):
        a, b = (np.array([rng.randrange(4) for _ in range(rng.randrange(1, 12))], np.uint64) for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
        place = L.common_subsequence(a, b)
        hit = place[place >= 0]
        assert len(hit) == table[-1][-1] and (np.diff(hit) > 0).all() and all(a[i] == b[p] for i, p in enumerate(place) if p >= 0)


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: f"w{min(rng.randrange(900), rng.randrange(900))}"
    text = lambda n: [word() for _ in range(n)]
    items = [text(rng.choice([40, 60, 90])) for _ in range(12)]
    docs, want = [], set()
    for d in range(150):
        words = text(rng.randrange(5, 200))
        if d % 3 == 0:
            i = rng.randrange(len(items))
            n = rng.choice([20, 33, 40])
            a = rng.randrange(len(items[i]) - n + 1)
            passage = [w if k % 12 != 5 or rng.random() < 0.5 else "other" for k, w in enumerate(items[i][a : a + n])]
            at = rng.randrange(len(words))
            words[at:at] = [w.upper() + rng.choice([",", "", " **", "<br>", "\n# "]) for w in passage]
            if n > 20:
                want.add((d, i))
        docs.append((d, " ".join(words)))
    return docs, [(i, " ".join(w)) for i, w in enumerate(items)], want


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_planted_passages(spark, seed):
    docs, items, want = corpus(seed)
    d = spark.createDataFrame([(k, t, 0) for k, t in docs], "doc_id long, text string, item_id int")
    i = spark.createDataFrame([(k, t, "b", "test", 1) for k, t in items], "item_id long, text string, benchmark string, split string, doc_id int")
    got = [tuple(r) for r in L.leaked_passages(d, i).collect()]
    assert len(got) == len(set(got)) and set(got) <= want and len(got) >= 0.97 * len(want)
    report = L.leak_report(d, i.drop("doc_id")).first()
    assert report["items"] == 12 and report["documents"] == len({x for x, _ in got})


def test_edges(spark):
    zh = "断网重连后，水泵会锁住空列。同事觉得应该复制一份再改，否则解析器还是覆盖空列，为什么面团切换冬令时后丢失空列，首次写入之前漏掉"
    docs = [(1, None), (2, ""), (3, "..."), (4, "x " * 50000 + zh[3:]), (4, "x " * 50000 + zh[3:]), (5, zh[:20]), (6, "one two three")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame([(7, zh), (8, None), (9, ""), (10, "One-Two, three!")], "item_id long, text string")
    assert sorted(tuple(r) for r in L.leaked_passages(d, i).collect()) == [(4, 7), (6, 10)]
    assert L.leaked_passages(d.limit(0), i).count() == 0 and L.leaked_passages(d, i.limit(0)).count() == 0


def test_items_in_blocks(spark, monkeypatch):
    docs, items, _ = corpus(4)
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    whole = sorted(tuple(r) for r in L.leaked_passages(d, i).collect())
    monkeypatch.setattr(L, "ITEMS", 5)
    assert whole and sorted(tuple(r) for r in L.leaked_passages(d, i).collect()) == whole


def test_subsequence_lengths_equal_alignment():
    rng = np.random.default_rng(5)
    for width in (5, 14, 28, 60):
        a, b = rng.integers(0, 6, (50, width)).astype(np.uint32), rng.integers(0, 6, (50, width + 4)).astype(np.uint32)
        got = L.subsequence_lengths(a, iter(b.T))
        assert got.tolist() == [int((L.common_subsequence(x, y) >= 0).sum()) for x, y in zip(a, b)]


def test_passages_with_insertions_and_omissions(spark):
    """A paraphrase that inserts and omits words shifts all later ones; at least 0.9 of such passages are found."""
    docs, items, _ = corpus(6)
    rng, want = random.Random(9), set()
    docs = [(k, t) for k, t in docs if k % 3]
    for k in range(1000, 1060):
        i = rng.randrange(len(items))
        words = items[i][1].split()[:36]
        del words[rng.randrange(8, 12)]
        words.insert(rng.randrange(20, 26), "inserted")
        docs.append((k, f"{docs[k % 50][1]} {' '.join(words)} {docs[k % 40][1]}"))
        want.add((k, i))
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {tuple(r) for r in L.leaked_passages(d, i).collect()}
    assert got <= want and len(got) >= 0.9 * len(want)
