import random
from collections import Counter

import numpy as np

from brindle.operators import decompose as D, features as X


def _texts(n, seed=11):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefgh股票公司ñ") for _ in range(r.randrange(2, 7))) for _ in range(400)]
    return [" ".join(words[min(int(r.expovariate(0.01)), 399)] for _ in range(r.randrange(3, 20))) for _ in range(n)]


def _dense(texts, vocabulary, idf):
    a = np.zeros((len(texts), sum(map(len, vocabulary))))
    for i, t in enumerate(texts):
        at = 0
        for of, v, w in zip(D.OF, vocabulary, idf):
            c = Counter(of(t))
            part = np.array([c[g] for g in v]) * w
            a[i, at : at + len(v)] = part / (np.linalg.norm(part) or 1)
            at += len(v)
    return a


def test_grams_of_a_text():
    assert D.characters_of("abcdef") == [*["ab", "bc", "cd", "de", "ef"], *["abc", "bcd", "cde", "def"], "abcd", "bcde", "cdef", "abcde", "bcdef"]
    assert D.characters_of("a") == [] and D.words_of("A b, 中文") == ["a", "b", "中", "文", "a b", "b 中", "中 文"]


def test_grams_of_spark_and_of_python_are_equal(spark):
    texts = ["", "a", "ab\nc 😀x中文", "Ein Äpfel\r\n😀😀 $NVDA 3.5%", None]
    df = X.with_grams(spark.createDataFrame([(t, p) for t in texts for p in ("英伟达 | NVDA 😀", None)], "message_text string, profile string"))
    for r in df.select(X._text().alias("text"), "words", "characters").collect():
        assert Counter(r["characters"]) == Counter(D.characters_of(r["text"])) and Counter(r["words"]) == Counter(D.words_of(r["text"]))


def test_vocabulary_has_the_most_frequent_grams_of_all_rows(spark, monkeypatch):
    monkeypatch.setattr(D, "HELD", 50)  # a task passes its counts on many times
    texts = _texts(300)
    found, n = D.vocabularies(spark.createDataFrame([(t,) for t in texts], "text string").repartition(5), 200)
    assert n == 300
    for of, (grams, df) in zip(D.OF, found):
        uses, having = Counter(g for t in texts for g in of(t)), Counter(g for t in texts for g in set(of(t)))
        want = sorted((g for g in uses if having[g] >= 2), key=lambda g: (-uses[g], g.encode()))[:200]
        assert grams == want and df == [having[g] for g in want]


def test_numbers_in_bytes():
    rows = [np.array(x, np.int64) for x in ([], [0, 0, 254, 255, 255, 39_999], [510, 510, 765], [])]
    coded = [D._coded(x) for x in rows]
    row, number, times = D._decoded(np.frombuffer(b"".join(coded), np.uint8), np.cumsum([len(c) for c in coded]))
    assert [(int(a), int(b), int(c)) for a, b, c in zip(row, number, times)] == [(1, 0, 2), (1, 254, 1), (1, 255, 2), (1, 39_999, 1), (2, 510, 2), (2, 765, 1)]


def test_components_are_those_of_the_whole_matrix_in_one_job(spark, monkeypatch):
    """More columns than are decomposed at once, and restarts: as numpy has it, with as few jobs for any number of passes."""
    monkeypatch.setattr(D, "BASIS", 96)
    texts = [*_texts(700), "", "."]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(4)
    found, n = D.vocabularies(df, 1_500)
    vocabulary = [grams for grams, _ in found]
    idf = [np.log((1 + n) / (1 + np.array(d))) + 1 for _, d in found]
    assert sum(map(len, vocabulary)) > D.SMALL
    spark.sparkContext.setJobGroup("components", "")
    found = sorted(D.components(df, vocabulary, idf, 20).collect())
    vectors, values = np.array([r["vector"] for r in found]).T, [r["value"] for r in found]
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("components"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    a = _dense(texts, vocabulary, idf)
    assert jobs < 5 and np.allclose(values, np.linalg.svd(a, compute_uv=False)[:20], rtol=1e-6)
    assert np.allclose(vectors.T @ vectors, np.eye(20), atol=1e-8) and np.allclose(np.linalg.norm(a @ vectors, axis=0), values, rtol=1e-6)
