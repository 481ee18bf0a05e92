import json
import os
import random

import pytest

from brindle.llm import bpe

pytestmark = pytest.mark.skipif(not os.path.exists(bpe.DEFAULT_PATH), reason="needs the public vocabulary")


def library():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(bpe.DEFAULT_PATH)
    t.encode_special_tokens = True
    return t


def test_equals_the_library_on_random_texts():
    rng = random.Random(4)
    pool = [chr(c) for c in [*range(9, 14), *range(32, 0x500), *range(0x2000, 0x2070), *range(0x3000, 0x3100), *range(0x4E00, 0x4EFF), *range(0x1F300, 0x1F400), 0x85, 0xA0, 0xFEFF]]
    texts = ["".join(rng.choice(pool if rng.random() < 0.5 else "aabbcde  \n'st,.0123") for _ in range(rng.randrange(1, 80))) for _ in range(3000)] + ["<|endoftext|>", "a" * 5000, " " * 500, "\n\n  x", "aaaa" * 50]
    words = bpe.compiled(bpe._content(bpe.DEFAULT_PATH))
    assert [bpe.encode_text(t, words) for t in texts] == [e.ids for e in library().encode_batch(texts, add_special_tokens=False)]


def brute(word, merges, ids):
    parts = [bytes([b]) for b in word]
    while True:
        best = min(((merges[p], i) for i, p in enumerate(zip(parts, parts[1:])) if p in merges), default=None)
        if best is None:
            return tuple(ids[p] for p in parts)
        i = best[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


@pytest.mark.parametrize("seed", range(6))
def test_automaton_of_random_merges(seed):
    """Vocabularies of a few letters, where equal letters and late merges meet often."""
    rng = random.Random(seed)
    known, merges = [bytes([b]) for b in b"abc"], {}
    while len(merges) < 25:
        u, v = rng.choice(known), rng.choice(known)
        if (u, v) not in merges and len(u + v) < 8 and u + v not in known:
            merges[u, v] = len(merges)
            known.append(u + v)
    stand_in = {b: c for c, b in bpe._byte_of().items()}
    text = lambda x: "".join(stand_in[b] for b in x)
    vocab = {text(bytes([b])): b for b in range(256)} | {text(u + v): 256 + i for (u, v), i in merges.items()}
    automaton = bpe.TokenizationAutomaton(json.dumps({"model": {"vocab": vocab, "merges": [[text(u), text(v)] for u, v in merges]}}))
    for _ in range(2000):
        word = bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 14)))
        assert automaton.encode_word(word) == brute(word, merges, automaton.id_of)
        assert automaton.decode(list(automaton.encode_word(word))) == word


def test_columns(spark):
    rows = [(1, "Hello  world", 0), (2, None, 0), (3, "", 0), (4, " \n", 0), (1, "Hello  world", 0), (5, "日本 x" * 30000, 0)]
    df = spark.createDataFrame(rows, "id long, text string, key int")
    ids = bpe.encode(df, "id", "text")
    got = {r["key"]: r["ids"] for r in ids.collect()}
    assert got[2] == got[3] == [] and got[4] == library().encode(" \n").ids and ids.count() == 6
    assert dict(bpe.decode(ids, "key", "ids").collect()) == {k: t or "" for k, t, _ in rows}
    assert bpe.encode(df.limit(0), "id", "text").count() == 0
