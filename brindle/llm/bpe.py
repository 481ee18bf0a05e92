"""Encoding of a corpus with a public byte-level BPE vocabulary by a tokenization automaton.

The merges are compiled, in the order of their priority, into a deterministic automaton whose arcs are labelled with tokens and
which accepts exactly the sequences that byte-pair encoding produces. Each merge (u, v) adds the arc label uv and a gadget that
forbids v's left spine after u's right spine while both stand on the boundary; a state is the token last read, and whether an
arc leaves it is settled by the gadgets once and kept in the transition table. Since the sequences are prefix-closed, every
prefix of a word ends in one state, so a word is encoded left to right by table lookups, without trying merges. Decoding emits
the labels of the arcs.

The vocabulary file's path is a parameter; its content (under VOCABULARY_BYTES) is broadcast, so executors need no file.

Cases: null and empty texts give an empty list; blank texts are encoded like others; special tokens' strings are ordinary text;
texts of any length are encoded whole; repeated rows give repeated results.
"""

from __future__ import annotations

import functools
import itertools
import json
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from brindle.session import widened

VOCABULARY_BYTES, KEPT_WORDS = 16 << 20, 200_000
DEFAULT_PATH = "/opt/tokenizers/byte_bpe_50k.json"
# Fixed value: the pre-splitting pattern of the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_of() -> dict[str, int]:
    """Byte of each printable stand-in of the file format: printable bytes stand for themselves, the others follow from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class TokenizationAutomaton:
    """Deterministic automaton over tokens of a byte-level BPE vocabulary."""

    def __init__(self, content: str) -> None:
        model = json.loads(content)["model"]
        byte_of = _byte_of()
        raw = lambda text: bytes(byte_of[c] for c in text)
        self.id_of: dict[bytes, int] = {}
        self.label: dict[int, bytes] = {}
        known = {raw(t): i for t, i in model["vocab"].items() if all(c in byte_of for c in t)}
        for b in range(256):  # the automaton before any merge: one state per byte, all arcs
            self._arc(bytes([b]), known[bytes([b])])
        #: token -> (left part, right part, time at which it comes into being)
        self.parts: dict[int, tuple[int, int, int]] = {}
        self.gadget: dict[tuple[int, int], int] = {}
        for time, pair in enumerate(model["merges"]):
            u, v = (raw(x) for x in (pair if isinstance(pair, list) else pair.split(" ")))
            uv = known.get(u + v)
            if uv is None or u not in self.id_of or v not in self.id_of:
                continue
            self._arc(u + v, uv)
            self.parts.setdefault(uv, (self.id_of[u], self.id_of[v], time))
            self.gadget.setdefault((self.id_of[u], self.id_of[v]), time)
        lengths: dict[bytes, set[int]] = {}
        for label in self.id_of:
            lengths.setdefault(label[-2:], set()).add(len(label))
        #: lengths of the labels that end in two bytes, longest first; every one-byte label is an arc
        self.lengths = {k: (*sorted(v | {1}, reverse=True),) for k, v in lengths.items() if len(k) == 2}
        self.spines: dict[tuple[int, int], list[tuple[int, int, float]]] = {}
        self.table: dict[tuple[int, int], bool] = {}
        self.stands: dict[int, bool] = {}
        for t in sorted(self.parts, key=lambda t: self.parts[t][2]):
            left, right, time = self.parts[t]
            self.stands[t] = self.stands.get(left, True) and self.stands.get(right, True) and self._meets(left, right, time)

    def _arc(self, label: bytes, token: int) -> None:
        self.id_of[label] = token
        self.label[token] = label

    def _spine(self, token: int, side: int) -> list[tuple[int, int, float]]:
        """(token, time it comes, time it is merged away) of those that stand at the left (0) or right (1) end of a token."""
        key = (token, side)
        if key not in self.spines:
            out, end, at = [], float("inf"), token
            while True:
                parts = self.parts.get(at)
                out.append((at, -1 if parts is None else parts[2], end))
                if parts is None:
                    break
                at, end = parts[side], parts[2]
            self.spines[key] = out
        return self.spines[key]

    def _meets(self, a: int, b: int, until: float = float("inf")) -> bool:
        """Whether b can follow a: no merge across the boundary comes due, before `until`, while both its tokens stand there."""
        right = self._spine(b, 0)
        for x, x_from, x_to in self._spine(a, 1):
            for y, y_from, y_to in right:
                time = self.gadget.get((x, y))
                # of equal merges the leftmost goes first: one that consumes x goes before, one that consumes y after
                if time is not None and x_from < time and y_from < time and time < x_to and time <= y_to and time < until:
                    return False
        return True

    def follows(self, a: int, b: int) -> bool:
        """Transition table: whether the arc b leaves state a."""
        ok = self.table.get((a, b))
        if ok is None:
            if len(self.table) > 4_000_000:  # bounds a worker's memory; entries are computed again when needed
                self.table.clear()
            ok = self.table[a, b] = self._meets(a, b)
        return ok

    def encode_word(self, word: bytes) -> tuple[int, ...]:
        """Tokens of a pre-split word: the state after each prefix, then the path back."""
        whole = self.id_of.get(word)
        if whole is not None and self.stands.get(whole, True):
            return (whole,)
        n, get, follows, stands, lengths = len(word), self.id_of.get, self.follows, self.stands, self.lengths
        states, starts = [-1] * (n + 1), [0] * (n + 1)
        for end in range(1, n + 1):
            for length in lengths.get(word[max(0, end - 2) : end], (1,)):
                start = end - length
                if start < 0:
                    continue
                token = get(word[start:end])
                if token is not None and stands.get(token, True) and (start == 0 or follows(states[start], token)):
                    states[end], starts[end] = token, start
                    break
        out, at = [], n
        while at:
            out.append(states[at])
            at = starts[at]
        return tuple(reversed(out))

    def decode(self, ids: list[int]) -> bytes:
        """Labels of the arcs of a path."""
        return b"".join(map(self.label.__getitem__, ids))


class Words(dict):
    """Encoded words; a missing one is encoded. Emptied where it grows beyond KEPT_WORDS."""

    def __init__(self, automaton: TokenizationAutomaton) -> None:
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: str) -> tuple[int, ...]:
        ids = self.automaton.encode_word(word.encode("utf-8", "replace"))
        if len(word) <= 64:
            if len(self) >= KEPT_WORDS:
                self.clear()
            self[word] = ids
        return ids


@functools.lru_cache(maxsize=2)
def compiled(content: str) -> Words:
    return Words(TokenizationAutomaton(content))


_split = regex.compile(PATTERN).findall


def encode_text(text: str, words: Words) -> list[int]:
    return list(itertools.chain.from_iterable(map(words.__getitem__, _split(text))))


def _content(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        content = f.read(VOCABULARY_BYTES + 1)
    if len(content) > VOCABULARY_BYTES:
        raise ValueError(f"{path} is no vocabulary: it has more than {VOCABULARY_BYTES} characters")
    return content


def encode(df: DataFrame, key: str, column: str, path: str = DEFAULT_PATH) -> DataFrame:
    """(key, ids) of every row, without special tokens. One pass, no shuffle."""
    flat = df.select(F.col(key).alias("key"), F.col(column).cast("string").alias("text"))
    kind = dict(flat.dtypes)["key"]
    shared = df.sparkSession.sparkContext.broadcast(_content(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = compiled(shared.value)
        for whole in batches:
            for start in range(0, whole.num_rows, 2000):
                b = whole.slice(start, 2000)
                lists = [encode_text(t, words) if t else [] for t in b.column("text").to_pylist()]
                offsets = list(itertools.accumulate(map(len, lists), initial=0))
                ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(list(itertools.chain.from_iterable(lists)), pa.int32()))
                yield pa.RecordBatch.from_arrays([b.column("key"), ids], names=["key", "ids"])

    return widened(flat).mapInArrow(run, f"key {kind}, ids array<int>")


def decode(df: DataFrame, key: str, column: str, path: str = DEFAULT_PATH) -> DataFrame:
    """(key, text) of token id lists; bytes that aren't valid text become U+FFFD. Null lists give null."""
    flat = df.select(F.col(key).alias("key"), F.col(column).alias("ids"))
    kind = dict(flat.dtypes)["key"]
    shared = df.sparkSession.sparkContext.broadcast(_content(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = compiled(shared.value).automaton
        for b in batches:
            texts = [None if x is None else automaton.decode(x).decode("utf-8", "replace") for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(texts, pa.string())], names=["key", "text"])

    return flat.mapInArrow(run, f"key {kind}, text string")
