"""Grams of texts in Python workers, their vocabularies, and the leading components of TF-IDF in one barrier stage."""

from __future__ import annotations

import re
import tempfile
from collections import Counter
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from brindle.operators.group import Group, together
from brindle.session import checkpoint

_TOKEN = re.compile("[A-Za-z0-9]+|[一-鿿]")
HELD = 500_000  # grams that a task holds before it passes them on
BLOCK, BASIS, SMALL = 32, 480, 1_000  # vectors a pass, vectors before a restart, columns that are decomposed at once
ROWS, DENSE = 128, 0.03  # rows decoded at a time; columns that so many rows have are multiplied as a dense matrix


def words_of(text: str) -> list[str]:
    """Words and pairs of neighbouring words, as features.word_grams."""
    w = _TOKEN.findall(text.lower())
    return w + [f"{a} {b}" for a, b in zip(w, w[1:])]


def characters_of(text: str) -> list[str]:
    """Substrings of 2 to 5 characters, as features.char_grams."""
    pairs = list(map(str.__add__, text, text[1:]))
    threes = list(map(str.__add__, pairs, text[2:]))
    fours = list(map(str.__add__, threes, text[3:]))
    return pairs + threes + fours + list(map(str.__add__, fours, text[4:]))


OF = (words_of, characters_of)


def vocabularies(texts: DataFrame, size: int, min_df: int = 2) -> tuple[list[tuple[list[str], list[int]]], int]:
    """For words and for characters the `size` most frequent grams (of equals the first by name) with the rows that have them; all rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, uses, having = 0, [Counter(), Counter()], [Counter(), Counter()]

        def told() -> Iterator[pa.RecordBatch]:
            for kind in (0, 1):
                n = len(uses[kind])
                yield pa.RecordBatch.from_arrays([pa.array([kind] * n, pa.int32()), pa.array(list(uses[kind]), pa.string()), pa.array(list(uses[kind].values()), pa.int64()), pa.array([having[kind][g] for g in uses[kind]], pa.int64())], ["kind", "gram", "uses", "df"])
                uses[kind], having[kind] = Counter(), Counter()

        for batch in batches:
            for text in batch.column(0).to_pylist():
                rows += 1
                for kind in (0, 1):
                    grams = OF[kind](text)
                    uses[kind].update(grams)
                    having[kind].update(set(grams))
                if len(uses[1]) > HELD:
                    yield from told()
        yield from told()
        yield pa.RecordBatch.from_arrays([pa.array([2], pa.int32()), pa.array([""]), pa.array([rows], pa.int64()), pa.array([rows], pa.int64())], ["kind", "gram", "uses", "df"])

    each = texts.mapInArrow(count, "kind int, gram string, uses long, df long")
    kept = checkpoint(each.groupBy("kind", "gram").agg(F.sum("uses").alias("uses"), F.sum("df").alias("df")).where(f"df >= {min_df} or kind = 2"))
    out = []
    for kind in (0, 1):
        top = kept.where(f"kind = {kind}").orderBy(kept["uses"].desc(), "gram").limit(size).collect()
        out.append(([r["gram"] for r in top], [r["df"] for r in top]))
    return out, sum(r["uses"] for r in kept.where("kind = 2").collect())


def _coded(ids: np.ndarray) -> bytes:
    """Sorted numbers as differences in bytes; a byte of 255 only adds to the next."""
    d = np.diff(ids, prepend=0)
    more = d // 255
    if not more.any():
        return d.astype(np.uint8).tobytes()
    out = np.full(len(d) + int(more.sum()), 255, np.uint8)
    out[np.arange(len(d)) + np.cumsum(more)] = d % 255
    return out.tobytes()


def _decoded(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, number and how often of each distinct number of the rows that end at `ends` in `raw`."""
    starts = np.concatenate([[0], ends[:-1]])
    lengths = ends - starts
    upto = np.cumsum(raw, dtype=np.int64)
    before = np.concatenate([[0], upto])[starts]
    real = np.flatnonzero(raw != 255)
    row = np.repeat(np.arange(len(ends)), lengths)[real]
    number = upto[real] - before[row]
    first = np.ones(len(real), bool)
    first[1:] = (number[1:] != number[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(first)
    return row[at], number[at], np.diff(at, append=len(real))


def components(texts: DataFrame, vocabulary: list[list[str]], idf: list[np.ndarray], k: int) -> DataFrame:
    """(component, value, vector): the k leading singular values and right singular vectors of the rows' TF-IDF, words and characters each of length 1."""
    numbers = [{g: i + at for i, g in enumerate(v)} for v, at in zip(vocabulary, (0, len(vocabulary[0])))]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(0).to_pylist():
                ids = [i for of, known in zip(OF, numbers) for i in map(known.get, of(text)) if i is not None]
                out.append(_coded(np.sort(np.array(ids, np.int64))))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["grams"])

    words, both = len(vocabulary[0]), np.concatenate(idf)

    def work(group: Group, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (found := _decompose(group, batches, words, both, k)) is not None:
            for i, value in enumerate(found[1]):
                yield pa.RecordBatch.from_pydict({"component": pa.array([i], pa.int32()), "value": pa.array([value]), "vector": pa.ListArray.from_arrays(pa.array([0, len(both)], pa.int32()), pa.array(np.ascontiguousarray(found[0][:, i])))})

    return together(texts.mapInArrow(encode, "grams binary"), work, "component int, value double, vector array<double>")


class _Rows:
    """The rows of a task, mapped from a file."""

    def __init__(self, file, batches: Iterator[pa.RecordBatch], words: int, idf: np.ndarray):
        self.idf, ends, at = idf, [], 0
        for batch in batches:
            for row in batch.column(0):
                file.write(data := row.as_py())
                at += len(data)
                ends.append(at)
        file.flush()
        self.ends = np.array(ends, np.int64)
        self.raw = np.memmap(file, np.uint8, "r", 0, (at,)) if at else np.zeros(0, np.uint8)
        self.words = words
        having = np.zeros(len(idf), np.int64)
        for _, _, column, _ in self:
            having += np.bincount(column, minlength=len(idf))
        self.dense = np.flatnonzero(having > DENSE * max(len(ends), 1))
        self.place = np.full(len(idf), -1)
        self.place[self.dense] = np.arange(len(self.dense))

    def __iter__(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Some rows at a time: how many, and row, column and value of what they have."""
        for a in range(0, len(self.ends), ROWS):
            ends = self.ends[a : a + ROWS]
            start = self.ends[a - 1] if a else 0
            row, column, times = _decoded(self.raw[start : ends[-1]], ends - start)
            value = times * self.idf[column]
            part = 2 * row + (column >= self.words)
            length = np.sqrt(np.bincount(part, value * value, 2 * len(ends)))
            yield len(ends), row, column, value / length[part]

    def product(self, q: np.ndarray) -> np.ndarray:
        """A' A q."""
        out, q_dense = np.zeros(q.shape), q[self.dense]
        out_dense = np.zeros(q_dense.shape)
        for n, row, column, value in self:
            place = self.place[column]
            at, rare = np.flatnonzero(place >= 0), np.flatnonzero(place < 0)
            block = np.zeros((n, len(self.dense)))
            block[row[at], place[at]] = value[at]
            y = block @ q_dense
            row, column, value = row[rare], column[rare], value[rare]
            cut = np.searchsorted(row, np.arange(n + 1))
            for k, (i, j) in enumerate(zip(cut[:-1], cut[1:])):
                y[k] += value[i:j] @ q[column[i:j]]
                out[column[i:j]] += np.outer(value[i:j], y[k])
            out_dense += block.T @ y
        out[self.dense] += out_dense
        return out


def _decompose(group: Group, batches: Iterator[pa.RecordBatch], words: int, idf: np.ndarray, k: int) -> Any:
    """Block Lanczos with full orthogonalisation and thick restarts; task 0 holds the basis."""
    with tempfile.TemporaryFile() as file:
        rows, m = _Rows(file, batches, words, idf), len(idf)
        n = group.shared(sum(group.gathered(len(rows.ends)) or []))
        k = max(1, min(k, m - 1, n - 1))
        if m <= SMALL:
            whole = group.total(rows.product(np.eye(m)))
            return _leading(np.eye(m), whole, k) if whole is not None else None
        if group.rank:
            while (q := group.shared()) is not None:
                group.total(rows.product(q))
            return None
        room, h, d = np.zeros((m, max(BASIS, k + 3 * BLOCK) + 2 * BLOCK), order="F"), np.zeros((0, 0)), 0
        q, before = np.linalg.qr(np.random.default_rng(7).standard_normal((m, BLOCK)))[0], None
        while True:
            z = group.total(rows.product(group.shared(np.ascontiguousarray(q))))
            room[:, d : d + BLOCK] = q
            basis = room[:, : d + BLOCK]
            new = basis.T @ z
            h = np.block([[h, new[:d]], [new[:d].T, (new[d:] + new[d:].T) / 2]])
            z -= basis @ new
            d += BLOCK
            if d >= k:
                now = np.linalg.eigvalsh(h)[::-1][:k]
                if d + BLOCK > m or before is not None and np.all(np.abs(now - before) <= 1e-8 * now + 1e-12 * now[0]):
                    group.shared(None)
                    return _leading(basis, h, k)
                before = now
            if d >= max(BASIS, k + 3 * BLOCK):
                top, turn = np.linalg.eigh(h)
                d = k + BLOCK
                for a in range(0, m, 4096):
                    basis[a : a + 4096, :d] = basis[a : a + 4096] @ turn[:, -d:]
                basis, h = room[:, :d], np.diag(top[-d:])
            for _ in range(2):  # what is left of a block of dependent columns is put at right angles too
                z = np.linalg.qr(z - basis @ (basis.T @ z))[0]
            q = z


def _leading(basis: np.ndarray, h: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    values, turn = np.linalg.eigh(h)
    return basis @ turn[:, ::-1][:, :k], np.sqrt(np.maximum(values[::-1][:k], 0.0))
