"""Evaluation passages inside a training corpus, by latent semantic retrieval and exact alignment.

1. Texts become word sequences without markup, case, punctuation and look-alikes (an ideograph is a word).
2. Passages of the corpus are TF-IDF vectors over FEATURES hashed words. A distributed randomised SVD gives their latent space:
   with O a random matrix that adds each passage, with a sign, to one of SKETCH rows, every task computes its part of O A while it
   cuts its texts into words; the sum spans nearly the row space of A, and its leading right singular vectors are the basis.
   Document frequencies scale its columns afterwards, so one pass serves both. They cover the whole corpus; what reaches the
   driver is of fixed size (SKETCH x FEATURES).
3. Every document is cut into chunks, and the latent vector of each is compared with those of the items' windows at every
   position: windows are grouped around centroids, a chunk meets the windows of the PROBES nearest ones, and pairs of cosine
   COSINE or more are candidates.
4. Of a candidate, the longest common subsequence of the window and the chunk with its neighbours (bit-parallel, for all
   candidates at once) has to reach ALIKE of the window, in any place, so insertions and omissions don't hide a passage. Then
   the longest common subsequence of item and document around it is aligned, and the answer check asks for a passage of
   MIN_WORDS consecutive item words (MIN_HAN characters for Chinese items, letters and digits counted), or the whole item, with
   at most one word in ten replaced.

The chunks of an item are at most half as long as its shortest passage that counts, so any such passage has a whole chunk
inside it, whatever its position; candidates only depend on COSINE and PROBES. The items are a stated query set, searched in
blocks of about ITEMS, each broadcast.

Cases: null and wordless texts are no case; repeated rows and items are found as often as they occur, pairs of ids once;
texts of any length are searched whole; an empty corpus or item table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from brindle.llm import codepoints as C
from brindle.llm.nearwords import mix, words
from brindle.session import checkpoint, widened

FEATURES, RANK, SKETCH, PASSAGE, WIDTHS, PROBES = 8192, 64, 256, 28, (14, 10, 7, 5, 3, 2, 1), 4
COSINE, ALIKE, MIN_WORDS, MIN_HAN, REPLACED, ITEMS = 0.7, 0.78, 28, 38, 0.1, 20_000
BLOCK_FEATURES, MARGIN = 256, 2
_MARKUP = r"</?[A-Za-z][^<>]*>|&[A-Za-z]+;|&#\d+;|_"


class Sequences:
    """Words of a batch of texts: 32-bit hashes, rows, offsets of the rows; of texts also each word's characters."""

    def __init__(self, column: pa.Array) -> None:
        if pa.types.is_list(column.type):
            self.hash = np.asarray(column.flatten()).view(np.uint32)
            counts = np.diff(np.asarray(column.offsets)).astype(np.int64)
            self.n = len(column)
            self.row = np.repeat(np.arange(self.n), counts)
        else:
            column = pc.replace_substring_regex(column.cast(pa.string()).fill_null(""), pattern=_MARKUP, replacement=" ")
            points, rows = C.normal_form(*C.decode(column))
            hashes, self.row, first, ends = words(points, rows)
            self.hash = (hashes >> np.uint64(32)).astype(np.uint32)
            self.n = len(column)
            self.size = ends - first
            self.han = (self.size == 1) & (points[first] >= 0x3400) if len(first) else np.zeros(0, bool)
            counts = np.bincount(self.row, minlength=self.n)
        self.at = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
        self.feature = (self.hash % np.uint32(FEATURES)).astype(np.int64)

    def chunks(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Start of each chunk of `width` words (the last of a text may be shorter), and the chunk of each word."""
        within = np.arange(len(self.hash)) - self.at[self.row]
        starts = within % width == 0
        return np.flatnonzero(starts), np.cumsum(starts) - 1


def word_sequences(docs: DataFrame) -> DataFrame:
    """(doc_id, words, block, part) of (doc_id, text): hashed words in order, of every text that has one; and of each task its
    part of the sketch O A and the passages of each feature, in blocks of features (block -1: number of passages)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, df, n = np.zeros(SKETCH * FEATURES), np.zeros(FEATURES, np.int64), 0
        names = ["doc_id", "words", "block", "part"]
        for whole in batches:
            for start in range(0, whole.num_rows, 2000):
                b = whole.slice(start, 2000)
                s = Sequences(b.column("text"))
                if not len(s.hash):
                    continue
                lists = pa.ListArray.from_arrays(pa.array(s.at, pa.int32()), pa.array(s.hash.view(np.int32)))
                keep = pa.array(np.diff(s.at) > 0)
                ids = b.column("doc_id").filter(keep)
                yield pa.RecordBatch.from_arrays([ids, lists.filter(keep), pa.nulls(len(ids), pa.int32()), pa.nulls(len(ids), pa.binary())], names=names)
                starts, chunk = s.chunks(PASSAGE)
                drawn = mix(np.add.reduceat(mix(s.hash), starts))  # by content: any partitioning gives the same sketch
                sign, bucket = np.where(drawn >> np.uint64(63), 1.0, -1.0), (drawn % np.uint64(SKETCH)).astype(np.int64)
                sketch += np.bincount(bucket[chunk] * FEATURES + s.feature, weights=sign[chunk], minlength=len(sketch))
                df += np.bincount(np.unique(chunk * FEATURES + s.feature) % FEATURES, minlength=FEATURES)
                n += len(starts)
        if n:
            blocks = FEATURES // BLOCK_FEATURES
            columns, counts = sketch.reshape(SKETCH, blocks, BLOCK_FEATURES).astype(np.float32), df.reshape(blocks, BLOCK_FEATURES)
            parts = [np.int64(n).tobytes(), *(counts[i].tobytes() + columns[:, i].tobytes() for i in range(blocks))]
            yield pa.RecordBatch.from_arrays([pa.nulls(blocks + 1, pa.int64()), pa.nulls(blocks + 1, pa.list_(pa.int32())), pa.array(range(-1, blocks), pa.int32()), pa.array(parts, pa.binary())], names=names)

    return docs.mapInArrow(run, "doc_id long, words array<int>, block int, part binary")


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts of equal block added up."""
    counts: dict[int, np.ndarray] = {}
    columns: dict[int, np.ndarray] = {}
    for b in batches:
        for block, part in zip(b.column(0).to_pylist(), b.column(1)):
            raw = part.as_buffer()
            k = 1 if block < 0 else BLOCK_FEATURES
            c, x = np.frombuffer(raw, np.int64, k), np.frombuffer(raw, np.float32, -1, 8 * k).astype(np.float64)
            counts[block] = counts[block] + c if block in counts else c
            columns[block] = columns[block] + x if block in columns else x
    for block, c in counts.items():
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([c.tobytes() + columns[block].astype(np.float32).tobytes()], pa.binary())], names=["block", "part"])


def latent_space(parts: DataFrame) -> np.ndarray:
    """Latent vector (RANK) of every feature, its idf included, from the tasks' parts (block, part) of the sketch."""
    kind, blocks = "block int, part binary", FEATURES // BLOCK_FEATURES
    salted = parts.select("block", "part", F.pmod(F.xxhash64("part"), F.lit(16)).alias("salt")).repartition(blocks, "block", "salt").select("block", "part")
    sketch, df, n = np.zeros((SKETCH, FEATURES)), np.zeros(FEATURES, np.int64), 0
    for r in salted.mapInArrow(_sums, kind).repartition(blocks, "block").mapInArrow(_sums, kind).toLocalIterator():
        at = r["block"] * BLOCK_FEATURES
        if at < 0:
            n = int(np.frombuffer(r["part"], np.int64)[0])
        else:
            df[at : at + BLOCK_FEATURES] = np.frombuffer(r["part"], np.int64, BLOCK_FEATURES)
            sketch[:, at : at + BLOCK_FEATURES] = np.frombuffer(r["part"], np.float32, -1, 8 * BLOCK_FEATURES).reshape(SKETCH, BLOCK_FEATURES)
    idf = np.log((n + 1) / (df + 1))
    basis = np.linalg.svd(sketch * idf, full_matrices=False)[2][:RANK]
    return (basis.T * idf[:, None]).astype(np.float32)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def common_subsequence(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each word of a, the position in b that a longest common subsequence gives it, or -1."""
    n, m = len(a), len(b)
    same = a[:, None] == b[None, :]
    best = np.zeros((n + 1, m + 1), np.int32)
    for i in range(n - 1, -1, -1):
        step = np.where(same[i], best[i + 1, 1:] + 1, best[i + 1, :-1])
        best[i, :-1] = np.maximum.accumulate(np.maximum(step, best[i + 1, :-1])[::-1])[::-1]
    out = np.full(n, -1, np.int64)
    i = j = 0
    while i < n and j < m:
        if same[i, j] and best[i, j] == best[i + 1, j + 1] + 1:
            out[i] = j
            i, j = i + 1, j + 1
        elif best[i + 1, j] >= best[i, j + 1]:
            i += 1
        else:
            j += 1
    return out


def contains(item: np.ndarray, weight: np.ndarray, need: int, around: np.ndarray) -> bool:
    """Whether words `around` hold consecutive item words of `need` units in all (or the whole item), one in ten replaced."""
    place = common_subsequence(item, around)
    hit = np.flatnonzero(place >= 0)
    units = np.concatenate([[0], np.cumsum(weight)])
    need = min(need, int(units[-1]))
    if weight[hit].sum() < need * (1 - REPLACED) ** 2:
        return False
    got = np.concatenate([[0], np.cumsum(weight[hit])])
    for x in range(len(hit)):
        for y in range(len(hit) - 1, x - 1, -1):
            if got[y + 1] - got[x] < need * (1 - REPLACED):
                break
            a, b = hit[x], hit[y]
            length = b - a + 1
            whole = a <= REPLACED * len(item) and len(item) - 1 - b <= REPLACED * len(item)
            if (units[b + 1] - units[a] >= need or whole) and y - x + 1 >= (1 - REPLACED) * length - 1e-9 and place[b] - place[a] + 1 <= 1.3 * length + 4:
                return True
    return False


def centroids(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit centroids of about as many groups as a group has members, and the group of each row: spherical k-means."""
    k = int(np.ceil(len(x) ** 0.5))
    c = x[np.random.default_rng(11).permutation(len(x))[:k]]
    for _ in range(8):
        of = np.concatenate([(x[i : i + 8192] @ c.T).argmax(1) for i in range(0, len(x), 8192)])
        sums = np.zeros_like(c)
        np.add.at(sums, of, x)
        c = np.where(np.linalg.norm(sums, axis=1, keepdims=True) > 1e-6, _unit(sums), c)
    return c, np.concatenate([(x[i : i + 8192] @ c.T).argmax(1) for i in range(0, len(x), 8192)])


class Windows:
    """Latent windows of `width` words of the items: all those inside a shortest passage that is searched by chunks of that width."""

    def __init__(self, width: int, q: Sequences, ends: np.ndarray, widths: np.ndarray, vectors: np.ndarray) -> None:
        self.width = width
        #: end of the shortest passage that begins at a word of an item, 0 where there is none of this width
        self.ends = np.where(widths == width, ends, 0)
        at = np.arange(len(ends))
        self.longest = int((self.ends - at).max())
        fewest, most = np.full(len(ends), 1 << 30), np.zeros(len(ends), np.int64)
        for k in range(self.longest - width + 1):
            x = np.maximum(at - k, 0)
            inside = (at >= k) & (self.ends[x] >= at + width)
            size = self.ends[x] - x
            fewest = np.where(inside, np.minimum(fewest, size), fewest)
            most = np.where(inside, np.maximum(most, size), most)
        start = np.flatnonzero(most)
        x = np.zeros((len(start), vectors.shape[1]), np.float32)
        for k in range(width):
            x += vectors[q.feature[start + k]]
        x = _unit(x)
        self.centroids, of = centroids(x)
        order = np.argsort(of, kind="stable")
        self.start, self.latent = start[order], x[order]
        self.fewest, self.reach = fewest[self.start], most[self.start] - width
        self.cut = np.searchsorted(of[order], np.arange(len(self.centroids) + 1))
        self.item = q.row[self.start]
        self.words = np.stack([q.hash[self.start + k] for k in range(width)], 1)
        self.need = int(np.ceil(ALIKE * width - 1e-9))
        self.member = np.zeros(1 << 16, bool)
        self.member[self.words.ravel() & np.uint32(0xFFFF)] = True
        self.bits = (self.words >> np.uint32(7)).astype(np.uint8) & np.uint8(63)

    def candidates(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (row of x, window) of cosine COSINE or more among the windows of the PROBES nearest centroids."""
        near = x @ self.centroids.T
        rows, groups = [], []
        for _ in range(min(PROBES, len(self.centroids))):
            best = near.argmax(1)
            rows.append(np.arange(len(x)))
            groups.append(best)
            near[rows[-1], best] = -2
        row, group = np.concatenate(rows), np.concatenate(groups).astype(np.uint16 if len(self.centroids) < 1 << 16 else np.int64)
        order = np.argsort(group, kind="stable")
        row, group = row[order], group[order]
        cuts = np.flatnonzero(np.diff(group.astype(np.int64), prepend=-1))
        left, right = [], []
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(group)]):
            low, high = self.cut[group[a]], self.cut[group[a] + 1]
            i, j = np.nonzero(x[row[a:b]] @ self.latent[low:high].T >= COSINE)
            left.append(row[a:b][i])
            right.append(low + j)
        return (np.concatenate(left), np.concatenate(right)) if left else (row[:0], row[:0])

    def alike(self, doc: np.ndarray, at: np.ndarray, window: np.ndarray, seen: np.ndarray) -> np.ndarray:
        """Candidates whose window and the words from `at` on have a common subsequence of ALIKE of the window.

        `seen` holds the words of each chunk as 64 bits: window words without their bit bound the subsequence from above.
        """
        need = self.need
        bound = np.zeros(len(at), np.uint8)
        for k in range(self.width):
            bound += (seen >> self.bits[window, k]).astype(np.uint8) & np.uint8(1)
        some = np.flatnonzero(bound >= need)
        p, words_ = at[some], self.words[window[some]]
        around = (doc[np.clip(p + j, 0, len(doc) - 1)] for j in range(-MARGIN, self.width + MARGIN))
        return some[subsequence_lengths(words_, around) >= need]


def subsequence_lengths(words_: np.ndarray, others) -> np.ndarray:
    """Length of a longest common subsequence of each row of up to 64 words with the words that `others` yields, column by column."""
    bits, kind = next((b, t) for b, t in ((16, np.uint16), (32, np.uint32), (64, np.uint64)) if words_.shape[1] <= b)
    wide = np.zeros((len(words_), bits), words_.dtype)
    wide[:, : words_.shape[1]] = words_
    full = kind((1 << words_.shape[1]) - 1)
    v = np.full(len(words_), full, kind)
    for w in others:
        u = v & np.packbits(wide == w[:, None], axis=1, bitorder="little").view(kind)[:, 0]
        v = (v + u) | (v - u)
    return np.bitwise_count(~v & full)


class Search:
    """The items of one block, ready to be found in word sequences."""

    def __init__(self, ids: np.ndarray, q: Sequences, vectors: np.ndarray) -> None:
        self.ids, self.vectors, self.hash, self.at = ids, vectors, q.hash, q.at
        sizes = np.diff(q.at)
        chinese = np.array([q.han[a:b].sum() * 3 >= b - a for a, b in zip(q.at[:-1], q.at[1:])])
        self.weight, self.need = np.where(chinese[q.row], q.size, 1), np.where(chinese, MIN_HAN, MIN_WORDS)
        ends = np.zeros(len(q.hash), np.int64)
        for i in np.flatnonzero(sizes):
            low, high = q.at[i], q.at[i + 1]
            units = np.concatenate([[0], np.cumsum(self.weight[low:high])])
            stop = np.searchsorted(units, units[:-1] + self.need[i])  # enough units
            whole = np.arange(high - low) + int(np.ceil((1 - 2 * REPLACED) * (high - low) - 1e-9))  # or what counts as the whole item
            stop = np.where(whole < stop, whole, stop)
            ends[low:high] = np.where(stop <= high - low, stop + low, 0)
        size = ends - np.arange(len(ends))
        widths = np.zeros(len(ends), np.int64)
        for w in reversed(WIDTHS):
            widths[(ends > 0) & ((size + 1) // 2 >= w)] = w
        self.windows = [Windows(w, q, ends, widths, vectors) for w in WIDTHS if (widths == w).any()]

    def _passage(self, s: Sequences, at: np.ndarray, w: Windows, window: np.ndarray) -> np.ndarray:
        """Candidates around which a passage that counts can lie, by the length of common subsequences.

        First of all words that the passages around the window can need, then, of those left, of each of these passages (two
        more words may be replaced in it than in ten on average).
        """
        ok = np.zeros(len(at), bool)
        for n in np.unique(w.reach[window]).tolist():  # item words to either side: at most two widths and what fits 64 bits
            some = np.flatnonzero(w.reach[window] == n)
            n = min(n, (64 - w.width) // 2)
            i, p, a, fewest = w.item[window[some]], at[some], w.start[window[some]], w.fewest[window[some]]
            some = some[self._common(s, i, p, a - n, a + w.width + n, w.width + 2 * n, n) >= np.ceil((1 - REPLACED) * fewest - 1e-9) - 2]
            p, a, i = at[some], w.start[window[some]], w.item[window[some]]
            for k in range(w.longest - w.width + 1):
                x = np.maximum(a - k, 0)
                end = w.ends[x]
                left = np.flatnonzero((x == a - k) & (end >= a + w.width) & ~ok[some])
                if not len(left):
                    continue
                size = end[left] - x[left]
                need = np.ceil((1 - REPLACED) * size - 1e-9) - 2
                ok[some[left[self._common(s, i[left], p[left], x[left], end[left], int(size.max()), k) >= need]]] = True
        return ok

    def _common(self, s: Sequences, item: np.ndarray, at: np.ndarray, start: np.ndarray, end: np.ndarray, width: int, before: int) -> np.ndarray:
        """Longest common subsequence of the item words from `start` to `end` (up to `width`) and the document's, which begin `before` words before `at`."""
        place = start[:, None] + np.arange(width)
        inside = (place >= self.at[item][:, None]) & (place < np.minimum(self.at[item + 1], end)[:, None])
        words_ = np.where(inside, self.hash[np.clip(place, 0, len(self.hash) - 1)], 0)
        row = s.row[at]
        low, high = s.at[row], s.at[row + 1]

        def near():
            for j in range(-before - MARGIN, width - before + MARGIN):
                q = at + j
                yield np.where((q >= low) & (q < high), s.hash[np.minimum(np.maximum(q, 0), len(s.hash) - 1)], 1)  # 0 and 1 never meet

        return subsequence_lengths(words_, near()).astype(np.int64)

    def found(self, s: Sequences) -> list[tuple[int, int]]:
        """(row, item) of the sequences that contain a passage of an item."""
        places: list[np.ndarray] = []
        size = np.diff(s.at)
        bit = np.uint64(1) << ((s.hash >> np.uint32(7)).astype(np.uint64) & np.uint64(63))
        for w in self.windows:
            chunks = size // w.width
            first = np.repeat(s.at[:-1] - np.concatenate([[0], np.cumsum(chunks)[:-1]]) * w.width, chunks) + np.arange(chunks.sum()) * w.width
            # chunks with enough words of the windows around: no other can be alike
            known = np.concatenate([[0], np.cumsum(w.member[s.hash & np.uint32(0xFFFF)])])
            first = first[known[np.minimum(first + w.width + MARGIN, len(s.hash))] - known[np.maximum(first - MARGIN, 0)] >= w.need]
            spots, windows = [], []
            for low in range(0, len(first), 16384):
                p = first[low : low + 16384]
                x = np.zeros((len(p), self.vectors.shape[1]), np.float32)
                seen = np.zeros(len(p), np.uint64)
                for k in range(-MARGIN, w.width + MARGIN):
                    at = p + k if 0 <= k < w.width else np.minimum(np.maximum(p + k, 0), len(s.hash) - 1)
                    seen |= bit[at]
                    if 0 <= k < w.width:
                        x += self.vectors[s.feature[at]]
                row, window = w.candidates(_unit(x))
                ok = w.alike(s.hash, p[row], window, seen[row])
                spots.append(p[row[ok]])
                windows.append(window[ok])
            if not spots:
                continue
            p, window = np.concatenate(spots), np.concatenate(windows)
            ok = self._passage(s, p, w, window)
            p, window = p[ok], window[ok]
            item = w.item[window]
            # row of the batch, item, place of the item's first word in the batch
            places.append(np.stack([s.row[p], item, p - (w.start[window] - self.at[item])], 1))
        out: set[tuple[int, int]] = set()
        for r, i, place in np.unique(np.concatenate(places), axis=0).tolist() if places else ():
            if (r, i) in out:
                continue
            a, b = self.at[i], self.at[i + 1]
            start, end = max(s.at[r], place - 12), min(s.at[r + 1], place + int(1.3 * (b - a)) + 16)
            if contains(self.hash[a:b], self.weight[a:b], int(self.need[i]), s.hash[start:end]):
                out.add((r, i))
        return sorted(out)


def leaked_passages(docs: DataFrame, items: DataFrame, doc_key: str = "doc_id", item_key: str = "item_id", column: str = "text") -> DataFrame:
    """(doc_id, item_id) of each document and item of which it contains the whole or a long passage."""
    spark = docs.sparkSession
    corpus = docs.select(F.col(doc_key).cast("long").alias("doc_id"), F.col(column).cast("string").alias("text")).where("text is not null")
    held = items.select(F.col(item_key).cast("long").alias("item_id"), F.col(column).cast("string").alias("text")).where("item_id is not null and text is not null")
    schema = "doc_id long, item_id long"
    total = held.count()
    if not total:
        return spark.createDataFrame([], schema)
    kept = checkpoint(word_sequences(widened(corpus)))  # read by the SVD and the search
    vectors = latent_space(kept.where("block is not null").select("block", "part"))
    sequences = widened(kept.where("block is null").select("doc_id", "words"))
    blocks = -(-total // ITEMS)
    found = None
    for k in range(blocks):
        some = held.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).toPandas()
        q = Sequences(pa.array(some["text"].tolist(), pa.string()))
        if not len(q.hash):
            continue
        one = sequences.mapInArrow(_searcher(spark.sparkContext.broadcast(Search(some["item_id"].to_numpy(), q, vectors))), schema)
        found = one if found is None else found.union(one)
    return spark.createDataFrame([], schema) if found is None else found.distinct()


def _searcher(shared):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for cut in range(0, whole.num_rows, 2000):
                b = whole.slice(cut, 2000)
                rows = shared.value.found(Sequences(b.column("words")))
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array([r for r, _ in rows], pa.int64())), pa.array([shared.value.ids[i] for _, i in rows], pa.int64())], names=["doc_id", "item_id"])

    return search


def leak_report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Per benchmark and split: items, leaked items and documents that contain one."""
    pairs = checkpoint(leaked_passages(docs, items))
    return items.select("item_id", "benchmark", "split").join(pairs, "item_id", "left").groupBy("benchmark", "split").agg(F.countDistinct("item_id").alias("items"), F.countDistinct(F.when(F.col("doc_id").isNotNull(), F.col("item_id"))).alias("leaked"), F.countDistinct("doc_id").alias("documents"))
