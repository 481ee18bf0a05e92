"""Near-duplicate texts by the words they share, counting repeats and in any order.

Two texts are near-duplicates when at least SHARE of the words of the longer one occur in the other. A word's k-th occurrence
is an element of its own, so a text is a set of elements and the shared words are an exact set intersection.

1. Texts of equal elements are one class (an order-free 128-bit fingerprint); a third of all rows being copies of one text
   costs one representative.
2. Representatives are put into tiles, within which texts are kept sorted by size, so that only the band of sizes that can
   reach SHARE is swept. With `exact`, tiles are the elements of exact prefixes, rarest elements first: two texts that share
   SHARE share one of them, so every pair is found. Without it (the pairs across splits of `llm.splits`), a tile is a minhash
   band of elements (ROWS minima of BANDS groups); texts of up to SHORT words also meet by an exact prefix. Keys with more
   than BLOCK rows are split into blocks of about BLOCK, and each pair of blocks is a tile of its own: no key has to fit one
   task, and no partner is capped. Few keys are so long, so few rows are repeated.
3. In a tile, hashed bitmaps (112 bits, 496 with `exact`) of odd and even counts bound the shared words from above by the bits in
   which they differ, folded to fewer bits for short texts, and the prefix position bounds the size of the other text; pairs
   that can't reach SHARE end there, in array arithmetic over blocks of rows.
4. The rest are verified by exact intersection of sorted element arrays.

Exact tiles cost no disk beyond their prefixes (0.3 of a text's words), but time that grows with the square of the most frequent
prefix elements; README has the figures. Elements are 32-bit hashes in the exact step (chance of one false shared word in a
pair of 70 words: 1e-6). Minhash finds a pair of similarity s = shared / union with 1 - (1 - s ** ROWS) ** BANDS, which is 0.92
at the least similarity that SHARE allows (two texts of equal length, s = 0.7 / 1.3) and more for all others.

Cases: null, empty and wordless texts are no case; repeated ids count once (the least text); empty tables give no rows.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from brindle.llm import codepoints as C
from brindle.session import bounded, by_key, checkpoint, checkpoint_by, widened

SHARE, ROWS, BANDS, SHORT, BLOCK, BUCKETS, HOT_KEYS = 0.7, 5, 56, 17, 500_000, 1 << 16, 200_000
WIDE = ("b3", "b4", "b5", "b6", "b7", "b8", "reach")
DENSE, TASK_ROWS = 32, 1_500_000  # rows of a key from which it is swept by blocks; rows of tiles for a task
_SIZE_BITS, _CLAMP = 14, (1 << 14) - 1
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x.astype(np.uint64)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@functools.lru_cache(maxsize=1)
def _case_table() -> tuple[np.ndarray, np.ndarray]:
    """Lower case of every code point, and its kind: 0 separator, 1 part of a word, 2 a word by itself."""
    import unicodedata

    lower = np.arange(C.LIMIT, dtype=np.uint32)
    kind = np.zeros(C.LIMIT, np.uint8)
    for c in range(C.LIMIT):
        if 0x3400 <= c < 0xA000 or 0x20000 <= c < 0x2FFFF:
            continue
        ch = chr(c)
        if ch.isalnum() or ch == "_" or unicodedata.category(ch)[0] == "M" and not 0xFE00 <= c < 0xFE10:
            kind[c] = 1
            low = ch.lower()
            if len(low) == 1:
                lower[c] = ord(low)
    kind[0x3400:0x4DC0], kind[0x4E00:0xA000], kind[0xF900:0xFB00], kind[0x20000:] = 2, 2, 2, 2
    kind[0x3007] = 2
    return lower, kind


def words(points: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, row, first position and end of every word, in order. An ideograph is a word; look-alikes are expected to be mapped."""
    lower, kinds = _case_table()
    if not len(points):
        e = np.zeros(0, np.int64)
        return e.astype(np.uint64), e, e, e
    small = np.where(points < C.LIMIT, points, 0)
    kind = np.where(points < C.LIMIT, kinds[small], 2)
    row = C._row_of(rows, len(points))
    after = np.concatenate([[False], row[1:] == row[:-1]])
    starts = (kind == 2) | ((kind == 1) & ~(np.concatenate([[False], kind[:-1] == 1]) & after))
    at = np.flatnonzero(kind > 0)
    first = np.flatnonzero(starts)
    if not len(first):
        e = np.zeros(0, np.int64)
        return e.astype(np.uint64), e, e, e
    heads = np.flatnonzero(starts[at])
    word = np.cumsum(starts[at]) - 1
    position = at - first[word]
    powers = np.cumprod(np.full(int(position.max()) + 1, 0x100000001B3 | 1 << 44, np.uint64))
    value = mix(np.where(points < C.LIMIT, lower[small], points)[at]) * powers[position]
    ends = at[np.concatenate([heads[1:], [len(at)]]) - 1] + 1
    return mix(np.add.reduceat(value, heads)), row[first], first, ends


def numbered(hashes: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Elements (hash of a word and how many times it has occurred in its row) and their rows, sorted by row and element."""
    order = np.lexsort((hashes, row))
    h, r = hashes[order], row[order]
    if not len(h):
        return h, r
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (r[1:] != r[:-1])])
    run = np.arange(len(h)) - np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
    e = mix(h + run.astype(np.uint64) * _GOLD)
    order = np.lexsort((e, r))
    return e[order], r[order]


def text_elements(df: DataFrame, key: str, column: str, *extra: str) -> DataFrame:
    """(id, f1, f2, n, elements) and `extra` columns of every row with a word; elements are sorted 32-bit hashes."""
    flat = df.select(F.col(key).cast("long").alias("id"), F.col(column).cast("string").alias("_t"), *extra).where("id is not null and _t is not null")
    kinds = dict(flat.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            points, rows = C.normal_form(*C.decode(b.column("_t")))
            h, r, _, _ = words(points, rows)
            e, r = numbered(h, r)
            counts = np.bincount(r, minlength=b.num_rows)
            keep = np.flatnonzero(counts)
            if not len(keep):
                continue
            heads = np.concatenate([[0], np.cumsum(counts)])[keep]
            f1, f2 = np.add.reduceat(e, heads), np.add.reduceat(mix(e ^ _GOLD), heads)
            small = (e >> np.uint64(32)).astype(np.uint32)
            small = small[np.lexsort((small, r))].view(np.int32)
            offsets = np.concatenate([heads, [len(e)]]).astype(np.int32)
            take = pa.array(keep)
            yield pa.RecordBatch.from_arrays(
                [b.column("id").take(take), pa.array(f1.view(np.int64)), pa.array(f2.view(np.int64)), pa.array(counts[keep], pa.int32()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(small)), *(b.column(x).take(take) for x in extra)],
                names=["id", "f1", "f2", "n", "elements", *extra],
            )

    return widened(flat).mapInArrow(run, "id long, f1 long, f2 long, n int, elements array<int>" + "".join(f", {x} {kinds[x]}" for x in extra))


@functools.lru_cache(maxsize=4)
def _seeds(count: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    return rng.integers(0, 2**32, count, np.uint32), rng.integers(0, 2**31, count, np.uint32) * np.uint32(2) + np.uint32(1)


def band_keys(elements: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """BANDS keys of each text, as an array (texts, BANDS)."""
    xor, odd = _seeds(ROWS * BANDS)
    out = np.empty((len(heads), BANDS), np.uint64)
    for band in range(BANDS):
        key = np.full(len(heads), band + 1, np.uint64)
        for k in range(band * ROWS, band * ROWS + ROWS):
            x = (elements ^ xor[k]) * odd[k]
            x ^= x >> np.uint32(15)
            x *= np.uint32(0x2C1B3C6D)
            key = mix(key * _GOLD + np.minimum.reduceat(x, heads))
        out[:, band] = key
    return out


def bitmaps(elements: np.ndarray, row: np.ndarray, n: int, bits: int = 112) -> list[np.ndarray]:
    """Bitmaps of element sets of 112 or 496 bits, as words of 64 bits of which the second has 48: whether the number of elements
    at a bit is odd. An element in which two sets differ changes one bit, also where words are folded by xor."""
    bit = (elements * np.uint32(0x85EBCA6B)) >> np.uint32(8)
    bit = bit.astype(np.int64) % bits
    width = 128 if bits == 112 else 512
    grid = (np.bincount(row * width + np.where(bit < 112, bit, bit + 16), minlength=n * width) & 1).astype(np.uint8).reshape(n, width)
    packed = np.packbits(grid, axis=1, bitorder="little").view(np.uint64)
    return [packed[:, i].copy() for i in range(packed.shape[1])]


def element_counts(texts: DataFrame) -> np.ndarray:
    """How often elements occur, by 16 bits of their hashes: a bounded stand-in for the rarity of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(1 << 16, np.int64)
        for b in batches:
            n += np.bincount(np.asarray(b.column(0).flatten()).view(np.uint32) & np.uint32(0xFFFF), minlength=1 << 16)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at])], names=["slot", "n"])

    out = np.zeros(1 << 16, np.int64)
    for r in texts.select("elements").mapInArrow(run, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toLocalIterator():
        out[r["slot"]] = r["n"]
    return out


def _tile_rows(texts: DataFrame, sided: bool, rarity: np.ndarray | None = None) -> DataFrame:
    """(key, id, b1, b2) of every text and band; b2 holds 48 bits of the bitmap, 14 of the size, and the side. With `rarity`,
    of every text and element of its exact prefix, with WIDE: six more words, and the most words of a longer text that can share
    enough from this element on."""
    names = ["b1", "b2", *(() if rarity is None else WIDE)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 1000):
                b = whole.slice(start, 1000)
                lists = b.column("elements")
                e = np.asarray(lists.flatten()).view(np.uint32)
                offsets = np.asarray(lists.offsets)
                heads, counts = (offsets[:-1] - offsets[0]).astype(np.int64), np.diff(offsets)
                n, ids = b.num_rows, np.asarray(b.column("id"))
                row = np.repeat(np.arange(n), counts)
                maps = bitmaps(e, row, n, 112 if rarity is None else 496)
                maps[1] |= np.minimum(counts, _CLAMP).astype(np.uint64) << np.uint64(48)
                keys, who = ([band_keys(e, heads).T.ravel()], [np.tile(np.arange(n), BANDS)]) if rarity is None else ([], [])
                if rarity is not None:
                    e = e[np.lexsort((e, rarity[e & np.uint32(0xFFFF)], row))]
                within = np.arange(len(e)) - heads[row]
                prefix = ((counts[row] <= SHORT) | (rarity is not None)) & (within <= counts[row] - np.ceil(SHARE * counts[row] - 1e-9))
                if prefix.any() or not keys:  # in one fixed order of all elements: two texts that share SHARE share one of the prefix
                    keys.append(mix(e[prefix].astype(np.uint64) + np.uint64(1 << 40)))
                    who.append(row[prefix])
                key, at = np.concatenate(keys), np.concatenate(who)
                if sided:
                    sides = [np.asarray(b.column(s))[at] for s in ("side0", "side1")]
                    pick = np.concatenate([np.flatnonzero(sides[0]), np.flatnonzero(sides[1])])
                    side = np.repeat([0, 1], [sides[0].sum(), sides[1].sum()]).astype(np.uint64)
                    key, at = key[pick], at[pick]
                else:
                    side = np.zeros(len(at), np.uint64)
                maps = [m[at] for m in maps]
                if rarity is not None:
                    maps.append((((counts[row] - within)[prefix] + 1e-6) / SHARE).astype(np.uint64))
                maps[1] |= side << np.uint64(63)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(ids[at]), *(pa.array(m.view(np.int64)) for m in maps)], names=["key", "id", *names])

    return texts.mapInArrow(run, "key long, id long" + "".join(f", {n} long" for n in names))


def _sweep(key: np.ndarray, ids: np.ndarray, maps: list[np.ndarray], sided: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of one key whose sizes and bitmaps allow SHARE. Keys come sorted; rows are swept in the order of their sizes."""
    size = ((maps[1] >> np.uint64(48)) & np.uint64(_CLAMP)).astype(np.int64)
    order = np.lexsort((size, key))
    key, ids, size, maps = key[order], ids[order], size[order], [m[order] for m in maps]
    reach = maps.pop().astype(np.int64) if len(maps) % 2 else None
    flags = maps[1] >> np.uint64(62)
    maps[1] = maps[1] & np.uint64((1 << 48) - 1)
    spare = size - 2 * np.ceil(SHARE * size - 1e-9).astype(np.int64)  # with the other's size: in how many elements two may differ
    left, right = [ids[:0]], [ids[:0]]

    def keep(at: np.ndarray, to: np.ndarray) -> None:
        differ = sum(np.bitwise_count(m[at] ^ m[to]).astype(np.int64) for m in maps)
        ok = ((differ <= spare[to] + size[at]) | (size[to] == _CLAMP)) & (ids[at] != ids[to])
        crossed = flags[at] & np.uint64(1)  # a tile of two blocks, or of two sides: only pairs across
        apart = (flags[at] ^ flags[to]) >> np.uint64(1) > 0
        ok &= apart if sided else (apart | (crossed == 0))
        if reach is not None:
            ok &= reach[at] >= size[to]
        left.append(ids[at[ok]])
        right.append(ids[to[ok]])

    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    lengths = np.diff(np.concatenate([starts, [len(key)]]))
    at, d = np.flatnonzero(np.repeat(lengths < DENSE, lengths)), 1
    while len(at := at[at + d < len(key)]):  # keys of few rows, all at once
        to = at + d
        at = at[(key[at] == key[to]) & (size[at] >= SHARE * size[to] - 1e-9)]  # both fail for good once they fail
        keep(at, at + d)
        d += 1
    folded = {len(maps): np.stack(maps)} if len(key) else {}
    while (n := min(folded, default=0)) > 2:
        folded[n // 2] = folded[n][: n // 2] ^ folded[n][n // 2 :]
    high, wide = 64, 1024
    xor, one, all_ = np.empty((high, wide), np.uint64), np.empty((high, wide), np.uint8), np.empty((high, wide), np.uint8)
    for start, length in zip(starts[lengths >= DENSE], lengths[lengths >= DENSE]):  # others, by blocks of rows
        for i in range(start, end := start + length, high):
            j = min(i + high, end)
            first = start + int(np.searchsorted(size[start:end], SHARE * size[i] - 1e-9))
            near = np.arange(first, j) if reach is None else first + np.flatnonzero(reach[first:j] >= size[i])
            words = folded[next((n for n, most in ((2, 60), (4, 110)) if n in folded and size[j - 1] <= most), len(maps))]
            xs, ys, most = words[:, i:j, None], words[:, None, near], spare[i:j].max() + size[near]
            most = np.clip(most, 0, 255).astype(np.uint8) if size[j - 1] < _CLAMP else np.full(len(near), 255, np.uint8)
            for k in range(0, len(near), wide):
                m = min(k + wide, len(near))
                x, c, differ = xor[: j - i, : m - k], one[: j - i, : m - k], all_[: j - i, : m - k]
                for n in range(len(words)):
                    np.bitwise_xor(xs[n], ys[n, :, k:m], out=x)
                    np.bitwise_count(x, out=c if n else differ)
                    if n:
                        np.add(differ, np.minimum(c, 255 - differ, out=c) if n > 2 else c, out=differ)  # up to 255
                hits = np.flatnonzero(differ <= most[k:m])
                to, at = i + hits // (m - k), near[k + hits % (m - k)]
                ok = (at < to) & (size[at] >= SHARE * size[to] - 1e-9)
                keep(at[ok], to[ok])
    return np.concatenate(left), np.concatenate(right)


def candidate_pairs(texts: DataFrame, sided: bool = False, exact: bool = False) -> DataFrame:
    """Distinct pairs (a < b) of texts (id, elements[, side0, side1]) that size and bitmap allow; with sides, only pairs across."""
    tiles = _tile_rows(texts, sided, element_counts(texts) if exact else None)
    bucket = F.pmod("key", F.lit(BUCKETS)).cast("int")
    counts = tiles.select(bucket.alias("bucket")).groupBy("bucket").count().collect()  # at most BUCKETS rows
    total = sum(r["count"] for r in counts)
    mean = total / BUCKETS
    hot = [(r["bucket"],) for r in counts if r["count"] > mean + 8 * mean**0.5 + BLOCK]
    if hot:  # only in these can a key have more than BLOCK rows; keys are counted there, and only hot ones are split
        few = F.broadcast(texts.sparkSession.createDataFrame(hot, "bucket int"))
        keys = tiles.withColumn("bucket", bucket).join(few, "bucket", "left_semi").groupBy("key").count().where(F.col("count") > BLOCK)
        keys = checkpoint(keys.select("key", F.ceil(F.col("count") / BLOCK).cast("int").alias("parts")))
        rows = tiles.join(bounded(keys, HOT_KEYS), "key", "left")
    else:
        rows = tiles.withColumn("parts", F.lit(None).cast("int"))
    salt = F.pmod(F.xxhash64("id", F.lit(7)), F.col("parts")).cast("int")
    side = F.shiftrightunsigned("b2", 63)
    other = F.explode(F.when(F.col("parts").isNull(), F.array(F.lit(-1))).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))).alias("other")
    wide = WIDE if exact else ()
    rows = rows.select("key", "id", "b1", "b2", *wide, salt.alias("salt"), side.alias("side"), other)
    if sided:
        x, y, flag = F.when(F.col("side") == 0, F.col("salt")).otherwise(F.col("other")), F.when(F.col("side") == 0, F.col("other")).otherwise(F.col("salt")), F.col("b2")
    else:
        x, y = F.least("salt", "other"), F.greatest("salt", "other")
        upper = F.when(F.col("salt") > F.col("other"), F.lit(-(1 << 63))).otherwise(F.lit(0))
        crossed = F.when(F.col("salt") != F.col("other"), F.lit(1 << 62)).otherwise(F.lit(0))
        flag = F.col("b2").bitwiseOR(upper).bitwiseOR(crossed)
    tile = F.when(F.col("other") < 0, F.col("key")).otherwise(F.xxhash64("key", x, y))
    rows = rows.select(tile.alias("key"), "id", "b1", F.when(F.col("other") < 0, F.col("b2")).otherwise(flag).alias("b2"), *wide)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs(parts: list[np.ndarray]) -> pa.RecordBatch:
            a, b = _sweep(parts[0], parts[1], [p.view(np.uint64) for p in parts[2:]], sided)
            packed = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0) if len(a) else np.zeros((0, 2), np.int64)
            return pa.RecordBatch.from_arrays([pa.array(packed[:, 0]), pa.array(packed[:, 1])], names=["a", "b"])

        held: list[list[np.ndarray]] = []
        for b in batches:
            cols = [np.asarray(c) for c in b.columns]
            if not len(cols[0]):
                continue
            cut = int(np.searchsorted(cols[0], cols[0][-1]))  # the last key may go on in the next batch
            if cut or held and held[-1][0][-1] != cols[0][0]:
                whole = [*held, [c[:cut] for c in cols]]
                yield pairs([np.concatenate(x) for x in zip(*whole)])
                held = []
            held.append([c[cut:] for c in cols])
        if held:
            yield pairs([np.concatenate(x) for x in zip(*held)])

    width = max(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // TASK_ROWS))  # so that no sort spills
    return rows.repartition(width, "key").sortWithinPartitions("key").mapInArrow(run, "a long, b long").distinct()


def shared_words(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b, shared, longest) of pairs, by exact intersection of sorted elements."""
    left = texts.select(F.col("id").alias("a"), F.col("elements").alias("x"))
    right = texts.select(F.col("id").alias("b"), F.col("elements").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 2000):
                b = whole.slice(start, 2000)
                keyed, sizes = [], []
                for name in ("x", "y"):
                    lists = b.column(name)
                    counts = np.diff(np.asarray(lists.offsets)).astype(np.int64)
                    keyed.append(np.repeat(np.arange(b.num_rows, dtype=np.uint64) << np.uint64(32), counts) | np.asarray(lists.flatten()).view(np.uint32).astype(np.uint64))
                    sizes.append(counts)
                at = np.searchsorted(keyed[1], keyed[0])  # both are sorted by pair and element
                hit = (at < len(keyed[1])) & (keyed[1][np.minimum(at, len(keyed[1]) - 1)] == keyed[0])
                shared = np.bincount((keyed[0][hit] >> np.uint64(32)).astype(np.int64), minlength=b.num_rows)
                yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(shared.astype(np.int32)), pa.array(np.maximum(*sizes).astype(np.int32))], names=["a", "b", "shared", "longest"])

    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long, shared int, longest int")


def classes(texts: DataFrame, *flags: str, carry: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Representatives (id, elements, flags: whether any member has it) and members (id, rep, flags, carried columns) of texts of
    equal elements."""
    light = texts.select("id", "f1", "f2", *flags, *carry)
    heads = light.groupBy("f1", "f2").agg(F.min("id").alias("rep"), *(F.max(f).alias(f) for f in flags))
    members = light.join(heads.drop(*flags), ["f1", "f2"]).select("id", "rep", *flags, *carry)
    reps = by_key(texts.select("id", "elements"), "id").join(heads.select(F.col("rep").alias("id"), *flags), "id")
    return checkpoint_by(reps, "id"), members  # by id, as the pairs to be verified meet its elements by id, twice


def near_links(reps: DataFrame, sided: bool = False, exact: bool = False) -> DataFrame:
    """Verified pairs (a, b) of representatives."""
    found = shared_words(candidate_pairs(reps, sided, exact), reps)
    return found.where(F.col("shared") >= F.ceil(F.lit(SHARE) * F.col("longest") - F.lit(1e-9))).select("a", "b")


def prepare(df: DataFrame, key: str, column: str) -> DataFrame:
    """Elements of each id, kept as a table: they are read several times."""
    return checkpoint(text_elements(df, key, column))


def near_duplicates(df: DataFrame, key: str, column: str, exact: bool = True) -> DataFrame:
    """Each pair (id_1 < id_2) of rows whose texts are near-duplicates, exact copies included.

    `near_duplicate_groups` says the same with one row a text: the pairs of a class of n equal texts are n * (n - 1) / 2 rows.
    """
    reps, members = classes(prepare(df, key, column))
    a = members.select(F.col("id").alias("m1"), F.col("rep").alias("a"))
    b = members.select(F.col("id").alias("m2"), F.col("rep").alias("b"))
    across = near_links(reps, exact=exact).join(a, "a").join(b, "b").select("m1", "m2")
    within = a.join(b, F.col("a") == F.col("b")).where("m1 < m2").select("m1", "m2")
    return across.union(within).select(F.least("m1", "m2").alias("id_1"), F.greatest("m1", "m2").alias("id_2"))


def near_duplicate_groups(df: DataFrame, key: str, column: str, exact: bool = True) -> DataFrame:
    """One row (id, group, links) for every text: the least id it is connected to, and the links of its class to other classes."""
    from brindle.operators.components import connected_components

    reps, members = classes(prepare(df, key, column))
    links = checkpoint(near_links(reps, exact=exact))
    degree = links.select(F.col("a").alias("rep")).union(links.select("b")).groupBy("rep").agg(F.count("*").alias("links"))
    groups = connected_components(links, "a", "b").select(F.col("node").alias("rep"), F.col("component").alias("group"))
    return members.join(groups, "rep", "left").join(degree, "rep", "left").select("id", F.coalesce("group", "rep").alias("group"), F.coalesce("links", F.lit(0)).alias("links"))
