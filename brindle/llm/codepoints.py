"""One consistent form for look-alike text, on numpy code-point arrays.

Arrow text is copied once a batch into a uint32 code-point array with row offsets. Lookup tables give each code point its
class and its expansion; expansions are applied by offsets, combining marks are composed pairwise on whole arrays, and words
that mix scripts are found by segment reductions. No string call is made per row.

What counts as standing in for an ordinary character: full-width and half-width letters and digits, ligatures, letter-like
compatibility forms, radicals used as ideographs, spaces other than U+0020, the non-breaking hyphen, a base letter followed by
a mark with which it composes, and a Cyrillic or Greek look-alike inside a word that also has Latin letters. Invisible
characters count except for joiners and variation selectors inside emoji sequences. Words wholly in another script, composed
accents and Chinese punctuation stay as they are.

Cases: null gives null (and is never flagged), empty text gives empty text; repeated rows give repeated results; texts of any
length are processed whole; lone surrogates don't occur in Arrow text.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

LIMIT = 0x30000  # code points from here on are ideographs, tags and private use; they are their own form
ORDINARY, SPACE, INVISIBLE, COMPAT, MARK, EMOJI, SELECTOR, JOINER = range(8)
LATIN, CYRILLIC, GREEK = 1, 2, 4

# Cyrillic and Greek letters that look like Latin ones, with the letter they look like.
LOOKALIKES = dict(zip(
    "АВЕЅІЈКМНОРСТУХаеѕіјорсухԁһӏԛԜԝΑΒΕΖΗΙΚΜΝΟΡΤΥΧονρυιαϲ",
    "ABESIJKMHOPCTYXaesijopcyxdhlqWwABEZHIKMNOPTYXovpuiac",
))
# Invisible characters and spaces.
INVISIBLES = [0xAD, 0x34F, 0x61C, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x180E, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2070), 0x3164, 0xFEFF, 0xFFA0]
SPACES = [0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000]


def _is_emoji(c: int) -> bool:
    return 0x1F000 <= c < 0x1FB00 or 0x2190 <= c < 0x2C00 and unicodedata.category(chr(c)) in ("So", "Sm") or c in (0x203C, 0x2049, 0x20E3, 0x2122, 0x2139, 0x3030, 0x303D, 0x3297, 0x3299)


def _compatible(c: int) -> str | None:
    """The ordinary form of a compatibility character that stands in for letters, digits or ideographs."""
    kind = unicodedata.decomposition(chr(c))
    if c < 0x100 or not kind:
        return None
    tag = kind.split()[0] if kind[0] == "<" else ""
    form = unicodedata.normalize("NFKC", chr(c))
    if tag in ("<super>", "<sub>", "<fraction>", "<square>", "<initial>", "<medial>", "<final>", "<isolated>"):
        return None
    if tag == "" and not (0xF900 <= c < 0xFB00 or 0x2F800 <= c < 0x2FA20 or c in (0x212A, 0x212B)):
        return None  # canonical: a composed accent
    usual = "，：；！？（）％～。、「」｡｢｣､･＂＇"
    if chr(c) in usual:
        return None
    if c == 0x2011:
        return "-"
    return form if all(x.isalnum() or unicodedata.category(x) == "Mn" for x in form) or 0xFF01 <= c <= 0xFF5E else None


@functools.lru_cache(maxsize=1)
def tables() -> dict[str, np.ndarray]:
    """Class, script and expansion of every code point below LIMIT, and the composition pairs."""
    kind = np.zeros(LIMIT, np.uint8)
    script = np.zeros(LIMIT, np.uint8)
    forms: dict[int, str] = {}
    pairs: dict[int, int] = {}
    for c in range(0x80, LIMIT):
        if 0x3400 <= c < 0xA000 or 0xAC00 <= c < 0xF900 or 0x20000 <= c < 0x2F800:
            continue  # ideographs, Hangul syllables, surrogates, private use
        ch = chr(c)
        if unicodedata.combining(ch):
            kind[c] = MARK
        elif _is_emoji(c):
            kind[c] = EMOJI
        elif (form := _compatible(c)) is not None:
            kind[c], forms[c] = COMPAT, form
        d = unicodedata.decomposition(ch)
        if d and d[0] != "<" and " " in d and unicodedata.normalize("NFC", ch) == ch:
            a, b = (int(x, 16) for x in d.split())
            pairs[a << 21 | b] = c
    kind[SPACES], kind[INVISIBLES] = SPACE, INVISIBLE
    kind[0x200D], kind[0xFE00:0xFE10] = JOINER, SELECTOR
    for low, high, s in ((0x41, 0x5B, LATIN), (0x61, 0x7B, LATIN), (0xC0, 0x250, LATIN), (0x1E00, 0x1F00, LATIN), (0x370, 0x400, GREEK), (0x1F00, 0x2000, GREEK), (0x400, 0x530, CYRILLIC), (0xFF21, 0xFF3B, LATIN), (0xFF41, 0xFF5B, LATIN), (0xFB00, 0xFB07, LATIN), (0x1D400, 0x1D6A4, LATIN)):
        script[low:high] |= s
    script[[0xD7, 0xF7, 0x37E, 0x387]] = 0
    twin = np.arange(LIMIT, dtype=np.uint32)
    for a, b in LOOKALIKES.items():
        twin[ord(a)] = ord(b)
    length, start = np.ones(LIMIT, np.uint8), np.zeros(LIMIT, np.uint32)
    flat = [0]
    for c, form in forms.items():
        length[c], start[c] = len(form), len(flat)
        flat.extend(map(ord, form))
    keys = np.array(sorted(pairs), np.int64)
    composing = np.zeros(LIMIT, bool)
    composing[keys & ((1 << 21) - 1)] = True
    based = kind == EMOJI  # what a variation selector may follow
    based[[*range(0x30, 0x3A), 0x23, 0x2A, 0xA9, 0xAE, 0x3030]] = True
    changed = np.isin(kind, (SPACE, INVISIBLE, COMPAT, JOINER, SELECTOR)) | composing | (twin != np.arange(LIMIT))
    return {"composing": composing, "based": based, "changed": changed, "kind": kind, "script": script, "twin": twin, "length": length, "start": start, "flat": np.array(flat, np.uint32), "pairs": keys, "composed": np.array([pairs[k] for k in keys.tolist()], np.uint32)}


def decode(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of a text column and the n + 1 offsets of its rows; null counts as empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8, at[-1] - at[0], at[0]) if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    points = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    first = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    return points, first[at - at[0]]


def encode(points: np.ndarray, rows: np.ndarray, nulls: np.ndarray | None = None) -> pa.Array:
    """Text column of code points and row offsets."""
    raw = np.frombuffer(points.astype("<u4").tobytes().decode("utf-32-le").encode("utf-8"), np.uint8)
    first = np.concatenate([np.flatnonzero((raw & 0xC0) != 0x80), [len(raw)]])
    offsets = first[rows].astype(np.int64)
    valid, count = None, 0
    if nulls is not None and nulls.any():
        valid, count = pa.py_buffer(np.packbits(~nulls, bitorder="little").tobytes()), int(nulls.sum())
    return pa.Array.from_buffers(pa.large_string(), len(rows) - 1, [valid, pa.py_buffer(offsets.tobytes()), pa.py_buffer(raw.tobytes())], count).cast(pa.string())


def _lookup(table: np.ndarray, points: np.ndarray) -> np.ndarray:
    return table[np.where(points < LIMIT, points, 0)]


def _row_of(rows: np.ndarray, n: int) -> np.ndarray:
    return np.repeat(np.arange(len(rows) - 1), np.diff(rows))


def _remapped(rows: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(lengths)])[rows]


def standins(points: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each code point: whether it stands in or is out of place, whether it is dropped, and its look-alike's twin (or itself)."""
    t = tables()
    n = len(points)
    if not n or points.max() < 0x80:
        return np.zeros(n, bool), np.zeros(n, bool), points
    kind, script = _lookup(t["kind"], points), _lookup(t["script"], points)
    row = _row_of(rows, n)
    after = np.empty(n, bool)  # same row as the code point before
    after[0], after[1:] = False, row[1:] == row[:-1]
    before = np.zeros(n, bool)
    before[:-1] = after[1:]
    emoji = (kind == EMOJI) | (kind == SELECTOR) | (points == 0x20E3)
    left, right = np.zeros(n, bool), np.zeros(n, bool)
    left[1:], right[:-1] = emoji[:-1] & after[1:], emoji[1:] & before[:-1]
    base = np.zeros(n, bool)
    base[1:] = _lookup(t["based"], points[:-1]) & after[1:]
    drop = (kind == INVISIBLE) | ((kind == JOINER) & ~(left & right)) | ((kind == SELECTOR) & ~base)
    found = drop | (kind == SPACE) | (kind == COMPAT)
    # marks that compose with the letter before them, invisible characters left out
    keep = np.flatnonzero(~drop)
    if (kind == MARK).any() and len(keep) > 1:
        at = np.flatnonzero(_lookup(t["composing"], points[keep[1:]]))
        first, second = keep[at], keep[at + 1]
        hit = np.isin(points[first].astype(np.int64) << 21 | points[second], t["pairs"]) & (row[first] == row[second])
        found[second[hit]] = True
    # words of letters, marks and invisible characters that mix Latin with look-alikes
    twin = points.copy()
    other = script > LATIN
    if other.any():
        part = (script > 0) | (kind == MARK) | drop
        starts = part & ~(np.concatenate([[False], part[:-1]]) & after)
        word = np.cumsum(starts)
        at = np.flatnonzero(part)
        heads = np.flatnonzero(np.diff(np.concatenate([[0], word[at]])))
        mixed = np.bitwise_or.reduceat(script[at], heads)
        mix = np.zeros(n, np.uint8)
        mix[at] = np.repeat(mixed, np.diff(np.concatenate([heads, [len(at)]])))
        alike = _lookup(t["twin"], points)
        swap = other & ((mix & LATIN) > 0) & (alike != points) & (points < LIMIT)
        twin[swap] = alike[swap]
        found |= swap
    return found, drop, twin


def expand(points: np.ndarray, rows: np.ndarray, length: np.ndarray, start: np.ndarray, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Replace code points by their table expansions; also gives the source position of each result."""
    lengths = _lookup(length, points).astype(np.int64)
    lengths[points >= LIMIT] = 1
    source = np.repeat(np.arange(len(points)), lengths)
    out = points[source]
    at = _lookup(start, points)
    at[points >= LIMIT] = 0
    first = np.concatenate([[0], np.cumsum(lengths)[:-1]]) if len(points) else np.zeros(0, np.int64)
    swap = at[source] > 0
    out = np.where(swap, flat[np.where(swap, at[source] + (np.arange(len(source)) - first[source]), 0)], out).astype(np.uint32)
    return out, _remapped(rows, lengths), source


def compose(points: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Compose letters with the marks after them, one mark of each letter a round."""
    t = tables()
    while len(points) > 1:
        second = np.flatnonzero(_lookup(t["composing"], points[1:])) + 1
        second = second[~np.isin(second, rows)]  # a row's first has nothing before it
        key = points[second - 1].astype(np.int64) << 21 | points[second]
        place = np.searchsorted(t["pairs"], key)
        fits = t["pairs"][np.minimum(place, len(t["pairs"]) - 1)] == key
        at = np.zeros(len(points) - 1, np.int64)
        hit = np.zeros(len(points) - 1, bool)
        hit[second[fits] - 1], at[second[fits] - 1] = True, place[fits]
        hit[1:] &= ~hit[:-1]
        if not hit.any():
            break
        points = points.copy()
        points[:-1][hit] = t["composed"][at[hit]]
        keep = np.concatenate([[True], ~hit])
        points, rows = points[keep], _remapped(rows, keep)
    return points, rows


def normal_form(points: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The one form: nothing invisible out of place, ordinary spaces and letters, composed accents.

    Only rows with a code point that can change are copied and worked on.
    """
    lengths = np.diff(rows)
    bad = np.diff(np.concatenate([[0], np.cumsum(_lookup(tables()["changed"], points))])[rows]) > 0
    if not bad.any():
        return points.astype(np.uint32), rows
    inside = np.repeat(bad, lengths)
    some, some_rows = _normal(points[inside], np.concatenate([[0], np.cumsum(lengths[bad])]))
    lengths = lengths.copy()
    lengths[bad] = np.diff(some_rows)
    out_rows = np.concatenate([[0], np.cumsum(lengths)])
    there = np.repeat(bad, lengths)
    out = np.empty(len(there), np.uint32)
    out[there], out[~there] = some, points[~inside]
    return out, out_rows


def _normal(points: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    t = tables()
    _, drop, points = standins(points, rows)
    if drop.any():
        points, rows = points[~drop], _remapped(rows, ~drop)
    points = np.where(_lookup(t["kind"], points) == SPACE, 32, points).astype(np.uint32)
    if (_lookup(t["kind"], points) == COMPAT).any():
        points, rows, _ = expand(points, rows, t["length"], t["start"], t["flat"])
    if len(points) and points.max() >= 0x300:
        points, rows = compose(points, rows)
    return points, rows


def normalise_text(df: DataFrame, key: str, column: str) -> DataFrame:
    """Rows (key, text, found): the one form of a text column and the number of characters that stood in or were out of place.

    Other columns of `df` are not read. One pass, no shuffle.
    """
    flat = df.select(F.col(key).alias("key"), F.col(column).cast("string").alias("text"))
    kind = dict(flat.dtypes)["key"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            points, rows = decode(b.column("text"))
            found, _, _ = standins(points, rows)
            total = np.concatenate([[0], np.cumsum(found)])
            nulls = np.asarray(b.column("text").is_null())
            form = encode(*normal_form(points, rows), nulls)
            yield pa.RecordBatch.from_arrays([b.column("key"), form, pa.array(total[rows[1:]] - total[rows[:-1]], pa.int64())], names=["key", "text", "found"])

    return flat.mapInArrow(run, f"key {kind}, text string, found long")


def suspicious_rows(df: DataFrame, key: str, column: str) -> DataFrame:
    """Keys of the rows whose text has at least one character that stands in for an ordinary one or is out of place."""
    flat = df.select(F.col(key).alias("key"), F.col(column).cast("string").alias("text")).where("text is not null")
    kind = dict(flat.dtypes)["key"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            points, rows = decode(b.column("text"))
            found, _, _ = standins(points, rows)
            total = np.concatenate([[0], np.cumsum(found)])
            yield pa.RecordBatch.from_arrays([b.column("key").filter(pa.array(total[rows[1:]] > total[rows[:-1]]))], names=["key"])

    return flat.mapInArrow(run, f"key {kind}")
