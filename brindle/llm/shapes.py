"""Pages that are stuffed keywords, product tags or lists of links rather than sentences.

Lines are cut into units at list separators and ends of sentences, and each unit is reduced to a shape: its kind, a bucket of
its word count, which of its first words are capital, the separator after it, its links, and how much of its vocabulary recurs
around it. No word is looked up: a sentence brings new words wherever it stands, while stuffing draws on a few key words again
and again, with or without function words strewn in. Recurrence is the share of words that occur twice within SPAN words,
averaged with the share that occur three times: near one for stuffing, half as much for nearly all prose. It is taken by run of
units, hence doesn't depend on the length of the page, nor on an honest opening before it.

The non-sentence shapes are links with few words around them, hash tags, products (a stock code and a price) and key words
(units whose neighbourhood recurs by RECURS or more). Code, logs and data have shapes of their own. Shapes are grouped by page;
a page is flagged when non-sentence shapes have SHARE of its characters, and FEW of them DOMINANT of these. A few links or one
short list in an answer don't suffice. `shape_groups` groups the shapes of the whole crawl.

All steps are array operations on the code points of a batch; no page is looped over. Cases: null, empty and blank texts are no
case; very long texts are processed whole; repeated rows give repeated results; a sentence that stands two to four times in a
page (a quotation) counts once.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from brindle.llm import codepoints as C
from brindle.llm.nearwords import mix, words
from brindle.session import widened

SHARE, RECURS, SPAN, FEW, DOMINANT, WORDS, UNITS = 0.7, 0.65, 40, 8, 0.6, 12, 4
KINDS = ("sentence", "code", "data", "link", "tag", "product", "key")
SENTENCE, CODE, DATA, LINK, TAG, PRODUCT, KEY = range(7)
ROWS = 2000  # pages handled at once: bounds the arrays, not the pages

_BREAK = r"(?i)\r\n?|</?p>|<br ?/?>"
_FENCE = r"(?is)```.*?(?:```|\z)|<pre>.*?(?:</pre>|\z)|<code>.*?(?:</code>|\z)|\{code[^}]*\}.*?(?:\{code\}|\z)|\[code\].*?(?:\[/code\]|\z)"
_LINK = r"(?i)\[url=[^\]\s]*\][^\[]*\[/url\]|<a\s[^>]*>[^<]*</a>|\[[^\]\n]*\]\([^)\s]*\)|(?:https?://|www\.)[^\s<>\])]+"
_STOCK, _PRICE, _ENTITY = r"\b[A-Z]{2,5}-?\d{3,}\b", r"\b\d+[.,]\d\d\b", r"&[A-Za-z]+;"
# Classes of characters; marks stand for what was taken out before.
OTHER, LETTER, HAN, DIGIT, SPACE, NEWLINE, LINK_MARK, STOCK_MARK, PRICE_MARK, LIST, STOP, STOP_CN, SYMBOL, HASH, DASH = range(15)
_BUCKETS = np.array([0, 1, 2, 3, 4, 4, 4, *[5] * 6, 6], np.int64)
_BUCKET_NAMES = ("0", "1", "2", "3", "4-6", "7-12", "13+")


@functools.lru_cache(maxsize=1)
def _classes() -> tuple[np.ndarray, np.ndarray]:
    """Class of every code point, and whether it is a capital."""
    import unicodedata

    kind, capital = np.zeros(C.LIMIT, np.uint8), np.zeros(C.LIMIT, bool)
    for c in range(0x3400):
        category = unicodedata.category(chr(c))
        kind[c] = LETTER if category[0] in "LM" else DIGIT if category[0] == "N" else SPACE if category[0] == "Z" else OTHER
        capital[c] = category in ("Lu", "Lt")
    kind[0x3400:] = HAN
    kind[0xD800:0xF900], kind[0xFE00:0xFFFF] = OTHER, OTHER
    kind[0xAC00:0xD7A4] = LETTER
    for marks, k in (("\n", NEWLINE), ("\t ", SPACE), ("\x01", LINK_MARK), ("\x02", STOCK_MARK), ("\x03", PRICE_MARK), (",;|•·、，；/>", LIST), (".!?", STOP), ("。！？", STOP_CN), ("_={}()<$\\`[]", SYMBOL), ("#", HASH), ("-–—*", DASH)):
        kind[[ord(c) for c in marks]] = k
    return kind, capital


class Units:
    """Units of a batch of texts: row, kind, shape, characters; and the characters of every row, code included."""

    def __init__(self, column: pa.Array) -> None:
        text = column.cast(pa.large_string()).fill_null("")
        self.n = len(text)
        length = lambda t: np.asarray(pc.utf8_length(t)).astype(np.int64)
        text = pc.replace_substring_regex(text, pattern=_BREAK, replacement="\n")
        before = length(text)
        text = pc.replace_substring_regex(text, pattern=_FENCE, replacement="\n")
        self.code = before - length(text)
        before = length(text)
        text = pc.replace_substring_regex(text, pattern=_LINK, replacement="\x01")
        links = np.asarray(pc.count_substring(text, "\x01")).astype(np.int64)
        each_link = 1 + (before - length(text)) / np.maximum(links, 1)
        for pattern, mark in ((_STOCK, "\x02"), (_PRICE, "\x03"), (_ENTITY, "|")):
            text = pc.replace_substring_regex(text, pattern=pattern, replacement=mark)
        self._cut(*C.decode(text), each_link)

    def _cut(self, points: np.ndarray, rows: np.ndarray, each_link: np.ndarray) -> None:
        classes, capitals = _classes()
        if not len(points):
            self.row = self.kind = self.shape = self.words = np.zeros(0, np.int64)
            self.size, self.total = np.zeros(0), self.code.astype(float)
            return
        small = np.minimum(points, C.LIMIT - 1)
        cls = np.where(points < C.LIMIT, classes[small], HAN)
        row = C._row_of(rows, len(points))
        head = np.concatenate([[True], row[1:] != row[:-1]])
        after = np.concatenate([cls[1:], [NEWLINE]])
        after[np.concatenate([head[1:], [True]])] = NEWLINE
        ahead = np.concatenate([[NEWLINE], cls[:-1]])
        ends = (cls == NEWLINE) | (cls == LIST) | (cls == STOP_CN) | ((cls == STOP) & ((after >= SPACE) | (after == HAN) | (after == OTHER)) & (after != SYMBOL)) | ((cls == DASH) & (after == SPACE) & ((ahead == SPACE) | (ahead == NEWLINE)))
        start = np.flatnonzero(head | np.concatenate([[True], ends[:-1]]))
        line_start = np.flatnonzero(head | (ahead == NEWLINE))
        weight = np.ones(len(points))
        weight[cls == LINK_MARK] = each_link[row[cls == LINK_MARK]]
        weight[cls == STOCK_MARK], weight[cls == PRICE_MARK] = 9, 5
        unit = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(points))))
        line = np.repeat(np.arange(len(line_start)), np.diff(np.append(line_start, len(points))))
        units, lines = len(start), len(line_start)
        per_unit = lambda mask: np.bincount(unit[mask], minlength=units)
        per_line = lambda mask: np.bincount(line[mask], minlength=lines)

        # words: plain ones, ideographs as half a word, and those with digits or underscores
        h, _, first, last = words(points, rows)
        odd = np.concatenate([[0], np.cumsum((cls == DIGIT) | (points == 0x5F))])
        plain = odd[last] == odd[first]
        number = odd[last] - odd[first] == last - first
        han = cls[first] == HAN
        value = np.where(han, 0.5, 1.0)
        of, of_line = unit[first], line[first]
        n_words = np.bincount(of[plain], weights=value[plain], minlength=units)
        all_words = np.bincount(of, weights=value, minlength=units)

        # kinds that don't depend on the words around
        spaces = per_unit((cls == SPACE) | (cls == NEWLINE))
        marks = per_unit((cls == LINK_MARK) | (cls == STOCK_MARK) | (cls == PRICE_MARK))
        chars, letters = np.diff(np.append(start, len(points))), per_unit((cls == LETTER) | (cls == HAN))
        n_links, tags, digits = per_unit(cls == LINK_MARK), per_unit(cls == HASH), per_unit(cls == DIGIT)
        line_words = np.bincount(of_line[plain], weights=value[plain], minlength=lines)
        strange = np.bincount(of_line[~plain & ~number], minlength=lines) + per_line(cls == SYMBOL)
        indent = (points[line_start] == 9) | np.all([points[np.minimum(line_start + k, len(points) - 1)] == 32 for k in range(4)], axis=0) & (np.diff(np.append(line_start, len(points))) > 4)
        marked = per_line((cls == LINK_MARK) | (cls == HASH)) + np.minimum(per_line(cls == STOCK_MARK), per_line(cls == PRICE_MARK))
        code_line = ((strange * 2 >= line_words) & (strange > 0) | indent & (strange * 8 >= line_words)) & (marked == 0)
        goods = np.minimum(per_line(cls == STOCK_MARK), per_line(cls == PRICE_MARK)) > 0
        at_line = line[start]
        kind = np.full(units, SENTENCE)
        kind[(all_words == 0) & (marks == 0) | (digits * 2 > chars - spaces)] = DATA
        kind[code_line[at_line]] = CODE
        kind[goods[at_line] & (line_words[at_line] <= 10 * np.maximum(1, per_line(cls == STOCK_MARK)[at_line]))] = PRODUCT
        kind[(tags > 0) & (tags * 2 >= all_words)] = TAG
        kind[(n_links > 0) & (n_words <= 4 * n_links)] = LINK
        empty = (letters + digits + marks + tags) == 0

        # recurrence among the SPAN words around, over the plain words of what may be sentences
        use = plain & (kind[of] == SENTENCE)
        word_row, word_unit, word_hash, word_value = row[first][use], of[use], h[use], value[use]
        count = np.bincount(word_unit, weights=word_value, minlength=units)
        if len(word_hash):
            heads = np.flatnonzero(np.diff(word_unit, prepend=-1))
            place = np.arange(len(word_unit)) - np.repeat(heads, np.diff(np.append(heads, len(word_unit))))
            chain = np.add.reduceat(mix(word_hash + place.astype(np.uint64)), heads)
            which = word_unit[heads]
            key = mix(chain ^ mix(row[start][which].astype(np.uint64)))
            _, original, same, times = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
            quoted = (count[which] >= 5) & (times[same] >= 2) & (times[same] <= 4) & (original[same] != np.arange(len(which)))
            origin = np.arange(units)
            origin[which[quoted]] = which[original[same[quoted]]]
            keep = origin[word_unit] == word_unit
            word_row, word_unit, word_hash, word_value = (x[keep] for x in (word_row, word_unit, word_hash, word_value))
            place = np.cumsum(word_value)
            order = np.lexsort((word_hash, word_row))
            sorted_hash, sorted_row, sorted_place = word_hash[order], word_row[order], place[order]
            near = lambda k: (sorted_hash[k:] == sorted_hash[:-k]) & (sorted_row[k:] == sorted_row[:-k]) & (sorted_place[k:] - sorted_place[:-k] <= SPAN)
            again, thrice = near(1), near(2)
            recurs = np.zeros((2, len(order)))
            recurs[0, order[1:][again]] = recurs[0, order[:-1][again]] = 0.5
            for k in range(3):  # a word that occurs thrice within the span, whichever of the three it is
                recurs[1, order[k : len(order) - 2 + k][thrice]] = 0.5
            recurs = recurs.sum(0)
            up = np.concatenate([[0], np.cumsum(recurs * word_value)])
            total = np.concatenate([[0], np.cumsum(word_value)])
            heads = np.flatnonzero(np.diff(word_unit, prepend=-1))
            tails = np.append(heads[1:], len(word_unit))
            row_heads = np.flatnonzero(np.diff(word_row, prepend=-1))
            row_tails = np.append(row_heads[1:], len(word_row))
            in_row = np.searchsorted(row_heads, heads, "right") - 1
            margin = SPAN // 4
            a, b = np.maximum(heads - margin, row_heads[in_row]), np.minimum(tails + margin, row_tails[in_row])
            ratio = np.full(units, -1.0)
            ratio[word_unit[heads]] = (up[b] - up[a]) / (total[b] - total[a])
            ratio = ratio[origin]
        else:
            ratio = np.full(units, -1.0)
        kind[(kind == SENTENCE) & (ratio >= RECURS)] = KEY
        self.ratio = ratio

        # shapes: kind, words, capitals, separator, links, recurrence
        big = capitals[small[first]]
        nth = np.arange(len(of)) - np.repeat(np.flatnonzero(np.diff(of, prepend=-1)), np.diff(np.append(np.flatnonzero(np.diff(of, prepend=-1)), len(of)))) if len(of) else of
        lead = (nth < 4) & ~han
        first_big = np.bincount(of[lead & (nth == 0) & big], minlength=units)
        rest_big = np.bincount(of[lead & (nth > 0) & big], minlength=units)
        pattern = np.minimum(first_big + 2 * (rest_big > 0), 3)  # the first word, and any of the next three
        mark = np.append(start[1:], len(points)) - 1
        sep = np.where(ends[mark] & (cls[mark] != NEWLINE), np.minimum(points[mark], 0x1FFFF), 0).astype(np.int64)
        bucket = _BUCKETS[np.minimum(all_words.astype(np.int64), len(_BUCKETS) - 1)]
        level = np.clip((ratio * 4).astype(np.int64) + (ratio >= 0), 0, 4)
        shape = ((((kind.astype(np.int64) * 8 + bucket) * 4 + pattern) * 4 + np.minimum(n_links, 2)) * 8 + level) << 17 | sep
        some = ~empty
        self.row, self.kind, self.shape = row[start][some], kind[some], shape[some]
        self.size = np.add.reduceat(weight, start)[some]
        self.words = np.maximum(n_words, marks + tags)[some]
        self.ratio = ratio[some]
        self.total = np.bincount(self.row, weights=self.size, minlength=self.n) + self.code


def shape_name(shape: int) -> str:
    """Readable form: kind, words, capitals, separator, links, quarter of recurrence."""
    sep, rest = shape & 0x1FFFF, shape >> 17
    rest, level = divmod(rest, 8)
    rest, links = divmod(rest, 4)
    rest, pattern = divmod(rest, 4)
    kind, bucket = divmod(rest, 8)
    return " ".join([KINDS[kind], _BUCKET_NAMES[bucket], ("aa", "Aa", "aA", "AA")[pattern], chr(sep) if sep else "-", str(links), str(level)])


def units(text: str) -> Iterator[tuple[str, str, float, float]]:
    """(kind, shape, characters, words) of every unit of one page, in order."""
    u = Units(pa.array([text], pa.string()))
    for kind, shape, size, n in zip(u.kind.tolist(), u.shape.tolist(), u.size.tolist(), u.words.tolist()):
        yield KINDS[kind], shape_name(shape), size, n


def judge(text: str) -> tuple[bool, float, str]:
    """(flagged, share of stuffing, its most common shape) of one page."""
    flagged, share, top = judge_pages(pa.array([text], pa.string()))
    return bool(flagged[0]), float(share[0]), shape_name(int(top[0])) if top[0] >= 0 else ""


def judge_pages(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whether each page is flagged, its share of stuffing, and its most common non-sentence shape (-1: none)."""
    u = Units(column)
    n = u.n
    stuff = u.kind >= LINK
    mass = np.bincount(u.row[stuff], weights=u.size[stuff], minlength=n)
    share = mass / np.maximum(u.total, 1)
    strong = np.bincount(u.row[stuff], weights=u.size[stuff] * (u.kind[stuff] != KEY), minlength=n) * 2 >= mass
    amount = np.bincount(u.row[stuff], weights=u.words[stuff], minlength=n)
    # characters of each shape of a page, largest first
    top = np.full(n, -1, np.int64)
    few = np.zeros(n)
    if stuff.any():
        order = np.lexsort((u.shape[stuff], u.row[stuff]))
        r, s, size = u.row[stuff][order], u.shape[stuff][order], u.size[stuff][order]
        heads = np.flatnonzero(np.concatenate([[True], (r[1:] != r[:-1]) | (s[1:] != s[:-1])]))
        r, s, size = r[heads], s[heads], np.add.reduceat(size, heads)
        order = np.lexsort((-size, r))
        r, s, size = r[order], s[order], size[order]
        first = np.flatnonzero(np.diff(r, prepend=-1))
        rank = np.arange(len(r)) - np.repeat(first, np.diff(np.append(first, len(r))))
        few = np.bincount(r[rank < FEW], weights=size[rank < FEW], minlength=n)
        top[r[first]] = s[first]
    enough = amount >= np.where(strong, UNITS, WORDS)
    return (mass > 0) & (share >= SHARE) & enough & (few >= DOMINANT * mass), share, top


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for start in range(0, b.num_rows, ROWS):
            yield b.slice(start, ROWS)


def stuffed_pages(df: DataFrame, key: str, column: str) -> DataFrame:
    """(key, share, shape) of the pages that are mostly stuffing. One pass."""
    flat = df.select(F.col(key).alias("key"), F.col(column).cast("string").alias("text")).where("text is not null")
    kind = dict(flat.dtypes)["key"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            flagged, share, top = judge_pages(b.column("text"))
            at = np.flatnonzero(flagged)
            yield pa.RecordBatch.from_arrays([b.column("key").take(pa.array(at, pa.int64())), pa.array(share[at]), pa.array([shape_name(s) for s in top[at].tolist()], pa.string())], names=["key", "share", "shape"])

    return widened(flat).mapInArrow(run, f"key {kind}, share double, shape string")


def shape_groups(df: DataFrame, column: str) -> DataFrame:
    """(kind, shape, units, pages, characters) over the whole crawl; counted within each batch before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            u = Units(b.column(0))
            shapes, at, n = np.unique(u.shape, return_inverse=True, return_counts=True)
            size = np.bincount(at, weights=u.size, minlength=len(shapes)).round().astype(np.int64)
            pages = np.bincount(np.unique(np.stack([at, u.row], 1), axis=0)[:, 0], minlength=len(shapes)) if len(at) else np.zeros(0, np.int64)
            names = [shape_name(s) for s in shapes.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array([x.split()[0] for x in names], pa.string()), pa.array(names, pa.string()), *(pa.array(x.astype(np.int64)) for x in (n, pages, size))], names=["kind", "shape", "units", "pages", "characters"])

    flat = df.select(F.col(column).cast("string").alias("text")).where("text is not null")
    return flat.mapInArrow(run, "kind string, shape string, units long, pages long, characters long").groupBy("kind", "shape").agg(*(F.sum(c).alias(c) for c in ("units", "pages", "characters")))
