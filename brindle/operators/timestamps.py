"""Mixed timestamp notations to UTC.

Each value becomes a shape mask (digits `9`, letters `A`, everything else itself); every distinct mask of a batch is matched
with the grammar below once, which gives the positions of its fields; all values of the mask are then converted together
by array arithmetic and, where they name a zone, through the versioned transition tables of `functions.zones`.

Cases: null, blank and meaningless values, impossible dates and unknown zones give no row. Digits beyond microseconds are
cut off. A local time that occurs twice is the earlier moment. Repeated rows give repeated results.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from brindle.functions.zones import ABBREVIATIONS, to_utc, tz_version

# Month names, meridiem words.
_NAMES = "JANUARY FEBRUARY MARCH APRIL MAY JUNE JULY AUGUST SEPTEMBER OCTOBER NOVEMBER DECEMBER".split()
MONTHS = {w: i for i, name in enumerate(_NAMES, 1) for w in (name, name[:3])}
HALVES = {"AM": 0, "PM": 12, "上午": 0, "凌晨": 0, "早上": 0, "中午": 12, "下午": 12, "晚上": 12}

_DATE = r"(?:(?P<Y>9999)(?P<s>[-/.])(?P<m>99?)(?P=s)(?P<d>99?)|(?P<Y2>9999)(?P<m2>99)(?P<d2>99)(?=[TA])|(?P<Y3>9999)年(?P<m3>99?)月(?P<d3>99?)日|(?P<m4>99?)/(?P<d4>99?)/(?P<Y4>9999)|(?P<d5>99?)\.(?P<m5>99?)\.(?P<Y5>9999)|(?:A{3,9},? )?(?P<d6>99?)[ -](?P<N6>A{3,9})[ -](?P<Y6>9999))"
_TIME = r"(?P<B>(?:上午|下午|凌晨|早上|中午|晚上)?)\s?(?:(?P<H>99?):(?P<M>99)(?::(?P<S>99)(?:[.,](?P<f>9{1,12}))?)?|(?P<H2>99)(?P<M2>99)(?P<S2>99)?)(?: ?(?P<P>AA)(?= |$))?"
_ZONE = r"(?: ?(?:(?P<sign>[-+])(?P<zh>99):?(?P<zm>99)?|(?P<zone>A[A_]*(?:/[A_+-]+)*)))?"
GRAMMAR = [
    re.compile(rf"(?P<lead>\s*){_DATE}(?:[TA]| |\s)?{_TIME}{_ZONE}\s*"),
    re.compile(r"(?P<lead>\s*)A{3,9},? (?P<N7>A{3,9}) (?P<d7>99?) (?P<H>99):(?P<M>99):(?P<S>99)(?: (?P<sign>[-+])(?P<zh>99):?(?P<zm>99)| (?P<zone>A{1,5}))? (?P<Y7>9999)\s*"),
    re.compile(rf"(?P<lead>\s*){_DATE}\s*"),
]
EPOCH = re.compile(r"\s*(?P<neg>-?)(?P<whole>9{9,19})(?:\.(?P<part>9{1,12}))?\s*")
UNITS = {9: 1, 10: 1, 11: 1, 12: 10**3, 13: 10**3, 14: 10**3, 15: 10**6, 16: 10**6, 17: 10**6, 18: 10**9, 19: 10**9}  # digits -> units a second

_CLASS = np.arange(0x3000, dtype=np.uint32)
_CLASS[48:58] = 57
for _a, _b in ((65, 91), (97, 123)):
    _CLASS[_a:_b] = 65


@functools.lru_cache(maxsize=4096)
def parser(mask: str) -> tuple[str, dict[str, tuple[int, int]]] | None:
    """Kind and field positions of a mask; None for one that denotes no moment."""
    if m := EPOCH.fullmatch(mask):
        return "epoch", {k: m.span(k) for k, v in m.groupdict().items() if v}
    for g in GRAMMAR:
        if m := g.fullmatch(mask):
            return "civil", {k: m.span(k) for k, v in m.groupdict().items() if v}
    return None


def _number(chars: np.ndarray, span: tuple[int, int]) -> np.ndarray:
    out = np.zeros(len(chars), dtype=np.int64)
    for k in range(*span):
        out = out * 10 + (chars[:, k].astype(np.int64) - 48)
    return out


def _words(chars: np.ndarray, span: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct words of a field and each row's index into them."""
    block = np.ascontiguousarray(chars[:, span[0] : span[1]])
    return np.unique(block.view(f"<U{span[1] - span[0]}").ravel(), return_inverse=True)


def _days(y: np.ndarray, m: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Days from 1970-01-01 in the proleptic Gregorian calendar."""
    months = (y - 1970) * 12 + (m - 1)
    return months.astype("datetime64[M]").astype("datetime64[D]").astype(np.int64) + d - 1


def _civil(chars: np.ndarray, at: dict[str, tuple[int, int]], zones: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(chars)
    get = lambda *ks: next((_number(chars, at[k]) for k in ks if k in at), np.zeros(n, np.int64))
    y, d = (get(*(f"{c}{i}" for i in ("", 2, 3, 4, 5, 6, 7))) for c in "Yd")
    ok = np.ones(n, bool)
    if name := next((k for k in ("N6", "N7") if k in at), None):
        words, which = _words(chars, at[name])
        m = np.array([MONTHS.get(str(w).upper(), 0) for w in words], dtype=np.int64)[which]
    else:
        m = get("m", "m2", "m3", "m4", "m5")
    hour, minute, second = get("H", "H2"), get("M", "M2"), get("S", "S2")
    for k in ("B", "P"):
        if k in at:
            words, which = _words(chars, at[k])
            half = np.array([HALVES.get(str(w).upper(), -1) for w in words], dtype=np.int64)[which]
            ok &= (half >= 0) & (hour >= 0) & (hour <= (12 if k == "P" else 23))
            hour = np.where(hour <= 12, hour % 12 + half, hour)
    micros = np.zeros(n, np.int64)
    if "f" in at:
        a, b = at["f"]
        micros = _number(chars, (a, min(b, a + 6))) * 10 ** max(0, 6 - (b - a))
    ok &= (m >= 1) & (m <= 12) & (hour <= 23) & (minute <= 59) & (second <= 60) & (y >= 1) & (d >= 1)
    m = np.where(ok, m, 1)
    ok &= d <= _days(np.where(m == 12, y + 1, y), m % 12 + 1, np.ones(n, np.int64)) - _days(y, m, np.ones(n, np.int64))
    wall = _days(y, m, d) * 86400 + hour * 3600 + minute * 60 + second
    if "sign" in at:
        sign = np.where(chars[:, at["sign"][0]] == ord("-"), -1, 1)
        return (wall - sign * (get("zh") * 3600 + get("zm") * 60)) * 10**6 + micros, ok
    words, which = _words(chars, at["zone"]) if "zone" in at else np.unique(zones, return_inverse=True)
    utc = wall.copy()
    for k, word in enumerate(map(str, words)):
        rows = which == k
        if word.upper() in ABBREVIATIONS:
            utc[rows] = wall[rows] - ABBREVIATIONS[word.upper()] * 60
        elif (moved := to_utc(wall[rows], word)) is not None:
            utc[rows] = moved
        elif "zone" in at:
            ok[rows] = False  # a notation that names a zone nobody knows denotes no moment; a default zone falls back to UTC
    return utc * 10**6 + micros, ok


def _epoch(chars: np.ndarray, at: dict[str, tuple[int, int]]) -> np.ndarray:
    a, b = at["whole"]
    unit = UNITS[b - a]
    whole = _number(chars, (a, b))
    if unit > 10**6:
        micros = whole // (unit // 10**6)
    else:
        micros = whole * (10**6 // unit)
        if "part" in at:
            c, e = at["part"]
            digits = {1: 6, 10**3: 3}.get(unit, 0)
            if digits:
                micros += _number(chars, (c, min(e, c + digits))) * 10 ** max(0, digits - (e - c))
    return -micros if "neg" in at else micros


def normalise_array(values: list[str | None], zones: list[str | None]) -> list[str | None]:
    """UTC texts of a batch; None for values that denote no moment. `zones` are the default zones of values without one."""
    out: list[str | None] = [None] * len(values)
    groups: dict[int, list[int]] = {}  # by length, so that a long value doesn't widen the array of all others
    stripped = [v.strip() if v else "" for v in values]
    for i, v in enumerate(stripped):
        if any(c.isdigit() for c in v):
            groups.setdefault((len(v) // 64).bit_length(), []).append(i)
    for keep in groups.values():
        _normalise(stripped, zones, keep, out)
    return out


def _normalise(values: list[str], zones: list[str | None], keep: list[int], out: list[str | None]) -> None:
    texts = np.array([values[i] for i in keep])
    width = texts.dtype.itemsize // 4
    chars = texts.view(np.uint32).reshape(len(keep), width)
    mask = np.where(chars < len(_CLASS), _CLASS[np.minimum(chars, len(_CLASS) - 1)], chars).astype(np.uint32)
    masks, which = np.unique(np.ascontiguousarray(mask).view(f"<U{width}").ravel(), return_inverse=True)
    default = np.array([zones[i] or "UTC" for i in keep])
    for k, shape in enumerate(map(str, masks)):
        if (plan := parser(shape)) is None:
            continue
        rows = np.flatnonzero(which == k)
        kind, at = plan
        micros, ok = (_epoch(chars[rows], at), np.ones(len(rows), bool)) if kind == "epoch" else _civil(chars[rows], at, default[rows])
        texts_out = np.char.add(np.datetime_as_string(micros.astype("datetime64[us]")), "Z")
        for r, t, good in zip(rows, texts_out, ok):
            if good:
                out[keep[r]] = str(t)


def normalise_timestamps(df: DataFrame, key: str, fields: dict[str, str | None]) -> DataFrame:
    """Rows (key, field, utc_time, tz_version) of every value that denotes a moment.

    `fields` maps each text column to the column with the default zone of its values, or None for UTC. Other columns of
    `df` are not read. One pass, no shuffle.
    """
    names = list(fields)
    flat = df.select(F.col(key).alias("_k"), *(F.col(f).cast("string").alias(f"_v{i}") for i, f in enumerate(names)), *(F.col(z).alias(f"_z{i}") if (z := fields[f]) else F.lit(None).cast("string").alias(f"_z{i}") for i, f in enumerate(names)))
    version = tz_version()
    kind = dict(flat.dtypes)["_k"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = b.column("_k")
            for i, f in enumerate(names):
                texts = normalise_array(b.column(f"_v{i}").to_pylist(), b.column(f"_z{i}").to_pylist())
                at = [j for j, t in enumerate(texts) if t is not None]
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(at, pa.int64())), pa.array([f] * len(at), pa.string()), pa.array([texts[j] for j in at], pa.string()), pa.array([version] * len(at), pa.string())], names=["key", "field", "utc_time", "tz_version"])

    return flat.mapInArrow(run, f"key {kind}, field string, utc_time string, tz_version string")


def event_zone(raw):
    """Zone named by `tz` at any depth of an event, also where the event is cut off or held in a string; null without one."""
    return F.nullif(F.regexp_extract(raw, r'\\*"tz\\*"\s*:\s*\\*"([A-Za-z][A-Za-z0-9_/+\-]*)', 1), F.lit(""))


def message_times(messages: DataFrame) -> DataFrame:
    """published_at (local to the event's zone) and received_at (UTC) of messages."""
    df = messages.select("id", "published_at", "received_at", event_zone(F.col("raw_event_json")).alias("zone"))
    return normalise_timestamps(df, "id", {"published_at": "zone", "received_at": None}).select(F.col("key").alias("message_id"), "field", "utc_time")
