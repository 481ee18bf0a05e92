"""Versioned zone transition tables as sorted arrays, for vectorised local-to-UTC conversion."""

from __future__ import annotations

import datetime as dt
import functools
import importlib.metadata
import zoneinfo

import numpy as np

#: Years covered by explicit transitions; outside, the nearest offset holds.
FIRST_YEAR, LAST_YEAR = 1900, 2100

# Zone abbreviations and their offsets from UTC in minutes.
ABBREVIATIONS = {
    "UTC": 0, "GMT": 0, "Z": 0, "UT": 0, "WET": 0, "BST": 60, "WEST": 60, "CET": 60, "CEST": 120, "MEZ": 60, "MESZ": 120,
    "EET": 120, "EEST": 180, "MSK": 180, "IST": 330, "SGT": 480, "HKT": 480, "CST": -360, "JST": 540, "KST": 540,
    "EST": -300, "EDT": -240, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420,
    "AEST": 600, "AEDT": 660, "NZST": 720, "NZDT": 780,
}


def tz_version() -> str:
    """Version of the zone database behind the tables."""
    try:
        return "tzdata-" + importlib.metadata.version("tzdata")
    except importlib.metadata.PackageNotFoundError:
        for root in zoneinfo.TZPATH:
            try:
                with open(f"{root}/tzdata.zi") as f:
                    return f.readline().strip("# \n").replace("version ", "system-")
            except OSError:
                continue
    return "system"


@functools.lru_cache(maxsize=None)
def transitions(zone: str) -> tuple[np.ndarray, np.ndarray] | None:
    """(wall seconds at which an offset ends, offsets in seconds): offsets[searchsorted(ends, wall, 'right')].

    The wall time of a switch is that of its later side, so a time that occurs twice takes the earlier moment and one that
    never occurs is carried on with the offset before the gap. None for an unknown zone.
    """
    try:
        tz = zoneinfo.ZoneInfo(zone)
    except (zoneinfo.ZoneInfoNotFoundError, ValueError, OSError, IsADirectoryError):
        return None
    utc = dt.timezone.utc

    def offset(ts: int) -> int:
        return int(dt.datetime.fromtimestamp(ts, utc).astimezone(tz).utcoffset().total_seconds())

    low = int(dt.datetime(FIRST_YEAR, 1, 1, tzinfo=utc).timestamp())
    high = int(dt.datetime(LAST_YEAR, 1, 1, tzinfo=utc).timestamp())
    step = 7 * 86400  # no zone has switched twice within a week and back
    ends, offsets, last = [], [offset(low)], low
    for t in range(low + step, high + step, step):
        if offset(t) != offsets[-1]:
            a, b = last, t
            while b - a > 1:
                mid = (a + b) // 2
                a, b = (mid, b) if offset(mid) == offsets[-1] else (a, mid)
            now = offset(b)
            ends.append(b + max(offsets[-1], now))
            offsets.append(now)
            if offset(t) != now:
                ends.append(t + max(now, offset(t)))
                offsets.append(offset(t))
        last = t
    return np.array(ends, dtype=np.int64), np.array(offsets, dtype=np.int64)


def to_utc(wall: np.ndarray, zone: str) -> np.ndarray | None:
    """UTC seconds of wall-clock seconds in a named zone."""
    if (table := transitions(zone)) is None:
        return None
    ends, offsets = table
    return wall - offsets[np.searchsorted(ends, wall, side="right")]
