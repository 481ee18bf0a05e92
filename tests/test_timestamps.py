import datetime as dt
import random
import zoneinfo

import numpy as np
import pytest

from brindle.functions.zones import to_utc
from brindle.operators.timestamps import message_times, normalise_array

CASES = [
    ("2025-02-02T16:19:30+01:00", None, "2025-02-02T15:19:30.000000Z"),
    ("2025-02-01 01:08:51", "Europe/Berlin", "2025-02-01T00:08:51.000000Z"),
    ("2025-02-01 01:08:51", "No/Such", "2025-02-01T01:08:51.000000Z"),
    ("1738400087609", None, "2025-02-01T08:54:47.609000Z"),
    ("1738417089592985", None, "2025-02-01T13:38:09.592985Z"),
    ("1738584036.9004009", None, "2025-02-03T12:00:36.900400Z"),
    ("Sat Feb 01 08:03:53 +0000 2025", None, "2025-02-01T08:03:53.000000Z"),
    ("Sat, 01 Feb 2025 23:21:49 -0500", None, "2025-02-02T04:21:49.000000Z"),
    ("20250201T041004Z", None, "2025-02-01T04:10:04.000000Z"),
    ("2025-02-01T18:00:24.702304984+01:00", None, "2025-02-01T17:00:24.702304Z"),
    ("2025年2月1日下午9:17", "Asia/Shanghai", "2025-02-01T13:17:00.000000Z"),
    ("2025年2月16日上午12:03", None, "2025-02-16T00:03:00.000000Z"),
    ("2025年2月16日下午12:03", None, "2025-02-16T12:03:00.000000Z"),
    ("02/06/2025 07:26 PM EST", None, "2025-02-07T00:26:00.000000Z"),
    ("01.02.2025 20:40:43 CET", None, "2025-02-01T19:40:43.000000Z"),
    ("2025-02-01 15:56:41 America/New_York", None, "2025-02-01T20:56:41.000000Z"),
    ("2025-11-02 01:30:00 America/New_York", None, "2025-11-02T05:30:00.000000Z"),  # occurs twice
    ("2026-02-30 10:00:00", None, None), ("0000-00-00 00:00:00", None, None), ("2025-13-01 00:00:00", None, None), ("2025-01-01 25:00:00", None, None),
    ("", None, None), ("-", None, None), ("just now", None, None), (None, None, None), ("2025-01-01 10:00 Mars/Base", None, None), ("9" * 500, None, None),
]


def test_notations():
    values, zones, want = zip(*CASES)
    assert normalise_array(list(values), list(zones)) == list(want)
    assert normalise_array([], []) == []


@pytest.mark.parametrize("zone", ["Europe/Berlin", "America/New_York", "Asia/Kolkata", "Australia/Lord_Howe", "America/St_Johns"])
def test_zone_tables_equal_the_library(zone):
    rng = random.Random(5)
    wall = np.array([rng.randrange(0, 2**31) for _ in range(4000)])
    tz, epoch = zoneinfo.ZoneInfo(zone), dt.datetime(1970, 1, 1)
    want = [int((epoch + dt.timedelta(seconds=int(w))).replace(tzinfo=tz, fold=0).timestamp()) for w in wall]
    assert to_utc(wall, zone).tolist() == want


def test_messages(spark):
    rows = [(1, "2025-02-01 01:00:00", "2025-02-01 01:00:00", '{"data":{"tz":"Asia/Tokyo"', 7), (2, None, "", None, 7), (2, None, "", None, 7)]
    df = spark.createDataFrame(rows, "id long, published_at string, received_at string, raw_event_json string, zone int")
    assert sorted(map(tuple, message_times(df).collect())) == [(1, "published_at", "2025-01-31T16:00:00.000000Z"), (1, "received_at", "2025-02-01T01:00:00.000000Z")]
    assert message_times(df.limit(0)).count() == 0


def test_padding_of_any_length():
    wide = " " * 300 + "2025-02-01 01:08:51" + "\t" * 5000
    assert normalise_array([wide, "2025-02-01 01:08:51", "1" * 3000], ["Europe/Berlin", None, None]) == ["2025-02-01T00:08:51.000000Z", "2025-02-01T01:08:51.000000Z", None]
