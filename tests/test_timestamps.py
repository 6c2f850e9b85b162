"""Timestamp cascade against an independent reading with the standard library."""

from __future__ import annotations

from datetime import UTC, datetime
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from gridloom.operators import timestamps as ts
from gridloom.plans.p3_timestamps import price_instants


def us(*parts: int, zone: str = "UTC", fold: int = 0) -> int:
    at = datetime(*parts, tzinfo=ZoneInfo(zone), fold=fold).astimezone(UTC)
    d = at - datetime(1970, 1, 1, tzinfo=UTC)
    return (d.days * 86400 + d.seconds) * 1_000_000 + d.microseconds


NY = "America/New_York"
CASES = [
    # text, default zone, day first, utc_us, status
    ("2024-01-02", NY, False, us(2024, 1, 2), "ok"),
    ("2024-02-30", NY, False, None, "unreadable"),
    ("06/07/2024", NY, False, us(2024, 6, 7), "ok"),
    ("06/07/2024", NY, True, us(2024, 7, 6), "ok"),
    ("06/07/2024", NY, None, None, "unreadable"),
    ("07/07/2024", NY, None, us(2024, 7, 7), "ok"),
    ("13/45/2024", NY, False, None, "unreadable"),
    ("9/3/23", NY, False, us(2023, 9, 3), "ok"),
    ("19-Oct-32", NY, True, us(2032, 10, 19), "ok"),
    ("May 12, 2026", NY, False, us(2026, 5, 12), "ok"),
    ("September 9, 2025", NY, False, us(2025, 9, 9), "ok"),
    ("26 Jul 2038", NY, True, us(2038, 7, 26), "ok"),
    ("23.11.2033", NY, False, us(2033, 11, 23), "ok"),
    ("2024-06-01 10:20", NY, False, us(2024, 6, 1, 10, 20, zone=NY), "ok"),
    ("2024-06-01T10:20:30.123456Z", NY, False, us(2024, 6, 1, 10, 20, 30, 123456), "ok"),
    ("2024-06-01T10:20:30.5+01:00", NY, False, us(2024, 6, 1, 9, 20, 30, 500000), "ok"),
    ("2024-06-01 10:20:30-0700", NY, False, us(2024, 6, 1, 17, 20, 30), "ok"),
    ("02/26/2023 01:04 PM", NY, False, us(2023, 2, 26, 13, 4, zone=NY), "ok"),
    ("02/26/2023 12:04 AM", NY, False, us(2023, 2, 26, 0, 4, zone=NY), "ok"),
    ("02/26/2023 13:04 PM", NY, False, None, "unreadable"),
    ("02/26/2023 00:04 AM", NY, False, None, "unreadable"),
    ("2025-07-01 09:29 EDT", "Europe/Paris", False, us(2025, 7, 1, 13, 29), "ok"),
    ("2025-07-01 09:29 XYZ", NY, False, None, "unreadable"),
    ("04/04/2026 24:00:00", NY, False, us(2026, 4, 5, zone=NY), "ok"),
    ("04/04/2026 24:01:00", NY, False, None, "unreadable"),
    ("2024-06-01 10:60", NY, False, None, "unreadable"),
    ("20230326093000", NY, True, us(2023, 3, 26, 9, 30, zone=NY), "ok"),
    ("20230101 1915", NY, True, us(2023, 1, 1, 19, 15, zone=NY), "ok"),
    ("1679800500", NY, True, 1679800500_000_000, "ok"),
    ("1696377600000", NY, True, 1696377600_000_000, "ok"),
    ("2024-03-10 02:30", NY, False, None, "nonexistent"),
    ("2024-11-03 01:30", NY, False, None, "ambiguous"),
    ("2024-11-03 01:30 EST", NY, False, us(2024, 11, 3, 6, 30), "ok"),
    ("2024-11-03 02:30", NY, False, us(2024, 11, 3, 2, 30, zone=NY), "ok"),
    ("2024-04-07 01:45", "Australia/Lord_Howe", False, None, "ambiguous"),
    ("2024-06-01 10:20", None, False, None, "no_zone"),
    ("2024-06-01", None, False, us(2024, 6, 1), "ok"),
    ("  2024-06-01    10:20 ", NY, False, us(2024, 6, 1, 10, 20, zone=NY), "ok"),
    ("Q3 2031", NY, False, None, "unreadable"),
    ("", NY, False, None, "unreadable"),
    (None, NY, False, None, "unreadable"),
    ("x" * 100_000, NY, False, None, "unreadable"),
    ("2024-06-01 and more", NY, False, None, "unreadable"),
]


@pytest.fixture(scope="module")
def read(spark):
    data = [(i, c[0], c[1], c[2]) for i, c in enumerate(CASES)]
    df = spark.createDataFrame(data, "i int, t string, z string, f boolean")
    df = ts.with_instant(ts.with_read(df, F.col("t"), F.col("f"), "r"), F.col("r"), F.col("z"), "at")
    return {r["i"]: (r["utc_us"], r["status"]) for r in df.select("i", "at.*").collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_text(read, i):
    assert read[i] == CASES[i][3:], CASES[i]


def test_prices(spark, rows):
    places = spark.createDataFrame(
        [("A", "s1", NY, "US"), ("B", "s2", "Europe/Berlin", "DE"), ("C", "s1", "No/Zone", "US"), ("D", "s1", NY, "US"), ("D", "s1", "UTC", "US"), (None, None, None, None)],
        "location_id string, source_id string, tz_name string, country string",
    )
    prices = spark.createDataFrame(
        [
            (1, "A", "s1", "06/01/2024 10:00", "06/01/2024 14:05:00", "x"),
            (2, "A", "s1", "06/01/2024 10:00", "00/00/0000 00:00", "x"),
            (3, "B", "s2", "01.06.2024 10:00:00", None, "x"),
            (4, "Z", "s1", "06/01/2024 10:00", "", "x"),
            (5, "Z", "s1", "2024-06-01T10:00:00-05:00", "N/A", "x"),
            (6, "C", "s1", "06/01/2024 10:00", None, "x"),
            (7, "D", "s1", "06/01/2024 10:00", None, "x"),
            (8, None, None, None, None, None),
            (9, "A", "unknown", "06/01/2024 10:00", None, "x"),
            (10, "A", "s1", "11/03/2024 01:30", "1730615400", "x"),
        ],
        "row_id long, location_id string, source_id string, local_interval string, gmtintervalend string, tz_name string",
    )
    got = {r["row_id"]: (r["utc_us"], r["status"]) for r in price_instants(prices, places).collect()}
    assert got == {
        1: (us(2024, 6, 1, 14, 5), "ok"), 2: (us(2024, 6, 1, 14), "ok"), 3: (us(2024, 6, 1, 8), "ok"), 4: (None, "no_zone"), 5: (us(2024, 6, 1, 15), "ok"),
        6: (None, "no_zone"), 7: (None, "no_zone"), 8: (None, "unreadable"), 9: (None, "unreadable"), 10: (1730615400_000_000, "ok"),
    }
    assert rows(price_instants(prices.limit(0), places.limit(0))) == []
