"""Mixed timestamp texts."""

import datetime as dt
import zoneinfo

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from eventide.operators import timestamps as T

TABLE = T.ZoneTable.build(["America/New_York", "America/Phoenix", "America/Los_Angeles", "Not/AZone"])
NY = "America/New_York"


def us(*a):
    return int(dt.datetime(*a, tzinfo=dt.timezone.utc).timestamp()) * 1_000_000


def one(text, zone=NY, order="MDY"):
    r = T.parse_batch(pd.Series([text]), pd.Series([zone], dtype=object), pd.Series([order], dtype=object), TABLE)
    return None if r.isna()[0] else int(r[0])


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("2024-01-18T04:43:35Z", us(2024, 1, 18, 4, 43, 35)),
        ("2021-09-14T14:24:20-04:00", us(2021, 9, 14, 18, 24, 20)),
        ("2024-08-25T13:47:04.260Z", us(2024, 8, 25, 13, 47, 4) + 260_000),
        ("20251015201612-0700", us(2025, 10, 16, 3, 16, 12)),
        ("2023-07-16 09:49:26.340699+00:00", us(2023, 7, 16, 9, 49, 26) + 340_699),
        ("202202230517", us(2022, 2, 23, 10, 17)),
        ("2024-12-18 15:11:39 GMT", us(2024, 12, 18, 15, 11, 39)),
        ("2021-03-14 01:31 EST", us(2021, 3, 14, 6, 31)),
        ("Nov 17 2021 6:39 PM PST", us(2021, 11, 18, 2, 39)),
        ("Sep 11, 2025 9:48 AM", us(2025, 9, 11, 13, 48)),
        ("17JAN2023:22:54:15", us(2023, 1, 18, 3, 54, 15)),
        ("03-Nov-2024 23:29", us(2024, 11, 4, 4, 29)),
        ("  07/02/2023   05:43 ", us(2023, 7, 2, 9, 43)),
        ("02/01/23 15:20", us(2023, 2, 1, 20, 20)),
        ("7/17/2025 12:35 AM", us(2025, 7, 17, 4, 35)),
        ("2023-03-04 13:55:24+00", us(2023, 3, 4, 13, 55, 24)),
        ("1688344568", 1_688_344_568_000_000),
        ("1718415420854", 1_718_415_420_854_000),
        ("2024-11-13T10:38:33+05:30", us(2024, 11, 13, 5, 8, 33)),
    ],
)
def test_layouts(text, want):
    assert one(text) == want


@pytest.mark.parametrize(
    "text",
    [None, "", "   ", "pending", "n/a", "2024-13-45 99:99", "00/00/0000 00:00", "20230427", "2021-02-21", "31-Oct-2023", "2023-02-29 10:00", "2024-01-01 24:00", "1/1/2024 13:00 PM",
     "2022-03-13 02:30", "2021-11-07 01:30", "2024-01-01X10:00", "2024-01-01 10:00 XYZ", "9" * 5000, "12:30"],
)
def test_no_instant(text):
    assert one(text) is None


def test_order_and_zone():
    assert one("03/04/2024 10:00", order="DMY") == us(2024, 4, 3, 14, 0)
    assert one("03/04/2024 10:00", order=None) is None
    assert one("13/04/2024 10:00", order=None) == us(2024, 4, 13, 14, 0)
    assert one("03/04/2024 10:00", zone=None) is None and one("03/04/2024 10:00", zone="Not/AZone") is None
    assert one("2022-03-13 02:30", zone="America/Phoenix") == us(2022, 3, 13, 9, 30)
    assert one("2022-03-13 02:30 EST") == us(2022, 3, 13, 7, 30)


@settings(max_examples=200, deadline=None)
@given(st.datetimes(dt.datetime(1971, 1, 1), dt.datetime(2037, 1, 1)))
def test_wall_clock_against_zoneinfo(naive):
    naive = naive.replace(microsecond=0)
    z = zoneinfo.ZoneInfo(NY)
    instants = {naive.replace(tzinfo=z, fold=f).astimezone(dt.timezone.utc) for f in (0, 1)}
    real = {i for i in instants if i.astimezone(z).replace(tzinfo=None) == naive}
    want = int(real.pop().timestamp()) * 1_000_000 if len(real) == 1 else None
    assert one(naive.strftime("%Y-%m-%d %H:%M:%S")) == want


def test_table(spark):
    sites = spark.createDataFrame([("A", NY, "MDY"), ("B", "America/Phoenix", "DMY")], "hospital_id string, timezone string, date_order string")
    rows = [("A", "03/04/2024 10:00", "x"), ("B", "03/04/2024 10:00", "x"), (None, "03/04/2024 10:00", "x"), ("C", "1688344568", "x"), ("A", None, "x"), ("A", "03/04/2024 10:00", "x")]
    df = spark.createDataFrame(rows, "hospital_id string, t string, timezone string")
    got = [(r.hospital_id, r.instant_us) for r in T.normalise(df, "t", sites).orderBy("hospital_id", "instant_us").collect()]
    assert got == [(None, None), ("A", None), ("A", us(2024, 3, 4, 15)), ("A", us(2024, 3, 4, 15)), ("B", us(2024, 4, 3, 17)), ("C", 1_688_344_568_000_000)]
    assert T.normalise(df.limit(0), "t", sites).count() == 0
    assert "timezone" in T.normalise(df, "t", sites).columns
