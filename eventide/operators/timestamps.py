"""Mixed timestamp texts to one UTC instant (problem 7).

Each text is reduced to its character-class shape ("2024/03/16 13:29" has
the shape "9999/99/99 99:99").  A shape is resolved to a field layout once
per worker; all texts of a shape within an Arrow batch have equal length, so
the fields are cut out and converted as numpy columns.  Wall-clock times go
through a transition table of the site's zone that is built on the driver,
carries the tz database version, and is shipped with the function.

The step is a projection: it neither shuffles nor holds more than a batch.

Defined results: null, empty, blank or over-long (> 64 characters after
collapsing white space) texts, dates without a time, impossible dates or
times, and texts of no known layout give null.  Wall-clock times give null
when the zone is unknown or null, and when the zone had that time twice or
never.  All-numeric dates of an unknown order give null unless only one
order is possible.  Missing parts are zero; digits past microseconds are cut.
"""

from __future__ import annotations

import datetime as dt
import functools
import re
import zoneinfo
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_CHARS = 64
MAX_ZONES = 1000  # the tz database has about 600 names
_FIRST, _LAST = dt.datetime(1900, 1, 1), dt.datetime(2101, 1, 1)
_US = 1_000_000

# Abbreviations with one meaning in the delivering hospitals, hours from UTC.
ABBREVIATIONS = {
    "Z": 0, "UTC": 0, "GMT": 0, "EST": -5, "EDT": -4, "CST": -6, "CDT": -5,
    "MST": -7, "MDT": -6, "PST": -8, "PDT": -7, "AKST": -9, "AKDT": -8, "HST": -10,
}
MONTHS = ("JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC")
MONTH_NAMES = (
    "JANUARY", "FEBRUARY", "MARCH", "APRIL", "MAY", "JUNE", "JULY", "AUGUST",
    "SEPTEMBER", "OCTOBER", "NOVEMBER", "DECEMBER",
)

_ZONE = r"(?: ?(?P<z>A{3,4}|A|[+-]99:?99|[+-]99))?"
_CLOCK = rf"(?P<H>99?):(?P<M>99)(?::(?P<S>99)(?:[.,](?P<f>9{{1,9}}))?)?(?: ?(?P<ap>AA)(?!A))?{_ZONE}"
_JOIN = r"(?:, | (?P<t>A) | |(?P<t2>A)|:)"
_DATES = (
    r"(?P<y>9999)(?P<s>[-/.])(?P<m>99?)(?P=s)(?P<d>99?)",
    r"(?P<p>99?)(?P<s>[-/.])(?P<q>99?)(?P=s)(?P<y>9999|99)",
    r"(?P<d>99?)[-/. ]?(?P<mon>A{3,9})[-/., ]{0,2}(?P<y>9999|99)",
    r"(?P<mon>A{3,9})[. ]{1,2}(?P<d>99?),? (?P<y>9999)",
)
LAYOUTS = tuple(re.compile(d + _JOIN + _CLOCK) for d in _DATES) + (
    re.compile(rf"(?P<y>9999)(?P<m>99)(?P<d>99)(?:(?P<t>A)| )?(?P<H>99)(?P<M>99)(?:(?P<S>99)(?:[.,](?P<f>9{{1,9}}))?)?{_ZONE}"),
    re.compile(r"(?P<e>9{9,10})(?:\.(?P<f>9{1,9}))?"),
    re.compile(r"(?P<e3>9{13})"),
)
_SHAPE = {**{ord(c): "9" for c in "0123456789"}, **{c: "A" for c in [*range(65, 91), *range(97, 123)]}}


@functools.lru_cache(maxsize=65536)
def layout(shape: str) -> dict[str, tuple[int, int]] | None:
    """Spans of the fields of a shape, or None for shapes that are no time."""
    for pattern in LAYOUTS:
        if m := pattern.fullmatch(shape):
            return {k: m.span(k) for k, v in m.groupdict().items() if v is not None and k != "s"}
    return None


@dataclass(frozen=True)
class ZoneTable:
    """UTC offsets of zones between 1900 and 2100: per zone the instants (s) from which an offset (s) holds."""

    version: str
    zones: dict[str, tuple[np.ndarray, np.ndarray]]

    @classmethod
    def build(cls, names: list[str]) -> ZoneTable:
        """Unknown names are left out; their wall-clock times stay unresolved."""
        return cls(_tz_version(), {n: t for n in sorted(set(names)) if (t := _transitions(n))})

    def to_utc(self, local: np.ndarray, zone: str) -> tuple[np.ndarray, np.ndarray]:
        """UTC seconds of wall-clock seconds, and whether exactly one instant has that time."""
        starts, offsets = self.zones[zone]
        at = lambda u: offsets[np.searchsorted(starts, u, side="right") - 1]
        a, b = local - at(local - 86400), local - at(local + 86400)
        good_a, good_b = a + at(a) == local, b + at(b) == local
        return np.where(good_a, a, b), (good_a | good_b) & ~(good_a & good_b & (a != b))


def _tz_version() -> str:
    for root in zoneinfo.TZPATH:
        try:
            with open(f"{root}/tzdata.zi") as f:
                return f.readline().removeprefix("# version").strip()
        except OSError:
            continue
    try:
        import tzdata

        return tzdata.IANA_VERSION
    except ImportError:
        return "unknown"


@functools.lru_cache(maxsize=MAX_ZONES)
def _transitions(name: str) -> tuple[np.ndarray, np.ndarray] | None:
    try:
        zone = zoneinfo.ZoneInfo(name)
    except (ValueError, OSError, zoneinfo.ZoneInfoNotFoundError):
        return None
    epoch = dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)
    off = lambda s: int((epoch + dt.timedelta(seconds=s)).astimezone(zone).utcoffset().total_seconds())
    lo, hi = (int((x - dt.datetime(1970, 1, 1)).total_seconds()) for x in (_FIRST, _LAST))
    starts, offsets = [-(2**62)], [off(lo)]
    for s in range(lo, hi, 2 * 86400):
        a, b = s, s + 2 * 86400
        if (after := off(b)) == offsets[-1]:
            continue
        while b - a > 1:
            mid = (a + b) // 2
            a, b = (a, mid) if off(mid) == after else (mid, b)
        starts.append(b)
        offsets.append(after)
    return np.array(starts, np.int64), np.array(offsets, np.int64)


def _numbers(chars: np.ndarray, span: tuple[int, int]) -> np.ndarray:
    digits = chars[:, span[0] : span[1]].astype(np.int64) - 48
    return digits @ (10 ** np.arange(span[1] - span[0] - 1, -1, -1, dtype=np.int64))


def _words(chars: np.ndarray, span: tuple[int, int]) -> np.ndarray:
    part = np.ascontiguousarray(chars[:, span[0] : span[1]])
    return np.char.upper(part.view(f"U{span[1] - span[0]}").ravel())


def _offset_seconds(chars: np.ndarray, span: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Stated offset in seconds and whether it is a known one."""
    if chr(chars[0, span[0]]) in "+-" or chr(chars[0, span[0]]).isdigit():
        sign = np.where(chars[:, span[0]] == ord("-"), -1, 1)
        hours = _numbers(chars, (span[0] + 1, span[0] + 3))
        minutes = _numbers(chars, (span[1] - 2, span[1])) if span[1] - span[0] > 3 else np.zeros_like(hours)
        return sign * (hours * 3600 + minutes * 60), (hours <= 15) & (minutes < 60)
    names, where = np.unique(_words(chars, span), return_inverse=True)
    hours = [ABBREVIATIONS.get(str(n)) for n in names]
    return np.array([(h or 0) * 3600 for h in hours], np.int64)[where], np.array([h is not None for h in hours])[where]


def _ordered(p: np.ndarray, q: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Month and day of an all-numeric date; month 0 where the order is open."""
    sure = (order == "MDY") | (order == "DMY")
    mdy = (order == "MDY") | (~sure & ((q > 12) | (p == q)))
    dmy = (order == "DMY") | (~sure & (p > 12))
    return np.where(mdy, p, np.where(dmy, q, 0)), np.where(mdy, q, np.where(dmy, p, 0))


def _parse(texts: np.ndarray, spans: dict, zone: np.ndarray, order: np.ndarray, table: ZoneTable) -> tuple[np.ndarray, np.ndarray]:
    """Microseconds UTC and validity of equally shaped texts."""
    chars = texts.astype(f"U{len(texts[0])}").view(np.uint32).reshape(len(texts), -1)
    n = len(texts)
    micros = np.zeros(n, np.int64)
    if "f" in spans:
        a, b = spans["f"]
        b = min(b, a + 6)
        micros = _numbers(chars, (a, b)) * 10 ** (6 - (b - a))
    if "e3" in spans:
        return _numbers(chars, spans["e3"]) * 1000, np.ones(n, bool)
    if "e" in spans:
        return _numbers(chars, spans["e"]) * _US + micros, np.ones(n, bool)

    ok = np.ones(n, bool)
    for k in ("t", "t2"):
        if k in spans:
            ok &= _words(chars, spans[k]) == "T"
    year = _numbers(chars, spans["y"])
    if spans["y"][1] - spans["y"][0] == 2:
        year = np.where(year < 70, 2000 + year, 1900 + year)
    if "p" in spans:
        month, day = _ordered(_numbers(chars, spans["p"]), _numbers(chars, spans["q"]), order)
    else:
        day = _numbers(chars, spans["d"])
        if "mon" in spans:
            names, where = np.unique(_words(chars, spans["mon"]), return_inverse=True)
            number = lambda w: next((i + 1 for i in range(12) if w in (MONTHS[i], MONTH_NAMES[i]) or w == "SEPT" and i == 8), 0)
            month = np.array([number(str(w)) for w in names], np.int64)[where]
        else:
            month = _numbers(chars, spans["m"])
    hour, minute = _numbers(chars, spans["H"]), _numbers(chars, spans["M"])
    second = _numbers(chars, spans["S"]) if "S" in spans else np.zeros(n, np.int64)
    if "ap" in spans:
        half = _words(chars, spans["ap"])
        ok &= ((half == "AM") | (half == "PM")) & (hour >= 1) & (hour <= 12)
        hour = hour % 12 + 12 * (half == "PM")
    ok &= (month >= 1) & (month <= 12) & (day >= 1) & (hour < 24) & (minute < 60) & (second < 60) & (year >= 1900) & (year <= 2099)
    y, m = np.where(ok, year, 1970), np.where(ok, month, 1)
    first = (y - 1970).astype("M8[Y]").astype("M8[M]") + (m - 1)
    days = first.astype("M8[D]") + (np.where(ok, day, 1) - 1)
    ok &= days < (first + 1).astype("M8[D]")
    local = days.astype(np.int64) * 86400 + hour * 3600 + minute * 60 + second
    if "z" in spans:
        offset, known = _offset_seconds(chars, spans["z"])
        return (local - offset) * _US + micros, ok & known
    utc = np.zeros(n, np.int64)
    one = np.zeros(n, bool)
    for name in pd.unique(zone):
        if isinstance(name, str) and name in table.zones:
            at = np.nonzero(zone == name)[0]
            utc[at], one[at] = table.to_utc(local[at], name)
    return utc * _US + micros, ok & one


def parse_batch(texts: pd.Series, zones: pd.Series, orders: pd.Series, table: ZoneTable) -> pd.Series:
    """Instants (microseconds UTC, nullable) of a batch of texts."""
    clean = [" ".join(t[: 4 * MAX_CHARS].split()) if isinstance(t, str) else "" for t in texts]
    cut = [isinstance(t, str) and len(t) > 4 * MAX_CHARS and t[4 * MAX_CHARS :].strip() != "" for t in texts]
    shapes = ["" if c or len(t) > MAX_CHARS else t.translate(_SHAPE) for t, c in zip(clean, cut)]
    codes, distinct = pd.factorize(np.array(shapes, dtype=object))
    words = np.array(clean, dtype=object)
    zone, order = zones.to_numpy(dtype=object), orders.to_numpy(dtype=object)
    value, valid = np.zeros(len(words), np.int64), np.zeros(len(words), bool)
    by = np.argsort(codes, kind="stable")
    ends = np.cumsum(np.bincount(codes, minlength=len(distinct)))
    for k, shape in enumerate(distinct):
        if spans := layout(shape):
            at = by[(ends[k - 1] if k else 0) : ends[k]]
            value[at], valid[at] = _parse(words[at], spans, zone[at], order[at], table)
    return pd.Series(pd.arrays.IntegerArray(value, ~valid))


def instant_us(text: Column, zone: Column, order: Column, table: ZoneTable) -> Column:
    """Column of microseconds since 1970 UTC, null where the text fixes no instant."""

    @F.pandas_udf("bigint")
    def convert(t: pd.Series, z: pd.Series, o: pd.Series) -> pd.Series:
        return parse_batch(t, z, o, table)

    return convert(text, zone, order)


def normalise(df: DataFrame, text: str, sites: DataFrame, out: str = "instant_us", site: str = "hospital_id") -> DataFrame:
    """``df`` with the instant of column ``text`` as ``out``.

    ``sites`` has hospital_id (key), timezone and date_order.  Only its
    distinct zone names reach the driver, checked against MAX_ZONES.  Rows of
    an unknown or null site keep stated zones only.
    """
    zones = [r[0] for r in sites.select("timezone").where("timezone is not null").distinct().limit(MAX_ZONES + 1).collect()]
    if len(zones) > MAX_ZONES:
        raise ValueError(f"more than {MAX_ZONES} distinct time zones")
    table = ZoneTable.build(zones)
    s = sites.where(F.col(site).isNotNull()).groupBy(F.col(site).alias("__site")).agg(F.min("timezone").alias("__zone"), F.min("date_order").alias("__order"))
    return (
        df.join(s, df[site] == s["__site"], "left")
        .withColumn(out, instant_us(F.col(text), F.col("__zone"), F.col("__order"), table))
        .drop("__site", "__zone", "__order")
    )
