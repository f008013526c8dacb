"""Numeric and time expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(v: Column) -> Column:
    """Not null, not NaN, not infinite."""
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))


def scale(v: Column, factor: float) -> Column:
    """v times factor; a factor of one over an integer divides by the integer, which rounds once only."""
    inverse = round(1 / factor) if factor else 0
    if factor and factor < 1 and abs(inverse * factor - 1) < 1e-12:
        return v / float(inverse)
    return v * float(factor)


def unit_interval(*parts: Column, seed: str = "") -> Column:
    """Uniform number in [0, 1) from the first 8 bytes of a SHA-256 of the parts joined by ':'."""
    text = F.concat_ws(":", F.lit(seed), *parts) if seed else F.concat_ws(":", *parts)
    return F.conv(F.substring(F.sha2(text, 256), 1, 16), 16, 10).cast("decimal(20,0)").cast("double") / float(2**64)


def z_score(v: Column, center: Column, spread: Column, cap: float) -> Column:
    """(v - center) / spread where finite and within the cap, else null."""
    z = (v - center) / F.when(spread > 0, spread)
    return F.when(finite(v) & (F.abs(z) <= cap), z)


def minutes(start: Column, end: Column) -> Column:
    """Whole minutes between two timestamps, cut toward zero."""
    return F.timestamp_diff("MINUTE", start, end)


def time_bin(at_minutes: Column, n_bins: int, horizon_hours: float) -> Column:
    """Left-closed bin of a grid over the horizon; not clamped."""
    return F.floor(at_minutes * n_bins / round(horizon_hours * 60)).cast("int")


def to_utc(local: Column, zone: Column | str) -> Column:
    """UTC of a wall-clock timestamp: the earlier instant where the zone had it twice, null where it never had it."""
    zone = F.lit(zone) if isinstance(zone, str) else zone
    utc = F.to_utc_timestamp(local, zone)
    return F.when(F.from_utc_timestamp(utc, zone) == local, utc)


def wilson(k: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Wilson score interval of k out of n; null for n = 0."""
    p, m = k / n, F.lit(z * z)
    mid, half = (p + m / (2 * n)) / (1 + m / n), z * F.sqrt(p * (1 - p) / n + m / (4 * n * n)) / (1 + m / n)
    return F.when(n > 0, F.greatest(F.lit(0.0), mid - half)), F.when(n > 0, F.least(F.lit(1.0), mid + half))
