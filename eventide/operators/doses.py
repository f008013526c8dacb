"""Dose units as powers of base measures: read once per distinct spelling, applied as a join."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Sizes of amounts within their kind, minutes of times.
AMOUNTS = {"mcg": ("mass", 1.0), "ug": ("mass", 1.0), "mg": ("mass", 1e3), "g": ("mass", 1e6), "ng": ("mass", 1e-3), "units": ("units", 1.0), "unit": ("units", 1.0), "u": ("units", 1.0), "milliunits": ("units", 1e-3), "ml": ("volume", 1.0), "l": ("volume", 1e3), "meq": ("charge", 1.0), "mmol": ("molar", 1.0)}
TIMES = {"min": 1.0, "minute": 1.0, "hr": 60.0, "h": 60.0, "hour": 60.0, "day": 1440.0, "d": 1440.0}


# Base of every spelling: what it measures and how many of the base measure it is.
_BASES = {
    **{name: (kind, size) for name, (kind, size) in AMOUNTS.items()},
    **{name: ("time", size) for name, size in TIMES.items()},
    "kg": ("weight", 1.0),
}


def dimensions(text: str | None) -> tuple[dict[str, int], float] | None:
    """(power of every base measure, size) of a dose unit: 'mg/kg/hr' is mass 1, weight -1, time -1 of 1000 / 60.

    Null for a word that is no unit, a dose that starts with no amount, and
    one whose divisors are anything but a weight or a time, each once.
    """
    words = [w for w in re.split(r"/", re.sub(r"[\s.]+", "", (text or "").lower())) if w]
    bases = [_BASES.get(w) for w in words]
    if not bases or None in bases:
        return None
    kinds = [kind for kind, _ in bases]
    if kinds[0] in ("time", "weight") or not set(kinds[1:]) <= {"time", "weight"} or len(set(kinds)) < len(kinds):
        return None
    powers = {kind: 1 if i == 0 else -1 for i, kind in enumerate(kinds)}
    return powers, math.prod(size ** powers[kind] for kind, size in bases)


def minutes_of(text: str) -> float | None:
    """Minutes of the time a dose unit is per, None without one."""
    return next((TIMES[w] for w in re.split(r"/", re.sub(r"[\s.]+", "", text.lower())) if w in TIMES), None)


def dose_plan(source: str | None, target: str) -> tuple[float | None, int, str]:
    """(factor, power of the weight, status) from one dose unit to another: their dimensions may differ by the weight only."""
    units = dimensions(source), dimensions(target)
    if None in units:
        return None, 0, "unknown_unit"
    (a, size), (b, other) = units
    differ = {k: a.get(k, 0) - b.get(k, 0) for k in {*a, *b}}
    if any(differ[k] for k in differ if k not in ("weight", "time")):
        return None, 0, "other_kind"
    if differ.get("time", 0):
        return None, 0, "other_rate"
    return size / other, -differ.get("weight", 0), "ok"


def convert(df: DataFrame, dose: str, unit: str, target: str, weight: str) -> DataFrame:
    """``df`` with ``converted`` and ``status``: ok, unknown_unit, other_kind, other_rate or no_weight.

    ``unit`` and ``target`` are columns; each distinct pair is planned once
    and the plans are joined back.
    """

    def plan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(u, t, *dose_plan(u, t)) for u, t in zip(b["__u"], b["__t"])]
            yield pd.DataFrame(rows, columns=["__u", "__t", "__f", "__p", "__s"])

    pairs = df.select(F.col(unit).alias("__u"), F.col(target).alias("__t")).where("__t is not null").distinct()
    plans = pairs.mapInPandas(plan, "__u string, __t string, __f double, __p int, __s string")
    joined = df.join(plans, F.col(unit).eqNullSafe(F.col("__u")) & (F.col(target) == F.col("__t")), "left")
    needs = (F.col("__p") != 0) & (F.col(weight).isNull() | (F.col(weight) <= 0))
    status = F.when(F.col("__s").isNull(), "unknown_unit").when((F.col("__s") == "ok") & needs, "no_weight").otherwise(F.col("__s"))
    value = F.col(dose) * F.col("__f") * F.when(F.col("__p") == 1, F.col(weight)).when(F.col("__p") == -1, 1 / F.col(weight)).otherwise(1.0)
    return joined.withColumn("status", status).withColumn("converted", F.when(F.col("status") == "ok", value)).drop("__u", "__t", "__f", "__p", "__s")


def correct(df: DataFrame, rules: DataFrame, on: list[str], value: str) -> DataFrame:
    """``df`` with declared corrections: rows whose rule has ``quarantine`` are dropped, others multiplied by ``factor``; rules are unique by ``on``."""
    r = rules.select(*on, F.col("factor").alias("__f"), F.col("quarantine").alias("__q"))
    joined = df.join(r, on, "left").where(~F.coalesce("__q", F.lit(False)))
    return joined.withColumn(value, F.col(value) * F.coalesce("__f", F.lit(1.0))).drop("__f", "__q")
