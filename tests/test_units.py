"""Units of another size."""

import random

import pytest

from eventide.operators import units as U
from pyspark.sql import functions as F


@pytest.mark.parametrize(
    ("quantity", "unit", "common", "want"),
    [("creatinine", "µmol/L", "mg/dL", 0.011312), ("creatinine", "mg%", "mg/dL", 1), ("glucose_serum", "mM", "mg/dL", 18.0156), ("glucose_serum", "grams per liter", "mg/dL", 100),
     ("wbc", "G/l (10^9)", "10^3/µL", 1), ("wbc", "cells/mcL", "10^3/µL", 0.001), ("wbc", "x10E9/L", "10^3/µL", 1), ("calcium_total", "mEq/L", "mg/dL", 2.0039), ("sodium", "mEq/L", "mmol/L", 1),
     ("so2_arterial", "frac", "%", 100), ("pco2_arterial", "kilopascal", "mmHg", 7.50062), ("hemoglobin", "g/100 mL", "g/dL", 1), ("troponin_t", "ug/L", "ng/L", 1000), ("wbc", "furlong", "10^3/µL", None),
     ("wbc", "mg/dL", "10^3/µL", None)],
)
def test_declared(quantity, unit, common, want):
    got = U.declared_factor(quantity, unit, common)
    assert got is None if want is None else got == pytest.approx(want, rel=1e-3)


def test_read_quantity(spark):
    rows = [("1.5", "mg/dL", "x", 1.5, "mg/dL"), ("1.5 mg/dL", None, "x", 1.5, "mg/dL"), ("result 142 (mmol/L)", "", "x", 142.0, "(mmol/L)"), ("> 5", "mg/dL", "x", None, None), ("hemolyzed", None, "x", None, None),
            ("10,000 /µL", None, "x", 10000.0, "/µL"), ("4.52x10^3/uL", None, "x", 4.52, "x10^3/uL"), ("7.86 10^3/µL", None, "x", 7.86, "10^3/µL"), ("3", None, "Albumin [g/L]", 3.0, "g/L"), ("3", None, "Albumin, g/L", 3.0, "g/L"),
            ("3", None, "ALB in G/L", 3.0, "G/L"), ("3", " ", "creat blood", 3.0, ""), (None, None, None, None, ""), ("", None, None, None, ""), ("5" * 400, None, None, float("5" * 300 + "5" * 8), "")]
    df = spark.createDataFrame([(a, b, c) for a, b, c, _, _ in rows], "v string, u string, n string")
    number, unit = U.read_quantity(F.col("v"), F.col("u"), F.col("n"))
    got = df.select(number.alias("x"), unit.alias("y")).collect()
    for g, (v, _, _, x, y) in list(zip(got, rows))[:-1]:
        assert g.x == x, v
        assert y is None or g.y == y, v


def test_linked_and_unitless(spark):
    rnd = random.Random(2)
    rows, want = [], {}
    i = 0
    for e in range(400):
        for _ in range(6):
            true, kind = rnd.lognormvariate(0.3, 0.5), rnd.choice(["mg/dl", "umol/l", "zorks", "", "bare"])
            v, key = {"mg/dl": (true, "mg/dl"), "umol/l": (true * 88.42, "umol/l"), "zorks": (true * 10, "zorks"), "": (true, ""), "bare": (true * 88.42, "")}[kind]
            rows.append((i, f"e{e}", "creatinine", v, key, 5.0))
            want[i] = true
            i += 1
    df = spark.createDataFrame(rows, "i int, entity string, quantity string, v double, key string, factor double")
    common = spark.createDataFrame([("creatinine", "mg/dL"), ("unused", "g/L")], "quantity string, unit string")
    out, graph = U.to_common(df, common)
    factors = {r.key: r.factor for r in graph.collect()}
    assert factors["umol/l"] == pytest.approx(0.011312, rel=1e-3) and factors["zorks"] == pytest.approx(0.1)  # mg/L, found from links alone
    good = [abs(r.v * r.factor / want[r.i] - 1) < 0.01 for r in out.collect()]
    assert sum(good) > 0.985 * len(good) and len(good) == len(rows)
    assert U.to_common(df.limit(0), common)[0].count() == 0


def test_offsets(spark):
    rnd = random.Random(3)
    rows = []
    for e in range(200):
        c = rnd.gauss(37, 1)
        rows += [(f"e{e}", "temp", c, "c"), (f"e{e}", "temp", c * 9 / 5 + 32, "f")]
    df = spark.createDataFrame(rows, "entity string, quantity string, v double, key string")
    out, graph = U.to_common(df, spark.createDataFrame([("temp", "C")], "quantity string, unit string"))
    by = {(r.key): (r.factor, r.offset) for r in graph.collect()}
    assert by["c"] == (1.0, 0.0) and by["f"] == pytest.approx((5 / 9, -160 / 9))
    both = {}
    for r in out.collect():
        both.setdefault(r.entity, []).append(r.v * r.factor + r.offset)
    assert all(abs(a - b) < 1e-9 for a, b in both.values())
    fit = {r.key: r for r in U.source_graph(df, spark.createDataFrame([("temp", "C")], "quantity string, unit string")).collect()}["f"]
    assert fit.estimated_offset == pytest.approx(-160 / 9, abs=1)


def test_two_digits(spark):
    xs = [1.4999, 0.0449, 132.6, 99.6, 4.54, 580000.0, 0.0]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(U.two_digits_milli(F.col("x"))).collect()]
    assert got == [1500, 45, 130000, 100000, 4500, 580000000, 0]
