"""Declarations, readers, ledgers and outputs."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from eventide.operators import disclosure
from eventide.sources import config


def test_overrides_and_declarations():
    base = {"note": "x", "a": {"b": 1, "c": [1], "note_2": 0}, "d": 2}
    assert config.merged(base, {"a": {"b": 5}, "d": {"e": 1}, "note": 1}) == {"a": {"b": 5, "c": [1]}, "d": {"e": 1}} and base["a"]["b"] == 1
    assert config.harmonisation_record(base)["sha256"] == config.harmonisation_record({"a": {"b": 1, "c": [1]}, "d": 2})["sha256"]
    with pytest.raises(ValueError):
        config.require_site("s1", "s2", "episodes")
    factors, units = config.unit_rules({"columns": {"x": {"unit": "L", "factor": 2, "range": [0, 9]}, "y": {"unit": "g"}}})
    assert factors == {"x": (2.0, (0, 9)), "y": (1.0, None)} and units == {"x": "L", "y": "g"}
    for bad in ({"x": {"factor": 1}}, {"x": {"unit": "L", "factor": 0}}, {"x": {"unit": "L", "range": [3, 3]}}):
        with pytest.raises(ValueError):
            config.unit_rules({"columns": bad})
    a = config.schema_snapshot({"one.sql": "x", "two.sql": "y"})
    assert a["all"] != config.schema_snapshot({"one.sql": "x", "two.sql": "z"})["all"] and a["one.sql"] == config.schema_snapshot({"one.sql": "x"})["one.sql"]
    assert config.permissible("tables:\n- name: adt\n  columns:\n  - {name: kind, permissible_values: [icu, 1]}\n  - {name: n}\n") == {"adt": {"kind": ["icu", "1"]}}


def test_dose_reader(spark):
    at = lambda h: dt.datetime(2024, 1, 1, h)
    rows = [("s", at(5), "Norepinephrine", 0.1, "mcg/kg/min"), ("s", at(1), "norepinephrine", 0.1, "mcg/kg/min"), ("s", at(6), "norepinephrine", 6.0, "mcg/min"), ("s", at(7), "norepinephrine", 1.0, "furlong"), ("s", at(8), "norepinephrine", 9.0, "mg/hr"), (None, at(8), "norepinephrine", 9.0, "mg/hr"), ("s", at(9), "other", 1.0, "mg")]
    df = spark.createDataFrame(rows, "h string, at timestamp, name string, dose double, unit string")
    targets = spark.createDataFrame([("norepinephrine", "mcg/min")], "name string, unit string")
    weights = spark.createDataFrame([("s", at(3), 60.0), ("s", at(4), 70.0)], "h string, at timestamp, weight double")
    rules = spark.createDataFrame([("norepinephrine", "mg/hr", 0.001, False), ("norepinephrine", "mcg/min", 1.0, True)], "name string, unit string, factor double, quarantine boolean")
    events, counts = config.dose_events(df, targets, weights, key="h", at="at", name="name", dose="dose", unit="unit", corrections=rules)
    assert sorted((r.dttm.hour, round(r.value, 6)) for r in events.collect()) == [(5, 7.0), (8, 0.15)]  # 70 kg known at five, none at one
    assert {(r.concept, r.status): r.n for r in counts.collect()} == {("norepinephrine", "ok"): 2, ("norepinephrine", "no_weight"): 1, ("norepinephrine", "unknown_unit"): 1, ("other", "unknown_unit"): 1}


def test_shadows_segments_and_selection(spark):
    raw = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "i int, c string")
    assert {r.i for r in config.fit_shadows(raw.where("i > 1"), raw, ["i"]).collect()} == {1}
    assert config.as_segments([2, 1, 1]) == [(None, 1.0, False, False), (1.0, 2.0, True, False), (2.0, None, True, False)] and config.as_segments([(0, 1, True, True)]) == [(0, 1, True, True)]
    assert config.selected(raw, "c", "a").count() == 2
    with pytest.raises(ValueError):
        config.selected(raw, "c", "z")
    rows = spark.createDataFrame([("x", 0.0, 1.0, True, True)], "concept string, lo double, hi double, lo_closed boolean, hi_closed boolean")
    with pytest.raises(ValueError):
        config.csv_segments(rows, ["x", "y"], {}, {"y": [0.5]}, {})
    with pytest.raises(ValueError):
        config.harmonised(raw, "c", {"a": "nope"}, ["b"])


def test_gate_and_stats_files(spark, tmp_path):
    good = {"cells": {"a": 20, "b": 0}, "availability": {"labs": 5}, "unknown_rate": 0.01, "p99_length": 90}
    assert all(ok for _, ok in config.gate(good, max_unknown=0.02, context=100, floor=10))
    bad = dict(config.gate({"cells": {"a": 3}, "who": "P00000001", "unknown_rate": None, "p99_length": 200}, max_unknown=0.02, context=100, floor=10))
    assert not any(bad.values())
    df = spark.createDataFrame([("a", 1.5), ("b", 0.1)], "token string, center double")
    path = f"{tmp_path}/s.json"
    assert config.write_stats(df, path, vocab="1", part="train") == config.write_stats(df.orderBy(F.desc("token")), path, part="train", vocab="1")
    assert {tuple(r) for r in config.read_stats(spark, path, "token string, center double", vocab="1", part="train").collect()} == {("a", 1.5), ("b", 0.1)}
    with pytest.raises(ValueError):
        config.read_stats(spark, path, "token string, center double", vocab="2", part="train")


def test_waterfall_hides_what_would_follow(spark):
    steps = spark.createDataFrame([(1, 100), (2, 96), (3, 50), (4, 50)], "step int, n int")
    got = {r.step: (r.left_shown, r.removed_shown) for r in disclosure.waterfall(steps, "step", "n").collect()}
    # four removed is small, so one of 100 and 96 must go, and with 96 hidden one more of the next equation
    assert got[2][1] == "<10" and got[2][0] == "hidden" and "hidden" in (*got[3], got[1][0]) and got[4] == ("50", "0")


def test_ledger(tmp_path):
    ledger = disclosure.Ledger(f"{tmp_path}/l")
    cell = lambda c, n, s="evaluable": {"cell": c, "status": s, "n": n}
    ledger.publish("r1", [cell("a", 50), cell("b", None, "suppressed")], lambda: None)
    with pytest.raises(ValueError, match="already"):
        ledger.publish("r1", [cell("a", 50)], lambda: None)
    with pytest.raises(ValueError, match="moved"):
        ledger.publish("r2", [cell("a", 53)], lambda: None)
    with pytest.raises(ValueError, match="hidden"):
        ledger.publish("r2", [cell("b", 80)], lambda: None)

    def crash():
        raise OSError

    with pytest.raises(OSError):
        ledger.publish("r3", [cell("a", 70), cell("c", None, "suppressed")], crash)
    assert ledger.confirmed() == {"r1"} and ledger.suppressed() == {"b", "c"}  # what may have got out stays hidden
    ledger.publish("r3", [cell("a", 75)], lambda: None)  # the crashed release may be tried again, with other counts
    assert disclosure.sticky_fixpoint({"a": 40, "b": 40, "d": 40}, [("a", "b", "d")], ledger) == {"a", "b"}
    payload = {"outcome": "x", "release": "r1"}
    seen: set[str] = set()
    report = {"payload": payload, "signature": disclosure.sign(payload, b"k")}
    assert disclosure.ingest(report, b"k", seen, "x") == payload
    for args in ((report, b"k", seen, "x"), (report, b"z", set(), "x"), (report, b"k", set(), "y")):
        with pytest.raises(ValueError):
            disclosure.ingest(*args)


def test_report_schema():
    ok = {"site": "s", "cells": [{"n": 20, "name": "a"}]}
    disclosure.check_schema(ok, {"site": str}, {"n": int, "name": str})
    for bad in ({"site": "s"}, {**ok, "extra": 1}, {"site": 1, "cells": []}, {"site": "s", "cells": [{"n": True, "name": "a"}]}, {"site": "s", "cells": [{"n": 20, "name": "a", "id": "P1"}]}):
        with pytest.raises(ValueError):
            disclosure.check_schema(bad, {"site": str}, {"n": int, "name": str})
