"""Streams over several micro-batches: state is carried, late rows are dropped."""

import datetime as dt
import random

from pyspark.sql import functions as F

from eventide.streaming import live


def test_state_is_carried_between_batches(spark):
    rnd = random.Random(1)
    rows = [(rnd.choice("ab"), i, rnd.choice([None, 1.0, 2.0, 3.0])) for i in range(80)]
    df = spark.createDataFrame(rows, "k string, i bigint, v double")
    last, want = {}, {}
    for k, i, v in rows:
        last[k] = v if v is not None else last.get(k)
        want[k, i] = last[k]
    for parts in (1, 8):
        got = live.run_to_end(live.carry_forward(live.replay(df, "i", parts), "k", "i", "v"), mode="append").collect()
        assert {(r.k, r.i): r.carried for r in got} == want and len(got) == 80


def test_streaks_reach_over_batches(spark):
    minutes = [("a", m, True) for m in (0, 100, 200)] + [("b", 0, True), ("b", 50, False), ("b", 100, True), ("b", 110, True), ("b", 120, True), ("c", 0, True), ("c", 500, True), ("c", 1000, True), ("c", 1100, True)]
    df = spark.createDataFrame(minutes, "k string, m bigint, x boolean")
    for parts in (1, 6):
        out = live.run_to_end(live.sustained_crossings(live.replay(df, "m", parts), "k", "m", "x", readings=3, within=600), mode="append")
        assert {(r.k, r.completed_min) for r in out.collect()} == {("a", 200), ("b", 120), ("c", 1100)}


def test_late_rows_are_dropped(spark):
    day = dt.datetime(2024, 1, 1)
    rows = [(0, day + dt.timedelta(hours=h), "x", 1.0) for h in (1, 2)] + [(1, day + dt.timedelta(days=9), "x", 1.0), (2, day + dt.timedelta(days=9, hours=1), "x", 1.0)]
    rows += [(3, day + dt.timedelta(hours=1), "x", 100.0), (4, day + dt.timedelta(days=9, hours=2), "x", 1.0)]  # late by more than a batch
    df = spark.createDataFrame(rows, "i bigint, ts timestamp, kind string, v double")
    out = live.run_to_end(live.windowed_counts(live.replay(df, "i", 5, [0.5, 1.5, 2.5, 3.5]).drop("i"), "ts", "kind", "v", "1 day", late="1 hour"), mode="append")
    assert {(r.n, r.total) for r in out.collect()} == {(2, 2.0)}  # the late hundred is in no window, the open one not out yet


def test_sessions_and_windows(spark):
    day = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([("a", day + dt.timedelta(minutes=m), m) for m in (0, 10, 50, 55)], "k string, ts timestamp, i int")
    out = live.run_to_end(live.sessions(live.replay(df, "i", 2), "k", "ts", "20 minutes")).collect()
    assert sorted(r.n for r in out) == [2, 2]
    stays = spark.createDataFrame([("a", day + dt.timedelta(minutes=15), day + dt.timedelta(minutes=60))], "k string, lo timestamp, hi timestamp")
    seen = live.run_to_end(live.in_window(live.available(live.replay(df, "i", 2), "ts", 5, "1 day"), stays, "k", "available_at", "lo", "hi"), mode="append")
    assert sorted((r.i, r.pos_min) for r in seen.select("i", "pos_min").collect()) == [(10, 0), (50, 40), (55, 45)]
    assert live.run_to_end(live.replay(df.where(F.lit(False)), "i", 1), mode="append").count() == 0
