"""Implausible readings."""

import random

from eventide.operators import spikes

LIMITS = {"flow": (0.0, 12.0), "sweep": (0.0, 30.0)}


def series(seed=3, runs=40, n=60):
    rnd = random.Random(seed)
    rows, want = [], set()
    for k in range(runs):
        level, noise = rnd.uniform(3, 5), rnd.uniform(0.02, 0.1)
        v = [round(level + rnd.gauss(0, noise), 3) for _ in range(n)]
        for i in range(n // 2, n):
            v[i] = round(v[i] + 0.9, 3)  # a lasting step
        i = rnd.randrange(8, 20)
        width = rnd.choice([1, 2, 3])
        for j in range(i, i + width):
            v[j] = round(v[j] - 20 * noise, 3)
            want.add((f"r{k}", j))
        if k % 4 == 0:
            for j in range(40, 54):
                v[j] = v[40]
                want.add((f"r{k}", j))
        if k % 5 == 0:
            v[36] = -2.0
            want.add((f"r{k}", 36))
        rows += [(1000 * k + i, f"r{k}", "flow", i, x) for i, x in enumerate(v)]
    return rows, want


def run(spark, rows):
    df = spark.createDataFrame(rows, "record_id bigint, source string, field string, t bigint, v double").selectExpr("*", "'x' as reason", "1 as n")
    return {(r.record_id, r.reason) for r in spikes.implausible(df, LIMITS).collect()}


def test_planted(spark):
    rows, want = series()
    got = {(f"r{i // 1000}", i % 1000) for i, _ in run(spark, rows)}
    assert len(want - got) <= 0.03 * len(want) and len(got - want) <= 0.03 * len(want)


def test_shards_change_nothing(spark, monkeypatch):
    rows, _ = series(runs=12)
    whole = run(spark, rows)
    monkeypatch.setattr(spikes, "MAX_SHARD", 10)
    assert run(spark, rows) == whole


def test_constant_series_repeats_and_nulls(spark):
    rows = [(i, "c", "sweep", i, 4.0 if i < 30 else 5.0) for i in range(60)]  # steps of a setting are no cases
    rows += [(100, None, "flow", 1, 99.0), (101, "z", "flow", None, -1.0), (102, "z", "flow", 1, None), (103, "z", "flow", 2, float("nan")), (104, None, None, None, None)]
    assert run(spark, rows) == {(100, "impossible"), (101, "impossible")}
    rows, _ = series(runs=20)
    twice = rows + [(i + 500_000, s, f, t, v) for i, s, f, t, v in rows]
    once = run(spark, rows)
    assert run(spark, twice) == once | {(i + 500_000, r) for i, r in once}
    assert run(spark, []) == set()


def test_hot_run_leaves_other_runs_alone(spark):
    rows, _ = series()
    alone = run(spark, rows)
    rnd = random.Random(8)
    hot = [(10**6 + i, "hot", "flow", i, round(4 + rnd.gauss(0, 0.4 if rnd.random() < 0.25 else 0.03), 3)) for i in range(len(rows) // 2)]
    both = run(spark, rows + hot)
    assert {x for x in both if x[0] < 10**6} == alone


def test_a_restless_run_has_its_own_cutoff(spark):
    rows, _ = series()
    rnd = random.Random(9)
    restless = [(10**6 + i, "restless", "flow", i, round(4 + rnd.gauss(0, 0.4 if rnd.random() < 0.25 else 0.03), 3)) for i in range(20_000)]
    cases = [x for x in run(spark, rows + restless) if x[0] >= 10**6]
    assert len(cases) < 0.01 * len(restless)
