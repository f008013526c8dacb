"""Mixing to target weights."""

import random

import pytest

from eventide.llm import mix


def docs(spark, seed=1, n=400):
    rnd = random.Random(seed)
    rows = [(i, " ".join(rnd.choice(["heparin", "flow", "bed", "night", "unit"]) for _ in range(rnd.randrange(3, 40))) + f" {i}", rnd.choices(["a", "b", "c", "zz", None], [60, 25, 5, 5, 5])[0], 1) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string, copies int")


def targets(spark, rows):
    return spark.createDataFrame(rows, "source string, target_share double, max_repeats int")


def test_shares_and_caps(spark, monkeypatch):
    monkeypatch.setattr(mix, "LEAVES", 50)  # several buckets and levels
    monkeypatch.setattr(mix, "FAN", 3)
    t = targets(spark, [("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.15, 6), ("never", 0.05, 3)])
    chosen = mix.select(docs(spark), t)
    rows = chosen.collect()
    assert len({r.doc_id for r in rows}) == len(rows) and {r.source for r in rows} == {"a", "b", "c"}
    caps = {"a": 1, "b": 2, "c": 6}
    assert all(1 <= r.copies <= caps[r.source] for r in rows)
    total = sum(r.copies * r.n_tokens for r in rows)
    for s, share in (("a", 0.5), ("b", 0.3), ("c", 0.15)):
        got = sum(r.copies * r.n_tokens for r in rows if r.source == s)
        assert abs(got - share / 0.95 * total) <= 60
    assert sorted(map(tuple, chosen.collect())) == sorted(map(tuple, mix.select(docs(spark), t).collect()))  # the same again
    report = {r.source: r for r in mix.shares(chosen, t).collect()}
    assert report["never"].n_texts == 0 and abs(sum(r.reached_share for r in report.values()) - 1) < 1e-9


def test_copies_nulls_empty(spark):
    t = targets(spark, [("a", 0.5, 3), ("b", 0.5, 1)])
    df = spark.createDataFrame([(1, "same text", "a"), (2, "same text", "a"), (3, "same text", "b"), (4, None, "a"), (5, "", "b"), (6, "  ", "b"), (7, "other text", "b"), (8, "third text", "zz")], "doc_id bigint, text string, source string")
    rows = {r.doc_id: r.copies for r in mix.select(df, t).collect()}
    assert set(rows) == {1, 7} and rows[1] == 1  # the smallest allowance among the copies' sources
    assert mix.select(df.limit(0), t).count() == 0 and mix.select(df, t.limit(0)).count() == 0


def test_rates_and_steps():
    assert mix.rates({"a": 100, "b": 10}, {"a": 0.5, "b": 0.5, "c": 0.2}) == {"a": pytest.approx(0.1), "b": 1.0}
    assert mix.rates({}, {"a": 1.0}) == {}
    rnd = random.Random(0)
    for _ in range(2000):
        p, q, a, b, u = rnd.random(), rnd.random(), rnd.randrange(1, 9), rnd.randrange(1, 9), rnd.random()
        x, y = mix._settle(p, a, q, b, u)
        assert x in (0.0, 1.0) or y in (0.0, 1.0)
        assert -1e-9 <= min(x, y) and max(x, y) <= 1 + 1e-9 and abs(p * a + q * b - x * a - y * b) < 1e-9
