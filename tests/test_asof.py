"""Attributes as known at event time."""

import datetime as dt
import random

from eventide.operators import asof, joins

T0 = dt.datetime(2024, 1, 1)
at = lambda h: None if h is None else T0 + dt.timedelta(hours=h)


def brute(events, versions):
    out = {}
    for i, p, t in events:
        best = max(((s, r, k, c) for k, q, s, r, c in versions if None not in (p, q, t, s, r, c) and p == q and s <= t and r <= t), default=None)
        if best:
            out[i] = best[3]
    return out


def run(spark, events, versions, hours, how="inner"):
    e = spark.createDataFrame([(i, p, at(t), "old") for i, p, t in events], "i bigint, p string, t timestamp, c string")
    v = spark.createDataFrame([(k, p, at(s), at(r), c, 1) for k, p, s, r, c in versions], "k bigint, p string, s timestamp, r timestamp, c string, t int")
    return asof.known_at(e, v, entity="p", at="t", valid_from="s", known_from="r", value="c", tie="k", how=how, shard_seconds=hours * 3600)


def test_random_against_brute(spark):
    rnd = random.Random(1)
    events = [(i, rnd.choice(["hot", "hot", "b", "c", None]), rnd.choice([None, *range(0, 90)])) for i in range(300)]
    versions = [(k, rnd.choice(["hot", "b", "c", None]), rnd.choice([None, *range(0, 90)]), rnd.choice([None, *range(0, 90)]), rnd.choice([None, "x", "y", "z"])) for k in range(120)]
    want = brute(events, versions)
    for hours in (1, 5, 24, 10_000):
        got = [(r.i, r.c) for r in run(spark, events, versions, hours).collect()]
        assert len(got) == len(set(got)) and dict(got) == want
    left = run(spark, events, versions, 5, "left").collect()
    assert len(left) == len(events) and {r.i: r.c for r in left if r.c is not None} == want


def test_ties_repeats_and_empty(spark):
    versions = [(1, "a", 1, 2, "x"), (2, "a", 1, 2, "y"), (2, "a", 1, 2, "y")]
    assert [r.c for r in run(spark, [(1, "a", 2), (1, "a", 2)], versions, 3).collect()] == ["y", "y"]
    assert run(spark, [(1, "a", 1)], versions, 3).count() == 0
    assert run(spark, [(1, "a", 5)], [], 3).count() == 0 and run(spark, [], versions, 3).count() == 0


def test_plain_asof(spark):
    left = spark.createDataFrame([(1, "a", at(1)), (2, "a", at(2)), (3, "b", at(9)), (4, None, at(9))], "i int, k string, t timestamp")
    right = spark.createDataFrame([("a", at(1), 1.0), ("a", at(1), 3.0), ("b", at(10), 5.0), (None, at(1), 9.0)], "k string, t timestamp, v double")
    loose = {r.i: r.v for r in joins.asof(left, right, "k", "t", "t", "v").collect()}
    strict = {r.i: r.v for r in joins.asof(left, right, "k", "t", "t", "v", strict=True).collect()}
    assert loose == {1: 2.0, 2: 2.0, 3: None, 4: None} and strict == {1: None, 2: 2.0, 3: None, 4: None}
