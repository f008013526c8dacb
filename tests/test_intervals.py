"""Periods and gaps."""

import random

from eventide.operators import intervals


def brute(rows):
    by = {}
    for k, a, b in rows:
        if k is not None and a is not None and b is not None and b > a:
            by.setdefault(k, []).append((a, b))
    out = set()
    for k, v in by.items():
        merged = []
        for a, b in sorted(v):
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        out |= {(k, "period", a, b) for a, b in merged} | {(k, "gap", x[1], y[0]) for x, y in zip(merged, merged[1:])}
    return out


def run(spark, rows, width):
    df = spark.createDataFrame(rows, "k string, a bigint, b bigint").selectExpr("*", "a as s", "'x' as kind")
    got = [tuple(r) for r in intervals.periods_and_gaps(df, "k", "a", "b", shard_us=width).collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_random_against_brute(spark):
    rnd = random.Random(5)
    rows = []
    for _ in range(400):
        a = rnd.randrange(-50, 300)
        rows.append((rnd.choice(["hot", "hot", "x", "y", None]), a, a + rnd.choice([0, -3, 1, 2, 5, 20, 90])))
    rows += rows[:40] + [("x", None, 5), ("y", 4, None)]
    for width in (7, 10, 64, 10_000):
        assert run(spark, rows, width) == brute(rows)


def test_touching_nested_and_borders(spark):
    rows = [("a", 0, 10), ("a", 10, 20), ("a", 2, 5), ("b", 0, 10), ("b", 11, 12), ("c", 5, 5)]
    assert run(spark, rows, 10) == brute(rows) == {("a", "period", 0, 20), ("b", "period", 0, 10), ("b", "period", 11, 12), ("b", "gap", 10, 11)}
    assert run(spark, [("a", 1, 2)], 10) == {("a", "period", 1, 2)}


def test_far_ends_are_one_row(spark):
    rnd = random.Random(9)
    rows = [(rnd.choice("ab"), a := rnd.randrange(0, 10_000), a + rnd.choice([1, 50, 10**15])) for _ in range(30)] + [("c", 5 * i, 5 * i + rnd.choice([2, 4, 10**15]) if i > 40 else 5 * i + 3) for i in range(50)]
    for width in (3, 1000):
        assert run(spark, rows, width) == brute(rows)
    df = spark.createDataFrame(rows, "k string, a bigint, b bigint")
    assert intervals._sharded(df, "k", "a", "b", 3).count() <= len(rows)


def test_empty(spark):
    df = spark.createDataFrame([], "k string, a bigint, b bigint")
    assert intervals.periods_and_gaps(df, "k", "a", "b").count() == 0
