"""Nearest values, trailing minima and prefix sums against brute force, over shards of every size."""

import random

import pytest
from pyspark.sql import functions as F

from eventide.operators import joins, labels, statistics, windows


def readings(seed=1, n=150):
    rnd = random.Random(seed)
    return [(i, rnd.choice(["a", "b", "hot", "hot", "hot"]), rnd.randrange(0, 300), rnd.choice([None, *range(9)]), "x") for i in range(n)] + [(1000, None, 5, 3, "x"), (1001, "a", None, 3, "x")]


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(readings(), "i int, k string, m bigint, v int, __low string").cache()


@pytest.mark.parametrize("width", [1, 7, 1000])
def test_nearest(frame, width):
    ranked = frame.where("k is not null and m is not null").withColumn("r", F.col("i"))
    got = {r.i: (r.a, r.b) for r in windows.nearest(ranked, ["k"], "m", "r", earlier={"a": F.col("v")}, later={"b": F.when(F.col("v") > 5, F.col("i"))}, width=width).collect()}
    rows = [r for r in readings() if r[1] is not None and r[2] is not None]
    for i, k, m, v, _ in rows:
        past = [(y, x, w) for x, q, y, w, _ in rows if q == k and (y, x) <= (m, i) and w is not None]
        ahead = [(y, x) for x, q, y, w, _ in rows if q == k and (y, x) > (m, i) and w is not None and w > 5]
        assert got[i] == (max(past)[2] if past else None, min(ahead)[1] if ahead else None)


def test_trailing_rise(frame):
    out = windows.trailing_rise(frame, ["k"], "m", "v", absolute=4, absolute_minutes=20, relative=3, relative_minutes=75)
    assert out.columns == [*frame.columns, "risen"]
    got = {r.i: r.risen for r in out.collect()}
    rows = readings()
    assert len(got) == len(rows)
    for i, k, m, v, _ in rows:
        low = lambda span: min((w for _, q, y, w, _ in rows if q == k and q is not None and None not in (m, y, w) and m - span <= y <= m - 1), default=None)
        a, r = (low(20), low(75)) if m is not None and v is not None else (None, None)
        assert got[i] == bool((a is not None and v - a >= 4) or (r is not None and v >= 3 * r)), i


def test_future_first(frame):
    got = {r.i: r.next_hit_min for r in windows.future_first(frame, ["k"], "m", F.col("v") > 6).collect()}
    rows = readings()
    assert len(got) == len(rows)
    for i, k, m, _, _ in rows:
        later = [y for _, q, y, w, _ in rows if k is not None and q == k and None not in (m, y, w) and y > m and w > 6]
        assert got[i] == min(later, default=None)


def test_previous_stay(spark):
    rnd = random.Random(5)
    rows = [(i, rnd.choice(["a", "b"]), a := rnd.randrange(0, 10**6), rnd.choice([None, a + rnd.randrange(0, 10**5)])) for i in range(60)] + [(99, None, 5, 9), (100, "a", None, 9)]
    df = spark.createDataFrame(rows, "i int, e string, s bigint, t bigint").select("i", "e", F.timestamp_seconds("s").alias("s"), F.timestamp_seconds("t").alias("t"))
    got = {r.i: r.x for r in joins.previous_stay(df, "e", "s", "t").select("i", F.unix_seconds("prior_end").alias("x")).collect()}
    assert got == {i: max((y for _, q, _, y in rows if e is not None and q == e and s is not None and y is not None and y < s), default=None) for i, e, s, _ in rows}


def test_anchors_of_a_hot_entity(spark):
    rnd = random.Random(3)
    rows = [("h", rnd.randrange(0, 50_000), rnd.random() < 0.05) for _ in range(300)]
    r = spark.createDataFrame(rows, "h string, minute bigint, x boolean")
    a = spark.createDataFrame([("h", m) for m in range(0, 52_000, 777)] + [("none", 5)], "h string, anchor_min bigint")
    got = {(x.h, x.anchor_min): (x.status, x.after_min) for x in labels.at_anchors(a, r, "h", F.col("x"), horizon_min=500).collect()}
    by = {}
    for _, m, x in rows:
        by[m] = by.get(m, False) or x
    for m in range(0, 52_000, 777):
        past, later = [y for y in by if y <= m], [y for y in by if m < y <= m + 500]
        hit = [y for y in later if by[y]]
        want = "prevalent" if past and by[max(past)] else "positive" if hit else "negative" if later else "censored"
        assert got["h", m] == (want, min(hit) - m if want == "positive" else None)
    assert got["none", 5] == ("censored", None)


def test_rank_statistics_over_cuts(spark):
    rnd = random.Random(2)
    rows = [(rnd.choice(["g", "g", "h", None]), round(rnd.random(), 2) if rnd.random() < 0.9 else None, rnd.randrange(2)) for _ in range(900)] + [("one", 0.5, 1)]
    df = spark.createDataFrame(rows, "g string, p double, y int")
    got = {r.g: r.auroc for r in statistics.auroc(df, ["g"]).collect()}
    precise = {r.g: r.auprc for r in statistics.average_precision(df, ["g"]).collect()}
    for g in ("g", "h", None):
        own = [(p, y) for q, p, y in rows if q == g and p is not None]
        pos, neg = [p for p, y in own if y], [p for p, y in own if not y]
        assert got[g] == pytest.approx(sum((a > b) + (a == b) / 2 for a in pos for b in neg) / len(pos) / len(neg))
        levels = sorted({p for p, _ in own}, reverse=True)
        assert precise[g] == pytest.approx(sum(sum(p == t for p in pos) * sum(p >= t for p in pos) / sum(p >= t for p, _ in own) for t in levels) / len(pos))
    assert got["one"] is None and statistics.auroc(df.limit(0), ["g"]).count() == 0 and statistics.auroc(df).first().n == sum(p is not None for _, p, _ in rows)


def test_recalibration(spark):
    rnd = random.Random(4)
    rows = []
    for _ in range(6000):
        z = rnd.gauss(0, 1.5)
        rows.append((1 / (1 + 2.718281828**-z), int(rnd.random() < 1 / (1 + 2.718281828 ** -(0.5 * z + 0.4)))))
    rows += [(0.0, 0), (1.0, 1), (None, 1)]
    large, slope = statistics.logistic_recalibration(spark.createDataFrame(rows, "p double, y int"))
    assert slope == pytest.approx(0.5, abs=0.06)
    p = [min(max(a, 1e-6), 1 - 1e-6) for a, _ in rows if a is not None]
    shifted = sum(1 / (1 + (1 - a) / a * 2.718281828459045**-large) for a in p)
    assert shifted == pytest.approx(sum(y for a, y in rows if a is not None), abs=1e-4)  # as many events as expected
    assert statistics.logistic_recalibration(spark.createDataFrame([(0.3, 1)], "p double, y int"))[0] != 0
