"""Fitted and resampled statistics on planted data, rollout operators on small cases."""

import collections
import math
import random

import pytest
from pyspark.sql import functions as F

from eventide.operators import inference as I
from eventide.operators import rollouts as R
from eventide.operators import statistics as S


def planted(spark, n=1500, effect=0.2, seed=1):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        x = rnd.gauss(0, 1)
        e = 1 / (1 + math.exp(-x))
        a = int(rnd.random() < e)
        p = min(max(0.3 + 0.15 * x / 2 + effect * a, 0.02), 0.98)
        rows.append((f"p{i // 2}", rnd.choice("st"), ["train", "selection", "calibration", "test"][min(i % 5, 3)], x, a, int(rnd.random() < p)))
    return spark.createDataFrame(rows, "who string, site string, part string, x double, a int, y int")


def test_cross_fitted_risk_is_unbiased(spark):
    df = planted(spark)
    r = I.cross_fitted_risk(df, ["x"], "a", "y", "who", k=3).first()
    assert r.risk == pytest.approx(0.5, abs=4 * r.se) and 0.005 < r.se < 0.06
    out = I.cross_fit(df, ["x"], "a", "who", k=3)
    assert out.count() == 1500 and out.where("probability is null").count() == 0
    assert S.auroc(out, p="probability", y="a").first().auroc > 0.6


def test_task_evaluation_and_transport(spark):
    roles = {"fit": "train", "selection": "selection", "calibration": "calibration", "evaluation": "test"}
    r = I.evaluate_task(planted(spark), ["x", "a"], "y", "part", roles).first()
    assert r.status == "evaluable" and r.auroc > 0.58 and r.temperature > 0 and r.brier < 0.26
    few = planted(spark).where("part <> 'test' or who < 'p101'")
    assert I.evaluate_task(few.withColumn("y", F.when(F.col("part") == "test", 0).otherwise(F.col("y"))), ["x"], "y", "part", roles).first().status in ("suppressed", "not evaluable")
    with pytest.raises(ValueError):
        I.evaluate_task(few, ["x"], "y", "part", {**roles, "fit": "test"})
    m = I.transport_matrix(planted(spark).withColumn("part", F.when(F.col("part") == "selection", "train").otherwise(F.col("part"))), ["x", "a"], "y", "site", "part")
    cells = {(c.fit_site, c.test_site): c for c in m.collect()}
    assert len(cells) == 4 and all(c.status == "evaluable" and c.auroc > 0.52 for c in cells.values())
    small = I.transport_matrix(planted(spark, n=40), ["x"], "y", "site", "part")
    assert {c.status for c in small.collect()} <= {"not fitted", "suppressed"}


def test_calibration_tests(spark):
    rnd = random.Random(2)
    rows = [([[rnd.random() for _ in range(4)] for _ in range(2)], rnd.choice([0, 1, 2]), rnd.randrange(-1, 9)) for _ in range(3000)]
    df = spark.createDataFrame(rows, "c array<array<double>>, cause int, b int")
    r = I.d_calibration(df, "c", "cause", "b").first()
    assert r.n == sum(x[1] > 0 for x in rows) and r.p > 0.001
    skewed = df.withColumn("c", F.transform("c", lambda a: F.transform(a, lambda v: v * v)))
    assert I.d_calibration(skewed, "c", "cause", "b").first().p < 1e-6
    assert I.d_calibration(df.limit(0), "c", "cause", "b").first().p is None
    assert I.chi_square_tail(16.918978, 9) == pytest.approx(0.05, abs=1e-6) and I.chi_square_tail(3.841459, 1) == pytest.approx(0.05, abs=1e-6) and I.chi_square_tail(5.991465, 2) == pytest.approx(0.05, abs=1e-6) and I.chi_square_tail(15.507313, 8) == pytest.approx(0.05, abs=1e-6)


def test_bootstraps(spark):
    rnd = random.Random(3)
    df = spark.createDataFrame([(f"c{i % 60}", i % 3, (u := rnd.gauss(0, 1)) + 0.5 + rnd.gauss(0, 0.1), u) for i in range(600)], "c string, s int, a double, b double")
    draws = I.paired_bootstrap(df, "c", "s", "a", "b", 200)
    r = I.bootstrap_summary(draws, "difference").first()
    assert 150 < r.draws <= 200 and r.lo < 0.5 < r.hi and r.hi - r.lo < 0.1 and r.p <= 0.01  # the shared part cancels
    assert sorted(map(tuple, draws.collect())) == sorted(map(tuple, I.paired_bootstrap(df, "c", "s", "a", "b", 200).collect()))


def test_fitted_temperature_and_isotonic(spark):
    rnd = random.Random(5)
    rows = [(z := rnd.gauss(0, 2), int(rnd.random() < 1 / (1 + math.exp(-z / 2)))) for _ in range(4000)]
    df = spark.createDataFrame(rows, "z double, y int")
    assert S.fit_temperature(df, "z", "y") == pytest.approx(2, abs=0.25)
    scored = df.withColumn("p", 1 / (1 + F.exp(-F.col("z") / 2)))
    assert S.isotonic_ici(scored) < 0.03 < S.isotonic_ici(df.withColumn("p", 1 / (1 + F.exp(-F.col("z") * 2))))


def test_draws_follow_probabilities(spark):
    logits = spark.createDataFrame([(k, t, float(t)) for k in range(3000) for t in range(3)], "key int, token int, logit double")
    p = R.next_probabilities(logits)
    n = collections.Counter(r.token for r in R.draw(p, 7).collect())
    for t in range(3):
        assert n[t] / 3000 == pytest.approx(math.exp(t) / sum(map(math.exp, range(3))), abs=0.03)
    allowed = spark.createDataFrame([(0, 1), (0, 2)], "key int, token int")
    one = R.next_probabilities(logits, allowed=allowed, top_p=0.1)
    assert [(r.key, r.token, r.p) for r in one.collect()] == [(0, 2, 1.0)]


def test_hold_out_meets_every_stratum(spark):
    df = spark.range(2000).selectExpr("concat('p', id) as p", "case when id % 7 = 0 then 'a' when id % 7 = 1 then null else 'b' end as s")
    out = R.hold_out(df.union(df.limit(5)), "p", "s", 0.3, "x").collect()
    assert len(out) == 2000
    for s in ("a", "b", None):
        own = [r for r in out if r.s == s]
        assert sum(r.held_out for r in own) == round(len(own) * 0.3) and sum(r.moved for r in own) < 0.1 * len(own)
