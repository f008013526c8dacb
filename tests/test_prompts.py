"""Prompt classes and observed outcomes."""

import random

from pyspark.sql import functions as F

from eventide import catalog
from eventide.operators import encode


def test_classes_hold_all_pairs(spark):
    rnd = random.Random(2)
    seqs = [(f"o{i}", [rnd.choice([1, 2]) for _ in range(rnd.randrange(1, 6))]) for i in range(60)]
    sims = [(f"s{i}", [rnd.choice([1, 2, 3]) for _ in range(rnd.choice([2, 3]))]) for i in range(40)]
    a = spark.createDataFrame(sims, "sim string, prompt array<int>")
    b = spark.createDataFrame(seqs, "h string, token array<int>")
    want = {(s, h) for s, p in sims for h, t in seqs if t[: len(p)] == p}
    assert {(r.sim, r.h) for r in encode.pair_by_prompt(a, b, "prompt", "token").collect()} == want
    classes = {tuple(r.prompt): (r.simulations, r.observed) for r in encode.prompt_classes(a, b, "prompt", "token").collect()}
    members = [(tuple(r.prompt), r.h) for r in encode.prompt_members(a, b, "prompt", "token", "h").collect()]
    assert {(s, h) for s, p in sims for q, h in members if q == tuple(p)} == want
    assert classes == {tuple(p): (sum(q == p for _, q in sims), sum(q == tuple(p) for q, _ in members)) for _, p in sims}
    assert sum(n * m for n, m in classes.values()) == len(want)


def test_every_stay_is_simulated(spark, sf):
    stays = spark.read.parquet(f"{sf}/patient_assessments.parquet").where("hospitalization_id is not null and recorded_dttm is not null and (coalesce(numerical_value, double('nan')) <> double('nan') or trim(categorical_value) <> '')")
    long = stays.groupBy("hospitalization_id").count().where("count >= 3").count()
    classes = catalog.queries()["gen_01_prompt_classes"](spark, sf).toPandas()
    members = catalog.queries()["gen_01_prompt_members"](spark, sf)
    assert classes["simulations"].sum() == classes["observed"].sum() == members.count() == long
    per = {r.prompt: r["count"] for r in members.groupBy("prompt").count().collect()}
    assert per == dict(zip(classes["prompt"], classes["observed"]))


def test_observed_outcome(spark):
    rows = [("one", [4, 9, 5], [0, 10, 30]), ("two", [4, 5, 6], [0, 30, 40]), ("none", [4, 9], [0, 10]), ("early", [5, 4, 9], [0, 10, 30]), ("tie", [4, 9, 7], [0, 20, 20])]
    df = spark.createDataFrame(rows, "h string, token array<bigint>, m array<bigint>").withColumn("o", encode.observed_outcome(F.col("token"), F.col("m"), [5, 6, 7], 10))
    got = {r.h: (r.o.token, r.o.after_min) if r.o else None for r in df.collect()}
    assert got == {"one": (5, 20), "two": None, "none": None, "early": None, "tie": (7, 20)}
