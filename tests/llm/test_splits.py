"""Splits by connected records."""

import random

import pytest
from pyspark.sql import functions as F

from eventide.llm import splits


def union_find(rows):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for r in rows:
        ns = [f"{k}:{v}" for k, v in zip("abc", r) if v is not None]
        for n in ns:
            parent[find(n)] = find(ns[0])
    groups = {}
    for n in parent:
        groups.setdefault(find(n), set()).add(n)
    return {frozenset(g) for g in groups.values() if len(g) > 1}


def labels(spark, rows):
    df = spark.createDataFrame(rows, "a string, b string, c string").select(splits.nodes({k: F.col(k) for k in "abc"}).alias("nodes"))
    groups = {}
    heads = {r.nodes[0] for r in df.collect() if r.nodes}
    for r in splits.components(df).collect():
        groups.setdefault(r.component, []).append(r.node)
    assert all(len(g) == len(set(g)) and min(heads.intersection(g)) == k for k, g in groups.items())
    return {frozenset(g) for g in groups.values() if len(g) > 1}


def test_random_chain_and_hot(spark):
    rnd = random.Random(4)
    rows = [tuple(None if rnd.random() < 0.3 else f"{rnd.randrange(60)}" for _ in range(3)) for _ in range(90)]
    assert labels(spark, rows) == union_find(rows)
    chain = [(f"{i:03}", f"{i + 1:03}", None) for i in range(60)] + [(f"{i + 1:03}", f"{i + 1:03}", None) for i in range(60)]
    assert labels(spark, chain) == union_find(chain)
    hot = [("h", f"{i}", None) for i in range(300)]
    assert len(labels(spark, hot)) == 1


def test_nulls_repeats_empty(spark):
    assert labels(spark, [(None, None, None), ("x", None, None)]) == set()
    assert labels(spark, [("x", "y", None)] * 3) == {frozenset({"a:x", "b:y"})}
    assert labels(spark, []) == set()


def test_assign(spark):
    rows = [(f"{i % 700}", f"{i}", "TEMP" if i % 3 else f"j{i % 50}") for i in range(2000)] + [(None, None, None), ("7", "7", None), ("7", "7", None)]
    df = spark.createDataFrame(rows, "a string, b string, c string").withColumn("split", F.lit("old")).withColumn("component", F.lit(1))
    ids = {"a": F.col("a"), "b": F.col("b"), "c": F.when(F.col("c") != "TEMP", F.col("c"))}
    out = splits.assign(df, ids, {"train": 0.7, "test": 0.3}).cache()
    assert out.count() == len(rows) and set(out.columns) == {"a", "b", "c", "component", "split"}
    for k in ("a", "b"):
        assert out.where(F.col(k).isNotNull()).groupBy(k).agg(F.count_distinct("split").alias("n")).where("n > 1").count() == 0
    assert sum(r.n_rows for r in splits.shares(out).collect()) == len(rows)
    assert splits.assign(df.limit(0), ids, {"train": 1.0}).count() == 0
    with pytest.raises(ValueError):
        splits.split_of(F.lit("x"), {"a": 0.5})


def test_placeholders_tie_too_much(spark):
    rows = [(f"p{i}", f"J{i:08}") for i in range(60)] + [("p1", "J00000002"), ("p3", "J00000004")]
    rows += [(f"p{i}", x) for i in range(40) for x in ("TEMP", "n/a", "0")] + [("p1", "xx"), (None, "TEMP"), ("p2", None), (None, "J00000009"), ("p5", "")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "who string, j string, __x int")
    out = splits.without_placeholders(df, "j", "who")
    assert out.columns == df.columns and out.count() == len(rows)
    assert {r.j for r in out.collect()} == {f"J{i:08}" for i in range(60)} | {None, "xx", ""}
    assert splits.without_placeholders(df.limit(0), "j", "who").count() == 0
