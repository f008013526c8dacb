"""Every query with SQL gives what DuckDB gives on the same tables."""

import collections
import math
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA:
        return None
    if isinstance(v, (float, np.floating)):
        return None if math.isnan(v) else round(float(v), 6) + 0.0
    return int(v) if isinstance(v, np.integer) else v


def rows(df):
    cols = sorted(df.columns)
    return cols, collections.Counter(tuple(plain(v) for v in r) for r in df[cols].astype(object).itertuples(index=False))


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("set TimeZone='UTC'")
    for f in os.listdir(sf):
        con.execute(f"create view {f.split('.')[0]} as select * from read_parquet('{sf}/{f}')")
    return con


# the corpus queries are tested beside the corpus operators
OWN = [n for n in entry.queries() if entry.queries()[n].__module__.startswith("eventide.catalog") or entry.queries()[n].__module__ == "eventide.problems"]


@pytest.mark.parametrize("name", sorted(n for n in OWN if n in entry.oracle_sql()))
def test_equals_sql(name, spark, sf, duck):
    got, want = rows(entry.queries()[name](spark, sf).toPandas()), rows(duck.execute(entry.oracle_sql()[name]).df())
    assert got == want


def check_whole(name, df):
    """What every query without SQL keeps: rows, columns with values, and for found cases distinct rows without nulls."""
    assert len(df) > 0, name
    assert not [c for c in df if df[c].isna().all()], name
    if name.endswith("_found"):
        assert not df.isna().any().any() and not df.duplicated().any()


@pytest.mark.parametrize("name", sorted(n for n in OWN if n not in entry.oracle_sql()))
def test_without_sql(name, spark, sf):
    df = entry.queries()[name](spark, sf).toPandas()
    if name == "lab_13_task_evaluation":  # too few stays for numbers here
        assert list(df["status"]) in (["evaluable"], ["suppressed"], ["not evaluable"])
    elif name == "sta_24_transport_matrix":
        assert set(df["status"]) <= {"evaluable", "suppressed", "not evaluable", "not fitted"} and len(df) == df["fit_site"].nunique() ** 2
    else:
        check_whole(name, df)
    if name == "sta_04_recalibration":
        assert df["slope"].notna().all()
    if name == "enc_05_packing":
        assert (df.groupby(["group", "pack"])["n_events"].sum() <= 64).mean() > 0.5 and df["h"].is_unique
    if name == "p4_found":
        assert (df["start_us"] < df["end_us"]).all() and set(df["kind"]) == {"period", "gap"}


def test_entry(spark):
    assert entry.entry(spark).columns == ["assessment_id", "code_status_category"]
