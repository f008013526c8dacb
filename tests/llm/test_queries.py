"""Corpus queries over the test tables: against SQL where there is some, else their invariants."""

import collections
import os

import duckdb
import pytest

import __spark_entry__ as entry
from eventide.llm import queries as corpus


def rows(df):
    cols = sorted(df.columns)
    return cols, collections.Counter(map(tuple, df[cols].astype(object).values.tolist()))


def check_whole(name, df):
    assert len(df) > 0 and not [c for c in df if df[c].isna().all()], name
    if name.endswith("_found"):
        assert not df.isna().any().any() and not df.duplicated().any()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("set TimeZone='UTC'")
    for f in os.listdir(sf):
        con.execute(f"create view {f.split('.')[0]} as select * from read_parquet('{sf}/{f}')")
    return con


@pytest.mark.parametrize("name", sorted(corpus.oracle_sql()))
def test_equals_sql(name, spark, sf, duck):
    got, want = rows(entry.queries()[name](spark, sf).toPandas()), rows(duck.execute(entry.oracle_sql()[name]).df())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(corpus.queries()) - set(corpus.oracle_sql())))
def test_without_sql(name, spark, sf):
    df = entry.queries()[name](spark, sf).toPandas()
    check_whole(name, df)
    n = spark.read.parquet(f"{sf}/documents.parquet").count()
    if name in ("p8_ids", "p10_statistics"):
        assert len(df) == n and df["doc_id"].is_unique
    if name == "p9_shares":
        listed = df[df["n_texts"] > 0]
        whole = listed["target_share"].sum()
        # shares are met up to a text per source
        assert (abs(listed["reached_share"] - listed["target_share"] / whole) < 0.05).all() and abs(df["reached_share"].sum() - 1) < 1e-9
        assert (df["most_copies"] <= df["max_repeats"]).all()
    if name == "p6_splits":
        assert df.dropna(subset=["patient_id"]).groupby("patient_id")["split"].nunique().max() == 1 and df.dropna(subset=["hospitalization_id"]).groupby("hospitalization_id")["split"].nunique().max() == 1
