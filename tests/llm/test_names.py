"""Typed names to canonical entries."""

import itertools

import pytest
from pyspark.sql import functions as F

from eventide.llm import names

ENTRIES = [("loc", "L1", "Alder Medical ICU", "MICU Alder; Med Intensive Alder"), ("loc", "L2", "Birch Surgical ICU", None), ("loc", "L3", "Harborview Stepdown", "IMCU Harborview"), ("mode", "M1", "Continuous Hemofiltration", "CVVH"), ("mode", "M2", "Continuous Hemodiafiltration", "CVVHDF")]


@pytest.fixture(scope="module")
def entries(spark):
    return spark.createDataFrame(ENTRIES, "list_name string, canonical_id string, canonical_name string, name_examples string")


def run(spark, entries, typed):
    df = spark.createDataFrame([(i, ln, n, "old") for i, (ln, n) in enumerate(typed)], "i int, list_name string, name string, canonical_id string")
    return {r.i: r.canonical_id for r in names.map_rows(df, entries).collect()}


def test_noise(spark, entries):
    typed = {"now Alder Medcial ICU bed 12": "L1", "ICU, Alder Medical": "L1", "aLDER mEDICAL icu": "L1", "MICU-Alder *": "L1", "Ald3r Medicál ICU (temp)": "L1", "Brch Srgcl ICU": "L2", "BirchSurgicalICU": "L2",
             "Hrbrvw Stepdown - ok": "L3", "Harborview Stepd": "L3", "parking deck P2": "none", "": "none", "???": "none", "4417": "none", "x" * 3000: "none", "Alder Medical ICU ": "L1"}
    got = run(spark, entries, [("loc", n) for n in typed])
    assert got == dict(enumerate(typed.values()))
    modes = ["Continuous Hemodiafltration", "Continuous Hemofltration", "cvvh", "CVVHDF"]
    assert run(spark, entries, [("mode", n) for n in modes]) == {0: "M2", 1: "M1", 2: "M1", 3: "M2"}


def test_exact_null_repeats_unknown_list(spark, entries):
    typed = [("loc", "Alder Medical ICU"), ("loc", None), (None, "Alder"), ("loc", "alder medical icu"), ("loc", "alder medical icu"), ("nolist", "Alder Medical ICU")]
    assert run(spark, entries, typed) == {3: "L1", 4: "L1", 5: "none"}
    assert run(spark, entries, []) == {}
    assert run(spark, entries.limit(0), [("loc", "Alder")]) == {0: "none"}


def test_similarity_join_is_complete(spark, entries):
    typed = ["Alder Medcial", "Brch ICU", "Harbor", "Surgical Birch", "stepdown hrbrvw", "Medical ICU", "zzz", "Ald", "l" * 50, "ICU ICU"]
    df = spark.createDataFrame([("loc", n) for n in typed], "list_name string, name string")
    left, right = names.tokenised(df, entries)
    got = {(r.name, r.form): round(r.jaccard, 9) for r in names.similar(left, right, 0.2).collect()}
    want = {}
    forms = right.where("list_name = 'loc'").collect()
    for n, f in itertools.product(left.collect(), forms):
        a, b = set(n.tokens), set(f.tokens)
        if a and len(a & b) / len(a | b) >= 0.2:
            want[n.name, f.form] = round(len(a & b) / len(a | b), 9)
    assert got == want and want


def test_consonants_alone(spark, entries):
    assert run(spark, entries, [("loc", "Hrbrvw Stpdwn"), ("loc", "Ldr Mdcl C"), ("loc", "Srgcl Brch"), ("loc", "qqq"), ("loc", "aei")]) == {0: "L3", 1: "L1", 2: "L2", 3: "none", 4: "none"}


def test_features(spark):
    cases = {("aid", "er"): {"fai", "fid", "fde", "fer", "cdr"}, ("boot",): {"fbo", "fot", "cbt"}, ("a",): {"fa"}, ("ii",): {"fi"}, ("mg",): {"fmg", "cmg"}, (): set()}
    df = spark.createDataFrame([(list(k),) for k in cases], "w array<string>")
    assert {tuple(r.w): set(r.t) for r in df.select("w", names.features(F.col("w")).alias("t")).collect()} == cases
    assert names.words("  Ald3r (temp) #12 É1") == ["alder", "ei"] and names.words("4417") == ["4417"] and names.words("(x)") == ["x"] and names.words("???") == []


def test_wrappings_are_learned(spark, entries):
    bare = ["Alder Medical", "Birch Surgical", "Harborview", "Stepdown", "Medical ICU", "Surgical ICU"]
    typed = bare + [f"ask {b}" for b in bare] + [f"{b} per MD" for b in bare] + ["Birch per MD 7", "ask Stepdown Harborview per MD"]
    rows = spark.createDataFrame([("loc", n, names.words(n)) for n in typed], "list_name string, name string, words array<string>")
    (found,) = names.wrappings(rows).collect()
    assert found.before == ["ask"] and found.after == ["per md"]
    assert run(spark, entries, [("loc", n) for n in typed])[len(typed) - 1] == "L3"
