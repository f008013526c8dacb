"""Queries of the training-corpus problems and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventide.llm import mix, names, quality, splits, tokens
from eventide.runtime import read, stage

#: Table, its key and its typed column of each list.
TYPED = {
    "location": ("adt", "adt_id", "location_name"),
    "device": ("ecmo_mcs", "ecmo_id", "device_name"),
    "crrt_mode": ("crrt_therapy", "crrt_id", "crrt_mode_name"),
    "code_status": ("code_status", "code_status_id", "code_status_name"),
}


def _typed_rows(spark: SparkSession, d: str) -> DataFrame:
    parts = [
        read(spark, d, table).select(F.lit(table).alias("record_type"), F.lit(list_name).alias("list_name"), F.col(key).alias("record_id"), F.col(column).alias("name"))
        for list_name, (table, key, column) in TYPED.items()
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Typed names and the canonical entry meant, or 'none'."""
    return names.map_rows(_typed_rows(spark, d), read(spark, d, "canonical_names")).select("record_type", "record_id", "canonical_id")


def p3_unmatched(spark: SparkSession, d: str) -> DataFrame:
    """Report of the typed names without an entry, with their number of rows."""
    mapped = names.map_rows(_typed_rows(spark, d), read(spark, d, "canonical_names"))
    return mapped.where(F.col("canonical_id") == names.NO_ENTRY).groupBy("record_type", "name").agg(F.count("*").alias("n"))


PROPORTIONS = {"train": 0.8, "validation": 0.1, "test": 0.1}


def _stays(spark: SparkSession, d: str) -> DataFrame:
    stays = read(spark, d, "hospitalization").select("patient_id", "hospitalization_id", "hospitalization_joined_id")
    return splits.without_placeholders(stays, "hospitalization_joined_id", "patient_id")


def _stay_ids() -> dict:
    return {"p": F.col("patient_id"), "h": F.col("hospitalization_id"), "j": F.col("hospitalization_joined_id")}


def p6_members(spark: SparkSession, d: str) -> DataFrame:
    """Patients tied to others, with the patient who stands for their group: linear however large a group is."""
    labels = splits.components(_stays(spark, d).select(splits.nodes(_stay_ids()).alias("nodes")))
    members = labels.where("node like 'p:%'").select("component", F.expr("substr(node, 3)").alias("patient_id"))
    groups = members.groupBy("component").agg(F.min("patient_id").alias("group_patient_id"), F.count("*").alias("n_patients")).where("n_patients > 1")
    return members.join(groups, "component").select("patient_id", "group_patient_id", "n_patients")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of patients tied by a chain of hospitalization rows."""
    members = stage(p6_members(spark, d))
    a, b = (members.select("group_patient_id", F.col("patient_id").alias(f"patient_id_{x}")) for x in "ab")
    return a.join(b, "group_patient_id").where("patient_id_a < patient_id_b").select("patient_id_a", "patient_id_b")


def p6_splits(spark: SparkSession, d: str) -> DataFrame:
    """Every hospitalization row with its split."""
    return splits.assign(_stays(spark, d), _stay_ids(), PROPORTIONS)


def p6_shares(spark: SparkSession, d: str) -> DataFrame:
    """Rows and components of each split."""
    return splits.shares(p6_splits(spark, d))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    """Token ids of every document."""
    return tokens.encode(read(spark, d, "documents"), "doc_id", "text")


def p8_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Number of documents, and of those whose text comes back from its ids (null as the empty text)."""
    docs = read(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    back = tokens.decode(tokens.encode(docs, "doc_id", "text"), "doc_id").select("doc_id", F.xxhash64("text").alias("h"))
    equal = docs.select("doc_id", F.xxhash64("text").alias("h")).join(back, ["doc_id", "h"], "left_semi")
    both = docs.select(F.lit(1).alias("n"), F.lit(0).alias("e")).unionByName(equal.select(F.lit(0).alias("n"), F.lit(1).alias("e")))
    return both.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("n_docs"), F.coalesce(F.sum("e"), F.lit(0)).cast("bigint").alias("n_equal"))


def p9_selection(spark: SparkSession, d: str) -> DataFrame:
    """Documents used in the mix, how often, and the share their source reaches."""
    targets = read(spark, d, "mix_targets")
    chosen = stage(mix.select(read(spark, d, "documents").select("doc_id", "text", "source"), targets))
    reached = mix.shares(chosen, targets).select("source", "target_share", "reached_share")
    return chosen.join(reached, "source").select("doc_id", "source", "n_tokens", "copies", "target_share", "reached_share")


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """Shares asked for and reached by every target source."""
    targets = read(spark, d, "mix_targets")
    return mix.shares(stage(mix.select(read(spark, d, "documents").select("doc_id", "text", "source"), targets)), targets)


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that are mostly lists, tables or junk."""
    return p10_statistics(spark, d).where("not is_prose").select("doc_id")


def p10_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Quality statistics of every document."""
    return quality.statistics(read(spark, d, "documents"), "doc_id", "text", "lang")


def queries() -> dict:
    return {"p9_selection": p9_selection, "p9_shares": p9_shares, "p10_found": p10_found, "p10_statistics": p10_statistics, "p8_ids": p8_ids, "p8_roundtrip": p8_roundtrip, "p6_found": p6_found, "p6_members": p6_members, "p6_splits": p6_splits, "p6_shares": p6_shares, "p3_found": p3_found, "p3_unmatched": p3_unmatched}


_NODES = """f AS (SELECT hospitalization_joined_id AS j, min(patient_id) < max(patient_id) AS ties, regexp_replace(regexp_replace(upper(hospitalization_joined_id), '[A-Z]', 'A', 'g'), '[0-9]', '9', 'g') AS form FROM hospitalization WHERE hospitalization_joined_id IS NOT NULL GROUP BY 1),
       x AS (SELECT form FROM f GROUP BY 1 HAVING 2 * COUNT(*) FILTER (ties) > COUNT(*)), r AS (SELECT row_number() OVER () AS i, 'p:' || patient_id AS p, 'h:' || hospitalization_id AS h, CASE WHEN f.form NOT IN (SELECT form FROM x) THEN 'j:' || j END AS j FROM hospitalization LEFT JOIN f ON f.j = hospitalization_joined_id),
       n AS (SELECT DISTINCT i, n FROM (SELECT i, unnest([p, h, j]) AS n FROM r) WHERE n IS NOT NULL), e AS (SELECT DISTINCT a.n AS a, b.n AS b FROM n a JOIN n b ON a.i = b.i AND a.n <> b.n),
       t AS (SELECT DISTINCT n AS s, n FROM n WHERE n LIKE 'p:%' UNION SELECT s, b FROM t JOIN e ON e.a = t.n), q AS (SELECT substr(s, 3) AS a, substr(n, 3) AS b FROM t WHERE n LIKE 'p:%')"""


def oracle_sql() -> dict:
    """SQL of the queries that have one; the others are tested against brute force, round trips and fixtures."""
    return {
        "p8_roundtrip": "SELECT COUNT(*) AS n_docs, COUNT(*) AS n_equal FROM documents",
        "p6_found": f"WITH RECURSIVE {_NODES} SELECT a AS patient_id_a, b AS patient_id_b FROM q WHERE a < b",
        "p6_members": f"WITH RECURSIVE {_NODES} SELECT a AS patient_id, min(b) AS group_patient_id, COUNT(*) AS n_patients FROM q GROUP BY 1 HAVING COUNT(*) > 1",
    }
