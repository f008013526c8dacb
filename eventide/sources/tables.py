"""Declared event tables read as one long event stream, and checks on tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventide.runtime import read

EVENT_COLUMNS = ("hosp_id", "dttm", "concept", "value", "unit", "cat_value", "source")


@dataclass(frozen=True)
class TableSpec:
    """How one table becomes events (hosp_id, dttm, concept, value, unit, cat_value, source).

    Either ``concept_col`` (long tables) or ``concept`` with ``value_cols``
    (wide tables, melted) is set.  ``lag_minutes`` is added to the time at
    which a value became available.
    """

    table: str
    at: str
    id_col: str = "hospitalization_id"
    concept_col: str | None = None
    value_col: str | None = None
    unit_col: str | None = None
    category_col: str | None = None
    value_cols: Sequence[str] = field(default=())
    qualifier_col: str | None = None
    lag_minutes: int = 0


ASSESSMENTS = TableSpec("patient_assessments", "recorded_dttm", concept_col="assessment_category", value_col="numerical_value", category_col="categorical_value")
LABS = TableSpec("labs", "lab_result_dttm", concept_col="lab_category", value_col="lab_value_numeric", unit_col="reference_unit")
CRRT = TableSpec("crrt_therapy", "recorded_dttm", value_cols=("blood_flow_rate", "dialysate_flow_rate", "ultrafiltration_out"))
ECMO = TableSpec("ecmo_mcs", "recorded_dttm", value_cols=("flow", "sweep", "fdo2", "device_rate"))


def with_lag(at: Column, minutes: int) -> Column:
    """Availability: a time plus a conservative lag."""
    return at + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(minutes))


def read_table(spark: SparkSession, folder: str, table: str, aliases: Mapping[str, str] | None = None) -> DataFrame:
    """A parquet table with a site's column names replaced by the configured ones."""
    df = read(spark, folder, table)
    return df.withColumnsRenamed({k: v for k, v in (aliases or {}).items() if k in df.columns})


def with_optional(df: DataFrame, required: Sequence[str], optional: Mapping[str, str]) -> DataFrame:
    """The required columns, and the optional ones, typed nulls where the table lacks them. Names match without case."""
    there = {c.lower(): c for c in df.columns}
    missing = [c for c in required if c.lower() not in there]
    if missing:
        raise ValueError(f"columns missing: {missing}")
    pick = lambda c, kind: F.col(there[c.lower()]).alias(c) if c.lower() in there else F.lit(None).cast(kind).alias(c)
    return df.select(*[F.col(there[c.lower()]).alias(c) for c in required], *[pick(c, k) for c, k in optional.items()])


def events_of(df: DataFrame, spec: TableSpec) -> DataFrame:
    """Events of one table; rows without id, time, concept or any value give none."""
    at = with_lag(F.col(spec.at), spec.lag_minutes) if spec.lag_minutes else F.col(spec.at)
    rows = df.where(F.col(spec.id_col).isNotNull() & F.col(spec.at).isNotNull())
    none = F.lit(None)
    if spec.value_cols:
        cells = F.array(*[F.struct(F.lit(c.lower()).alias("c"), F.col(c).cast("double").alias("v")) for c in spec.value_cols])
        name = F.col("x.c") if spec.qualifier_col is None else F.concat(F.coalesce(spec.qualifier_col, F.lit("unknown")), F.lit("_"), F.col("x.c"))
        keep = [F.col(spec.qualifier_col)] if spec.qualifier_col else []
        long = rows.select(F.col(spec.id_col).alias("hosp_id"), at.alias("dttm"), *keep, F.explode(cells).alias("x")).where("x.v is not null and not isnan(x.v)")
        return long.select("hosp_id", "dttm", name.alias("concept"), F.col("x.v").alias("value"), none.cast("string").alias("unit"), none.cast("string").alias("cat_value"), F.lit(spec.table).alias("source"))
    value = F.col(spec.value_col).cast("double") if spec.value_col else none.cast("double")
    category = F.col(spec.category_col) if spec.category_col else none.cast("string")
    unit = F.col(spec.unit_col) if spec.unit_col else none.cast("string")
    kept = rows.where(F.col(spec.concept_col).isNotNull() & (value.isNotNull() | category.isNotNull()))
    return kept.select(F.col(spec.id_col).alias("hosp_id"), at.alias("dttm"), F.lower(spec.concept_col).alias("concept"), value.alias("value"), unit.alias("unit"), category.alias("cat_value"), F.lit(spec.table).alias("source"))


def read_events(spark: SparkSession, folder: str, specs: Sequence[TableSpec]) -> DataFrame:
    """One long event stream of several tables; lazily planned, columns pruned per table."""
    return reduce(DataFrame.unionByName, [events_of(read(spark, folder, s.table), s) for s in specs])


def sample_ids(df: DataFrame, column: str, n: int, salt: str) -> DataFrame:
    """n distinct ids in order of a salted SHA-256: the same ids whatever the row order."""
    ids = df.where(F.col(column).isNotNull()).select(column).distinct()
    return ids.orderBy(F.sha2(F.concat(F.lit(f"{salt}:"), column), 256), column).limit(n)


def page(df: DataFrame, order: str, offset: int, rows: int) -> DataFrame:
    return df.orderBy(order).offset(offset).limit(rows)


def conformance(df: DataFrame, column: str, permitted: Sequence[str], aliases: Mapping[str, str]) -> DataFrame:
    """(raw, n, status): counts of a coded column, each value compliant, aliased, missing or failing."""
    raw = F.col(column)
    status = F.when(raw.isNull(), "missing").when(raw.isin(*permitted), "compliant").when(raw.isin(*aliases), "aliased").otherwise("failing")
    return df.groupBy(raw.alias("raw"), status.alias("status")).agg(F.count("*").alias("n"))


def null_report(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.agg(F.count("*").alias("n_rows"), *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in columns])


def require(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """``df`` if it has the columns in the given types, else an error naming them."""
    types = dict(df.dtypes)
    wrong = [f"{c}: {types.get(c, 'missing')} instead of {k}" for c, k in columns.items() if types.get(c) != k]
    if wrong:
        raise TypeError("; ".join(wrong))
    return df


def row_sha(*columns: str) -> Column:
    """SHA-256 of the columns' texts joined by '|' (nulls left out)."""
    return F.sha2(F.concat_ws("|", *columns), 256)


def manifest(df: DataFrame, columns: Sequence[str]) -> str:
    """Content hash of a table, whatever its row order: row hashes summed modulo 2^128 in two halves, hashed again."""
    half = lambda a: F.sum(F.conv(F.substring(row_sha(*columns), a, 12), 16, 10).cast("decimal(38,0)"))
    r = df.agg(half(1).alias("a"), half(13).alias("b"), F.count("*").alias("n")).first()
    return df.sparkSession.range(1).select(F.sha2(F.lit(f"{r['a']}|{r['b']}|{r['n']}"), 256)).first()[0]


def rule(spec: Mapping) -> Column:
    """Rule over boolean columns, null as false: all_true, any_true, none_true: names; count_at_least, count_at_most: (names, k)."""
    (kind, arg), = spec.items()
    names, k = arg if kind.startswith("count") else (arg, 0)
    n = sum((F.coalesce(F.col(c), F.lit(False)).cast("int") for c in names), F.lit(0))
    return {"all_true": n == len(names), "any_true": n > 0, "none_true": n == 0, "count_at_least": n >= k, "count_at_most": n <= k}[kind]


