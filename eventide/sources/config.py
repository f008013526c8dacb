"""Declarations of sites: overrides, unit and name harmonisation, dose tables, availability, segments, run matrices, cached and labelled outputs."""

from __future__ import annotations

import copy
import hashlib
import itertools
import json
import re
from collections.abc import Mapping, Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eventide.functions.numbers import finite
from eventide.operators import bins, doses
from eventide.runtime import scratch
from eventide.sources.sinks import json_sha256
from eventide.sources.tables import EVENT_COLUMNS, with_lag


def merged(base: Mapping, local: Mapping) -> dict:
    """``base`` with a site's overrides: mappings merge key by key, anything else is replaced; keys that start with 'note' go."""
    out = {k: copy.deepcopy(v) for k, v in base.items() if not str(k).startswith("note")}
    for k, v in local.items():
        if str(k).startswith("note"):
            continue
        out[k] = merged(out.get(k, {}), v) if isinstance(v, Mapping) and isinstance(out.get(k, {}), Mapping) else copy.deepcopy(v)
    return {k: merged(v, {}) if isinstance(v, Mapping) else v for k, v in out.items()}


def require_site(recorded: str, site: str, what: str) -> None:
    """Error if an artifact is of another site."""
    if recorded != site:
        raise ValueError(f"{what} is of site {recorded}, not {site}")


def schema_snapshot(files: Mapping[str, str]) -> dict[str, str]:
    """Content hash of every schema file (name: text), and of all of them as 'all'."""
    each = {n: hashlib.sha256(t.encode()).hexdigest() for n, t in sorted(files.items())}
    return {**each, "all": json_sha256(each)}


def permissible(text: str) -> dict[str, dict[str, list[str]]]:
    """Table: column: permitted values of a YAML schema with entries ``tables: [{name, columns: [{name, permissible_values}]}]``."""
    import yaml

    return {t["name"]: {c["name"]: [str(v) for v in c["permissible_values"]] for c in t.get("columns", []) if c.get("permissible_values")} for t in yaml.safe_load(text)["tables"]}


def unit_rules(site: Mapping) -> tuple[dict[str, tuple[float, tuple[float, float] | None]], dict[str, str]]:
    """({column: (factor, range or None)}, {column: unit}) of a site's declared ``columns``, checked: a factor over 0, a range that rises, a unit for each."""
    factors, units = {}, {}
    for column, rule in site.get("columns", {}).items():
        factor, span = float(rule.get("factor", 1.0)), rule.get("range")
        if not factor > 0 or (span is not None and not span[0] < span[1]) or not rule.get("unit"):
            raise ValueError(f"declaration of {column} is wrong: {dict(rule)}")
        factors[column], units[column] = (factor, tuple(span) if span else None), rule["unit"]
    return factors, units


def convert_columns(df: DataFrame, factors: Mapping[str, tuple[float, tuple[float, float] | None]]) -> DataFrame:
    """``df`` with declared columns in common units; values outside the range after conversion become null."""
    def one(c: str, factor: float, span: tuple[float, float] | None) -> Column:
        v = F.col(c).cast("double") * factor
        return v if span is None else F.when(v.between(*span), v)

    return df.withColumns({c: one(c, f, s) for c, (f, s) in factors.items() if c in df.columns})


def harmonised(df: DataFrame, column: str, names: Mapping[str, str], permitted: Sequence[str]) -> DataFrame:
    """``df`` with a coded column in common names; values neither permitted nor mapped become null and are told by ``raw_<column>``."""
    bad = set(names.values()) - set(permitted)
    if bad:
        raise ValueError(f"mapped to names that are not permitted: {sorted(bad)}")
    key = F.lower(F.trim(column))
    mapping = F.create_map(*[F.lit(x) for kv in {**{p.lower(): p for p in permitted}, **{k.lower(): v for k, v in names.items()}}.items() for x in kv])
    return df.withColumn(f"raw_{column}", F.col(column)).withColumn(column, F.try_element_at(mapping, key))


def harmonisation_record(declarations: Mapping) -> dict:
    """The declarations that made the data, with their hash, notes left out."""
    clean = merged(declarations, {})
    return {"declarations": clean, "sha256": json_sha256(clean)}


def available_tables(tables: Mapping[str, DataFrame], clock: Mapping[str, tuple[str, int]]) -> dict[str, DataFrame]:
    """Tables with ``<column>_at``, the declared time plus its lag in minutes; rows without it are left out, undeclared tables are an error."""
    missing = sorted(set(tables) - set(clock))
    if missing:
        raise ValueError(f"no availability is declared for {missing}")
    return {n: t.where(F.col(clock[n][0]).isNotNull()).withColumn(f"{clock[n][0]}_at", with_lag(F.col(clock[n][0]), clock[n][1])) for n, t in tables.items()}


# ---- readers --------------------------------------------------------------------------


def dose_events(df: DataFrame, targets: DataFrame, weights: DataFrame, *, key: str, at: str, name: str, dose: str, unit: str, corrections: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(events, counts): doses in the target unit of each name as events, and how many rows had which status.

    A declared correction (name, unit, factor, quarantine) is applied first;
    the weight is the last one of the stay known at the dose's time.
    """
    from eventide.operators.joins import asof

    rows = df.where(F.col(key).isNotNull() & F.col(at).isNotNull() & F.col(name).isNotNull()).select(F.col(key).alias("hosp_id"), F.col(at).alias("dttm"), F.lower(name).alias("concept"), F.col(dose).cast("double").alias("value"), F.col(unit).alias("given"))
    if corrections is not None:
        rules = corrections.select(F.lower("name").alias("concept"), F.col("unit").alias("given"), "factor", "quarantine")
        rows = doses.correct(rows, rules, ["concept", "given"], "value")
    known = asof(rows, weights.select(F.col(key).alias("hosp_id"), F.col("at").alias("__at"), "weight"), "hosp_id", "dttm", "__at", "weight")
    placed = known.join(targets.select(F.lower("name").alias("concept"), F.col("unit").alias("unit")), "concept", "left")
    done = doses.convert(placed, "value", "given", "unit", "weight")
    events = done.where("status = 'ok'").select("hosp_id", "dttm", "concept", F.col("converted").alias("value"), "unit", F.lit(None).cast("string").alias("cat_value"), F.lit("doses").alias("source"))
    return events.select(*EVENT_COLUMNS), done.groupBy("concept", "status").agg(F.count("*").alias("n"))


def patient_events(df: DataFrame, stays: DataFrame, *, at: str, value: str, concept: str) -> DataFrame:
    """Events of the stays (patient_id, hosp_id, lo, hi) from patient-keyed states: the state that holds at admission, and each change until the stay's end."""
    rows = df.where(F.col("patient_id").isNotNull() & F.col(at).isNotNull() & F.col(value).isNotNull()).select("patient_id", F.col(at).alias("dttm"), F.col(value).alias("cat_value"))
    near = rows.join(stays.select("patient_id", "hosp_id", "lo", "hi"), "patient_id").where(F.col("dttm") <= F.col("hi"))
    before = near.where(F.col("dttm") <= F.col("lo")).groupBy("hosp_id", "lo").agg(F.max(F.struct("dttm", "cat_value")).alias("s")).select("hosp_id", F.col("lo").alias("dttm"), "s.cat_value")
    every = before.unionByName(near.where(F.col("dttm") > F.col("lo")).select("hosp_id", "dttm", "cat_value"))
    w = Window.partitionBy("hosp_id").orderBy("dttm", "cat_value")
    changes = every.withColumn("__b", F.lag("cat_value").over(w)).where(F.col("__b").isNull() | (F.col("__b") != F.col("cat_value")))
    return changes.select("hosp_id", "dttm", F.lit(concept).alias("concept"), F.lit(None).cast("double").alias("value"), F.lit(None).cast("string").alias("unit"), "cat_value", F.lit("patient").alias("source"))


def fit_shadows(events: DataFrame, raw: DataFrame, key: Sequence[str]) -> DataFrame:
    """``raw`` events that a filter took out of ``events``: kept to fit edges on, never encoded."""
    return raw.join(events.select(*key), list(key), "left_anti")


# ---- segments, matrices, outputs ------------------------------------------------------


def csv_segments(rows: DataFrame, concepts: Sequence[str] | None, alias: Mapping[str, str], forced: Mapping[str, Sequence[float]], above: Mapping[str, bool]) -> DataFrame:
    """(concept, segments, n_bins) of declared rows (concept, lo, hi, lo_closed, hi_closed), one strict partition per concept; a forced edge of a concept without rows is an error."""
    declared: dict[str, list] = {}
    for r in rows.collect():  # a declaration file's few rows
        name = alias.get(r["concept"], r["concept"])
        declared.setdefault(name, []).append((r["lo"], r["hi"], r["lo_closed"], r["hi_closed"]))
    wanted = declared if concepts is None else {c: declared.get(c, []) for c in concepts}
    table = [(c, [tuple(s) for s in bins.merge_partition(v, forced.get(c, ()), above.get(c, False))]) for c, v in wanted.items()]
    out = rows.sparkSession.createDataFrame(table, f"concept string, segments array<{bins.SEGMENT}>")
    return out.withColumn("n_bins", F.size("segments"))


def as_segments(value: Sequence) -> list[bins.Row]:
    """Segments of an old list of edges, [e, next), or the segments themselves."""
    if not value or isinstance(value[0], (tuple, list)):
        return [tuple(v) for v in value]
    edges = sorted(set(map(float, value)))
    return [(None, edges[0], False, False), *[(a, b, True, False) for a, b in zip(edges, edges[1:])], (edges[-1], None, True, False)]


def expand_matrix(axes: Mapping[str, Sequence[Mapping]], skip: Sequence[Mapping] = ()) -> list[dict]:
    """Every combination of one setting per axis, named by its choices, but those that match an entry of ``skip``."""
    out = []
    for choice in itertools.product(*axes.values()):
        row = {k: v for part in choice for k, v in part.items() if k != "name"}
        row["run"] = "-".join(str(part["name"]) for part in choice)
        if not any(all(row.get(k) == v for k, v in s.items()) for s in skip):
            out.append(row)
    return out


def gate(metrics: Mapping, *, max_unknown: float, context: int, floor: int) -> list[tuple[str, bool]]:
    """(rule, passed) over an aggregate report: nothing but aggregates, small cells hidden, availability declared, unknown rate outside the fit partition, and the 99 % length within the context."""
    texts = json.dumps(metrics)
    counts = [v for v in metrics.get("cells", {}).values() if isinstance(v, int)]
    rate = metrics.get("unknown_rate")
    return [
        ("aggregates only", not re.search(r'"[A-Z]\d{8}"', texts)),
        ("small cells hidden", all(v == 0 or v >= floor for v in counts)),
        ("availability declared", bool(metrics.get("availability"))),
        ("unknown rate", rate is not None and rate <= max_unknown),
        ("length in context", metrics.get("p99_length", context + 1) <= context),
    ]


def write_stats(stats: DataFrame, path: str, **bound: str) -> str:
    """Value statistics (few rows) as JSON bound to the hashes of what they were made of; returns the file's hash."""
    rows = sorted((list(map(str, r)) for r in stats.collect()))
    text = json.dumps({"columns": stats.columns, "rows": rows, "bound": dict(sorted(bound.items()))}, sort_keys=True)
    Path(path).write_text(text)
    return hashlib.sha256(text.encode()).hexdigest()


def read_stats(spark: SparkSession, path: str, schema: str, **bound: str) -> DataFrame:
    """Statistics of a file that is bound to exactly these hashes."""
    blob = json.loads(Path(path).read_text())
    if blob["bound"] != dict(sorted(bound.items())):
        raise ValueError("statistics are bound to other artifacts")
    text = spark.createDataFrame([tuple(r) for r in blob["rows"]], ", ".join(f"`{c}` string" for c in blob["columns"]))
    kinds = dict(f.strip().rsplit(" ", 1) for f in schema.split(","))
    return text.select(*[F.col(c).cast(kinds[c]).alias(c) for c in blob["columns"]])


def write_run(df: DataFrame, folder: str, record: Mapping) -> None:
    """Scores or rollouts of a run as parquet beside its record."""
    df.write.mode("overwrite").parquet(f"{folder}/rows")
    line = json.dumps({**record, "columns": df.columns}, sort_keys=True)
    df.sparkSession.createDataFrame([(line,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/record")


def read_run(spark: SparkSession, folder: str) -> tuple[DataFrame, dict]:
    """Rows and record of a run; an error if they do not belong together."""
    record = json.loads(spark.read.text(f"{folder}/record").first()[0])
    rows = spark.read.parquet(f"{folder}/rows")
    if rows.columns != record["columns"]:
        raise ValueError("rows are not those of the record")
    return rows, record


def cached(df: DataFrame, folder: str, content: Mapping) -> DataFrame:
    """``df`` written once under the hash of what it was made of, and read from there by whoever asks again.

    A builder writes to a folder of its own and renames it, so the first to
    finish wins and no half-written cache is ever read.
    """
    spark = df.sparkSession
    target = f"{folder}/{json_sha256(content)}"
    jvm = spark._jvm.org.apache.hadoop.fs
    path = jvm.Path(target)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        draft = scratch(spark)
        df.write.parquet(draft)
        fs.mkdirs(path.getParent())
        if fs.exists(path) or not fs.rename(jvm.Path(draft), path):
            fs.delete(jvm.Path(draft), True)
    return spark.read.schema(df.schema).parquet(target)


def selected(df: DataFrame, partition: str, value: str) -> DataFrame:
    """Rows of the fit partition; an error if there are none."""
    out = df.where(F.col(partition) == value)
    if out.isEmpty():
        raise ValueError(f"partition {value} is empty")
    return out


def unit_share(df: DataFrame, concept: str, value: str, lo: float, hi: float) -> DataFrame:
    """(concept, n, share) of finite values within a range."""
    return df.where(finite(F.col(value))).groupBy(concept).agg(F.count("*").alias("n"), F.avg(F.when(F.col(value).between(lo, hi), 1.0).otherwise(0.0)).alias("share"))
