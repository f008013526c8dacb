"""Segments: declared partitions, forced and tied edges, thresholds, soft bins, statistics of values, vocabulary."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventide.catalog.registry import query
from eventide.functions import numbers as N
from eventide.functions import text as T
from eventide.operators import bins, encode
from eventide.runtime import read

#: Overlapping rows, a point and a forced edge of a target that counts values above it.
_ROWS = [(None, 135.0, False, True), (130.0, 150.0, True, True), (150.0, None, False, False), (140.0, 140.0, True, True)]
_FORCED = [145.0]
_FINITE = "lab_value_numeric IS NOT NULL AND NOT isnan(lab_value_numeric) AND NOT isinf(lab_value_numeric)"
_SODIUM = f"(SELECT lab_id, lab_value_numeric AS v FROM labs WHERE lab_category = 'sodium' AND {_FINITE})"


def _labs(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "labs").select("lab_id", "lab_category", F.col("lab_value_numeric").alias("v")).where(N.finite(F.col("v")))


def _sodium(spark: SparkSession, d: str, segments: list[bins.Row]) -> DataFrame:
    table = spark.createDataFrame([("sodium", [tuple(s) for s in segments])], f"lab_category string, s array<{bins.SEGMENT}>")
    return _labs(spark, d).join(table, "lab_category").withColumn("bin", bins.bin_index(F.col("v"), F.col("s")))


@query("bin_02_strict_partition", f"SELECT lab_id, CAST(CASE WHEN v <= 135 THEN 0 WHEN v < 140 THEN 1 WHEN v = 140 THEN 2 WHEN v <= 145 THEN 3 WHEN v <= 150 THEN 4 ELSE 5 END AS INTEGER) AS bin FROM {_SODIUM}")
def bin_02(spark: SparkSession, d: str) -> DataFrame:
    """Readings in the strict partition of overlapping rows, a point and a forced edge."""
    return _sodium(spark, d, bins.merge_partition(_ROWS, _FORCED, above=True)).select("lab_id", "bin")


_THRESHOLDS = [(135.0, False), (140.0, True), (145.0, True)]


@query("bin_05_event_side", f"SELECT t.threshold, COUNT(*) FILTER (CASE WHEN above THEN v > threshold ELSE v <= threshold END) AS n FROM {_SODIUM}, (VALUES (135.0::DOUBLE, false), (140.0, true), (145.0, true)) AS t(threshold, above) GROUP BY 1")
def bin_05(spark: SparkSession, d: str) -> DataFrame:
    """Readings in the bins from a threshold's event side on; the bin that ends at 135 holds it."""
    segments = bins.merge_partition(_ROWS, _FORCED, above=True)
    side = lambda t, above: F.col("bin") >= bins.threshold_bin(t, segments, above) if above else F.col("bin") <= bins.threshold_bin(t, segments, above)
    counts = _sodium(spark, d, segments).agg(*[F.count_if(side(t, a)).alias(f"n{i}") for i, (t, a) in enumerate(_THRESHOLDS)])
    return counts.select(F.inline(F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(f"n{i}").alias("n")) for i, (t, _) in enumerate(_THRESHOLDS)])))


@query(
    "bin_06_soft_bins",
    f"""WITH b AS (SELECT lab_id, v, CASE WHEN v < 135 THEN 0 WHEN v <= 145 THEN 1 ELSE 2 END AS h FROM {_SODIUM}), c AS (SELECT *, h + greatest(least((v - (125 + 10 * h)) / 10, 1), 0) - 0.5 AS center, unnest([-1, 0, 1]) AS o FROM b),
        w AS (SELECT *, CASE WHEN h + o BETWEEN 0 AND 2 THEN exp(-0.5 * pow((h + o - center) / 0.5, 2)) ELSE 0 END AS r FROM c)
        SELECT lab_id, CAST(o + 1 AS INTEGER) AS slot, CAST(CASE WHEN h + o BETWEEN 0 AND 2 THEN h + o ELSE h END AS INTEGER) AS bin, round(r / sum(r) OVER (PARTITION BY lab_id), 9) AS weight FROM w""",
)
def bin_06(spark: SparkSession, d: str) -> DataFrame:
    """Weights around a value's place in its segment; the end segments borrow the width of the middle one."""
    rows = _sodium(spark, d, [(None, 135.0, False, False), (135.0, 145.0, True, True), (145.0, None, False, False)])
    soft = bins.soft_bins(F.col("v"), F.col("bin"), F.col("s"), 1)
    return rows.select("lab_id", F.posexplode(soft).alias("slot", "x")).select("lab_id", "slot", "x.bin", F.round("x.weight", 9).alias("weight"))


_RANKED = f"r AS (SELECT lab_category AS c, lab_value_numeric AS x, row_number() OVER (PARTITION BY lab_category ORDER BY lab_value_numeric) - 1 AS i, COUNT(*) OVER (PARTITION BY lab_category) AS n FROM labs WHERE {_FINITE})"
_PINS = [("sodium", 135.0), ("potassium", 5.5), ("lactate", 2.0), ("not measured", 1.0)]


@query(
    "agg_10_forced_edges",
    f"""WITH {_RANKED}, e AS (SELECT DISTINCT c, x FROM r, (SELECT unnest(range(1, 10)) AS k) WHERE i = floor((n - 1) * k / 10.0 + 0.5)), f AS (SELECT * FROM (VALUES {', '.join(f"('{c}', {t}::DOUBLE)" for c, t in _PINS)}) AS v(c, t)),
        p AS (SELECT e.c, x, t, coalesce(abs(x - t) <= 1e-8 + 1e-5 * abs(t), false) AS same, COUNT(*) OVER (PARTITION BY e.c) AS k, row_number() OVER (PARTITION BY e.c ORDER BY abs(x - t), x) AS near FROM e LEFT JOIN f ON f.c = e.c),
        q AS (SELECT *, bool_or(same) OVER (PARTITION BY c) AS has FROM p)
        SELECT c AS lab_category, x AS edge FROM q WHERE t IS NULL OR NOT (same OR (NOT has AND k >= 9 AND near = 1)) UNION ALL SELECT c, t FROM f""",
)
def agg_10_forced(spark: SparkSession, d: str) -> DataFrame:
    """Quantile edges with a threshold pinned in the place of the nearest one."""
    edges = bins.quantile_edges(_labs(spark, d), "lab_category", "v", 10, spark.createDataFrame(_PINS, "lab_category string, edge double"))
    return edges.select("lab_category", F.explode("edges").alias("edge"))


@query("agg_11_matched_edges")
def agg_11(spark: SparkSession, d: str) -> DataFrame:
    """Edges filled up where ties leave too few (no SQL: each edge depends on those before; tested on literal cases)."""
    return bins.matched_edges(read(spark, d, "patient_assessments").select("assessment_category", F.col("numerical_value").alias("x")), "assessment_category", "x", 9)


def stats_sql(source: str, key: str, value: str) -> str:
    """SQL of robust_stats: (key, n, center, spread)."""
    return f"""(SELECT {key}, n, center, CASE WHEN s > 1e-6 THEN s ELSE greatest(abs(center) * 0.5, 1e-6) END AS spread FROM (
        SELECT {key}, n, CASE WHEN n < 20 THEN m ELSE md END AS center, CASE WHEN n < 20 THEN greatest(sd, abs(m) * 0.5) WHEN q / 1.349 > 1e-6 THEN q / 1.349 ELSE sd END AS s FROM (
        SELECT {key}, COUNT(*) AS n, avg({value}) AS m, stddev_pop({value}) AS sd, quantile_cont({value}, 0.5) AS md, quantile_cont({value}, 0.75) - quantile_cont({value}, 0.25) AS q FROM {source} GROUP BY 1)))"""


@query("agg_12_robust_stats", f"SELECT lab_category, n, round(center, 6) AS center, round(spread, 6) AS spread FROM {stats_sql(f'(SELECT lab_category, lab_value_numeric AS x FROM labs WHERE {_FINITE})', 'lab_category', 'x')}")
def agg_12(spark: SparkSession, d: str) -> DataFrame:
    s = bins.robust_stats(_labs(spark, d), "lab_category", "v")
    return s.select("lab_category", "n", F.round("center", 6).alias("center"), F.round("spread", 6).alias("spread"))


@query("agg_12_small_groups", f"SELECT k, n, round(center, 6) AS center, round(spread, 6) AS spread FROM {stats_sql('(SELECT o_custkey AS k, o_totalprice AS x FROM orders)', 'k', 'x')}")
def agg_12_small(spark: SparkSession, d: str) -> DataFrame:
    """Statistics of few values a group."""
    s = bins.robust_stats(read(spark, d, "orders").select(F.col("o_custkey").alias("k"), "o_totalprice"), "k", "o_totalprice")
    return s.select("k", "n", F.round("center", 6).alias("center"), F.round("spread", 6).alias("spread"))


CATEGORY = "(SELECT assessment_category AS c, hospitalization_id AS h, recorded_dttm AS tm, assessment_id AS i, numerical_value AS x, regexp_replace(regexp_replace(lower(trim(categorical_value)), '[\\s_]+', '_', 'g'), '^_+|_+$', '', 'g') AS v FROM patient_assessments)"
NAMED = "CASE WHEN v <> '' THEN c || '=' || CASE WHEN regexp_full_match(v, '[+-]?[0-9]+') THEN 'cat_' || v ELSE v END END"


@query(
    "bin_08_vocabulary",
    f"""WITH a AS (SELECT c, h, x, CASE WHEN x IS NULL OR isnan(x) THEN {NAMED} END AS token FROM {CATEGORY} WHERE c IS NOT NULL), v AS (SELECT DISTINCT c, x FROM a WHERE x IS NOT NULL AND NOT isnan(x)),
        s AS (SELECT c, 0 AS kind, row_number() OVER (PARTITION BY c ORDER BY x) - 1 AS b, c || '#' || CAST(row_number() OVER (PARTITION BY c ORDER BY x) - 1 AS VARCHAR) AS token FROM v
              UNION ALL SELECT DISTINCT c, 0, 0, c FROM a WHERE c NOT IN (SELECT c FROM v) UNION ALL SELECT c, 1, 0, token FROM a WHERE token IS NOT NULL GROUP BY 1, 4 HAVING COUNT(DISTINCT h) >= 3)
        SELECT token, row_number() OVER (ORDER BY c, kind, b, token) + 3 AS id FROM s""",
)
def bin_08(spark: SparkSession, d: str) -> DataFrame:
    """A token for every segment, a bare one for concepts without any, and the categories seen in three stays."""
    x, finite = F.col("numerical_value"), N.finite(F.col("numerical_value"))
    events = read(spark, d, "patient_assessments").select(
        F.col("assessment_category").alias("concept"), F.col("hospitalization_id").alias("h"), x.alias("value"), F.when(~F.coalesce(finite, F.lit(False)), T.categorical_token(F.col("assessment_category"), F.col("categorical_value"))).alias("cat_token")
    )
    point = lambda v: F.struct(v.alias("lo"), v.alias("hi"), F.lit(True).alias("lo_closed"), F.lit(True).alias("hi_closed"))
    segments = events.where(N.finite(F.col("value")) & F.col("concept").isNotNull()).groupBy("concept").agg(F.array_sort(F.collect_set("value")).alias("v")).select("concept", F.transform("v", point).alias("segments"))
    return encode.segment_vocabulary(events, segments, "h", 3)
