"""Binning plans, artifacts, evaluation sets, gates and dry runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eventide.catalog.registry import query
from eventide.catalog.segments import stats_sql
from eventide.catalog.sequences import _MIN, _TOKENS, _VOCAB, _creatinine, _tokens, _vocab
from eventide.functions import numbers as N
from eventide.functions import text as T
from eventide.operators import bins, encode, joins, labels, windows
from eventide.runtime import read, scratch
from eventide.sources import sinks, tables


@query("src_07_whole_entity_limit", "SELECT lab_id FROM labs WHERE hospitalization_id IN (SELECT hospitalization_id FROM (SELECT DISTINCT hospitalization_id FROM labs WHERE hospitalization_id IS NOT NULL) ORDER BY sha256('w:' || hospitalization_id), hospitalization_id LIMIT 10)")
def src_07(spark: SparkSession, d: str) -> DataFrame:
    """All rows of ten whole stays: the limit is the feature, and falls on entities, not rows."""
    labs = read(spark, d, "labs").select("lab_id", "hospitalization_id")
    return joins.keep_ids(labs, tables.sample_ids(labs, "hospitalization_id", 10, "w"), "hospitalization_id").select("lab_id")


@query("src_10_declared_segments", "SELECT lab_id, CAST(CASE WHEN lab_category = 'sodium' THEN CASE WHEN lab_value_numeric < 135 THEN 0 WHEN lab_value_numeric <= 145 THEN 1 ELSE 2 END WHEN lab_category = 'potassium' THEN CASE WHEN lab_value_numeric < 3.5 THEN 0 ELSE 1 END END AS INTEGER) AS bin FROM labs WHERE lab_category IN ('sodium', 'potassium') AND lab_value_numeric IS NOT NULL AND NOT isnan(lab_value_numeric)")
def src_10(spark: SparkSession, d: str) -> DataFrame:
    """Declared segments, made a strict partition and joined by concept."""
    declared = {"sodium": [(None, 135.0, False, False), (135.0, 145.0, True, True), (145.0, None, False, False)], "potassium": [(None, 3.5, False, False), (3.5, None, True, False)]}
    rows = [(c, [tuple(s) for s in bins.merge_partition(v)]) for c, v in declared.items()]
    segments = spark.createDataFrame(rows, f"lab_category string, s array<{bins.SEGMENT}>")
    labs = read(spark, d, "labs").select("lab_id", "lab_category", "lab_value_numeric").where(N.finite(F.col("lab_value_numeric")))
    return labs.join(segments, "lab_category").select("lab_id", bins.bin_index(F.col("lab_value_numeric"), F.col("s")).alias("bin"))


@query("snk_01_partitioned_write", "SELECT location_category AS part, COUNT(*) AS n FROM adt WHERE location_category IS NOT NULL GROUP BY 1")
def snk_01(spark: SparkSession, d: str) -> DataFrame:
    """Rows of each written partition."""
    path = scratch(spark) + "/parts"
    sinks.write_shards(read(spark, d, "adt").where("location_category is not null").select("adt_id", "hospitalization_id", F.col("location_category").alias("part")), path, "part", ["hospitalization_id", "adt_id"])
    return spark.read.parquet(path).groupBy("part").agg(F.count("*").alias("n"))


@query("sch_05_validator", "SELECT COUNT(*) AS n_rows, COUNT(*) FILTER (patient_id IS NULL) AS null_key, COUNT(*) - COUNT(DISTINCT patient_id) AS repeated_key, COUNT(*) FILTER (NOT regexp_full_match(patient_id, 'P[0-9]{8}')) AS malformed FROM patient")
def sch_05(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("patient_id")
    return read(spark, d, "patient").agg(F.count("*").alias("n_rows"), F.count_if(p.isNull()).alias("null_key"), (F.count("*") - F.count_distinct(p)).alias("repeated_key"), F.count_if(~p.rlike("^P[0-9]{8}$")).alias("malformed"))


@query("prj_17_guarded_ratio", "SELECT crrt_id, round(CASE WHEN dialysate_flow_rate > 0 AND CAST(blood_flow_rate AS DOUBLE) / dialysate_flow_rate BETWEEN 0.05 AND 1 THEN CAST(blood_flow_rate AS DOUBLE) / dialysate_flow_rate END, 9) AS ratio FROM crrt_therapy")
def prj_17(spark: SparkSession, d: str) -> DataFrame:
    """A derived value kept only within a plausible range."""
    b, q = F.col("blood_flow_rate").cast("double"), F.col("dialysate_flow_rate").cast("double")
    ratio = F.try_divide(b, q)
    return read(spark, d, "crrt_therapy").select("crrt_id", F.round(F.when((q > 0) & ratio.between(0.05, 1), ratio), 9).alias("ratio"))


@query("prj_20_split_sequence", "SELECT canonical_id, array_to_string(regexp_extract_all(canonical_name, '(Critical Care|\\S+)', 1), '|') AS tokens FROM canonical_names")
def prj_20(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "canonical_names").select("canonical_id", F.array_join(T.split_sequence(F.col("canonical_name"), ["Critical Care"]), "|").alias("tokens"))


@query("prj_21_describe", "SELECT lab_category, replace(lab_category, '_', ' ') || ' 1.5 to 2.5 ' || reference_unit AS text FROM clif_lab_categories")
def prj_21(spark: SparkSession, d: str) -> DataFrame:
    token = T.bin_token(F.col("lab_category"), F.lit(3))
    return read(spark, d, "clif_lab_categories").select("lab_category", T.describe_token(token, F.col("reference_unit"), F.lit(1.5), F.lit(2.5)).alias("text"))


@query(
    "join_05_window_pushdown",
    "SELECT COUNT(*) AS n, COUNT(DISTINCT h) AS stays FROM (SELECT l.hospitalization_id AS h FROM labs l JOIN (SELECT hospitalization_id, min(admission_dttm) AS lo FROM hospitalization WHERE hospitalization_id IS NOT NULL GROUP BY 1) s USING (hospitalization_id) WHERE lab_result_dttm BETWEEN lo AND lo + INTERVAL 24 HOUR)",
)
def join_05(spark: SparkSession, d: str) -> DataFrame:
    stays = read(spark, d, "hospitalization").where("hospitalization_id is not null").groupBy("hospitalization_id").agg(F.min("admission_dttm").alias("lo")).withColumn("hi", tables.with_lag(F.col("lo"), 1440))
    near = joins.in_window(read(spark, d, "labs").select("hospitalization_id", "lab_result_dttm"), stays, "hospitalization_id", "lab_result_dttm", "lo", "hi")
    return near.agg(F.count("*").alias("n"), F.count_distinct("hospitalization_id").alias("stays"))


@query(
    "join_12_extra_stays",
    """WITH e AS (SELECT DISTINCT hospitalization_id FROM ecmo_mcs), c AS (SELECT DISTINCT hospitalization_id FROM crrt_therapy WHERE hospitalization_id IS NOT NULL) SELECT c.hospitalization_id, h.hospitalization_id IS NOT NULL AS found FROM c LEFT JOIN (SELECT DISTINCT hospitalization_id FROM hospitalization) h USING (hospitalization_id) WHERE c.hospitalization_id NOT IN (SELECT hospitalization_id FROM e WHERE hospitalization_id IS NOT NULL)""",
)
def join_12(spark: SparkSession, d: str) -> DataFrame:
    """Stays of one table that another lacks, and whether the stay table knows them."""
    extra = read(spark, d, "crrt_therapy").select("hospitalization_id").where("hospitalization_id is not null").distinct().join(read(spark, d, "ecmo_mcs").select("hospitalization_id"), "hospitalization_id", "left_anti")
    known = read(spark, d, "hospitalization").select("hospitalization_id").distinct().withColumn("found", F.lit(True))
    return extra.join(known, "hospitalization_id", "left").na.fill(False, ["found"])


@query(
    "bin_04_binning_source",
    """WITH v AS (SELECT lab_category AS concept, lab_value_numeric AS x FROM labs WHERE lab_value_numeric IS NOT NULL AND NOT isnan(lab_value_numeric) UNION ALL SELECT assessment_category, numerical_value FROM patient_assessments WHERE numerical_value IS NOT NULL)
       SELECT concept, COUNT(*) AS n, CASE WHEN concept = 'sodium' THEN 'declared' WHEN COUNT(*) < 20 THEN 'single' WHEN bool_and(x = round(x)) AND COUNT(DISTINCT x) <= 25 THEN 'ordinal' ELSE 'quantile' END AS source FROM v GROUP BY 1""",
)
def bin_04(spark: SparkSession, d: str) -> DataFrame:
    v = read(spark, d, "labs").select(F.col("lab_category").alias("concept"), F.col("lab_value_numeric").alias("x")).unionByName(read(spark, d, "patient_assessments").select(F.col("assessment_category").alias("concept"), F.col("numerical_value").alias("x")))
    return bins.binning_source(v, "concept", "x", spark.createDataFrame([("sodium",)], "concept string"))


@query(
    "bin_09_reference_units",
    "SELECT lab_category, unit, n, stays FROM (SELECT lab_category, reference_unit AS unit, COUNT(*) AS n, COUNT(DISTINCT hospitalization_id) AS stays, row_number() OVER (PARTITION BY lab_category ORDER BY COUNT(*) DESC, reference_unit) AS r FROM labs WHERE reference_unit IS NOT NULL GROUP BY 1, 2) WHERE r = 1",
)
def bin_09(spark: SparkSession, d: str) -> DataFrame:
    n = read(spark, d, "labs").where("reference_unit is not null").groupBy("lab_category", F.col("reference_unit").alias("unit")).agg(F.count("*").alias("n"), F.count_distinct("hospitalization_id").alias("stays"))
    return windows.first_per(n, ["lab_category"], [F.desc("n"), "unit"])


@query(
    "enc_04_value_channel",
    f"""WITH s AS (SELECT assessment_category AS c, numerical_value AS v, hospitalization_id AS h, recorded_dttm AS tm, assessment_id AS i FROM patient_assessments WHERE hospitalization_id IS NOT NULL AND recorded_dttm IS NOT NULL AND numerical_value IS NOT NULL AND NOT isnan(numerical_value)), m AS {stats_sql('s', 'c', 'v')}
        SELECT h, string_agg(s.c, ',' ORDER BY tm, i) AS tokens, round(sum(CASE WHEN abs((v - center) / spread) <= 5 THEN (v - center) / spread ELSE 0 END), 5) AS z_sum FROM s JOIN m ON m.c = s.c GROUP BY 1""",
)
def enc_04(spark: SparkSession, d: str) -> DataFrame:
    """Tokens without their bins, beside a channel of normalised values."""
    rows = read(spark, d, "patient_assessments").where("hospitalization_id is not null and recorded_dttm is not null").where(N.finite(F.col("numerical_value")))
    t = rows.select(F.col("hospitalization_id").alias("h"), F.col("recorded_dttm").alias("at"), F.col("assessment_id").alias("i"), F.col("assessment_category").alias("c"), F.col("numerical_value").alias("v"))
    stats = bins.robust_stats(t, "c", "v")
    z = t.join(stats, "c").withColumn("z", F.coalesce(N.z_score(F.col("v"), F.col("center"), F.col("spread"), 5), F.lit(0.0)))
    packed = z.groupBy("h").agg(F.array_sort(F.collect_list(F.struct("at", "i", "c", "z"))).alias("a"))
    return packed.select("h", F.array_join(F.col("a.c"), ",").alias("tokens"), F.round(F.aggregate(F.col("a.z"), F.lit(0.0), lambda x, y: x + y), 5).alias("z_sum"))


@query("spl_04_fit_partition", "SELECT patient_id FROM patient WHERE CAST(('0x' || substr(sha256('5:' || patient_id), 1, 16))::UBIGINT AS DOUBLE) / 18446744073709551616.0 < 0.8")
def spl_04(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "patient").select("patient_id").where(N.unit_interval(F.col("patient_id"), seed="5") < 0.8)


_RISE = f"(SELECT h, m, bool_or(r) AS r FROM (SELECT h, m, coalesce(v >= min(v) OVER (PARTITION BY h ORDER BY m RANGE BETWEEN 10080 PRECEDING AND 1 PRECEDING) * 1.5 - 1e-9, false) AS r FROM {_MIN}) GROUP BY 1, 2)"


@query(
    "lab_04_rule_cause",
    f"""WITH r AS {_RISE}, a AS (SELECT h, min(m) + 1440 AS anchor_min FROM {_MIN} GROUP BY 1)
        SELECT a.h, anchor_min, CASE WHEN (SELECT arg_max(r, m) FROM r WHERE r.h = a.h AND m <= anchor_min) THEN 'prevalent' WHEN (SELECT min(m) FROM r WHERE r.h = a.h AND m > anchor_min AND r) IS NOT NULL THEN 'positive' WHEN (SELECT COUNT(*) FROM r WHERE r.h = a.h AND m > anchor_min) > 0 THEN 'negative' ELSE 'censored' END AS status FROM a""",
)
def lab_04(spark: SparkSession, d: str) -> DataFrame:
    """Labels of a rule over the past (a rise in a trailing window) instead of a threshold."""
    rows = _creatinine(spark, d)
    risen = windows.trailing_rise(rows, ["h"], "m", "v", absolute=1e9, absolute_minutes=1, relative=1.5, relative_minutes=10080)
    anchors = rows.groupBy("h").agg((F.min("m") + 1440).alias("anchor_min"))
    return labels.at_anchors(anchors, risen.select("h", F.col("m").alias("minute"), "risen"), "h", F.col("risen")).select("h", "anchor_min", "status")


@query(
    "lab_08_same_minute_method",
    """WITH m AS (SELECT hospitalization_id AS h, epoch_us(recorded_dttm) // 60000000 AS m, max(device_category) AS dev FROM ecmo_mcs WHERE hospitalization_id IS NOT NULL AND recorded_dttm IS NOT NULL AND device_category IS NOT NULL GROUP BY 1, 2)
       SELECT ecmo_id FROM ecmo_mcs JOIN m ON h = hospitalization_id AND m = epoch_us(recorded_dttm) // 60000000 WHERE dev = 'pulmara_ecmo' AND flow IS NOT NULL""",
)
def lab_08(spark: SparkSession, d: str) -> DataFrame:
    """Readings whose method, charted in the same minute, is the one asked for."""
    rows = read(spark, d, "ecmo_mcs").where("hospitalization_id is not null and recorded_dttm is not null").withColumn("m", F.expr("unix_micros(recorded_dttm) div 60000000"))
    dev = F.max("device_category").over(Window.partitionBy("hospitalization_id", "m"))
    return rows.withColumn("dev", dev).where("dev = 'pulmara_ecmo' and flow is not null").select("ecmo_id")


@query(
    "lab_14_evaluation_set",
    f"""WITH a AS (SELECT h, m AS anchor_min FROM (SELECT DISTINCT h, m FROM {_MIN}) QUALIFY row_number() OVER (PARTITION BY h ORDER BY sha256('9:' || h || ':' || CAST(m AS VARCHAR)), m) <= 1), q AS (SELECT * FROM (VALUES (1.5), (3.0)) AS t(threshold)),
        r AS (SELECT h, m, max(v) AS v FROM {_MIN} GROUP BY 1, 2)
        SELECT a.h, anchor_min, CAST(threshold AS DOUBLE) AS threshold, CAST(CASE WHEN (SELECT arg_max(v, m) FROM r WHERE r.h = a.h AND m <= anchor_min) > threshold THEN NULL WHEN EXISTS (SELECT 1 FROM r WHERE r.h = a.h AND m > anchor_min AND v > threshold) THEN 1 WHEN EXISTS (SELECT 1 FROM r WHERE r.h = a.h AND m > anchor_min) THEN 0 END AS INTEGER) AS label FROM a, q""",
)
def lab_14(spark: SparkSession, d: str) -> DataFrame:
    """Sampled anchors against registered thresholds; labels only where the outcome is open at the anchor and seen after it."""
    rows = _creatinine(spark, d).select("h", F.col("m").alias("minute"), "v")
    anchors = labels.sample_anchors(rows, "h", 1, 9)
    out = None
    for t in (1.5, 3.0):  # a registered handful, one labelled pass each
        one = labels.at_anchors(anchors, rows, "h", F.col("v") > t).select("h", "anchor_min", F.lit(t).alias("threshold"), F.when(F.col("status") == "positive", 1).when(F.col("status") == "negative", 0).alias("label"))
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "lab_02_outcome_lists",
    f"""WITH {_TOKENS}, s AS (SELECT DISTINCT h FROM t), o AS (SELECT h, string_agg(CAST(m AS VARCHAR), ',' ORDER BY m) AS mins FROM (SELECT DISTINCT h, m FROM {_MIN} WHERE v > 2) GROUP BY 1) SELECT s.h, coalesce(mins, '') AS outcomes FROM s LEFT JOIN o ON o.h = s.h""",
)
def lab_02(spark: SparkSession, d: str) -> DataFrame:
    """Outcome lists joined onto sequences; an empty list for stays without any."""
    hits = _creatinine(spark, d).where("v > 2").select("h", "m").distinct()
    out = joins.lists_per_key(_tokens(spark, d).select("h").distinct(), hits, "h", ["m"], "l")
    return out.select("h", F.array_join(F.transform("l", lambda x: x["m"].cast("string")), ",").alias("outcomes"))


@query(
    "lab_02_outcome_slots",
    f"""WITH {_TOKENS}, s AS (SELECT DISTINCT h FROM t), o AS (SELECT DISTINCT h, m, 0 AS slot, 1 AS bin FROM {_MIN} WHERE v > 2 UNION ALL SELECT DISTINCT hospitalization_id, epoch_us(lab_result_dttm) // 60000000, 1, 2 FROM labs WHERE lab_category = 'potassium' AND lab_value_numeric > 5.5 AND NOT isnan(lab_value_numeric) AND lab_result_dttm IS NOT NULL AND hospitalization_id IS NOT NULL),
        l AS (SELECT h, string_agg(CAST(slot AS VARCHAR) || ':' || CAST(bin AS VARCHAR) || ':' || CAST(m AS VARCHAR), ',' ORDER BY slot, m) AS x FROM o GROUP BY 1) SELECT s.h, coalesce(x, '') AS outcomes FROM s LEFT JOIN l ON l.h = s.h""",
)
def lab_02_slots(spark: SparkSession, d: str) -> DataFrame:
    """Outcomes of several causes joined onto sequences: cause slot, the bin on the threshold's event side, and the minute."""
    segments = {"creatinine": bins.merge_partition([(None, 2.0, False, True), (2.0, None, False, False)]), "potassium": bins.merge_partition([(None, 3.5, False, False), (3.5, 5.5, True, True), (5.5, None, False, False)])}
    side = lambda c, t: bins.threshold_bin(t, segments[c], above=True)
    first = _creatinine(spark, d).where("v > 2").select("h", "m", F.lit(0).alias("slot"), F.lit(side("creatinine", 2.0)).alias("bin"))
    labs = read(spark, d, "labs").where("lab_category = 'potassium' and lab_result_dttm is not null and hospitalization_id is not null").where(N.finite(F.col("lab_value_numeric")) & (F.col("lab_value_numeric") > 5.5))
    second = labs.select(F.col("hospitalization_id").alias("h"), F.expr("unix_micros(lab_result_dttm) div 60000000").alias("m"), F.lit(1).alias("slot"), F.lit(side("potassium", 5.5)).alias("bin"))
    out = joins.lists_per_key(_tokens(spark, d).select("h").distinct(), first.unionByName(second).distinct(), "h", ["slot", "m", "bin"], "l")
    return out.select("h", F.array_join(F.transform("l", lambda x: F.concat_ws(":", x["slot"].cast("string"), x["bin"].cast("string"), x["m"].cast("string"))), ",").alias("outcomes"))


@query("sta_26_best", "SELECT lab_category, arg_min(lab_id, (lab_value_numeric, lab_id)) AS best FROM labs WHERE lab_value_numeric IS NOT NULL AND NOT isnan(lab_value_numeric) GROUP BY 1")
def sta_26(spark: SparkSession, d: str) -> DataFrame:
    """Row of the lowest finite value per group."""
    return read(spark, d, "labs").where(N.finite(F.col("lab_value_numeric"))).groupBy("lab_category").agg(F.min_by("lab_id", F.struct("lab_value_numeric", "lab_id")).alias("best"))


@query("enc_03_prompt_at_anchor", f"WITH {_TOKENS}, {_VOCAB}, f AS (SELECT h, min(tm) AS a FROM t GROUP BY 1) SELECT h, COUNT(*) FILTER (epoch_us(tm) // 60000000 <= epoch_us(a) // 60000000 + 720) AS prompt, COUNT(*) AS whole FROM t JOIN f USING (h) GROUP BY 1")
def enc_03_prompt(spark: SparkSession, d: str) -> DataFrame:
    t = _tokens(spark, d).withColumn("at_min", F.expr("unix_micros(at) div 60000000"))
    s = encode.encode(t, _vocab(t), "h", ["at", "i"], ["at_min"]).withColumn("whole", F.size("token").cast("bigint"))
    return encode.cut_at(s, ["token"], "at_min", F.array_min("at_min") + 720).select("h", F.size("token").cast("bigint").alias("prompt"), "whole")
