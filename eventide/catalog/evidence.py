"""Doses, anchors, packing, generated sequences, calibration and causal estimators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eventide.catalog.registry import query
from eventide.catalog.sequences import _MIN, _TOKENS, _VOCAB, _creatinine, _sequences
from eventide.catalog.statistics import _ARMS, _SCORES, _arms, _scores
from eventide.operators import bins, doses, encode, labels
from eventide.operators import statistics as S
from eventide.runtime import read, scratch
from eventide.sources import sinks


@query("src_08_csv", "SELECT canonical_id, list_name, canonical_name FROM canonical_names")
def src_08(spark: SparkSession, d: str) -> DataFrame:
    """A table written as CSV and read with a declared schema."""
    path = scratch(spark) + "/csv"
    read(spark, d, "canonical_names").select("canonical_id", "list_name", "canonical_name").write.option("header", True).csv(path)
    return sinks.read_csv(spark, path, "canonical_id string, list_name string, canonical_name string")


@query("src_11_partition_read", "SELECT lab_id, lab_value_numeric FROM labs WHERE lab_category = 'sodium'")
def src_11(spark: SparkSession, d: str) -> DataFrame:
    """Labs written by category, of which one category is read."""
    path = scratch(spark) + "/shards"
    sinks.write_shards(read(spark, d, "labs").select("lab_id", "hospitalization_id", "lab_category", "lab_value_numeric"), path, "lab_category", ["hospitalization_id", "lab_id"])
    return sinks.read_shard(spark, path, "lab_category", "sodium", ["lab_id", "lab_value_numeric"])


@query("sch_06_binding", "SELECT canonical_id, 'v1' AS vocabulary FROM canonical_names")
def sch_06(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "canonical_names").select("canonical_id", sinks.binding(vocabulary="v1").alias("artifacts"))
    return sinks.check_binding(rows, "artifacts", vocabulary="v1").select("canonical_id", F.col("artifacts.vocabulary").alias("vocabulary"))


_DOSES = "(SELECT p_partkey AS i, CAST(p_size AS DOUBLE) AS dose, CASE p_partkey % 6 WHEN 0 THEN 'mcg/kg/min' WHEN 1 THEN 'mg/hr' WHEN 2 THEN 'units/hr' WHEN 3 THEN 'mcg' WHEN 4 THEN 'furlong' END AS u, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE 70.0 END AS w FROM part)"


@query(
    "prj_08_convert_dose",
    f"""SELECT i, CASE WHEN u IS NULL OR u = 'furlong' THEN 'unknown_unit' WHEN u = 'units/hr' THEN 'other_kind' WHEN u = 'mcg' THEN 'other_rate' WHEN w IS NULL AND u = 'mg/hr' THEN 'no_weight' ELSE 'ok' END AS status,
        CASE WHEN u = 'mcg/kg/min' THEN round(dose, 9) WHEN u = 'mg/hr' AND w IS NOT NULL THEN round(dose * 1000 / 60 / w, 9) END AS converted FROM {_DOSES}""",
)
def prj_08(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey") % 6
    unit = F.when(k == 0, "mcg/kg/min").when(k == 1, "mg/hr").when(k == 2, "units/hr").when(k == 3, "mcg").when(k == 4, "furlong")
    rows = read(spark, d, "part").select(F.col("p_partkey").alias("i"), F.col("p_size").cast("double").alias("dose"), unit.alias("u"), F.when(F.col("p_partkey") % 5 != 0, 70.0).alias("w"), F.lit("mcg/kg/min").alias("t"))
    return doses.convert(rows, "dose", "u", "t", "w").select("i", "status", F.round("converted", 9).alias("converted"))


@query(
    "rsh_10_corrections",
    "SELECT lab_id, CASE WHEN lab_category = 'crp' AND reference_unit = 'mg/dL' THEN lab_value_numeric * 10 ELSE lab_value_numeric END AS v FROM labs WHERE NOT (lab_category = 'inr' AND reference_unit = 'ratio') OR reference_unit IS NULL OR lab_category IS NULL",
)
def rsh_10(spark: SparkSession, d: str) -> DataFrame:
    rules = spark.createDataFrame([("crp", "mg/dL", 10.0, False), ("inr", "ratio", None, True)], "lab_category string, reference_unit string, factor double, quarantine boolean")
    rows = read(spark, d, "labs").select("lab_id", "lab_category", "reference_unit", F.col("lab_value_numeric").alias("v"))
    return doses.correct(rows, rules, ["lab_category", "reference_unit"], "v").select("lab_id", "v")


@query(
    "rsh_07_impute_total",
    """WITH p AS (SELECT hospitalization_id AS h, recorded_dttm AS t, max(CASE WHEN assessment_category = 'rass' THEN numerical_value END) AS r, max(CASE WHEN assessment_category = 'gcs_total' THEN numerical_value END) AS g FROM patient_assessments WHERE hospitalization_id IS NOT NULL AND recorded_dttm IS NOT NULL GROUP BY 1, 2)
       SELECT h, epoch_us(t) AS at_us, coalesce(g, CASE WHEN r <= -4 THEN 3 WHEN r <= -2 THEN 8 WHEN r < 2 THEN 15 END) AS total, g IS NULL AS imputed FROM p WHERE g IS NOT NULL OR r < 2""",
)
def rsh_07(spark: SparkSession, d: str) -> DataFrame:
    """A total missing at a time is imputed by bands of another score charted there; times without either are dropped."""
    rows = read(spark, d, "patient_assessments").where("hospitalization_id is not null and recorded_dttm is not null")
    of = lambda c: F.max(F.when(F.col("assessment_category") == c, F.col("numerical_value")))
    p = rows.groupBy(F.col("hospitalization_id").alias("h"), F.unix_micros("recorded_dttm").alias("at_us")).agg(of("rass").alias("r"), of("gcs_total").alias("g"))
    banded = F.when(F.col("r") <= -4, 3.0).when(F.col("r") <= -2, 8.0).when(F.col("r") < 2, 15.0)
    return p.select("h", "at_us", F.coalesce("g", banded).alias("total"), F.col("g").isNull().alias("imputed")).where("total is not null")


@query(
    "rsh_07_not_testable",
    """WITH e AS (SELECT assessment_id AS i, hospitalization_id AS h, recorded_dttm AS t, assessment_category AS c, numerical_value AS v, categorical_value AS x FROM patient_assessments WHERE hospitalization_id IS NOT NULL AND recorded_dttm IS NOT NULL AND assessment_category IS NOT NULL),
       k AS (SELECT h, t, CASE WHEN min(v) FILTER (c = 'rass') = max(v) FILTER (c = 'rass') AND min(v) FILTER (c = 'nrs_pain') = max(v) FILTER (c = 'nrs_pain') THEN min(v) FILTER (c = 'rass') + min(v) FILTER (c = 'nrs_pain') END AS em FROM e GROUP BY 1, 2 HAVING bool_or(c = 'cam_total' AND lower(trim(x)) = 'unable')),
       m AS (SELECT e.*, k.h IS NOT NULL AS u, em + CASE WHEN em BETWEEN -5 AND 2 THEN 1.0 WHEN em BETWEEN 3 AND 14 THEN 3.0 END AS total FROM e LEFT JOIN k ON k.h = e.h AND k.t = e.t)
       SELECT i AS assessment_id, c AS concept, CASE WHEN c = 'gcs_total' AND u THEN total WHEN c = 'cam_total' AND lower(trim(x)) = 'unable' THEN NULL ELSE v END AS value, CASE WHEN c = 'cam_total' AND lower(trim(x)) = 'unable' THEN 'not_testable' ELSE x END AS cat_value FROM m WHERE NOT (c = 'gcs_total' AND u AND total IS NULL)
       UNION ALL SELECT NULL, 'total_source', NULL, 'imputed' FROM (SELECT DISTINCT h, t FROM m WHERE c = 'gcs_total' AND u AND total IS NOT NULL)""",
)
def rsh_07_not_testable(spark: SparkSession, d: str) -> DataFrame:
    """Scores that could not be tested: recoded, and the total of that time imputed and marked, or dropped."""
    from eventide.operators import reshape

    rows = read(spark, d, "patient_assessments").where("hospitalization_id is not null and recorded_dttm is not null and assessment_category is not null")
    events = rows.select("assessment_id", F.col("hospitalization_id").alias("hosp_id"), F.col("recorded_dttm").alias("dttm"), F.col("assessment_category").alias("concept"), F.col("numerical_value").alias("value"), F.col("categorical_value").alias("cat_value"))
    out = reshape.not_testable(events, verbal="cam_total", eye="rass", motor="nrs_pain", total="gcs_total", codes=["unable"], numbers=[], bands=[(-5, 2, 1), (3, 14, 3)])
    return out.select("assessment_id", "concept", "value", "cat_value")


@query(
    "rsh_08_marker_events",
    """WITH e AS (SELECT DISTINCT hospitalization_id AS h, recorded_dttm AS t, device_category AS m FROM ecmo_mcs WHERE hospitalization_id IS NOT NULL AND recorded_dttm IS NOT NULL AND device_category IS NOT NULL)
       SELECT h, epoch_us(t) AS at_us, 0 AS rank, 'device=' || m AS token FROM e UNION ALL SELECT hospitalization_id, epoch_us(recorded_dttm), 1, 'flow' FROM ecmo_mcs WHERE hospitalization_id IS NOT NULL AND recorded_dttm IS NOT NULL AND flow IS NOT NULL""",
)
def rsh_08(spark: SparkSession, d: str) -> DataFrame:
    """A marker of the device, once per time, sorted just before the readings it belongs to."""
    rows = read(spark, d, "ecmo_mcs").where("hospitalization_id is not null and recorded_dttm is not null").select(F.col("hospitalization_id").alias("h"), F.unix_micros("recorded_dttm").alias("at_us"), "device_category", "flow")
    marks = rows.where("device_category is not null").select("h", "at_us", F.lit(0).alias("rank"), F.concat(F.lit("device="), "device_category").alias("token")).distinct()
    return marks.unionByName(rows.where("flow is not null").select("h", "at_us", F.lit(1).alias("rank"), F.lit("flow").alias("token")))


@query("join_06_semi", "SELECT assessment_id FROM patient_assessments WHERE hospitalization_id IN (SELECT hospitalization_id FROM ecmo_mcs)")
def join_06(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "patient_assessments").select("assessment_id", "hospitalization_id").join(read(spark, d, "ecmo_mcs").select("hospitalization_id"), "hospitalization_id", "left_semi").select("assessment_id")


@query(
    "join_08_left_chain",
    """SELECT p.patient_id, n.n AS n_stays, c.last_us, d.n AS n_notes FROM patient p LEFT JOIN (SELECT patient_id, COUNT(*) AS n FROM hospitalization GROUP BY 1) n ON n.patient_id = p.patient_id LEFT JOIN (SELECT patient_id, max(epoch_us(start_dttm)) AS last_us FROM code_status GROUP BY 1) c ON c.patient_id = p.patient_id
       LEFT JOIN (SELECT h.patient_id, COUNT(*) AS n FROM documents JOIN (SELECT hospitalization_id, min(patient_id) AS patient_id FROM hospitalization GROUP BY 1) h USING (hospitalization_id) GROUP BY 1) d ON d.patient_id = p.patient_id""",
)
def join_08(spark: SparkSession, d: str) -> DataFrame:
    stays = read(spark, d, "hospitalization")
    owner = stays.groupBy("hospitalization_id").agg(F.min("patient_id").alias("patient_id"))
    notes = read(spark, d, "documents").select("hospitalization_id").join(owner, "hospitalization_id").groupBy("patient_id").agg(F.count("*").alias("n_notes"))
    last = read(spark, d, "code_status").groupBy("patient_id").agg(F.max(F.unix_micros("start_dttm")).alias("last_us"))
    return read(spark, d, "patient").select("patient_id").join(stays.groupBy("patient_id").agg(F.count("*").alias("n_stays")), "patient_id", "left").join(last, "patient_id", "left").join(notes, "patient_id", "left")


@query(
    "join_10_interval",
    """WITH b AS (SELECT * FROM (VALUES ('sodium', 0, 0.0, 130.0), ('sodium', 1, 130.0, 145.0), ('sodium', 2, 145.0, 1e9), ('potassium', 0, 0.0, 3.5), ('potassium', 1, 3.5, 1e9)) AS t(c, bin, lo, hi))
       SELECT lab_id, bin FROM labs JOIN b ON c = lab_category AND lab_value_numeric >= lo AND lab_value_numeric < hi""",
)
def join_10(spark: SparkSession, d: str) -> DataFrame:
    b = spark.createDataFrame([("sodium", 0, 0.0, 130.0), ("sodium", 1, 130.0, 145.0), ("sodium", 2, 145.0, 1e9), ("potassium", 0, 0.0, 3.5), ("potassium", 1, 3.5, 1e9)], "lab_category string, bin int, lo double, hi double")
    labs = read(spark, d, "labs").select("lab_id", "lab_category", "lab_value_numeric")
    return labs.join(b, "lab_category").where((F.col("lab_value_numeric") >= F.col("lo")) & (F.col("lab_value_numeric") < F.col("hi"))).select("lab_id", "bin")


@query("agg_08_plausible_share", "SELECT crrt_mode_category, round(avg(CASE WHEN blood_flow_rate BETWEEN 150 AND 300 THEN 1.0 ELSE 0.0 END), 9) AS share, COUNT(*) AS n FROM crrt_therapy WHERE blood_flow_rate IS NOT NULL GROUP BY 1")
def agg_08(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "crrt_therapy").where("blood_flow_rate is not null").groupBy("crrt_mode_category").agg(F.round(F.avg(F.when(F.col("blood_flow_rate").between(150, 300), 1.0).otherwise(0.0)), 9).alias("share"), F.count("*").alias("n"))


@query("agg_13_coverage_gaps", "SELECT DISTINCT lab_category AS concept FROM labs WHERE lab_category IS NOT NULL AND lab_category NOT IN (SELECT lab_category FROM clif_lab_categories WHERE lab_order_category = 'bmp')")
def agg_13(spark: SparkSession, d: str) -> DataFrame:
    known = read(spark, d, "clif_lab_categories").where("lab_order_category = 'bmp'").select(F.col("lab_category").alias("concept"))
    return read(spark, d, "labs").select(F.col("lab_category").alias("concept")).where("concept is not null").distinct().join(known, "concept", "left_anti")


@query("agg_16_source_shares", "SELECT coalesce(lab_order_category, 'none') AS origin, COUNT(*) AS n FROM labs LEFT JOIN clif_lab_categories USING (lab_category) GROUP BY 1")
def agg_16(spark: SparkSession, d: str) -> DataFrame:
    origin = read(spark, d, "clif_lab_categories").select("lab_category", "lab_order_category")
    return read(spark, d, "labs").join(origin, "lab_category", "left").groupBy(F.coalesce("lab_order_category", F.lit("none")).alias("origin")).agg(F.count("*").alias("n"))


@query(
    "bin_07_edge_distance",
    """WITH r AS (SELECT lab_category AS c, lab_value_numeric AS x, row_number() OVER (PARTITION BY lab_category ORDER BY lab_value_numeric) - 1 AS i, COUNT(*) OVER (PARTITION BY lab_category) AS n FROM labs WHERE lab_value_numeric IS NOT NULL AND NOT isnan(lab_value_numeric)),
       e AS (SELECT DISTINCT c, x FROM r, (SELECT unnest(range(1, 8)) AS k) WHERE i = floor((n - 1) * k / 8.0 + 0.5)), t AS (SELECT * FROM (VALUES ('sodium', 130.0), ('potassium', 5.5), ('lactate', 4.0)) AS v(concept, threshold))
       SELECT concept, threshold, x AS edge, abs(x - threshold) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY concept ORDER BY abs(x - threshold), x) AS k FROM t JOIN e ON c = concept) WHERE k = 1""",
)
def bin_07(spark: SparkSession, d: str) -> DataFrame:
    labs = read(spark, d, "labs").select(F.col("lab_category").alias("concept"), F.col("lab_value_numeric").alias("x"))
    t = spark.createDataFrame([("sodium", 130.0), ("potassium", 5.5), ("lactate", 4.0)], "concept string, threshold double")
    return bins.edge_distance(t, bins.quantile_edges(labs, "concept", "x", 8))


_READ = f"(SELECT h, m AS minute, max(CASE WHEN v > 2 THEN 1 ELSE 0 END) AS hit FROM {_MIN} GROUP BY 1, 2)"
@query(
    "lab_03_all_anchors",
    f"""WITH r AS {_READ}, a AS (SELECT DISTINCT h, m + 600 AS anchor_min FROM {_MIN}),
            p AS (SELECT a.h, anchor_min, max_by(hit, minute) FILTER (minute <= anchor_min) AS now, min(minute) FILTER (minute > anchor_min AND minute <= anchor_min + 10080 AND hit = 1) AS nx, COUNT(*) FILTER (minute > anchor_min AND minute <= anchor_min + 10080) AS later FROM a JOIN r ON r.h = a.h GROUP BY 1, 2)
       SELECT h, anchor_min, CASE WHEN now = 1 THEN 'prevalent' WHEN nx IS NOT NULL THEN 'positive' WHEN later > 0 THEN 'negative' ELSE 'censored' END AS status, CASE WHEN coalesce(now, 0) <> 1 AND nx IS NOT NULL THEN nx - anchor_min END AS after_min FROM p""",
)
def lab_03_all(spark: SparkSession, d: str) -> DataFrame:
    """An anchor after every reading."""
    rows = _creatinine(spark, d)
    return labels.at_anchors(rows.select("h", (F.col("m") + 600).alias("anchor_min")), rows.select("h", F.col("m").alias("minute"), "v"), "h", F.col("v") > 2, horizon_min=10080)


@query("lab_07_anchor_sample", f"SELECT h, m AS anchor_min FROM (SELECT DISTINCT h, m FROM {_MIN}) QUALIFY row_number() OVER (PARTITION BY h ORDER BY sha256('3:' || h || ':' || CAST(m AS VARCHAR)), m) <= 2")
def lab_07(spark: SparkSession, d: str) -> DataFrame:
    return labels.sample_anchors(_creatinine(spark, d).select("h", F.col("m").alias("minute")), "h", 2, 3)


@query(
    "lab_10_window_resolution",
    """WITH c AS (SELECT o_custkey AS k, min(CASE WHEN o_orderstatus = 'P' THEN o_totalprice END) AS a, min(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END) AS b, max(o_totalprice) AS f FROM orders GROUP BY 1)
       SELECT k AS o_custkey, CASE WHEN a <= 60000 AND (b IS NULL OR b > 60000 OR a <= b) THEN 'a' WHEN b <= 60000 THEN 'b' WHEN f >= 60000 THEN 'event_free' ELSE 'censored' END AS outcome,
       CASE WHEN a <= 60000 OR b <= 60000 THEN least(coalesce(a, b), coalesce(b, a)) WHEN f >= 60000 THEN 60000 ELSE f END AS at FROM c""",
)
def lab_10(spark: SparkSession, d: str) -> DataFrame:
    price = F.col("o_totalprice")
    rows = read(spark, d, "orders").groupBy("o_custkey").agg(F.min(F.when(F.col("o_orderstatus") == "P", price)).alias("a"), F.min(F.when(F.col("o_orderstatus") == "F", price)).alias("b"), F.max(price).alias("f"))
    return labels.resolve_window(rows, ["a", "b"], "f", 60000.0).select("o_custkey", "outcome", "at")


@query("enc_05_packing")
def enc_05(spark: SparkSession, d: str) -> DataFrame:
    """Sequences packed into rows of 64 positions (no SQL: a greedy algorithm; tests check capacity and completeness)."""
    return encode.pack(_sequences(spark, d).select("h", "n_events"), "h", "n_events", 64, 4)


@query(
    "lab_16_header",
    f"""WITH {_TOKENS}, {_VOCAB}, s AS (SELECT h, list(coalesce(v.id, 3) ORDER BY tm, i) AS a FROM t LEFT JOIN v ON v.token = t.token GROUP BY 1)
        SELECT h, CAST(coalesce((SELECT min(k) FROM (SELECT unnest(range(1, len(a) + 1)) AS k) WHERE a[k] > 12) - 1, len(a)) AS INTEGER) AS header, (SELECT CASE WHEN COUNT(*) = 1 THEN min(x) END FROM (SELECT unnest(a) AS x) WHERE x IN (5, 6, 7)) AS outcome FROM s""",
)
def lab_16(spark: SparkSession, d: str) -> DataFrame:
    return _sequences(spark, d).select("h", encode.header_length(F.col("token"), list(range(0, 13))).alias("header"), encode.outcome_token(F.col("token"), [5, 6, 7]).alias("outcome"))


_PROMPTS = f"{_TOKENS}, {_VOCAB}, s AS (SELECT h, list(coalesce(v.id, 3) ORDER BY tm, i) AS a FROM t LEFT JOIN v ON v.token = t.token GROUP BY 1), p AS (SELECT h, array_to_string(a[1:3], ',') AS prompt FROM s WHERE len(a) >= 3)"


def _prompts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Every stay as a simulation and as observed."""
    s = _sequences(spark, d).select("h", "token")
    return s.where("size(token) >= 3").select(F.col("h").alias("sim"), F.slice("token", 1, 3).alias("prompt")), s


_ids = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


@query("gen_01_prompt_classes", f"WITH {_PROMPTS}, n AS (SELECT prompt, COUNT(*) AS observed FROM p GROUP BY 1) SELECT p.prompt, COUNT(*) AS simulations, any_value(observed) AS observed FROM p JOIN n ON n.prompt = p.prompt GROUP BY 1")
def gen_01_classes(spark: SparkSession, d: str) -> DataFrame:
    """Prompts with their numbers of simulations and of observed stays, of which every one pairs with every other."""
    sims, s = _prompts(spark, d)
    return encode.prompt_classes(sims, s, "prompt", "token").withColumn("prompt", _ids("prompt"))


@query("gen_01_prompt_members", f"WITH {_PROMPTS} SELECT prompt, h FROM p")
def gen_01_members(spark: SparkSession, d: str) -> DataFrame:
    """The prompt class of each stay."""
    sims, s = _prompts(spark, d)
    return encode.prompt_members(sims, s, "prompt", "token", "h").withColumn("prompt", _ids("prompt"))


@query(
    "gen_02_observed_outcome",
    f"""WITH {_TOKENS}, {_VOCAB}, e AS (SELECT h, coalesce(v.id, 3) AS id, epoch_us(tm) // 60000000 AS m, row_number() OVER (PARTITION BY h ORDER BY tm, i) AS k, min(epoch_us(tm) // 60000000) OVER (PARTITION BY h) + 720 AS a FROM t LEFT JOIN v ON v.token = t.token),
            g AS (SELECT h, max(m) FILTER (m <= a) AS now, max(k) FILTER (m <= a) AS last, COUNT(*) FILTER (id IN (5, 6, 7)) AS n, min(k) FILTER (id IN (5, 6, 7)) AS hit, min(id) FILTER (id IN (5, 6, 7)) AS outcome, min(m) FILTER (id IN (5, 6, 7)) AS m FROM e GROUP BY 1)
       SELECT h, CASE WHEN n = 1 AND hit > last THEN outcome END AS outcome, CASE WHEN n = 1 AND hit > last THEN m - now END AS after_min FROM g""",
)
def gen_02(spark: SparkSession, d: str) -> DataFrame:
    out = encode.observed_outcome(F.col("token"), F.col("at_min"), [5, 6, 7], 720)
    return _sequences(spark, d).withColumn("o", out).select("h", F.col("o.token").alias("outcome"), F.col("o.after_min").alias("after_min"))


@query("sta_05_ici")
def sta_05(spark: SparkSession, d: str) -> DataFrame:
    """Integrated calibration index by isotonic regression (no SQL: pool adjacent violators)."""
    return spark.createDataFrame([(float(S.isotonic_ici(_scores(spark, d))),)], "ici double")


@query("sta_07_temperature")
def sta_07(spark: SparkSession, d: str) -> DataFrame:
    """Temperature of logits (no SQL: a minimisation)."""
    rows = _scores(spark, d).where("p > 0 and p < 1").withColumn("z", F.log(F.col("p") / (1 - F.col("p"))) * 3)
    return spark.createDataFrame([(S.fit_temperature(rows, "z", "y"),)], "temperature double")


@query(
    "sta_10_calibration_histogram",
    f"""WITH c AS (SELECT CAST(least(floor(p * 10), 9) AS BIGINT) AS bin, COUNT(*) AS n FROM {_SCORES} WHERE p BETWEEN 0 AND 1 GROUP BY 1), e AS (SELECT b AS bin, coalesce(n, 0) AS n FROM (SELECT unnest(range(0, 10)) AS b) LEFT JOIN c ON c.bin = b)
        SELECT bin, n, round(sum(n) OVER () / 10.0, 6) AS expected, round(pow(n - sum(n) OVER () / 10.0, 2) / (sum(n) OVER () / 10.0), 6) AS chi2 FROM e""",
)
def sta_10(spark: SparkSession, d: str) -> DataFrame:
    return S.calibration_histogram(_scores(spark, d), "p").select("bin", "n", F.round("expected", 6).alias("expected"), F.round("chi2", 6).alias("chi2"))


@query(
    "sta_12_clones",
    """WITH p AS (SELECT o_orderkey AS k, o_orderstatus AS arm, CAST(o_orderkey % 50 AS DOUBLE) AS t FROM orders), c AS (SELECT *, unnest(['F', 'O']) AS clone_arm FROM p)
       SELECT k, clone_arm, t <= 24 AND arm = clone_arm AS follows, CASE WHEN NOT (t <= 24 AND arm = clone_arm) THEN CASE WHEN t <= 24 THEN t ELSE 24 END END AS censored_at FROM c""",
)
def sta_12(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("arm"), (F.col("o_orderkey") % 50).cast("double").alias("t"))
    return S.clones(rows, "arm", "t", ["F", "O"], 24).select("k", "clone_arm", "follows", "censored_at")


@query(
    "sta_28_doubly_robust",
    f"WITH s AS (SELECT 0.5 + CASE WHEN a = 1 THEN (y - 0.5) / e ELSE 0 END AS s FROM {_ARMS}) SELECT round(avg(s), 9) AS risk, round(stddev_samp(s) / sqrt(COUNT(*)), 9) AS se FROM s",
)
def sta_28(spark: SparkSession, d: str) -> DataFrame:
    out = S.doubly_robust(_arms(spark, d).withColumn("m", F.lit(0.5)), "y", "a", "e", "m")
    return out.select(F.round("risk", 9).alias("risk"), F.round("se", 9).alias("se"))


@query("sta_22_cluster_bootstrap")
def sta_22_boot(spark: SparkSession, d: str) -> DataFrame:
    """Bootstrap means over resampled customers (no SQL: pseudo-random weights)."""
    return S.cluster_bootstrap(read(spark, d, "orders"), "o_custkey", "o_totalprice", 20)


@query(
    "sta_19_recall",
    """WITH s AS (SELECT user_id, list(DISTINCT event_type) FILTER (value > 50) AS a, list(DISTINCT event_type) FILTER (value <= 50) AS b FROM events GROUP BY 1)
       SELECT user_id, round(len(list_intersect(a, coalesce(b, []))) / CAST(len(a) AS DOUBLE), 9) AS recall FROM s WHERE len(a) > 0""",
)
def sta_19_recall(spark: SparkSession, d: str) -> DataFrame:
    of = lambda c: F.collect_set(F.when(c, F.col("event_type")))
    s = read(spark, d, "events").groupBy("user_id").agg(of(F.col("value") > 50).alias("a"), of(F.col("value") <= 50).alias("b"))
    return s.select("user_id", F.round(S.set_recall(F.col("a"), F.col("b")), 9).alias("recall")).where("recall is not null")


@query(
    "sta_25_head_math",
    """WITH h AS (SELECT l_orderkey AS k, l_discount AS p FROM lineitem) SELECT k, round(CASE WHEN max(p) < 1 THEN 1 - exp(sum(ln(1 - p))) ELSE 1 END, 9) AS failure, round(CASE WHEN min(p) > 0 THEN exp(sum(CASE WHEN p > 0 THEN ln(p) ELSE 0 END)) ELSE 0 END, 9) AS joint FROM h GROUP BY 1""",
)
def sta_25(spark: SparkSession, d: str) -> DataFrame:
    h = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.array_sort(F.collect_list("l_discount")).alias("h"))
    return h.select("k", F.round(S.cause_incidence(F.col("h")), 9).alias("failure"), F.round(S.all_of(F.col("h")), 9).alias("joint"))


@query(
    "sta_08_subgroup_panel",
    f"""WITH r AS (SELECT g, p, y, rank() OVER (PARTITION BY g ORDER BY p) + (COUNT(*) OVER (PARTITION BY g, p) - 1) / 2.0 AS r FROM {_SCORES})
        SELECT g, COUNT(*) AS n, round((sum(CASE WHEN y = 1 THEN r END) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (COUNT(*) - sum(y))), 9) AS auroc, round(avg(pow(p - y, 2)), 9) AS brier, round(avg(y), 9) AS prevalence FROM r GROUP BY 1""",
)
def sta_08(spark: SparkSession, d: str) -> DataFrame:
    s = _scores(spark, d)
    base = s.groupBy("g").agg(F.round(S.brier(F.col("p"), F.col("y")), 9).alias("brier"), F.round(F.avg("y"), 9).alias("prevalence"))
    return S.auroc(s, ["g"]).select("g", "n", F.round("auroc", 9).alias("auroc")).join(base, "g")


@query("sta_27_logistic_baseline")
def sta_27(spark: SparkSession, d: str) -> DataFrame:
    """L2 logistic baseline on counts per stay, fitted on four folds of entities and scored on the fifth (no SQL: a fitted model)."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    rows = read(spark, d, "orders").groupBy("o_custkey").agg(
        F.count("*").cast("double").alias("n"), F.avg("o_totalprice").alias("m"), F.max(F.when(F.col("o_orderstatus") == "P", 1.0).otherwise(0.0)).alias("label")
    )
    x = VectorAssembler(inputCols=["n", "m"], outputCol="features").transform(rows).withColumn("fold", S.folds(F.col("o_custkey"), 5))
    model = LogisticRegression(regParam=0.01, elasticNetParam=0.0).fit(x.where("fold < 4"))
    scored = model.transform(x.where("fold = 4")).select("probability", F.col("label").cast("int").alias("y"))
    from pyspark.ml.functions import vector_to_array

    return S.auroc(scored.select(vector_to_array("probability")[1].alias("p"), "y"))


@query("up_02_previous_codes", "WITH o AS (SELECT o_custkey, o_orderkey, o_orderdate, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS p FROM orders), f AS (SELECT l_orderkey, string_agg(DISTINCT l_returnflag, '|' ORDER BY l_returnflag) AS flags FROM lineitem GROUP BY 1) SELECT o_orderkey, coalesce(flags, 'no_history') AS history FROM o LEFT JOIN f ON l_orderkey = p")
def up_02(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    orders = read(spark, d, "orders").select("o_orderkey", F.lag("o_orderkey").over(w).alias("l_orderkey"))
    flags = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_set("l_returnflag")), "|").alias("f"))
    return orders.join(flags, "l_orderkey", "left").select("o_orderkey", F.coalesce("f", F.lit("no_history")).alias("history"))


@query(
    "up_07_narrative",
    "SELECT user_id, string_agg(event_type, ' ' ORDER BY ts, CASE event_type WHEN 'signup' THEN 0 WHEN 'login' THEN 1 ELSE 2 END, event_id) AS story FROM events GROUP BY 1",
)
def up_07(spark: SparkSession, d: str) -> DataFrame:
    rank = F.when(F.col("event_type") == "signup", 0).when(F.col("event_type") == "login", 1).otherwise(2)
    items = F.array_sort(F.collect_list(F.struct(F.col("ts"), rank.alias("r"), F.col("event_id"), F.col("event_type"))))
    return read(spark, d, "events").groupBy("user_id").agg(items.alias("s")).select("user_id", F.array_join(F.col("s.event_type"), " ").alias("story"))


@query(
    "up_08_last_state",
    """WITH l AS (SELECT hospitalization_id AS h, arg_max(device_category, (recorded_dttm, ecmo_id)) AS d FROM ecmo_mcs WHERE hospitalization_id IS NOT NULL AND recorded_dttm IS NOT NULL AND device_category IS NOT NULL GROUP BY 1), x AS (SELECT hospitalization_id AS h, bool_or(discharge_category = 'Expired') AS dead FROM hospitalization WHERE hospitalization_id IS NOT NULL GROUP BY 1)
       SELECT l.h, CASE WHEN coalesce(dead, false) THEN 'expired' WHEN d LIKE '%ecmo' THEN 'ecmo' ELSE 'other' END AS outcome FROM l LEFT JOIN x USING (h)""",
)
def up_08(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "ecmo_mcs").where("hospitalization_id is not null and recorded_dttm is not null and device_category is not null")
    last = rows.groupBy(F.col("hospitalization_id").alias("h")).agg(F.max_by("device_category", F.struct("recorded_dttm", "ecmo_id")).alias("d"))
    dead = read(spark, d, "hospitalization").where("hospitalization_id is not null").groupBy(F.col("hospitalization_id").alias("h")).agg(F.bool_or(F.col("discharge_category") == "Expired").alias("dead"))
    return last.join(dead, "h", "left").select("h", F.when(F.coalesce("dead", F.lit(False)), "expired").when(F.col("d").endswith("ecmo"), "ecmo").otherwise("other").alias("outcome"))


