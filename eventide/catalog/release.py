"""Declarations applied, reports, ledgers, pooled results and outputs of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventide.catalog.registry import query
from eventide.catalog.sequences import _MIN, _creatinine
from eventide.functions import numbers as N
from eventide.operators import bins, disclosure, labels
from eventide.operators.windows import nearest
from eventide.runtime import read, scratch
from eventide.sources import config, tables

_CHAIN = ["true", "l_quantity > 10", "l_quantity > 10 AND l_discount < 0.08", "l_quantity > 10 AND l_discount < 0.08 AND l_returnflag = 'N'"]


@query(
    "dis_04_waterfall",
    "WITH s AS (" + " UNION ALL ".join(f"SELECT {i + 1} AS step, COUNT(*) FILTER ({c}) AS n FROM lineitem" for i, c in enumerate(_CHAIN)) + ") SELECT step, CAST(n AS VARCHAR) AS left_shown, CAST(lag(n) OVER (ORDER BY step) - n AS VARCHAR) AS removed_shown FROM s",
)
def dis_04(spark: SparkSession, d: str) -> DataFrame:
    """A cohort's steps and what each removes; none is small here, small ones are tested on fixtures."""
    one = read(spark, d, "lineitem").agg(*[F.count_if(F.coalesce(F.expr(c), F.lit(False))).alias(f"n{i}") for i, c in enumerate(_CHAIN)])
    steps = one.select(F.inline(F.array(*[F.struct(F.lit(i + 1).alias("step"), F.col(f"n{i}").alias("n")) for i in range(len(_CHAIN))])))
    return disclosure.waterfall(steps, "step", "n")


@query(
    "dis_08_forest",
    """WITH c AS (SELECT hospital_id AS site, COUNT(*) AS n, avg(CASE WHEN discharge_category = 'Expired' THEN 1.0 ELSE 0.0 END) AS v FROM hospitalization WHERE hospital_id IS NOT NULL GROUP BY 1), s AS (SELECT site, CASE WHEN n < 30 OR v * (1 - v) = 0 THEN 'suppressed' ELSE 'evaluable' END AS status, v, sqrt(v * (1 - v) / n) AS e FROM c),
       w AS (SELECT *, CASE WHEN status = 'evaluable' THEN 1 / pow(e, 2) END AS w FROM s), p AS (SELECT sum(w) AS tw, sum(w * v) / sum(w) AS m FROM w)
       SELECT site, status, round(CASE WHEN w IS NOT NULL THEN v END, 8) AS value, round(CASE WHEN w IS NOT NULL THEN v - 1.959963984540054 * e END, 8) AS lo, round(CASE WHEN w IS NOT NULL THEN v + 1.959963984540054 * e END, 8) AS hi, round(w / tw, 8) AS weight FROM w, p
       UNION ALL SELECT 'pooled', 'evaluable', round(m, 8), round(m - 1.959963984540054 / sqrt(tw), 8), round(m + 1.959963984540054 / sqrt(tw), 8), 1 FROM p WHERE tw > 0""",
)
def dis_08(spark: SparkSession, d: str) -> DataFrame:
    """A rate of every site and their inverse-variance mean; small sites have a status only."""
    y = F.when(F.col("discharge_category") == "Expired", 1.0).otherwise(0.0)
    c = read(spark, d, "hospitalization").where("hospital_id is not null").groupBy(F.col("hospital_id").alias("site")).agg(F.count("*").alias("n"), F.avg(y).alias("v"))
    cells = c.select("site", F.when((F.col("n") < 30) | (F.col("v") * (1 - F.col("v")) == 0), "suppressed").otherwise("evaluable").alias("status"), "v", F.sqrt(F.col("v") * (1 - F.col("v")) / F.col("n")).alias("e"))
    return disclosure.forest(cells, "v", "e").select("site", "status", *[F.round(c, 8).alias(c) for c in ("value", "lo", "hi", "weight")])


@query("dis_06_ledger", "SELECT site, min(status) AS status FROM (SELECT hospital_id AS site, CASE WHEN COUNT(*) < 40 THEN 'suppressed' ELSE 'evaluable' END AS status FROM hospitalization WHERE hospital_id IS NOT NULL GROUP BY 1) GROUP BY 1")
def dis_06(spark: SparkSession, d: str) -> DataFrame:
    """The cells of a release as the ledger holds them after it is published."""
    import tempfile

    n = read(spark, d, "hospitalization").where("hospital_id is not null").groupBy("hospital_id").count().collect()  # one cell per site
    cells = [{"cell": r["hospital_id"], "status": "evaluable" if r["count"] >= 40 else "suppressed", "n": r["count"] if r["count"] >= 40 else None} for r in n]
    with tempfile.TemporaryDirectory() as folder:  # the driver's own ledger file
        ledger = disclosure.Ledger(f"{folder}/ledger")
        ledger.publish("r1", cells, lambda: None)
        held = [(e["cell"], e["status"]) for e in ledger.entries() if "cell" in e]
    return spark.createDataFrame(held, "site string, status string")


_SITE = {"columns": {"blood_flow_rate": {"unit": "L/h", "factor": 0.06, "range": [0.0, 20.0]}, "dialysate_flow_rate": {"unit": "L/h", "factor": 0.001}}}


@query("cfg_01_declared_units", "SELECT crrt_id, round(CASE WHEN CAST(blood_flow_rate AS DOUBLE) * 0.06 BETWEEN 0 AND 20 THEN CAST(blood_flow_rate AS DOUBLE) * 0.06 END, 9) AS blood_flow_rate, round(CAST(dialysate_flow_rate AS DOUBLE) * 0.001, 9) AS dialysate_flow_rate FROM crrt_therapy")
def cfg_01(spark: SparkSession, d: str) -> DataFrame:
    """Columns in the units a site declares, values out of range dropped."""
    factors, _ = config.unit_rules(_SITE)
    out = config.convert_columns(read(spark, d, "crrt_therapy").select("crrt_id", "blood_flow_rate", "dialysate_flow_rate"), factors)
    return out.select("crrt_id", F.round("blood_flow_rate", 9).alias("blood_flow_rate"), F.round("dialysate_flow_rate", 9).alias("dialysate_flow_rate"))


@query(
    "cfg_02_harmonised",
    "SELECT adt_id, location_category AS raw_location_category, CASE lower(trim(location_category)) WHEN 'icu' THEN 'intensive' WHEN 'intensive' THEN 'intensive' WHEN 'ward' THEN 'ward' WHEN 'ed' THEN 'emergency' WHEN 'emergency' THEN 'emergency' END AS location_category FROM adt",
)
def cfg_02(spark: SparkSession, d: str) -> DataFrame:
    """A coded column in common names; what is not declared becomes null."""
    return config.harmonised(read(spark, d, "adt").select("adt_id", "location_category"), "location_category", {"ICU": "intensive", "ed": "emergency"}, ["intensive", "ward", "emergency"])


@query("cfg_05_availability", "SELECT code_status_id, epoch_us(recorded_dttm + INTERVAL 30 MINUTE) AS at_us FROM code_status WHERE recorded_dttm IS NOT NULL")
def cfg_05(spark: SparkSession, d: str) -> DataFrame:
    """Rows with the time they were available by the declared clock."""
    t = config.available_tables({"code_status": read(spark, d, "code_status").select("code_status_id", "recorded_dttm")}, {"code_status": ("recorded_dttm", 30)})["code_status"]
    return t.select("code_status_id", F.unix_micros("recorded_dttm_at").alias("at_us"))


@query(
    "cfg_04_dry_run",
    """SELECT 'patient_assessments' AS source, COUNT(*) AS n FROM patient_assessments WHERE hospitalization_id IS NOT NULL AND recorded_dttm IS NOT NULL AND assessment_category IS NOT NULL AND (numerical_value IS NOT NULL OR categorical_value IS NOT NULL)
       UNION ALL SELECT 'labs', COUNT(*) FROM labs WHERE hospitalization_id IS NOT NULL AND lab_result_dttm IS NOT NULL AND lab_category IS NOT NULL AND lab_value_numeric IS NOT NULL
       UNION ALL SELECT 'crrt_therapy', CAST(sum(CASE WHEN blood_flow_rate IS NULL OR isnan(blood_flow_rate) THEN 0 ELSE 1 END + CASE WHEN dialysate_flow_rate IS NULL OR isnan(dialysate_flow_rate) THEN 0 ELSE 1 END + CASE WHEN ultrafiltration_out IS NULL OR isnan(ultrafiltration_out) THEN 0 ELSE 1 END) AS BIGINT) FROM crrt_therapy WHERE hospitalization_id IS NOT NULL AND recorded_dttm IS NOT NULL
       UNION ALL SELECT 'ecmo_mcs', CAST(sum(CASE WHEN flow IS NULL OR isnan(flow) THEN 0 ELSE 1 END + CASE WHEN sweep IS NULL OR isnan(sweep) THEN 0 ELSE 1 END + CASE WHEN fdo2 IS NULL OR isnan(fdo2) THEN 0 ELSE 1 END + CASE WHEN device_rate IS NULL OR isnan(device_rate) THEN 0 ELSE 1 END) AS BIGINT) FROM ecmo_mcs WHERE hospitalization_id IS NOT NULL AND recorded_dttm IS NOT NULL""",
)
def cfg_04(spark: SparkSession, d: str) -> DataFrame:
    """Events that each declared source would give; nothing is written."""
    from eventide.plans import stream

    return tables.read_events(spark, d, stream.SOURCES).groupBy("source").agg(F.count("*").alias("n"))


@query(
    "src_03_patient_keyed",
    """WITH s AS (SELECT hospitalization_id AS h, min(patient_id) AS p, min(admission_dttm) AS lo, max(discharge_dttm) AS hi FROM hospitalization WHERE hospitalization_id IS NOT NULL AND patient_id IS NOT NULL AND discharge_dttm IS NOT NULL GROUP BY 1),
       n AS (SELECT h, start_dttm AS t, code_status_category AS c, lo FROM code_status JOIN s ON p = patient_id WHERE start_dttm <= hi AND code_status_category IS NOT NULL),
       e AS (SELECT h, lo AS t, arg_max(c, (t, c)) AS c FROM n WHERE t <= lo GROUP BY 1, 2 UNION ALL SELECT h, t, c FROM n WHERE t > lo), l AS (SELECT *, lag(c) OVER (PARTITION BY h ORDER BY t, c) AS b FROM e)
       SELECT h AS hosp_id, epoch_us(t) AS at_us, c AS cat_value FROM l WHERE b IS NULL OR b <> c""",
)
def src_03_patient(spark: SparkSession, d: str) -> DataFrame:
    """States kept by patient as events of their stays: the one in force at admission, then the changes."""
    rows = read(spark, d, "hospitalization").where("hospitalization_id is not null and patient_id is not null and discharge_dttm is not null")
    stays = rows.groupBy(F.col("hospitalization_id").alias("hosp_id")).agg(F.min("patient_id").alias("patient_id"), F.min("admission_dttm").alias("lo"), F.max("discharge_dttm").alias("hi"))
    out = config.patient_events(read(spark, d, "code_status"), stays, at="start_dttm", value="code_status_category", concept="code_status")
    return out.select("hosp_id", F.unix_micros("dttm").alias("at_us"), "cat_value")


@query(
    "src_03_doses",
    """WITH r AS (SELECT crrt_id, hospitalization_id AS h, recorded_dttm AS t, CAST(dialysate_flow_rate AS DOUBLE) AS v, CASE WHEN crrt_id % 3 = 0 THEN 'ml/hr' WHEN crrt_id % 3 = 1 THEN 'l/day' ELSE 'ml/kg/hr' END AS u FROM crrt_therapy WHERE hospitalization_id IS NOT NULL AND recorded_dttm IS NOT NULL AND dialysate_flow_rate IS NOT NULL AND NOT isnan(dialysate_flow_rate))
       SELECT h AS hosp_id, epoch_us(t) AS at_us, round(CASE u WHEN 'ml/hr' THEN v WHEN 'l/day' THEN v * 1000 / 24 END, 6) AS value FROM r WHERE u <> 'ml/kg/hr'""",
)
def src_03_doses(spark: SparkSession, d: str) -> DataFrame:
    """Doses of several units as events in one; those per weight are left out where no weight is known."""
    unit = F.when(F.col("crrt_id") % 3 == 0, "ml/hr").when(F.col("crrt_id") % 3 == 1, "l/day").otherwise("ml/kg/hr")
    rows = read(spark, d, "crrt_therapy").where("dialysate_flow_rate is not null and not isnan(dialysate_flow_rate)").withColumn("u", unit).withColumn("name", F.lit("Dialysate"))
    targets = spark.createDataFrame([("dialysate", "ml/hr")], "name string, unit string")
    weights = spark.createDataFrame([], "hospitalization_id string, at timestamp, weight double")
    events, _ = config.dose_events(rows, targets, weights, key="hospitalization_id", at="recorded_dttm", name="name", dose="dialysate_flow_rate", unit="u")
    return events.select("hosp_id", F.unix_micros("dttm").alias("at_us"), F.round("value", 6).alias("value"))


@query("src_13_cached", "SELECT lab_category, COUNT(*) AS n FROM labs GROUP BY 1")
def src_13(spark: SparkSession, d: str) -> DataFrame:
    """Counts written once under the hash of what they were made of, and read from there."""
    folder, rows = scratch(spark), read(spark, d, "labs").groupBy("lab_category").agg(F.count("*").alias("n"))
    config.cached(rows, folder, {"table": "labs", "of": d})
    return config.cached(rows.where(F.lit(False)), folder, {"table": "labs", "of": d})  # found, so not built again


@query("snk_05_run_outputs", "SELECT l_returnflag AS cell, l_orderkey AS pair, l_discount AS prob FROM lineitem")
def snk_05(spark: SparkSession, d: str) -> DataFrame:
    """Scores of a run written beside their record and read back."""
    folder = scratch(spark)
    config.write_run(read(spark, d, "lineitem").select(F.col("l_returnflag").alias("cell"), F.col("l_orderkey").alias("pair"), F.col("l_discount").alias("prob")), folder, {"run": "a", "seed": 1})
    rows, record = config.read_run(spark, folder)
    if record["seed"] != 1:
        raise ValueError("record was lost")
    return rows


@query(
    "bin_10_csv_segments",
    "SELECT lab_id, CAST(CASE WHEN lab_category = 'sodium' THEN CASE WHEN v < 130 THEN 0 WHEN v <= 135 THEN 1 WHEN v < 150 THEN 2 ELSE 3 END ELSE CASE WHEN v < 3.5 THEN 0 ELSE 1 END END AS INTEGER) AS bin FROM (SELECT lab_id, lab_category, lab_value_numeric AS v FROM labs WHERE lab_category IN ('sodium', 'potassium') AND lab_value_numeric IS NOT NULL AND NOT isnan(lab_value_numeric))",
)
def bin_10(spark: SparkSession, d: str) -> DataFrame:
    """Declared rows under their file's names, with a threshold forced in."""
    rows = spark.createDataFrame([("Na", None, 130.0, False, False), ("Na", 130.0, 150.0, True, False), ("Na", 150.0, None, True, False), ("potassium", None, 3.5, False, False), ("potassium", 3.5, None, True, False)], "concept string, lo double, hi double, lo_closed boolean, hi_closed boolean")
    s = config.csv_segments(rows, None, {"Na": "sodium"}, {"sodium": [135.0]}, {"sodium": True}).withColumnRenamed("concept", "lab_category")
    labs = read(spark, d, "labs").select("lab_id", "lab_category", "lab_value_numeric").where(N.finite(F.col("lab_value_numeric")))
    return labs.join(s, "lab_category").select("lab_id", bins.bin_index(F.col("lab_value_numeric"), F.col("segments")).alias("bin"))


@query("rpt_05_run_matrix", "SELECT a || '-' || b AS run, CAST(n AS INTEGER) AS bins, soft FROM (VALUES ('q5', 5), ('q10', 10), ('q20', 20)) AS x(a, n), (VALUES ('hard', false), ('soft', true)) AS y(b, soft) WHERE NOT (n = 20 AND soft)")
def rpt_05(spark: SparkSession, d: str) -> DataFrame:
    """Every combination of the settings of an experiment but the skipped one."""
    rows = config.expand_matrix({"bins": [{"name": f"q{n}", "bins": n} for n in (5, 10, 20)], "soft": [{"name": "hard", "soft": False}, {"name": "soft", "soft": True}]}, skip=[{"bins": 20, "soft": True}])
    return spark.createDataFrame([(r["run"], r["bins"], r["soft"]) for r in rows], "run string, bins int, soft boolean")


_EDGES = "r AS (SELECT lab_category AS c, lab_value_numeric AS x, row_number() OVER (PARTITION BY lab_category ORDER BY lab_value_numeric) - 1 AS i, COUNT(*) OVER (PARTITION BY lab_category) AS n FROM labs WHERE lab_value_numeric IS NOT NULL AND NOT isnan(lab_value_numeric))"


@query(
    "rpt_04_edge_distances",
    f"""WITH {_EDGES}, e AS (SELECT DISTINCT b AS arm, c, x FROM r, (SELECT unnest([5, 10]) AS b), (SELECT unnest(range(1, 10)) AS k) WHERE k < b AND i = floor((n - 1) * k / CAST(b AS DOUBLE) + 0.5)), t AS (SELECT * FROM (VALUES ('sodium', 130.0), ('lactate', 4.0)) AS v(concept, threshold))
        SELECT arm, concept, threshold, x AS edge, round(abs(x - threshold), 9) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY arm, concept ORDER BY abs(x - threshold), x) AS k FROM t JOIN e ON c = concept) WHERE k = 1""",
)
def rpt_04(spark: SparkSession, d: str) -> DataFrame:
    """How far the nearest edge of every arm is from each threshold."""
    labs = read(spark, d, "labs").select(F.col("lab_category").alias("concept"), F.col("lab_value_numeric").alias("x"))
    t = spark.createDataFrame([("sodium", 130.0), ("lactate", 4.0)], "concept string, threshold double")
    arms = [bins.edge_distance(t, bins.quantile_edges(labs, "concept", "x", n)).withColumn("arm", F.lit(n)) for n in (5, 10)]
    return arms[0].unionByName(arms[1]).select("arm", "concept", "threshold", "edge", F.round("distance", 9).alias("distance"))


_ENDS = "(SELECT hospitalization_id AS h, max(epoch_us(discharge_dttm)) // 60000000 AS e FROM hospitalization WHERE hospitalization_id IS NOT NULL AND discharge_dttm IS NOT NULL GROUP BY 1)"


@query(
    "lab_03_stream_statuses",
    f"""WITH r AS (SELECT h, m AS minute, max(CASE WHEN v > 2 THEN 1 ELSE 0 END) AS hit FROM {_MIN} GROUP BY 1, 2), a AS (SELECT DISTINCT h, m + 600 AS anchor_min FROM {_MIN}),
        p AS (SELECT a.h, anchor_min, any_value(e) AS e, max_by(hit, minute) FILTER (minute <= anchor_min) AS now, min(minute) FILTER (minute > anchor_min AND minute <= least(anchor_min + 10080, e) AND hit = 1) AS nx, COUNT(*) FILTER (minute > anchor_min AND minute <= least(anchor_min + 10080, e)) AS later FROM a JOIN {_ENDS} d ON d.h = a.h JOIN r ON r.h = a.h GROUP BY 1, 2)
        SELECT h, anchor_min, CASE WHEN e <= anchor_min THEN 'ended' WHEN now = 1 THEN 'prevalent' WHEN nx IS NOT NULL THEN 'positive' WHEN later = 0 THEN 'not_ascertainable' WHEN e < anchor_min + 10080 THEN 'censored' ELSE 'negative' END AS status FROM p""",
)
def lab_03_statuses(spark: SparkSession, d: str) -> DataFrame:
    """Labels of an anchor after every reading, up to the end of the stay."""
    rows = _creatinine(spark, d)
    ends = read(spark, d, "hospitalization").where("hospitalization_id is not null and discharge_dttm is not null").groupBy(F.col("hospitalization_id").alias("h")).agg(F.expr("max(unix_micros(discharge_dttm)) div 60000000").alias("end_min"))
    return labels.stream_labels(rows.select("h", (F.col("m") + 600).alias("anchor_min")), rows.select("h", F.col("m").alias("minute"), "v"), ends, "h", F.col("v") > 2, horizon_min=10080).select("h", "anchor_min", "status")


@query(
    "lab_06_eligible_targets",
    """WITH e AS (SELECT event_id, user_id, epoch_us(ts) AS t, event_type, value, event_type <> 'view' AS ok FROM events), s AS (SELECT event_type AS c, quantile_cont(value, 0.5) AS m, (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) / 1.349 AS q FROM events GROUP BY 1),
       n AS (SELECT a.event_id, min_by(b.event_id, (b.t, b.event_id)) AS nx FROM e a JOIN e b ON b.user_id = a.user_id AND (b.t, b.event_id) > (a.t, a.event_id) AND b.ok GROUP BY 1)
       SELECT e.event_id, x.event_type AS target, (x.t - e.t) // 60000000 AS delta_min, round((x.value - m) / q, 6) AS z, x.event_id IS NOT NULL AS mask FROM e LEFT JOIN n USING (event_id) LEFT JOIN e x ON x.event_id = nx LEFT JOIN s ON c = x.event_type""",
)
def lab_06_targets(spark: SparkSession, d: str) -> DataFrame:
    """The next eligible event of every event: its type, the minutes to it, its normalised value, and whether there is one."""
    rows = read(spark, d, "events").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), "event_type", "value")
    ahead = nearest(rows, ["user_id"], "t", "event_id", later={"x": F.when(F.col("event_type") != "view", F.struct("t", "event_type", "value"))}, width=7 * 86_400_000_000)
    stats = bins.robust_stats(rows, "event_type", "value").select(F.col("event_type").alias("target"), "center", "spread")
    out = ahead.select("event_id", F.col("x.event_type").alias("target"), F.expr("(x.t - t) div 60000000").alias("delta_min"), F.col("x.value").alias("v"), F.col("x").isNotNull().alias("mask"))
    return out.join(stats, "target", "left").select("event_id", "target", "delta_min", F.round((F.col("v") - F.col("center")) / F.col("spread"), 6).alias("z"), "mask")


_FLAGS = {"lactate": ("lactate", ">", 4.0), "sodium_low": ("sodium", "<", 130.0), "sodium_high": ("sodium", ">", 150.0), "potassium": ("potassium", ">", 5.5), "creatinine": ("creatinine", ">", 2.0), "glucose": ("glucose_serum", ">", 250.0), "hemoglobin": ("hemoglobin", "<", 7.0), "bilirubin": ("bilirubin_total", ">", 4.0)}


@query(
    "lab_11_task_states",
    "WITH s AS (SELECT hospitalization_id AS h, min(admission_dttm) + INTERVAL 24 HOUR AS a, max(discharge_dttm) AS e FROM hospitalization WHERE hospitalization_id IS NOT NULL AND discharge_dttm IS NOT NULL GROUP BY 1), l AS (SELECT h, a, e, lab_result_dttm AS t, lab_category AS c, lab_value_numeric AS v FROM s LEFT JOIN labs ON hospitalization_id = h AND lab_result_dttm IS NOT NULL AND lab_value_numeric IS NOT NULL AND NOT isnan(lab_value_numeric)), g AS (SELECT h, "
    + ", ".join(f"coalesce(bool_or(t <= a AND c = '{c}' AND v {op} {x}), false) AS p_{n}, coalesce(bool_or(t > a AND t <= e AND c = '{c}' AND v {op} {x}), false) AS q_{n}, coalesce(bool_or(t > a AND t <= e AND c = '{c}'), false) AS s_{n}" for n, (c, op, x) in _FLAGS.items())
    + ", bool_or(e <= a) AS gone FROM l GROUP BY 1) SELECT h, "
    + ", ".join(f"CASE WHEN gone THEN 'not_at_risk' WHEN p_{n} THEN 'prevalent' WHEN q_{n} THEN 'positive' WHEN s_{n} THEN 'negative' ELSE 'not_ascertainable' END AS {n}" for n in _FLAGS) + " FROM g",
)
def lab_11_states(spark: SparkSession, d: str) -> DataFrame:
    """States of eight threshold tasks at the first day's end, in one pass over the readings."""
    stays = read(spark, d, "hospitalization").where("hospitalization_id is not null and discharge_dttm is not null").groupBy(F.col("hospitalization_id").alias("h")).agg(tables.with_lag(F.min("admission_dttm"), 1440).alias("anchor"), F.max("discharge_dttm").alias("end"))
    obs = read(spark, d, "labs").where("lab_result_dttm is not null").where(N.finite(F.col("lab_value_numeric"))).select(F.col("hospitalization_id").alias("h"), F.col("lab_result_dttm").alias("at"), F.col("lab_category").alias("concept"), F.col("lab_value_numeric").alias("value"))
    return labels.task_states(stays, obs, "h", {n: [(c, op, x)] for n, (c, op, x) in _FLAGS.items()})
