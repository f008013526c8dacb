"""Windows, bins, encoded sequences, labels, splits and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eventide.catalog.registry import query
from eventide.catalog.segments import CATEGORY, NAMED
from eventide.functions import numbers as N
from eventide.functions import text as T
from eventide.operators import bins, encode, intervals, labels, windows
from eventide.plans import stream
from eventide.runtime import read
from eventide.sources import tables
from eventide.streaming import live

_ORDERED = "(SELECT o_custkey, o_orderkey, o_orderdate, o_orderstatus, o_totalprice FROM orders)"


@query(
    "agg_01_coalesce_intervals",
    """WITH r AS (SELECT DISTINCT patient_id AS k, epoch_us(admission_dttm) AS a, epoch_us(discharge_dttm) AS b FROM hospitalization WHERE patient_id IS NOT NULL AND admission_dttm < discharge_dttm),
       f AS (SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY k ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS n FROM r),
       g AS (SELECT *, sum(n) OVER (PARTITION BY k ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS i FROM f),
       p AS (SELECT k, i, min(a) AS a, max(b) AS b FROM g GROUP BY 1, 2), q AS (SELECT *, lag(b) OVER (PARTITION BY k ORDER BY a) AS e FROM p)
       SELECT k AS patient_id, 'period' AS kind, a AS start_us, b AS end_us FROM p UNION ALL SELECT k, 'gap', e, a FROM q WHERE e IS NOT NULL""",
)
def agg_01(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "hospitalization").select("patient_id", F.unix_micros("admission_dttm").alias("a"), F.unix_micros("discharge_dttm").alias("b"))
    return intervals.periods_and_gaps(rows, "patient_id", "a", "b")


@query("win_01_lag", "SELECT o_orderkey, lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS previous FROM orders")
def win_01(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "orders").select("o_orderkey", F.lag("o_totalprice").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).alias("previous"))


@query("win_02_latest_rows", "SELECT o_custkey, o_orderkey FROM orders QUALIFY o_orderdate = max(o_orderdate) OVER (PARTITION BY o_custkey)")
def win_02(spark: SparkSession, d: str) -> DataFrame:
    return windows.latest_rows(read(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], "o_orderdate").select("o_custkey", "o_orderkey")


@query(
    "win_03_running",
    "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 4) AS running, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM events",
)
def win_03(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return read(spark, d, "events").select(
        "event_id", F.round(F.sum("value").over(w.rowsBetween(Window.unboundedPreceding, 0)), 4).alias("running"), F.max("value").over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("before")
    )


_RUNS = """o AS (SELECT o_custkey AS k, epoch_us(o_orderdate) AS t, o_orderkey AS i, o_orderstatus AS s, lag(o_orderstatus) OVER w AS p FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
       n AS (SELECT *, sum(CASE WHEN p IS DISTINCT FROM s THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY t, i ROWS UNBOUNDED PRECEDING) AS run FROM o),
       r AS (SELECT k, run, any_value(s) AS s, COUNT(*) AS n, min(t) AS a, max(t) AS b FROM n GROUP BY 1, 2)"""


def _runs(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", F.col("o_orderdate").cast("timestamp").alias("at"))
    return windows.runs(rows, ["o_custkey"], ["at", "o_orderkey"], "o_orderstatus", "at")


@query("win_04_runs", f"WITH {_RUNS} SELECT k AS o_custkey, CAST(run AS BIGINT) AS run, s AS state, n, a AS first_us, lead(a) OVER (PARTITION BY k ORDER BY run) AS next_us FROM r")
def win_04(spark: SparkSession, d: str) -> DataFrame:
    return _runs(spark, d).select("o_custkey", "run", F.col("o_orderstatus").alias("state"), "n", F.unix_micros("first_at").alias("first_us"), F.unix_micros("next_at").alias("next_us"))


@query(
    "win_04_episodes",
    f"""WITH {_RUNS}, f AS (SELECT *, CASE WHEN a - max(b) OVER (PARTITION BY k ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 30 * 24 * 3600000000 THEN 0 ELSE 1 END AS x FROM r WHERE s = 'F'),
        g AS (SELECT *, sum(x) OVER (PARTITION BY k ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS e FROM f)
        SELECT k AS o_custkey, CAST(e AS BIGINT) AS episode, COUNT(*) AS n_runs, min(a) AS start_us, max(b) AS end_us FROM g GROUP BY 1, 2""",
)
def win_04_episodes(spark: SparkSession, d: str) -> DataFrame:
    e = windows.stitch(_runs(spark, d).where("o_orderstatus = 'F'"), ["o_custkey"], 30 * 24)
    return e.select("o_custkey", "episode", "n_runs", F.unix_micros("start_at").alias("start_us"), F.unix_micros("end_at").alias("end_us"))


@query(
    "win_05_after_first",
    "SELECT o_orderkey, sum(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) > 0 AS after FROM orders",
)
def win_05(spark: SparkSession, d: str) -> DataFrame:
    return windows.after_first(read(spark, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], F.col("o_orderstatus") == "P").select("o_orderkey", "after")


_MIN = "(SELECT lab_id, hospitalization_id AS h, epoch_us(lab_result_dttm) // 60000000 AS m, lab_value_numeric AS v FROM labs WHERE lab_category = 'creatinine' AND reference_unit = 'mg/dL' AND hospitalization_id IS NOT NULL AND lab_result_dttm IS NOT NULL AND lab_value_numeric IS NOT NULL AND NOT isnan(lab_value_numeric))"


def _creatinine(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "labs").where("lab_category = 'creatinine' and reference_unit = 'mg/dL' and hospitalization_id is not null and lab_result_dttm is not null").where(N.finite(F.col("lab_value_numeric")))
    return rows.select("lab_id", F.col("hospitalization_id").alias("h"), F.expr("unix_micros(lab_result_dttm) div 60000000").alias("m"), F.col("lab_value_numeric").alias("v"))


@query(
    "win_06_trailing_rise",
    f"""SELECT lab_id, coalesce(v - min(v) OVER (PARTITION BY h ORDER BY m RANGE BETWEEN 2880 PRECEDING AND 1 PRECEDING) >= 0.3 - 1e-9, false) OR coalesce(v >= min(v) OVER (PARTITION BY h ORDER BY m RANGE BETWEEN 10080 PRECEDING AND 1 PRECEDING) * 1.5 - 1e-9, false) AS risen FROM {_MIN}""",
)
def win_06(spark: SparkSession, d: str) -> DataFrame:
    return windows.trailing_rise(_creatinine(spark, d), ["h"], "m", "v", absolute=0.3, absolute_minutes=2880, relative=1.5, relative_minutes=10080).select("lab_id", "risen")


@query(
    "win_07_sustained",
    f"""WITH b AS (SELECT h, m, bool_or(v > 1.5) AS x FROM {_MIN} GROUP BY 1, 2), k AS (SELECT *, sum(CASE WHEN x THEN 0 ELSE 1 END) OVER (PARTITION BY h ORDER BY m ROWS UNBOUNDED PRECEDING) AS g FROM b),
        s AS (SELECT h, m, lag(m, 2) OVER (PARTITION BY h, g ORDER BY m) AS st FROM k WHERE x) SELECT h, min(m) AS completed_min FROM s WHERE m - st <= 4320 GROUP BY 1""",
)
def win_07(spark: SparkSession, d: str) -> DataFrame:
    rows = _creatinine(spark, d).groupBy("h", "m").agg(F.bool_or(F.col("v") > 1.5).alias("x"))
    return windows.sustained(rows, ["h"], "m", F.col("x"), readings=3, within=4320)


@query("win_08_next_hit", f"SELECT lab_id, (SELECT min(m) FROM {_MIN} f WHERE f.h = a.h AND f.m > a.m AND f.v > 3) AS next_hit_min FROM {_MIN} a")
def win_08(spark: SparkSession, d: str) -> DataFrame:
    return windows.future_first(_creatinine(spark, d), ["h"], "m", F.col("v") > 3).select("lab_id", "next_hit_min")


@query(
    "win_10_moving_count",
    """WITH p AS (SELECT user_id AS k, event_type AS x, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events), c AS (SELECT k, COUNT(*) OVER (PARTITION BY k, x ORDER BY i RANGE BETWEEN 7 PRECEDING AND CURRENT ROW) AS n FROM p) SELECT k AS user_id, max(n) AS most_in_window FROM c GROUP BY 1""",
)
def win_10(spark: SparkSession, d: str) -> DataFrame:
    return windows.moving_count(read(spark, d, "events").select("user_id", "ts", "event_id", "event_type"), ["user_id"], ["ts", "event_id"], "event_type", 8)


@query("srt_01_total_order", "SELECT assessment_id, row_number() OVER (PARTITION BY hospitalization_id ORDER BY recorded_dttm ASC NULLS LAST, assessment_category ASC NULLS LAST, numerical_value ASC NULLS LAST, assessment_id) AS place FROM patient_assessments")
def srt_01(spark: SparkSession, d: str) -> DataFrame:
    order = encode.total_order("recorded_dttm", "assessment_category", "numerical_value", "assessment_id")
    return read(spark, d, "patient_assessments").select("assessment_id", F.row_number().over(Window.partitionBy("hospitalization_id").orderBy(order)).cast("bigint").alias("place"))


@query("srt_02_tie_order", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'P' THEN 1 ELSE 2 END, o_orderkey) AS place FROM orders")
def srt_02(spark: SparkSession, d: str) -> DataFrame:
    rank = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "P", 1).otherwise(2)
    return read(spark, d, "orders").select("o_orderkey", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", rank, "o_orderkey")).cast("bigint").alias("place"))


_EDGES = [10.0, 20.0, 40.0]
_SEGMENTS = "array(" + ", ".join(
    f"named_struct('lo', {lo}, 'hi', {hi}, 'lo_closed', {lc}, 'hi_closed', {hc})"
    for lo, hi, lc, hc in [("0D", "0D", "true", "true"), ("0D", "10D", "false", "false"), ("10D", "20D", "true", "false"), ("25D", "40D", "true", "true")]
) + ")"
_BIN_SQL = """CASE WHEN {v} IS NULL OR isnan({v}) OR isinf({v}) THEN NULL WHEN {v} = 0 THEN 0 WHEN {v} > 0 AND {v} < 10 THEN 1 WHEN {v} >= 10 AND {v} < 20 THEN 2 WHEN {v} >= 25 AND {v} <= 40 THEN 3
    WHEN {v} <= 0 THEN 0 WHEN {v} >= 40 THEN 3 WHEN {v} - 20 <= 25 - {v} THEN 2 ELSE 3 END"""


@query("bin_01_index", f"SELECT lab_id, CAST({_BIN_SQL.format(v='lab_value_numeric')} AS INTEGER) AS bin FROM labs")
def bin_01(spark: SparkSession, d: str) -> DataFrame:
    """A point bin, open and closed ends, a gap between 20 and 25, and clamped ends."""
    return read(spark, d, "labs").select("lab_id", bins.bin_index(F.col("lab_value_numeric"), F.expr(_SEGMENTS)).alias("bin"))


@query("agg_15_placement", "SELECT CASE WHEN lab_value_numeric IS NULL OR isnan(lab_value_numeric) THEN NULL WHEN lab_value_numeric BETWEEN 0 AND 20 AND lab_value_numeric < 20 OR lab_value_numeric BETWEEN 25 AND 40 THEN 'inside' WHEN lab_value_numeric <= 0 THEN 'low' WHEN lab_value_numeric >= 40 THEN 'high' ELSE 'gap' END AS placement, COUNT(*) AS n FROM labs GROUP BY 1")
def agg_15(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "labs").groupBy(bins.placement(F.col("lab_value_numeric"), F.expr(_SEGMENTS)).alias("placement")).agg(F.count("*").alias("n"))


_RANKED = "v AS (SELECT lab_category AS c, lab_value_numeric AS x FROM labs WHERE lab_value_numeric IS NOT NULL AND NOT isnan(lab_value_numeric)), r AS (SELECT c, x, row_number() OVER (PARTITION BY c ORDER BY x) - 1 AS i, COUNT(*) OVER (PARTITION BY c) AS n FROM v)"


@query(
    "agg_10_quantile_edges",
    f"WITH {_RANKED}, e AS (SELECT DISTINCT c, x FROM r, (SELECT unnest(range(1, 10)) AS k) WHERE i = floor((n - 1) * k / 10.0 + 0.5)) SELECT c AS lab_category, x AS edge FROM e",
)
def agg_10(spark: SparkSession, d: str) -> DataFrame:
    edges = bins.quantile_edges(read(spark, d, "labs").select("lab_category", F.col("lab_value_numeric").alias("x")), "lab_category", "x", 10)
    return edges.select("lab_category", F.explode("edges").alias("edge"))


@query(
    "bin_03_binned_by_edges",
    f"""WITH {_RANKED}, e AS (SELECT DISTINCT c, x FROM r, (SELECT unnest(range(1, 5)) AS k) WHERE i = floor((n - 1) * k / 5.0 + 0.5))
        SELECT lab_id, CAST((SELECT COUNT(*) FROM e WHERE e.c = l.lab_category AND e.x <= l.lab_value_numeric) AS INTEGER) AS bin FROM labs l WHERE lab_value_numeric IS NOT NULL AND NOT isnan(lab_value_numeric)""",
)
def bin_03(spark: SparkSession, d: str) -> DataFrame:
    labs = read(spark, d, "labs").select("lab_id", "lab_category", F.col("lab_value_numeric").alias("x")).where(N.finite(F.col("x")))
    segments = bins.quantile_edges(labs, "lab_category", "x", 5).select("lab_category", bins.segments_from_edges(F.col("edges")).alias("s"))
    return labs.join(segments, "lab_category").select("lab_id", bins.bin_index(F.col("x"), F.col("s")).alias("bin"))


_TOKENS = f"""a AS (SELECT h, tm, i, x IS NULL OR isnan(x) AS held, CASE WHEN x IS NULL OR isnan(x) THEN {NAMED} ELSE c || '=' || CAST(CAST(x AS INTEGER) AS VARCHAR) END AS token FROM {CATEGORY} WHERE h IS NOT NULL AND tm IS NOT NULL),
       t AS (SELECT * FROM a WHERE token IS NOT NULL)"""
_VOCAB = "v AS (SELECT token, row_number() OVER (ORDER BY token) + 3 AS id FROM (SELECT token FROM t GROUP BY 1 HAVING COUNT(DISTINCT h) >= 3 OR NOT bool_and(held)))"


def _tokens(spark: SparkSession, d: str) -> DataFrame:
    """One token per assessment of a stay: its whole number, else its category; ``held``: only kept if seen in several stays."""
    rows = read(spark, d, "patient_assessments").where("hospitalization_id is not null and recorded_dttm is not null")
    number = F.coalesce(N.finite(F.col("numerical_value")), F.lit(False))
    token = F.when(number, F.concat("assessment_category", F.lit("="), F.round("numerical_value").cast("int").cast("string"))).otherwise(T.categorical_token(F.col("assessment_category"), F.col("categorical_value")))
    return rows.select(F.col("hospitalization_id").alias("h"), F.col("recorded_dttm").alias("at"), F.col("assessment_id").alias("i"), (~number).alias("held"), token.alias("token")).where("token is not null")


def _vocab(tokens: DataFrame) -> DataFrame:
    return encode.vocabulary(tokens, "token", "h", 3, F.col("held"))


def _sequences(spark: SparkSession, d: str) -> DataFrame:
    t = _tokens(spark, d).withColumn("at_min", F.expr("unix_micros(at) div 60000000"))
    return encode.encode(t, _vocab(t), "h", ["at", "i"], ["at_min"])


@query(
    "enc_01_encode",
    f"WITH {_TOKENS}, {_VOCAB} SELECT h, string_agg(CAST(coalesce(v.id, 3) AS VARCHAR), ',' ORDER BY tm, i) AS ids, string_agg(CAST(epoch_us(tm) // 60000000 AS VARCHAR), ',' ORDER BY tm, i) AS mins, COUNT(*) AS n_events FROM t LEFT JOIN v ON v.token = t.token GROUP BY 1",
)
def enc_01(spark: SparkSession, d: str) -> DataFrame:
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return _sequences(spark, d).select("h", text("token").alias("ids"), text("at_min").alias("mins"), "n_events")


@query(
    "enc_02_framed_windows",
    f"""WITH {_TOKENS}, {_VOCAB}, s AS (SELECT h, list_concat(list_concat([1], list(coalesce(v.id, 3) ORDER BY tm, i)), [2]) AS a FROM t LEFT JOIN v ON v.token = t.token GROUP BY 1),
        w AS (SELECT h, a, unnest(range(0, len(a), 8)) AS st FROM s)
        SELECT h, CAST(st // 8 AS INTEGER) AS continuation_index, CAST(st AS INTEGER) AS source_start, CAST(least(st + 8, len(a)) AS INTEGER) AS source_end, CAST(ceil(len(a) / 8.0) AS INTEGER) AS n_windows, st > 0 AS continues_from_previous, st + 8 < len(a) AS continues_to_next, array_to_string(a[st + 1 : st + 8], ',') AS ids FROM w""",
)
def enc_02(spark: SparkSession, d: str) -> DataFrame:
    t = _tokens(spark, d)
    w = encode.encode_windows(t, _vocab(t), "h", ["at", "i"], [], 8, framed=True)
    return w.withColumn("ids", F.array_join(F.transform("token", lambda x: x.cast("string")), ",")).drop("token")


@query("enc_03_stitched", f"WITH {_TOKENS}, {_VOCAB} SELECT h, string_agg(CAST(coalesce(v.id, 3) AS VARCHAR), ',' ORDER BY tm, i) AS ids FROM t LEFT JOIN v ON v.token = t.token GROUP BY 1")
def enc_03(spark: SparkSession, d: str) -> DataFrame:
    w = encode.windows(_sequences(spark, d).select("h", "token"), ["token"], 5)
    return encode.stitch(w, "h", ["token"]).select("h", F.array_join(F.transform("token", lambda x: x.cast("string")), ",").alias("ids"))


@query(
    "lab_12_prefix_at_hour",
    f"WITH {_TOKENS}, {_VOCAB}, f AS (SELECT h, min(tm) AS a FROM t GROUP BY 1) SELECT h, string_agg(CAST(coalesce(v.id, 3) AS VARCHAR), ',' ORDER BY tm, i) AS ids FROM t JOIN f USING (h) LEFT JOIN v ON v.token = t.token WHERE epoch_us(tm) // 60000000 <= epoch_us(a) // 60000000 + 1440 GROUP BY 1",
)
def lab_12(spark: SparkSession, d: str) -> DataFrame:
    cut = encode.cut_at(_sequences(spark, d), ["token"], "at_min", F.array_min("at_min") + 1440)
    return cut.select("h", F.array_join(F.transform("token", lambda x: x.cast("string")), ",").alias("ids"))


@query(
    "agg_19_successors",
    f"WITH {_TOKENS}, n AS (SELECT token, lead(token) OVER (PARTITION BY h ORDER BY tm, i) AS nx FROM t) SELECT token, string_agg(DISTINCT nx, ',' ORDER BY nx) AS successors, COUNT(nx) AS n FROM n WHERE nx IS NOT NULL GROUP BY 1",
)
def agg_19(spark: SparkSession, d: str) -> DataFrame:
    return encode.next_tokens(_tokens(spark, d), "h", ["at", "i"], "token").select("token", F.array_join("successors", ",").alias("successors"), "n")


@query(
    "lab_06_next_delta",
    "SELECT event_id, lead(event_type) OVER w AS next_type, (epoch_us(lead(ts) OVER w) - epoch_us(ts)) // 60000000 AS delta_min FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)",
)
def lab_06(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    return read(spark, d, "events").select("event_id", F.lead("event_type").over(w).alias("next_type"), ((F.lead(micros).over(w) - micros) / 60_000_000).cast("bigint").alias("delta_min"))


_OUTCOME = """s AS (SELECT hospitalization_id AS h, min(admission_dttm) + INTERVAL 24 HOUR AS a, max(discharge_dttm) AS e FROM hospitalization WHERE hospitalization_id IS NOT NULL AND discharge_dttm IS NOT NULL GROUP BY 1),
       o AS (SELECT hospitalization_id AS h, lab_result_dttm AS t, lab_value_numeric AS v, lab_id AS i FROM labs WHERE lab_category = 'potassium' AND lab_value_numeric IS NOT NULL AND NOT isnan(lab_value_numeric) AND lab_result_dttm IS NOT NULL),
       g AS (SELECT s.h, arg_max(CASE WHEN t <= a AND t >= a - INTERVAL 24 HOUR THEN v END, CASE WHEN t <= a AND t >= a - INTERVAL 24 HOUR THEN (t, i) END) AS lastv, min(CASE WHEN t > a AND t <= e AND v > 5 THEN t END) AS hit, COUNT(CASE WHEN t > a AND t <= e THEN 1 END) AS n FROM s LEFT JOIN o ON o.h = s.h GROUP BY 1)"""


@query(
    "lab_01_incident_outcome",
    f"""WITH {_OUTCOME} SELECT s.h, CASE WHEN e <= a THEN 'censored' WHEN lastv > 5 THEN 'prevalent' WHEN hit IS NOT NULL THEN 'positive' WHEN n < 1 THEN 'not_ascertainable' ELSE 'negative' END AS status,
        CASE WHEN e > a AND NOT coalesce(lastv > 5, false) AND hit IS NOT NULL THEN (epoch_us(hit) - epoch_us(a)) // 60000000 END AS after_min FROM s JOIN g USING (h)""",
)
def lab_01(spark: SparkSession, d: str) -> DataFrame:
    stays = (
        read(spark, d, "hospitalization").where("hospitalization_id is not null and discharge_dttm is not null")
        .groupBy(F.col("hospitalization_id").alias("h")).agg(tables.with_lag(F.min("admission_dttm"), 1440).alias("a"), F.max("discharge_dttm").alias("e"))
    )
    obs = read(spark, d, "labs").where("lab_category = 'potassium' and lab_result_dttm is not null").where(N.finite(F.col("lab_value_numeric")))
    obs = obs.select(F.col("hospitalization_id").alias("h"), F.col("lab_result_dttm").alias("t"), F.col("lab_value_numeric").alias("v"), F.col("lab_id").alias("i"))
    return labels.incident(stays, obs, "h", anchor="a", end="e", at="t", value="v", tie="i", beyond=lambda v: v > 5, lookback_hours=24, min_readings=1)


@query(
    "lab_05_competing",
    """WITH c AS (SELECT o_custkey AS k, min(CASE WHEN o_orderstatus = 'F' THEN epoch_us(o_orderdate) END) AS f, min(CASE WHEN o_orderstatus = 'P' THEN epoch_us(o_orderdate) END) AS p, max(epoch_us(o_orderdate)) AS l FROM orders GROUP BY 1)
       SELECT k AS o_custkey, CASE WHEN f IS NOT NULL AND (p IS NULL OR f <= p) THEN 1 WHEN p IS NOT NULL THEN 2 ELSE 0 END AS cause, least(coalesce(f, l), coalesce(p, l), l) AS at_us FROM c""",
)
def lab_05(spark: SparkSession, d: str) -> DataFrame:
    at = F.unix_micros(F.col("o_orderdate").cast("timestamp"))
    rows = read(spark, d, "orders").groupBy("o_custkey").agg(F.min(F.when(F.col("o_orderstatus") == "F", at)).alias("f"), F.min(F.when(F.col("o_orderstatus") == "P", at)).alias("p"), F.max(at).alias("l"))
    return labels.first_cause(rows, ["f", "p"], "l").select("o_custkey", "cause", F.col("at").alias("at_us"))


@query(
    "lab_11_task_flags",
    """WITH s AS (SELECT hospitalization_id AS h, min(admission_dttm) + INTERVAL 24 HOUR AS a FROM hospitalization WHERE hospitalization_id IS NOT NULL GROUP BY 1)
       SELECT h, bool_or(lab_result_dttm <= a AND lab_category = 'lactate' AND lab_value_numeric > 4) AS lactate_before, bool_or(lab_result_dttm > a AND lab_category = 'lactate' AND lab_value_numeric > 4) AS lactate_after, bool_or(lab_result_dttm > a AND lab_category = 'sodium' AND lab_value_numeric < 130) AS sodium_after
       FROM s JOIN labs ON hospitalization_id = h WHERE lab_result_dttm IS NOT NULL AND lab_value_numeric IS NOT NULL AND NOT isnan(lab_value_numeric) GROUP BY 1""",
)
def lab_11(spark: SparkSession, d: str) -> DataFrame:
    stays = read(spark, d, "hospitalization").where("hospitalization_id is not null").groupBy(F.col("hospitalization_id").alias("h")).agg(tables.with_lag(F.min("admission_dttm"), 1440).alias("a"))
    labs = read(spark, d, "labs").where("lab_result_dttm is not null").where(N.finite(F.col("lab_value_numeric")))
    rows = labs.join(stays, labs["hospitalization_id"] == stays["h"])
    after, v = F.col("lab_result_dttm") > F.col("a"), F.col("lab_value_numeric")
    is_ = lambda c: F.col("lab_category") == c
    return rows.groupBy("h").agg(F.bool_or(~after & is_("lactate") & (v > 4)).alias("lactate_before"), F.bool_or(after & is_("lactate") & (v > 4)).alias("lactate_after"), F.bool_or(after & is_("sodium") & (v < 130)).alias("sodium_after"))


@query("spl_03_leaks", "SELECT o_custkey AS entity, COUNT(DISTINCT o_orderkey % 10 < 8) AS partitions FROM orders GROUP BY 1 HAVING COUNT(DISTINCT o_orderkey % 10 < 8) > 1")
def spl_03(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "orders").select(F.col("o_custkey").alias("entity"), (F.col("o_orderkey") % 10 < 8).alias("part"))
    return labels.leaks(rows, "entity", "part")


@query(
    "up_01_previous_id",
    "SELECT o_orderkey, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS previous FROM orders WHERE o_totalprice > 0",
)
def up_01(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "orders").where("o_totalprice > 0").select("o_orderkey", F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).alias("previous"))


@query(
    "up_03_age_band",
    "SELECT hospitalization_id, admission_type_category, CASE WHEN age_at_admission < 40 THEN '18-39' WHEN age_at_admission < 65 THEN '40-64' WHEN age_at_admission >= 65 THEN '65+' ELSE 'unknown' END AS band FROM hospitalization",
)
def up_03(spark: SparkSession, d: str) -> DataFrame:
    a = F.col("age_at_admission")
    return read(spark, d, "hospitalization").select("hospitalization_id", "admission_type_category", F.when(a < 40, "18-39").when(a < 65, "40-64").when(a >= 65, "65+").otherwise("unknown").alias("band"))


@query(
    "up_05_wide_bins",
    "SELECT hospitalization_id, max(CASE WHEN lab_category = 'sodium' THEN CAST(floor(lab_value_numeric / 10) AS INTEGER) END) AS sodium, max(CASE WHEN lab_category = 'potassium' THEN CAST(floor(lab_value_numeric / 10) AS INTEGER) END) AS potassium FROM labs WHERE lab_category IN ('sodium', 'potassium') AND lab_value_numeric IS NOT NULL AND NOT isnan(lab_value_numeric) GROUP BY 1",
)
def up_05(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "labs").where("lab_category in ('sodium', 'potassium')").where(N.finite(F.col("lab_value_numeric"))).withColumn("b", F.floor(F.col("lab_value_numeric") / 10).cast("int"))
    return rows.groupBy("hospitalization_id").pivot("lab_category", ["sodium", "potassium"]).agg(F.max("b"))


@query(
    "up_06_day_markers",
    """WITH f AS (SELECT hospitalization_id AS h, min(recorded_dttm) AS a FROM patient_assessments WHERE hospitalization_id IS NOT NULL GROUP BY 1)
       SELECT h, CAST(least((epoch_us(recorded_dttm) - epoch_us(a)) // 86400000000 + 1, 30) AS BIGINT) AS day, min(epoch_us(recorded_dttm)) AS at_us FROM patient_assessments JOIN f ON h = hospitalization_id WHERE recorded_dttm IS NOT NULL GROUP BY 1, 2""",
)
def up_06(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "patient_assessments").where("hospitalization_id is not null and recorded_dttm is not null").select(F.col("hospitalization_id").alias("h"), F.unix_micros("recorded_dttm").alias("t"))
    first = F.min("t").over(Window.partitionBy("h"))
    return rows.withColumn("day", F.least(F.floor((F.col("t") - first) / 86_400_000_000) + 1, F.lit(30)).cast("bigint")).groupBy("h", "day").agg(F.min("t").alias("at_us"))


@query(
    "up_09_time_share",
    """WITH o AS (SELECT hospitalization_id AS h, epoch_us(recorded_dttm) AS t, lead(epoch_us(recorded_dttm)) OVER (PARTITION BY hospitalization_id ORDER BY recorded_dttm, ecmo_id) AS n, CAST(fdo2 AS DOUBLE) > 0.5 AS x FROM ecmo_mcs WHERE hospitalization_id IS NOT NULL AND recorded_dttm IS NOT NULL AND fdo2 IS NOT NULL AND NOT isnan(fdo2))
       SELECT h, round(sum(CASE WHEN x THEN n - t ELSE 0 END) / CAST(sum(n - t) AS DOUBLE), 9) AS share FROM o WHERE n IS NOT NULL GROUP BY 1 HAVING sum(n - t) > 0""",
)
def up_09(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "ecmo_mcs").where("hospitalization_id is not null and recorded_dttm is not null and fdo2 is not null and not isnan(fdo2)")
    rows = rows.select(F.col("hospitalization_id").alias("h"), F.unix_micros("recorded_dttm").alias("t"), "ecmo_id", (F.col("fdo2").cast("double") > 0.5).alias("x"))
    return labels.time_share(rows, "h", "t", ["ecmo_id"], F.col("x"))


@query("enc_00_event_stream_encoded")
def enc_00(spark: SparkSession, d: str) -> DataFrame:
    """Tables to windowed, binned and encoded stays in one lazy plan (no SQL: it is the composition of the parts above)."""
    return stream.encoded_stays(spark, d)


@query("stm_01_windowed_counts", "SELECT event_type, epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS start_us, COUNT(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stm_01(spark: SparkSession, d: str) -> DataFrame:
    """Hourly counts by a structured stream over the events table, run to its end."""
    out = live.run_to_end(live.windowed_counts(live.open_table(spark, d, "events"), "ts", "event_type", "value", "1 hour"))
    return out.select("event_type", F.unix_micros(F.col("start").cast("timestamp")).alias("start_us"), "n", F.round("total", 4).alias("total"))


@query(
    "stm_02_transitions",
    """WITH o AS (SELECT o_custkey, o_orderkey, o_orderstatus, lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS p FROM orders) SELECT o_custkey, o_orderkey, o_orderstatus AS state FROM o WHERE p IS NULL OR p <> o_orderstatus""",
)
def stm_02(spark: SparkSession, d: str) -> DataFrame:
    """State changes per entity by a stateful stream that keeps the last state only, in four micro-batches."""
    rows = read(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    return live.run_to_end(live.state_changes(live.replay(rows, "o_orderkey", 4), "o_custkey", "o_orderkey", "o_orderstatus"), mode="append").select("o_custkey", "o_orderkey", F.col("state"))


@query("stm_03_carry_forward", "SELECT o_custkey, o_orderkey, last_value(CASE WHEN o_orderstatus = 'P' THEN o_totalprice END IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS carried FROM orders")
def stm_03(spark: SparkSession, d: str) -> DataFrame:
    """The last value known at every row, carried from one micro-batch to the next."""
    rows = read(spark, d, "orders").select("o_custkey", "o_orderkey", F.when(F.col("o_orderstatus") == "P", F.col("o_totalprice")).alias("v"))
    return live.run_to_end(live.carry_forward(live.replay(rows, "o_orderkey", 4), "o_custkey", "o_orderkey", "v"), mode="append")


@query(
    "stm_04_sustained",
    f"""WITH b AS (SELECT h, m, bool_or(v > 1.5) AS x FROM {_MIN} GROUP BY 1, 2), k AS (SELECT *, sum(CASE WHEN x THEN 0 ELSE 1 END) OVER (PARTITION BY h ORDER BY m ROWS UNBOUNDED PRECEDING) AS g FROM b),
        s AS (SELECT h, m, lag(m, 2) OVER (PARTITION BY h, g ORDER BY m) AS st FROM k WHERE x) SELECT h, min(m) AS completed_min FROM s WHERE m - st <= 4320 GROUP BY 1""",
)
def stm_04(spark: SparkSession, d: str) -> DataFrame:
    """Sustained crossings found by a stream, whose streaks reach over micro-batches."""
    rows = _creatinine(spark, d).groupBy("h", "m").agg(F.bool_or(F.col("v") > 1.5).alias("x"))
    return live.run_to_end(live.sustained_crossings(live.replay(rows, "m", 5), "h", "m", "x", readings=3, within=4320), mode="append")


@query(
    "stm_05_sessions",
    """WITH e AS (SELECT user_id, epoch_us(ts) AS t, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) < 86400000000 THEN 0 ELSE 1 END AS f FROM events), g AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS g FROM e)
       SELECT user_id, min(t) AS start_us, max(t) + 86400000000 AS end_us, COUNT(*) AS n FROM g GROUP BY user_id, g""",
)
def stm_05(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of each user by a stream."""
    out = live.run_to_end(live.sessions(live.open_table(spark, d, "events"), "user_id", "ts", "1 day"))
    return out.select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n")


@query(
    "stm_06_stay_window",
    """WITH s AS (SELECT hospitalization_id AS h, min(admission_dttm) AS lo FROM hospitalization WHERE hospitalization_id IS NOT NULL GROUP BY 1)
       SELECT assessment_id, (epoch_us(recorded_dttm + INTERVAL 15 MINUTE) - epoch_us(lo)) // 60000000 AS pos_min FROM patient_assessments JOIN s ON h = hospitalization_id WHERE recorded_dttm + INTERVAL 15 MINUTE BETWEEN lo AND lo + INTERVAL 24 HOUR""",
)
def stm_06(spark: SparkSession, d: str) -> DataFrame:
    """Readings that became available, a lag after they were charted, within a day of the admission: a stream joined with the table of stays."""
    stays = read(spark, d, "hospitalization").where("hospitalization_id is not null").groupBy("hospitalization_id").agg(F.min("admission_dttm").alias("lo")).withColumn("hi", tables.with_lag(F.col("lo"), 1440))
    rows = live.available(live.open_table(spark, d, "patient_assessments").select("assessment_id", "hospitalization_id", "recorded_dttm"), "recorded_dttm", 15, "30 days")
    return live.run_to_end(live.in_window(rows, stays, "hospitalization_id", "available_at", "lo", "hi").select("assessment_id", "pos_min"), mode="append")
