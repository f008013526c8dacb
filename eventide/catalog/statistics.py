"""Metrics, estimators and disclosure control.

Scores are made from the test tables: of every order line the discount, plus
a part of its size, is the score and a late flag the outcome.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventide.catalog.registry import query
from eventide.functions import numbers as N
from eventide.operators import disclosure
from eventide.operators import statistics as S
from eventide.runtime import read

_SCORES = "(SELECT l_returnflag AS g, round(l_discount * 8 + l_quantity / 500.0, 3) AS p, CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS y FROM lineitem)"


def _scores(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "lineitem").select(
        F.col("l_returnflag").alias("g"), F.round(F.col("l_discount") * 8 + F.col("l_quantity") / 500.0, 3).alias("p"), F.when(F.col("l_linestatus") == "O", 1).otherwise(0).alias("y")
    )


@query(
    "sta_01_auroc",
    f"""WITH r AS (SELECT g, y, rank() OVER (PARTITION BY g ORDER BY p) + (COUNT(*) OVER (PARTITION BY g, p) - 1) / 2.0 AS r FROM {_SCORES})
        SELECT g, COUNT(*) AS n, CAST(sum(y) AS BIGINT) AS n_pos, round((sum(CASE WHEN y = 1 THEN r END) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (COUNT(*) - sum(y))), 9) AS auroc FROM r GROUP BY 1""",
)
def sta_01(spark: SparkSession, d: str) -> DataFrame:
    return S.auroc(_scores(spark, d), ["g"]).select("g", "n", "n_pos", F.round("auroc", 9).alias("auroc"))


@query(
    "sta_01_auprc",
    f"""WITH l AS (SELECT g, p, sum(y) AS k, COUNT(*) AS n FROM {_SCORES} GROUP BY 1, 2), c AS (SELECT g, k, sum(k) OVER w AS tp, sum(n) OVER w AS m FROM l WINDOW w AS (PARTITION BY g ORDER BY p DESC ROWS UNBOUNDED PRECEDING))
        SELECT g, round(sum(CAST(k AS DOUBLE) * tp / m) / sum(k), 9) AS auprc FROM c GROUP BY 1""",
)
def sta_01_auprc(spark: SparkSession, d: str) -> DataFrame:
    return S.average_precision(_scores(spark, d), ["g"]).select("g", F.round("auprc", 9).alias("auprc"))


@query(
    "sta_02_ece",
    f"""WITH b AS (SELECT g, p, y, CAST((SELECT COUNT(*) FROM (SELECT unnest(range(0, 10)) / 10.0 AS e) WHERE e < p) AS INTEGER) AS b FROM {_SCORES} WHERE p > 0), a AS (SELECT g, b, COUNT(*) AS n, avg(y) AS my, avg(p) AS mp FROM b GROUP BY 1, 2), t AS (SELECT g, COUNT(*) AS n FROM {_SCORES} GROUP BY 1)
        SELECT a.g, round(sum(a.n * abs(my - mp)) / any_value(t.n), 9) AS ece FROM a JOIN t ON t.g = a.g GROUP BY 1""",
)
def sta_02(spark: SparkSession, d: str) -> DataFrame:
    return S.calibration_error(_scores(spark, d), ["g"]).select("g", F.round("ece", 9).alias("ece"))


@query("sta_03_brier", f"SELECT g, round(avg(pow(p - y, 2)), 9) AS brier FROM {_SCORES} GROUP BY 1")
def sta_03(spark: SparkSession, d: str) -> DataFrame:
    return _scores(spark, d).groupBy("g").agg(F.round(S.brier(F.col("p"), F.col("y")), 9).alias("brier"))


@query("sta_04_recalibration")
def sta_04(spark: SparkSession, d: str) -> DataFrame:
    """Intercept and slope of logistic recalibration (no SQL: Newton iterations)."""
    a, b = S.logistic_recalibration(_scores(spark, d))
    return spark.createDataFrame([(a, b)], "intercept double, slope double")


@query(
    "sta_06_net_benefit",
    f"""SELECT t AS threshold, round(avg(CASE WHEN p >= t THEN CASE WHEN y = 1 THEN 1.0 ELSE -t / (1 - t) END ELSE 0 END), 9) AS net_benefit, round(avg(y) - (1 - avg(y)) * t / (1 - t), 9) AS treat_all
        FROM {_SCORES}, (SELECT unnest([0.1, 0.25, 0.5, 0.75])::DOUBLE AS t) GROUP BY t""",
)
def sta_06(spark: SparkSession, d: str) -> DataFrame:
    out = S.net_benefit(_scores(spark, d), [0.1, 0.25, 0.5, 0.75])
    return out.select("threshold", F.round("net_benefit", 9).alias("net_benefit"), F.round("treat_all", 9).alias("treat_all"))


@query(
    "sta_11_cumulative_incidence",
    """WITH r AS (SELECT l_returnflag AS g, CAST(l_quantity AS BIGINT) AS t, l_linenumber % 3 AS c FROM lineitem), n AS (SELECT g, t, COUNT(*) AS n, COUNT(*) FILTER (c = 1) AS d1, COUNT(*) FILTER (c = 2) AS d2 FROM r GROUP BY 1, 2),
       k AS (SELECT *, sum(n) OVER (PARTITION BY g ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS risk FROM n),
       s AS (SELECT *, exp(sum(CASE WHEN d1 + d2 < risk THEN ln(1 - (d1 + d2) / risk) ELSE -1e9 END) OVER (PARTITION BY g ORDER BY t ROWS UNBOUNDED PRECEDING)) AS survival FROM k),
       b AS (SELECT *, coalesce(lag(survival) OVER (PARTITION BY g ORDER BY t), 1) AS before FROM s)
       SELECT g, t, round(survival, 9) AS survival, round(sum(before * d1 / risk) OVER w, 9) AS cif_1, round(sum(before * d2 / risk) OVER w, 9) AS cif_2 FROM b WINDOW w AS (PARTITION BY g ORDER BY t ROWS UNBOUNDED PRECEDING)""",
)
def sta_11(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "lineitem").select(F.col("l_returnflag").alias("g"), F.col("l_quantity").cast("bigint").alias("t"), (F.col("l_linenumber") % 3).alias("c"))
    out = S.cumulative_incidence(rows, "t", "c", ["g"])
    return out.select("g", "t", *[F.round(c, 9).alias(c) for c in ("survival", "cif_1", "cif_2")])


_ARMS = "(SELECT CASE WHEN l_tax > 0.04 THEN 1 ELSE 0 END AS a, CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS y, 0.2 + l_discount * 5 AS e, l_quantity AS q FROM lineitem)"
_WEIGHT = "CASE WHEN a = 1 THEN 1 / greatest(0.05, least(0.95, e)) ELSE 1 / (1 - greatest(0.05, least(0.95, e))) END"


def _arms(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "lineitem").select(
        F.when(F.col("l_tax") > 0.04, 1).otherwise(0).alias("a"), F.when(F.col("l_linestatus") == "O", 1).otherwise(0).alias("y"), (F.lit(0.2) + F.col("l_discount") * 5).alias("e"), F.col("l_quantity").alias("q")
    )
    return rows.withColumn("w", S.ipw(F.col("e"), F.col("a"), clip=0.05))


@query(
    "sta_13_weighted_contrast",
    f"""WITH w AS (SELECT *, {_WEIGHT} AS w FROM {_ARMS}), m AS (SELECT sum(w * y) FILTER (a = 1) / sum(w) FILTER (a = 1) AS r1, sum(w * y) FILTER (a = 0) / sum(w) FILTER (a = 0) AS r0, pow(sum(w) FILTER (a = 1), 2) / sum(w * w) FILTER (a = 1) AS e1, pow(sum(w) FILTER (a = 0), 2) / sum(w * w) FILTER (a = 0) AS e0 FROM w)
        SELECT round(r1, 9) AS risk_1, round(r0, 9) AS risk_0, round(r1 - r0, 9) AS difference, round(e1, 3) AS ess_1, round(e0, 3) AS ess_0 FROM m""",
)
def sta_13(spark: SparkSession, d: str) -> DataFrame:
    out = S.hajek(_arms(spark, d), "y", "a", "w")
    return out.select(*[F.round(c, 9).alias(c) for c in ("risk_1", "risk_0", "difference")], *[F.round(c, 3).alias(c) for c in ("ess_1", "ess_0")])


@query(
    "sta_14_balance",
    f"""WITH w AS (SELECT *, {_WEIGHT} AS w FROM {_ARMS}), l AS (SELECT a, w, 'q' AS covariate, CAST(q AS DOUBLE) AS x FROM w UNION ALL SELECT a, w, 'e', e FROM w),
        m AS (SELECT covariate, a, sum(w * x) / sum(w) AS m, sum(w * x * x) / sum(w) - pow(sum(w * x) / sum(w), 2) AS v FROM l GROUP BY 1, 2)
        SELECT covariate, round((max(CASE WHEN a = 1 THEN m END) - max(CASE WHEN a = 0 THEN m END)) / sqrt((max(CASE WHEN a = 1 THEN v END) + max(CASE WHEN a = 0 THEN v END)) / 2), 7) AS smd FROM m GROUP BY 1""",
)
def sta_14(spark: SparkSession, d: str) -> DataFrame:
    return S.balance(_arms(spark, d), ["q", "e"], "a", F.col("w")).select("covariate", F.round("smd", 7).alias("smd"))


_COUNTS = "SELECT event_type, COUNT(*) AS n FROM events WHERE user_id % 2 = {0} GROUP BY 1"


def _counts(spark: SparkSession, d: str, half: int) -> DataFrame:
    return read(spark, d, "events").where(F.col("user_id") % 2 == half).groupBy("event_type").agg(F.count("*").alias("n"))


@query(
    "sta_18_divergence",
    f"""WITH a AS ({_COUNTS.format(0)}), b AS ({_COUNTS.format(1)}), j AS (SELECT coalesce(a.n, 0) / sum(coalesce(a.n, 0)) OVER () AS p, coalesce(b.n, 0) / sum(coalesce(b.n, 0)) OVER () AS q FROM a FULL JOIN b ON a.event_type = b.event_type)
        SELECT round(sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) / 2 ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) / 2 ELSE 0 END), 9) AS js, round(sum(CASE WHEN p = 0 THEN q ELSE 0 END), 9) AS only_b FROM j""",
)
def sta_18(spark: SparkSession, d: str) -> DataFrame:
    out = S.divergence(_counts(spark, d, 0), _counts(spark, d, 1), "event_type")
    return out.select(F.round("js", 9).alias("js"), F.round("only_b", 9).alias("only_b"))


@query("sta_18_top_overlap", f"WITH a AS (SELECT event_type FROM ({_COUNTS.format(0)}) ORDER BY n DESC, event_type LIMIT 3), b AS (SELECT event_type FROM ({_COUNTS.format(1)}) ORDER BY n DESC, event_type LIMIT 3) SELECT COUNT(*) / 3.0 AS overlap FROM a JOIN b USING (event_type)")
def sta_18_top(spark: SparkSession, d: str) -> DataFrame:
    return S.top_overlap(_counts(spark, d, 0), _counts(spark, d, 1), "event_type", 3)


@query(
    "sta_19_distinct_n",
    """WITH g AS (SELECT event_type AS a, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) SELECT round(COUNT(DISTINCT (a, b)) / CAST(COUNT(*) AS DOUBLE), 9) AS distinct_n FROM g WHERE b IS NOT NULL""",
)
def sta_19(spark: SparkSession, d: str) -> DataFrame:
    seq = read(spark, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))).alias("s"))
    return S.distinct_grams(seq.select(F.col("s.event_type").alias("t")), "t", 2).select(F.round("distinct_n", 9).alias("distinct_n"))


@query(
    "sta_20_wilson",
    """WITH c AS (SELECT hospital_id, COUNT(*) AS n, COUNT(*) FILTER (discharge_category = 'Expired') AS k FROM hospitalization GROUP BY 1), z AS (SELECT *, k / n AS p, 1.959963984540054 AS z FROM c)
       SELECT hospital_id, k, n, round((p + z*z/(2*n)) / (1 + z*z/n) - z * sqrt(p*(1-p)/n + z*z/(4*n*n)) / (1 + z*z/n), 9) AS lo, round((p + z*z/(2*n)) / (1 + z*z/n) + z * sqrt(p*(1-p)/n + z*z/(4*n*n)) / (1 + z*z/n), 9) AS hi FROM z WHERE k > 0""",
)
def sta_20(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "hospitalization").groupBy("hospital_id").agg(F.count("*").alias("n"), F.count_if(F.col("discharge_category") == "Expired").alias("k")).where("k > 0")
    lo, hi = N.wilson(F.col("k"), F.col("n"))
    return c.select("hospital_id", "k", "n", F.round(lo, 9).alias("lo"), F.round(hi, 9).alias("hi"))


@query(
    "sta_22_bh",
    """WITH t AS (SELECT lab_category, round(avg(CASE WHEN lab_value_numeric IS NULL THEN 1.0 ELSE 0.0 END), 6) AS p FROM labs GROUP BY 1), r AS (SELECT *, rank() OVER (ORDER BY p) + COUNT(*) OVER (PARTITION BY p) - 1 AS k, COUNT(*) OVER () AS m FROM t)
       SELECT lab_category, p, round(min(least(1.0, p * m / k)) OVER (ORDER BY p RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 9) AS q FROM r""",
)
def sta_22(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "labs").groupBy("lab_category").agg(F.round(F.avg(F.when(F.col("lab_value_numeric").isNull(), 1.0).otherwise(0.0)), 6).alias("p"))
    return S.benjamini_hochberg(t, "p", 0.05).select("lab_category", "p", F.round("q", 9).alias("q"))


@query(
    "sta_15_risk_ratio",
    """WITH c AS (SELECT hospital_id, COUNT(*) FILTER (age_at_admission >= 65) AS n1, COUNT(*) FILTER (age_at_admission >= 65 AND discharge_category = 'Expired') AS k1, COUNT(*) FILTER (age_at_admission < 65) AS n0, COUNT(*) FILTER (age_at_admission < 65 AND discharge_category = 'Expired') AS k0 FROM hospitalization GROUP BY 1),
       r AS (SELECT *, (k1 / n1) / (k0 / n0) AS rr, sqrt(1 / k1 - 1 / n1 + 1 / k0 - 1 / n0) AS se FROM c WHERE k1 > 0 AND k0 > 0)
       SELECT hospital_id, round(rr, 7) AS rr, round(rr * exp(-1.959963984540054 * se), 7) AS lo, round(rr * exp(1.959963984540054 * se), 7) AS hi, round(CASE WHEN rr < 1 THEN 1 / rr + sqrt(1 / rr * (1 / rr - 1)) ELSE rr + sqrt(rr * (rr - 1)) END, 7) AS e_value FROM r""",
)
def sta_15(spark: SparkSession, d: str) -> DataFrame:
    old, dead = F.col("age_at_admission") >= 65, F.col("discharge_category") == "Expired"
    young = F.col("age_at_admission") < 65
    c = read(spark, d, "hospitalization").groupBy("hospital_id").agg(F.count_if(old).alias("n1"), F.count_if(old & dead).alias("k1"), F.count_if(young).alias("n0"), F.count_if(young & dead).alias("k0")).where("k1 > 0 and k0 > 0")
    rr, lo, hi = S.relative_effect(F.col("k1"), F.col("n1"), F.col("k0"), F.col("n0"))
    out = c.select("hospital_id", rr.alias("rr"), lo.alias("lo"), hi.alias("hi"))
    return out.select("hospital_id", *[F.round(x, 7).alias(x) for x in ("rr", "lo", "hi")], F.round(S.e_value(F.col("rr")), 7).alias("e_value"))


@query(
    "dis_01_suppressed",
    "SELECT hospital_id, location_category, CASE WHEN COUNT(*) > 0 AND COUNT(*) < 10 THEN '<10' ELSE CAST(COUNT(*) AS VARCHAR) END AS shown, CASE WHEN COUNT(*) < 10 THEN '<10' WHEN COUNT(*) < 100 THEN '10-99' WHEN COUNT(*) < 1000 THEN '100-999' ELSE '>=1000' END AS band FROM adt GROUP BY 1, 2",
)
def dis_01(spark: SparkSession, d: str) -> DataFrame:
    n = read(spark, d, "adt").groupBy("hospital_id", "location_category").agg(F.count("*").alias("n"))
    return n.select("hospital_id", "location_category", F.when(disclosure.hidden(F.col("n")), "<10").otherwise(F.col("n").cast("string")).alias("shown"), disclosure.band(F.col("n")).alias("band"))


@query(
    "dis_02_complementary",
    """WITH c AS (SELECT hospital_id, location_category, COUNT(*) AS n FROM adt WHERE location_category IS NOT NULL AND hospital_id IS NOT NULL GROUP BY 1, 2), h AS (SELECT *, n < 10 AS small, sum(CASE WHEN n < 10 THEN 1 ELSE 0 END) OVER (PARTITION BY hospital_id) AS k FROM c),
       r AS (SELECT *, row_number() OVER (PARTITION BY hospital_id ORDER BY small, n, location_category) AS r FROM h)
       SELECT hospital_id, location_category, CASE WHEN small OR (k = 1 AND r = 1) THEN '<10' ELSE CAST(n AS VARCHAR) END AS shown FROM r""",
)
def dis_02(spark: SparkSession, d: str) -> DataFrame:
    n = read(spark, d, "adt").where("location_category is not null and hospital_id is not null").groupBy("hospital_id", "location_category").agg(F.count("*").alias("n"))
    return disclosure.suppress(n, ["hospital_id"], "location_category", "n").select("hospital_id", "location_category", "shown")
