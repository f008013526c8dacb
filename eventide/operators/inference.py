"""Weighted contrasts with clustered errors, cross-fitting, overlap, calibration tests, bootstraps, transport and task evaluation."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventide.operators import statistics as S
from eventide.operators.disclosure import MIN_CELL
from eventide.runtime import stage

Z95 = 1.959963984540054
MAX_SITES = 200


def clustered_contrast(df: DataFrame, outcome: str, treated: str, weight: str, cluster: str, z: float = Z95) -> DataFrame:
    """(risk_1, risk_0, difference, se, lo, hi, ratio, ratio_lo, ratio_hi, clusters): Hajek contrast of two arms, its errors from influence values summed over clusters.

    The ratio's interval is that of its logarithm; null where a risk is 0.
    Rows without outcome, arm, weight or cluster are left out.
    """
    rows = df.where(F.col(outcome).isNotNull() & F.col(treated).isin(0, 1) & F.col(weight).isNotNull() & F.col(cluster).isNotNull())
    arm = lambda a, x: F.sum(F.when(F.col(treated) == a, x).otherwise(0.0))
    w, y = F.col(weight).cast("double"), F.col(outcome).cast("double")
    per = rows.groupBy(F.col(cluster).alias("__c")).agg(*[x for a in (1, 0) for x in (arm(a, w).alias(f"w{a}"), arm(a, w * y).alias(f"y{a}"))])
    total = [v if v is not None else 0.0 for v in per.agg(*[F.sum(c) for c in ("w1", "y1", "w0", "y0")], F.count("*")).first()]
    w1, y1, w0, y0, n = total
    if not w1 or not w0 or n < 2:
        return df.sparkSession.createDataFrame([(None,) * 9 + (int(n),)], "risk_1 double, risk_0 double, difference double, se double, lo double, hi double, ratio double, ratio_lo double, ratio_hi double, clusters bigint")
    r1, r0 = y1 / w1, y0 / w0
    phi1, phi0 = (F.col("y1") - F.col("w1") * r1) / w1, (F.col("y0") - F.col("w0") * r0) / w0
    factor = n / (n - 1)
    log = phi1 / r1 - phi0 / r0 if r1 and r0 else F.lit(None).cast("double")
    se = per.agg(F.sqrt(F.sum(F.pow(phi1 - phi0, F.lit(2.0))) * factor).alias("se"), F.sqrt(F.sum(F.pow(log, F.lit(2.0))) * factor).alias("sl"))
    ratio = F.lit(r1 / r0 if r1 and r0 else None).cast("double")
    d = F.lit(r1 - r0)
    return se.select(
        F.lit(r1).alias("risk_1"), F.lit(r0).alias("risk_0"), d.alias("difference"), "se", (d - z * F.col("se")).alias("lo"), (d + z * F.col("se")).alias("hi"),
        ratio.alias("ratio"), (ratio * F.exp(-z * F.col("sl"))).alias("ratio_lo"), (ratio * F.exp(z * F.col("sl"))).alias("ratio_hi"), F.lit(int(n)).cast("bigint").alias("clusters"),
    )


def overlap(df: DataFrame, propensity: str, treated: str, weight: str, support: tuple[float, float] = (0.05, 0.95)) -> DataFrame:
    """(arm, n, q05, median, q95, outside, ess): how the arms' propensities spread, the part outside the support and the Kish size."""
    e, w = F.col(propensity), F.col(weight)
    out = df.where(e.isNotNull() & F.col(treated).isNotNull()).groupBy(F.col(treated).alias("arm")).agg(
        F.count("*").alias("n"), F.percentile(e, [0.05, 0.5, 0.95]).alias("q"), F.avg(F.when(e.between(*support), 0.0).otherwise(1.0)).alias("outside"), (F.pow(F.sum(w), F.lit(2.0)) / F.sum(w * w)).alias("ess")
    )
    return out.select("arm", "n", F.col("q")[0].alias("q05"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q95"), "outside", "ess")


def minimal_effect(n1: Column, n0: Column, risk: Column, z_alpha: float = Z95, z_power: float = 0.8416212335729143) -> Column:
    """Smallest risk difference two arms of these sizes show with 80 % power."""
    return (z_alpha + z_power) * F.sqrt(risk * (1 - risk) * (1 / n1 + 1 / n0))


def _logistic(features: Sequence[str], label: str, l2: float):
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    return Pipeline(stages=[
        VectorAssembler(inputCols=list(features), outputCol="__x", handleInvalid="skip"), StandardScaler(inputCol="__x", outputCol="__z", withMean=True),
        LogisticRegression(featuresCol="__z", labelCol=label, regParam=l2, elasticNetParam=0.0, probabilityCol="__p", rawPredictionCol="__raw", predictionCol="__y"),
    ])


def _scored(model, df: DataFrame, p: str, logit: str | None = None) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    out = model.transform(df).withColumn(p, vector_to_array("__p")[1])
    if logit:
        out = out.withColumn(logit, vector_to_array("__raw")[1])
    return out.drop("__x", "__z", "__p", "__raw", "__y")


def cross_fit(df: DataFrame, features: Sequence[str], label: str, entity: str, k: int = 5, l2: float = 0.01, seed: int = 0, out: str = "probability") -> DataFrame:
    """``df`` with the probability of ``label`` from a model fitted on the other folds of entities.

    A fold whose others have one class only gets their mean.
    """
    rows = stage(df.withColumn("__fold", S.folds(F.col(entity), k, seed)).withColumn(label, F.col(label).cast("double")))
    parts = None
    for i in range(k):
        rest, own = rows.where(F.col("__fold") != i), rows.where(F.col("__fold") == i)
        mean, classes = rest.agg(F.avg(label), F.count_distinct(label)).first()
        one = own.withColumn(out, F.lit(mean).cast("double")) if classes < 2 else _scored(_logistic(features, label, l2).fit(rest), own, out)
        parts = one if parts is None else parts.unionByName(one)
    return parts.drop("__fold")


def cross_fitted_risk(df: DataFrame, features: Sequence[str], arm: str, outcome: str, cluster: str, clip: float = 0.01, k: int = 5) -> DataFrame:
    """(risk, se): doubly robust risk under the arm, both models cross-fitted, its error from influence values summed over clusters."""
    rows = cross_fit(df, features, arm, cluster, k, out="__e")
    # the outcome model of a fold is fitted on the treated of the others and predicts for everyone of the fold
    everyone = _predict_by_fold(rows.withColumn("__m", F.col(outcome).cast("double")), arm, features, cluster, k)
    score = F.col("__q") + F.when(F.col(arm) == 1, (F.col(outcome) - F.col("__q")) / F.greatest(F.col("__e"), F.lit(clip))).otherwise(0.0)
    return _clustered_mean(everyone.withColumn("__s", score), "__s", cluster)


def _predict_by_fold(rows: DataFrame, arm: str, features: Sequence[str], cluster: str, k: int) -> DataFrame:
    staged = stage(rows.withColumn("__fold", S.folds(F.col(cluster), k)))
    out = None
    for i in range(k):
        rest, own = staged.where((F.col("__fold") != i) & (F.col(arm) == 1)), staged.where(F.col("__fold") == i)
        mean, classes = rest.agg(F.avg("__m"), F.count_distinct("__m")).first()
        one = own.withColumn("__q", F.lit(mean).cast("double")) if classes < 2 else _scored(_logistic(features, "__m", 0.01).fit(rest), own, "__q")
        out = one if out is None else out.unionByName(one)
    return out.drop("__fold")


def _clustered_mean(df: DataFrame, value: str, cluster: str) -> DataFrame:
    per = stage(df.groupBy(F.col(cluster).alias("__c")).agg(F.sum(value).alias("s"), F.count(value).alias("n")))
    total, n, clusters = per.agg(F.sum("s"), F.sum("n"), F.count("*")).first()
    mean = (total or 0.0) / n if n else None
    factor = clusters / (clusters - 1) if clusters and clusters > 1 else None
    spread = F.sqrt(F.sum(F.pow(F.col("s") - F.col("n") * F.lit(mean), F.lit(2.0))) * F.lit(factor)) / F.lit(n)
    return per.agg(F.lit(mean).cast("double").alias("risk"), spread.cast("double").alias("se"))


def chi_square_tail(x: float, df: int) -> float:
    """Probability over x of a chi-square distribution, by the recurrence from 1 or 2 degrees of freedom."""
    if x <= 0:
        return 1.0
    tail, k = (math.erfc(math.sqrt(x / 2)), 1) if df % 2 else (math.exp(-x / 2), 2)
    term = math.sqrt(2 * x / math.pi) * math.exp(-x / 2) if df % 2 else x / 2 * math.exp(-x / 2)
    while k < df:
        tail += term
        k += 2
        term *= x / k
    return tail


def d_calibration(df: DataFrame, incidence: str, cause: str, bin_: str, n_bins: int = 10) -> DataFrame:
    """(n, chi2, p): whether the incidence of the cause that happened, at the time it happened, is uniform.

    ``incidence`` is an array by cause (from 1) of arrays by time bin; times
    beyond the last bin take it; rows without an event (cause 0) are left out.
    """
    curve = F.get(F.col(incidence), F.col(cause) - 1)
    at = F.get(curve, F.least(F.greatest(F.col(bin_), F.lit(0)), F.size(curve) - 1))
    counts = S.calibration_histogram(df.where(F.col(cause) > 0).withColumn("__u", at).where(F.col("__u").between(0, 1)), "__u", n_bins)
    n, chi = counts.agg(F.sum("n"), F.sum("chi2")).first()
    p = chi_square_tail(chi, n_bins - 1) if n and n >= n_bins else None
    return df.sparkSession.createDataFrame([(int(n or 0), float(chi) if p is not None else None, p)], "n bigint, chi2 double, p double")


def decile_slope(df: DataFrame, p: str, y: str, least: int = 5) -> DataFrame:
    """(slope, n_deciles): observed on predicted means of the tenths (lo, hi] of the predictions with at least ``least`` rows."""
    rows = df.where(F.col(p).isNotNull() & ~F.isnan(p))
    edges = rows.agg(F.percentile(p, [k / 10 for k in range(1, 11)])).first()[0]
    if edges is None:
        return df.sparkSession.createDataFrame([(None, 0)], "slope double, n_deciles bigint")
    tenth = F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges]), lambda e: e < F.col(p)))
    means = rows.where(F.col(p) > 0).groupBy(tenth.alias("t")).agg(F.avg(p).alias("x"), F.avg(F.col(y).cast("double")).alias("y"), F.count("*").alias("n")).where(F.col("n") >= least)
    return means.agg(F.when(F.count("*") >= 3, F.regr_slope("y", "x")).alias("slope"), F.count("*").alias("n_deciles"))


def paired_bootstrap(df: DataFrame, cluster: str, seed_column: str, a: str, b: str, draws: int, seed: int = 0) -> DataFrame:
    """(draw, difference): mean of a - b when clusters and training seeds are resampled together, the same way in both arms; Poisson weights from hashes. A draw that takes nothing is null."""
    gap = F.col(a) - F.col(b)
    per = df.groupBy(F.col(cluster).alias("__c"), F.col(seed_column).alias("__r")).agg(F.sum(gap).alias("s"), F.count(gap).alias("n"))
    drawn = per.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    w = S.poisson_weight(F.lit(seed), F.lit("c"), F.col("__c"), F.col("draw")) * S.poisson_weight(F.lit(seed), F.lit("s"), F.col("__r"), F.col("draw"))
    return drawn.withColumn("w", w).groupBy("draw").agg(F.try_divide(F.sum(F.col("w") * F.col("s")), F.sum(F.col("w") * F.col("n"))).alias("difference"))


def bootstrap_summary(draws: DataFrame, value: str, groups: Sequence[str] = (), level: float = 0.95) -> DataFrame:
    """(groups, draws, p, lo, hi): two-sided p-value of a zero difference, no less than 1 / draws, and the percentile interval."""
    v = F.col(value)
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    g = draws.where(v.isNotNull()).groupBy(*groups).agg(F.count("*").alias("draws"), F.least(share(v <= 0), share(v >= 0)).alias("s"), F.percentile(v, [(1 - level) / 2, (1 + level) / 2]).alias("q"))
    return g.select(*groups, "draws", F.least(F.lit(1.0), F.greatest(2 * F.col("s"), 1 / F.col("draws"))).alias("p"), F.col("q")[0].alias("lo"), F.col("q")[1].alias("hi"))


def false_coverage_level(alpha: float, rejected: Column, tests: Column) -> Column:
    """Level of intervals reported only for rejected tests."""
    return 1 - alpha * F.greatest(rejected, F.lit(1)) / tests


def group_rates(real: DataFrame, generated: DataFrame, item: str, groups: DataFrame) -> DataFrame:
    """(group, real, generated, ratio): parts of two count tables (item, n) that fall in each group (item, group); items without a group are 'other'."""
    def parts(t: DataFrame, name: str) -> DataFrame:
        total = t.agg(F.sum("n")).first()[0] or 0
        named = t.join(groups, item, "left").groupBy(F.coalesce("group", F.lit("other")).alias("group")).agg(F.sum("n").alias("k"))
        return named.select("group", F.try_divide(F.col("k"), F.lit(total)).alias(name))

    both = parts(real, "real").join(parts(generated, "generated"), "group", "full").na.fill(0.0, ["real", "generated"])
    return both.withColumn("ratio", F.try_divide(F.col("generated"), F.col("real")))


def align_runs(rows: DataFrame, cell: Sequence[str], pair: str, run: str, label: str, runs: Sequence[str]) -> DataFrame:
    """(cell, pairs, status) of the scores of many runs: 'aligned' only if every run scores the same pairs, once, with the same labels; else 'labels differ', 'repeated' or 'incomplete', and nothing is compared."""
    per = rows.where(F.col(run).isin(*runs)).groupBy(*cell, pair).agg(F.count_distinct(run).alias("r"), F.count("*").alias("k"), (F.min(label).eqNullSafe(F.max(label)) & (F.count(label) == F.count("*"))).alias("same"))
    g = per.groupBy(*cell).agg(F.count("*").alias("pairs"), F.bool_and("same").alias("same"), F.bool_and(F.col("r") == len(runs)).alias("all"), F.bool_and(F.col("k") == F.col("r")).alias("once"))
    status = F.when(~F.col("same"), "labels differ").when(~F.col("once"), "repeated").when(~F.col("all"), "incomplete").otherwise("aligned")
    return g.select(*cell, "pairs", status.alias("status"))


def aligned_scores(rows: DataFrame, cell: Sequence[str], pair: str, run: str, label: str, score: str, runs: Sequence[str]) -> DataFrame:
    """One row per pair of the aligned cells: label and a score column per run."""
    good = align_runs(rows, cell, pair, run, label, runs).where("status = 'aligned'").select(*cell)
    return rows.join(good, list(cell), "left_semi").groupBy(*cell, pair, label).pivot(run, list(runs)).agg(F.max(score))


ROLES = ("fit", "selection", "calibration", "evaluation")


def evaluate_task(df: DataFrame, features: Sequence[str], label: str, partition: str, roles: dict[str, str], grid: Sequence[float] = (0.001, 0.1), floor: int = MIN_CELL) -> DataFrame:
    """(status, n_band, l2, temperature, auroc, auprc, brier): one task on fixed partition roles.

    Models of the grid are fitted on the fit partition and the one with the
    best AUROC on the selection partition stays, the first of equals, or the
    first if that has one class; the temperature is fitted on the calibration
    partition, the panel on the evaluation partition.  Cells under the floor or
    of a single class have a status and no numbers, and nothing is fitted for
    them.  Rows with a null label are not at risk.
    """
    if set(roles) != set(ROLES) or len(set(roles.values())) < len(ROLES):
        raise ValueError(f"each of {ROLES} needs a partition of its own")
    rows = stage(df.where(F.col(label).isNotNull()).withColumn(label, F.col(label).cast("double")))
    counts = {r[0]: (r[1], r[2]) for r in rows.groupBy(partition).agg(F.count("*"), F.sum(label)).collect()}
    of = lambda role: rows.where(F.col(partition) == roles[role])
    n, k = counts.get(roles["evaluation"], (0, 0.0))
    both = lambda role: 0 < counts.get(roles[role], (0, 0.0))[1] < counts[roles[role]][0] if roles[role] in counts else False
    schema = "status string, n_band string, l2 double, temperature double, auroc double, auprc double, brier double"
    band = "0" if not n else f"<{floor}" if n < floor else f"{floor}-99" if n < 100 else "100-999" if n < 1000 else ">=1000"
    empty = lambda status: df.sparkSession.createDataFrame([(status, band, None, None, None, None, None)], schema)
    if n < floor or 0 < k < floor or 0 < n - k < floor:
        return empty("suppressed")
    if not both("evaluation") or not both("fit"):
        return empty("not evaluable")
    best = None
    for l2 in grid:
        model = _logistic(features, label, l2).fit(of("fit"))
        score = S.auroc(_scored(model, of("selection"), "p"), y=label).first()["auroc"] if both("selection") and len(grid) > 1 else 0.0
        if best is None or score > best[0]:
            best = (score, l2, model)
        if not both("selection"):
            break
    _, l2, model = best
    t = S.fit_temperature(_scored(model, of("calibration"), "p", "z"), "z", label) if both("calibration") else None
    scored = stage(_scored(model, of("evaluation"), "p", "z").withColumn("p", 1 / (1 + F.exp(-F.col("z") / (t or 1.0)))).select("p", F.col(label).alias("y")))
    auroc, auprc = S.auroc(scored).first()["auroc"], S.average_precision(scored).first()["auprc"]
    brier = scored.agg(S.brier(F.col("p"), F.col("y"))).first()[0]
    return df.sparkSession.createDataFrame([("evaluable", band, float(l2), t, auroc, auprc, brier)], schema)


def transport_matrix(df: DataFrame, features: Sequence[str], label: str, site: str, partition: str, l2: float = 0.01, floor: int = MIN_CELL) -> DataFrame:
    """(fit_site, test_site, status, auroc, brier): the model of every site, its temperature from the same site, on the test rows of every site.

    Partitions are 'train', 'calibration' and 'test'.  Sites are few: their
    names reach the driver, checked against MAX_SITES, and each is one fit; the
    test rows are scored once per model and all cells come from one
    aggregation.  Cells under the floor on either side have a status only.
    """
    rows = stage(df.where(F.col(label).isNotNull() & F.col(site).isNotNull()).withColumn(label, F.col(label).cast("double")))
    sites = sorted(r[0] for r in rows.select(site).distinct().limit(MAX_SITES + 1).collect())
    if len(sites) > MAX_SITES:
        raise ValueError(f"more than {MAX_SITES} sites")
    test, parts = rows.where(F.col(partition) == "test"), []
    for s in sites:
        own = rows.where(F.col(site) == s)
        n, k = own.where(F.col(partition) == "train").agg(F.count("*"), F.sum(label)).first()
        if min(k or 0, (n or 0) - (k or 0)) < floor:
            continue
        model = _logistic(features, label, l2).fit(own.where(F.col(partition) == "train"))
        cal = own.where(F.col(partition) == "calibration")
        t = S.fit_temperature(_scored(model, cal, "p", "z"), "z", label) if cal.select(label).distinct().count() == 2 else 1.0
        parts.append(_scored(model, test, "p", "z").select(F.lit(s).alias("fit_site"), F.col(site).alias("test_site"), (1 / (1 + F.exp(-F.col("z") / t))).alias("p"), F.col(label).alias("y")))
    spark = df.sparkSession
    names = spark.createDataFrame([(a, b) for a in sites for b in sites] or [], "fit_site string, test_site string")
    if not parts:
        return names.select("fit_site", "test_site", F.lit("not fitted").alias("status"), F.lit(None).cast("double").alias("auroc"), F.lit(None).cast("double").alias("brier"))
    scored = parts[0]
    for p in parts[1:]:
        scored = scored.unionByName(p)
    scored = stage(scored)
    sizes = scored.groupBy("fit_site", "test_site").agg(F.count("*").alias("n"), F.sum("y").alias("k"), S.brier(F.col("p"), F.col("y")).alias("brier"))
    both = names.join(sizes, ["fit_site", "test_site"], "left").join(S.auroc(scored, ["fit_site", "test_site"]).select("fit_site", "test_site", "auroc"), ["fit_site", "test_site"], "left")
    fitted = scored.select("fit_site").distinct().withColumn("__f", F.lit(True))
    small = (F.coalesce("n", F.lit(0)) < floor) | F.col("k").between(1, floor - 1) | (F.col("n") - F.col("k")).between(1, floor - 1)
    status = F.when(F.col("__f").isNull(), "not fitted").when(small, "suppressed").when(F.col("auroc").isNull(), "not evaluable").otherwise("evaluable")
    out = both.join(fitted, "fit_site", "left").withColumn("status", status)
    shown = lambda c: F.when(F.col("status") == "evaluable", F.col(c)).alias(c)
    return out.select("fit_site", "test_site", "status", shown("auroc"), shown("brier"))


def curriculum(step: Column, total: int, warmup: float, transition: float, target: float) -> Column:
    """Weight of the second objective: 0 during warm-up, then linear, then ``target``."""
    a, b = warmup * total, (warmup + transition) * total
    return F.when(step < a, 0.0).when(step >= b, target).otherwise((step - a) / (b - a) * target) if b > a else F.when(step < a, 0.0).otherwise(target)


def cross_entropy(logits: Column, target: Column) -> Column:
    """Negative log probability of the target's place in an array of logits."""
    top = F.array_max(logits)
    return top + F.log(F.aggregate(logits, F.lit(0.0), lambda a, z: a + F.exp(z - top))) - F.get(logits, target)


def gaussian_nll(value: Column, mean: Column, log_variance: Column) -> Column:
    """Negative log density of a normal distribution."""
    return 0.5 * (F.log(F.lit(2 * math.pi)) + log_variance + F.pow(value - mean, F.lit(2.0)) / F.exp(log_variance))


def coverage(df: DataFrame, columns: Sequence[str], groups: Sequence[str], floor: int = MIN_CELL) -> DataFrame:
    """(groups, column, n, share, shown): part of the rows of each group that have a value; shares over hidden counts are not shown."""
    g = df.groupBy(*groups).agg(F.count("*").alias("n"), *[F.count(c).alias(f"__{c}") for c in columns])
    long = g.select(*groups, "n", F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"__{c}").alias("k")) for c in columns])))
    small = (F.col("n") < floor) | F.col("k").between(1, floor - 1) | (F.col("n") - F.col("k")).between(1, floor - 1)
    return long.select(*groups, "column", "n", F.when(~small, F.col("k") / F.col("n")).alias("share"))
