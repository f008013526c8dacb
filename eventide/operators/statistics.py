"""Metrics and estimators as aggregations; score columns are ``p`` and outcomes ``y`` (0 or 1) unless named."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventide.runtime import stage


KNOTS = 64


def _prefix(df: DataFrame, groups: Sequence[str], order: str, columns: Sequence[str], descending: bool = False) -> DataFrame:
    """``df`` (one row per group and order value) with ``before_`` of each column: its sum over the rows of the group before.

    The rows are cut at KNOTS quantiles of the order, so sums run within a cut
    and the cuts' totals are carried: no task sees all rows of a group.
    """
    staged = stage(df)
    knots = staged.agg(F.percentile_approx(order, [i / KNOTS for i in range(1, KNOTS)], 100 * KNOTS)).first()[0] or []
    cut = F.size(F.filter(F.array(*[F.lit(k) for k in sorted(set(knots))]), lambda k: k < F.col(order))) if knots else F.lit(0)
    rows = staged.withColumn("__cut", -cut if descending else cut)
    by = [F.col(g) for g in groups]
    totals = rows.groupBy(*groups, "__cut").agg(*[F.sum(c).alias(f"__t_{c}") for c in columns])
    outer = Window.partitionBy(*by).orderBy("__cut").rowsBetween(Window.unboundedPreceding, -1) if groups else Window.partitionBy(F.lit(0)).orderBy("__cut").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(*groups, F.col("__cut").alias("__c"), *[F.coalesce(F.sum(f"__t_{c}").over(outer), F.lit(0.0)).alias(f"__t_{c}") for c in columns])
    same = F.col("__cut") == F.col("__c")
    for g in groups:
        carried = carried.withColumnRenamed(g, f"__g_{g}")
        same = same & F.col(g).eqNullSafe(F.col(f"__g_{g}"))
    inner = Window.partitionBy(*by, "__cut").orderBy(F.desc(order) if descending else F.col(order)).rowsBetween(Window.unboundedPreceding, -1)
    return rows.join(carried, same).select(*df.columns, *[(F.col(f"__t_{c}") + F.coalesce(F.sum(c).over(inner), F.lit(0.0))).alias(f"before_{c}") for c in columns])


def _levels(df: DataFrame, groups: Sequence[str], p: str, y: str) -> DataFrame:
    """Distinct scores with outcome counts: what every rank statistic needs, one row per score."""
    return df.where(F.col(p).isNotNull() & ~F.isnan(p) & F.col(y).isNotNull()).groupBy(*groups, F.col(p).cast("double").alias("p")).agg(F.sum(y).cast("double").alias("pos"), (F.count("*") - F.sum(y)).cast("double").alias("neg"))


def auroc(df: DataFrame, groups: Sequence[str] = (), p: str = "p", y: str = "y") -> DataFrame:
    """(groups, n, n_pos, auroc) from average ranks; ties count half; null for one class. Rows without a score or an outcome are left out."""
    ranked = _prefix(_levels(df, groups, p, y), groups, "p", ["neg"])
    wins = F.sum(F.col("pos") * (F.col("before_neg") + F.col("neg") / 2))
    out = ranked.groupBy(*groups).agg(F.sum(F.col("pos") + F.col("neg")).alias("n"), F.sum("pos").alias("n_pos"), wins.alias("u"))
    return out.select(*groups, F.col("n").cast("bigint").alias("n"), F.col("n_pos").cast("bigint").alias("n_pos"), F.try_divide(F.col("u"), F.col("n_pos") * (F.col("n") - F.col("n_pos"))).alias("auroc"))


def average_precision(df: DataFrame, groups: Sequence[str] = (), p: str = "p", y: str = "y") -> DataFrame:
    """(groups, auprc): precision summed over steps of recall, high scores first."""
    cum = _prefix(_levels(df, groups, p, y), groups, "p", ["pos", "neg"], descending=True)
    hits, all_ = F.col("before_pos") + F.col("pos"), F.col("before_pos") + F.col("pos") + F.col("before_neg") + F.col("neg")
    return cum.groupBy(*groups).agg(F.try_divide(F.sum(F.col("pos") * hits / all_), F.sum("pos")).alias("auprc"))


def brier(p: Column, y: Column) -> Column:
    return F.avg(F.pow(p - y, F.lit(2.0)))


def calibration_error(df: DataFrame, groups: Sequence[str] = (), n_bins: int = 10, p: str = "p", y: str = "y") -> DataFrame:
    """(groups, ece) over bins (lo, hi]; a score of 0 is in no bin."""
    edges = F.array(*[F.lit(k / n_bins) for k in range(n_bins)])
    bins = df.where(F.col(p) > 0).withColumn("__b", F.size(F.filter(edges, lambda e: e < F.col(p)))).groupBy(*groups, "__b").agg(F.count("*").alias("n"), F.avg(y).alias("my"), F.avg(p).alias("mp"))
    total = df.groupBy(*groups).agg(F.count("*").alias("t"))
    err = F.sum(F.col("n") * F.abs(F.col("my") - F.col("mp"))).alias("e")
    both = bins.groupBy(*groups).agg(err)
    joined = both.join(total, list(groups)) if groups else both.withColumn("t", F.lit(df.count()))
    return joined.select(*groups, (F.col("e") / F.col("t")).alias("ece"))


def net_benefit(df: DataFrame, thresholds: Sequence[float], p: str = "p", y: str = "y") -> DataFrame:
    """(threshold, net_benefit, treat_all): one pass, one pair of conditional sums per threshold."""
    sums = df.agg(F.count("*").alias("n"), F.avg(y).alias("m"), *[F.sum(F.when(F.col(p) >= t, F.when(F.col(y) == 1, 1.0).otherwise(-t / (1 - t))).otherwise(0.0)).alias(f"b{i}") for i, t in enumerate(thresholds)])
    rows = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), (F.col(f"b{i}") / F.col("n")).alias("net_benefit"), (F.col("m") - (1 - F.col("m")) * t / (1 - t)).alias("treat_all")) for i, t in enumerate(thresholds)])
    return sums.select(F.inline(rows))


def logistic_recalibration(df: DataFrame, p: str = "p", y: str = "y", rounds: int = 50) -> tuple[float, float]:
    """(intercept in the large, slope) of the outcome on the score's logit.

    The slope is that of a joint fit; the intercept that of a fit with the
    logit as offset.  Both by Newton steps over aggregated moments of the
    distinct scores, staged once; scores of 0 and 1 are clipped.  Not a number
    where a fit has no solution.
    """
    clipped = F.greatest(F.least(F.col(p).cast("double"), F.lit(1 - 1e-6)), F.lit(1e-6))
    scored = df.where(F.col(p).isNotNull() & ~F.isnan(p) & F.col(y).isNotNull())
    rows = stage(scored.groupBy(F.log(clipped / (1 - clipped)).alias("x")).agg(F.sum(y).cast("double").alias("k"), F.count("*").cast("double").alias("n")))

    def moments(a: float, b: float) -> list[float]:
        m = 1 / (1 + F.exp(-(F.lit(a) + F.lit(b) * F.col("x"))))
        w, r = F.col("n") * m * (1 - m), F.col("k") - F.col("n") * m
        return [v or 0.0 for v in rows.agg(F.sum(w), F.sum(w * F.col("x")), F.sum(w * F.col("x") ** 2), F.sum(r), F.sum(r * F.col("x"))).first()]

    a, b, large = 0.0, 1.0, 0.0
    for _ in range(rounds):
        w, wx, wxx, r, rx = moments(a, b)
        det = w * wxx - wx**2
        if abs(det) < 1e-12:
            return math.nan, math.nan
        da, db = (wxx * r - wx * rx) / det, (w * rx - wx * r) / det
        a, b = a + da, b + db
        if abs(da) + abs(db) < 1e-10:
            break
    for _ in range(rounds):
        w, _, _, r, _ = moments(large, 1.0)
        if w < 1e-12:
            return math.nan, b
        large += r / w
        if abs(r / w) < 1e-10:
            break
    return large, b


def cumulative_incidence(df: DataFrame, time: str, cause: str, groups: Sequence[str] = (), weight: Column | None = None, causes: Sequence[int] = (1, 2), horizon: float | None = None) -> DataFrame:
    """(groups, time, survival, cif_..): weighted Aalen-Johansen over the distinct times up to the horizon; cause 0 is censoring."""
    w = F.lit(1.0) if weight is None else weight
    deaths = [F.sum(F.when(F.col(cause) == k, w).otherwise(0.0)).alias(f"d{k}") for k in causes]
    grid = df.where(F.col(time).isNotNull()).groupBy(*groups, time).agg(F.sum(w).alias("n"), *deaths)
    total = grid.groupBy(*groups).agg(F.sum("n").alias("__all"))
    g = _prefix(grid, groups, time, ["n"])
    if groups:
        same = None
        for c in groups:
            total = total.withColumnRenamed(c, f"__g_{c}")
            one = F.col(c).eqNullSafe(F.col(f"__g_{c}"))
            same = one if same is None else same & one
        g = g.join(total, same)
    else:
        g = g.withColumn("__all", F.lit(total.first()["__all"] or 0.0))
    g = g.withColumn("risk", F.col("__all") - F.col("before_n"))
    h = sum((F.col(f"d{k}") for k in causes), F.lit(0.0)) / F.col("risk")
    g = g.withColumn("log", F.when(h < 1 - 1e-12, F.log1p(-h)).otherwise(F.lit(-1e9))).select(*groups, time, "risk", "log", *[f"d{k}" for k in causes])
    g = _prefix(g, groups, time, ["log"])
    steps = [(F.exp("before_log") * F.col(f"d{k}") / F.col("risk")).alias(f"c{k}") for k in causes]
    g = g.select(*groups, time, F.exp(F.col("before_log") + F.col("log")).alias("survival"), *steps)
    g = _prefix(g, groups, time, [f"c{k}" for k in causes])
    out = g.select(*groups, time, "survival", *[(F.col(f"before_c{k}") + F.col(f"c{k}")).alias(f"cif_{k}") for k in causes])
    return out if horizon is None else out.where(F.col(time) <= horizon)


def ipw(propensity: Column, treated: Column, clip: float = 0.01) -> Column:
    """Inverse probability weight with a clipped propensity."""
    e = F.greatest(F.lit(clip), F.least(F.lit(1 - clip), propensity))
    return F.when(treated == 1, 1 / e).otherwise(1 / (1 - e))


def overlap_weight(propensity: Column, treated: Column) -> Column:
    return F.when(treated == 1, 1 - propensity).otherwise(propensity)


def hajek(df: DataFrame, outcome: str, treated: str, weight: str) -> DataFrame:
    """(risk_1, risk_0, difference, ess_1, ess_0): weighted means and Kish sizes by arm."""
    arm = lambda a, x: F.sum(F.when(F.col(treated) == a, x))
    mean = lambda a: arm(a, F.col(weight) * F.col(outcome)) / arm(a, F.col(weight))
    size = lambda a: F.pow(arm(a, F.col(weight)), F.lit(2.0)) / arm(a, F.col(weight) ** 2)
    return df.agg(mean(1).alias("risk_1"), mean(0).alias("risk_0"), (mean(1) - mean(0)).alias("difference"), size(1).alias("ess_1"), size(0).alias("ess_0"))


def balance(df: DataFrame, covariates: Sequence[str], treated: str, weight: Column) -> DataFrame:
    """(covariate, smd): weighted standardised mean difference of every covariate, one pass."""
    long = df.select(F.col(treated).alias("a"), weight.alias("w"), F.explode(F.array(*[F.struct(F.lit(c).alias("covariate"), F.col(c).cast("double").alias("x")) for c in covariates])).alias("c")).select("a", "w", "c.*")
    on = lambda a, x: F.sum(F.when(F.col("a") == a, x))
    m = {a: on(a, F.col("w") * F.col("x")) / on(a, F.col("w")) for a in (0, 1)}
    v = {a: on(a, F.col("w") * F.col("x") ** 2) / on(a, F.col("w")) - m[a] ** 2 for a in (0, 1)}
    return long.where("x is not null").groupBy("covariate").agg(((m[1] - m[0]) / F.sqrt((v[1] + v[0]) / 2)).alias("smd"))


def divergence(a: DataFrame, b: DataFrame, item: str, n: str = "n") -> DataFrame:
    """(js, only_b): Jensen-Shannon divergence in bits of two count tables and the part of ``b`` that ``a`` never shows."""
    sums = [d.agg(F.sum(F.col(n).cast("double"))).first()[0] or 0.0 for d in (a, b)]
    both = a.select(item, F.col(n).cast("double").alias("x")).join(b.select(item, F.col(n).cast("double").alias("y")), item, "full")
    p, q = (F.coalesce(F.try_divide(F.col(c), F.lit(t)), F.lit(0.0)) for c, t in zip("xy", sums))
    m = (p + q) / 2
    term = F.when(p > 0, p * F.log2(p / m)).otherwise(0.0) / 2 + F.when(q > 0, q * F.log2(q / m)).otherwise(0.0) / 2
    return both.agg(F.sum(term).alias("js"), F.sum(F.when(p == 0, q).otherwise(0.0)).alias("only_b"))


def top_overlap(a: DataFrame, b: DataFrame, item: str, k: int, n: str = "n") -> DataFrame:
    """(overlap): part of the k most frequent items shared; ties by name."""
    top = lambda d: d.orderBy(F.desc(n), item).limit(k).select(item)
    return top(a).join(top(b), item).agg((F.count("*") / k).alias("overlap"))


def benjamini_hochberg(df: DataFrame, p: str, alpha: float) -> DataFrame:
    """``df`` with the adjusted value ``q`` and ``rejected``; a list of tests is small by nature and ranked in one window."""
    w = Window.orderBy(p)
    m = F.count("*").over(Window.partitionBy())
    ranked = df.withColumn("__k", F.rank().over(w) + F.count("*").over(Window.partitionBy(p)) - 1).withColumn("__m", m)
    raw = F.least(F.lit(1.0), F.col(p) * F.col("__m") / F.col("__k"))
    q = F.min(raw).over(Window.orderBy(F.desc(p)).rangeBetween(Window.unboundedPreceding, 0))
    return ranked.withColumn("q", q).withColumn("rejected", F.col("q") <= alpha).drop("__k", "__m")


def distinct_grams(df: DataFrame, array: str, n: int) -> DataFrame:
    """(distinct_n): distinct runs of n items over all runs."""
    at = F.explode(F.sequence(F.lit(1), F.size(array) - n + 1)).alias("i")
    grams = df.where(F.size(array) >= n).select(array, at).groupBy(F.slice(array, F.col("i"), F.lit(n)).alias("g")).agg(F.count("*").alias("n"))
    return grams.agg((F.count("*") / F.sum("n")).alias("distinct_n"))


def relative_effect(k1: Column, n1: Column, k0: Column, n0: Column, z: float = 1.959963984540054) -> tuple[Column, Column, Column]:
    """Risk ratio with the Katz interval; null where a count is 0."""
    rr = (k1 / n1) / (k0 / n0)
    se = F.sqrt(1 / k1 - 1 / n1 + 1 / k0 - 1 / n0)
    ok = (k1 > 0) & (k0 > 0)
    return F.when(ok, rr), F.when(ok, rr * F.exp(-z * se)), F.when(ok, rr * F.exp(z * se))


def e_value(rr: Column) -> Column:
    """Strength of confounding that could explain a risk ratio away."""
    r = F.when(rr < 1, 1 / rr).otherwise(rr)
    return r + F.sqrt(r * (r - 1))


def isotonic_ici(df: DataFrame, p: str = "p", y: str = "y") -> float:
    """Integrated calibration index: mean distance of the scores to their isotonic calibration. Equal scores are pooled first."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import IsotonicRegression

    pooled = df.where(F.col(p).isNotNull() & F.col(y).isNotNull()).groupBy(F.col(p).alias("p")).agg(F.avg(F.col(y).cast("double")).alias("label"), F.count("*").cast("double").alias("w"))
    rows = VectorAssembler(inputCols=["p"], outputCol="features").transform(pooled)
    fitted = IsotonicRegression(labelCol="label", weightCol="w").fit(rows).transform(rows)
    return fitted.agg(F.sum(F.abs(F.col("prediction") - F.col("p")) * F.col("w")) / F.sum("w")).first()[0]


def fit_temperature(df: DataFrame, logit: str, y: str, rounds: int = 60) -> float:
    """Temperature that minimises the log loss of logit / t, by golden section over an aggregated loss."""
    rows = df.groupBy(F.col(logit).alias("z")).agg(F.sum(y).cast("double").alias("k"), F.count("*").cast("double").alias("n"))

    def losses(ts: list[float]) -> list[float]:
        one = lambda t: F.sum(F.col("n") * F.log1p(F.exp(F.col("z") / t)) - F.col("k") * F.col("z") / t)
        return list(rows.agg(*[one(t) for t in ts]).first())

    lo, hi = math.log(0.05), math.log(20.0)
    for _ in range(6):  # eleven points a pass: six passes narrow it to 1e-4
        xs = [lo + (hi - lo) * i / 10 for i in range(11)]
        v = losses([math.exp(x) for x in xs])
        i = min(range(11), key=v.__getitem__)
        lo, hi = xs[max(0, i - 1)], xs[min(10, i + 1)]
    return math.exp((lo + hi) / 2)


def calibration_histogram(df: DataFrame, score: str, n_bins: int = 10) -> DataFrame:
    """(bin, n, expected, chi2): histogram of scores that are uniform if calibrated, with each bin's part of the chi-square statistic."""
    b = F.least(F.floor(F.col(score) * n_bins), F.lit(n_bins - 1))
    counts = df.where(F.col(score).between(0, 1)).groupBy(b.alias("bin")).agg(F.count("*").alias("n"))
    every = df.sparkSession.range(n_bins).withColumnRenamed("id", "bin").join(counts, "bin", "left").na.fill(0, ["n"])
    e = F.sum("n").over(Window.partitionBy()) / n_bins
    return every.withColumn("expected", e).withColumn("chi2", F.try_divide(F.pow(F.col("n") - F.col("expected"), F.lit(2.0)), F.col("expected")))


def clones(df: DataFrame, arm: str, at: str, arms: Sequence[str], grace: float) -> DataFrame:
    """One row per entity and arm: ``follows`` and, for clones that leave their arm, ``censored_at``.

    A clone follows its arm if the entity starts it within the grace period;
    it is censored when another arm starts, or at the end of grace without any.
    """
    cloned = df.withColumn("clone_arm", F.explode(F.array(*[F.lit(a) for a in arms])))
    within = F.coalesce(F.col(at) <= grace, F.lit(False))
    follows = within & (F.col(arm) == F.col("clone_arm"))
    return cloned.withColumn("follows", F.coalesce(follows, F.lit(False))).withColumn("censored_at", F.when(~F.col("follows"), F.when(within, F.col(at)).otherwise(F.lit(float(grace)))))


def censoring_weights(df: DataFrame, arm: str, at: str, censored: str) -> DataFrame:
    """``df`` with ``weight``: for rows that were not censored the inverse of the probability, within the arm, of staying uncensored until before their time; 0 for the others.

    The probabilities are those of the product-limit estimate; censoring at a
    time comes after the events of that time.
    """
    grid = df.groupBy(arm, at).agg(F.count("*").cast("double").alias("n"), F.count_if(censored).cast("double").alias("c"))
    total = grid.groupBy(F.col(arm).alias("__a")).agg(F.sum("n").alias("__all"))
    g = _prefix(grid, [arm], at, ["n"]).join(total, F.col(arm).eqNullSafe(F.col("__a"))).withColumn("h", F.col("c") / (F.col("__all") - F.col("before_n")))
    g = _prefix(g.select(arm, at, F.when(F.col("h") < 1, F.log1p(-F.col("h"))).otherwise(F.lit(-700.0)).alias("log")), [arm], at, ["log"])
    w = g.select(F.col(arm).alias("__a"), F.col(at).alias("__t"), F.exp(-F.col("before_log")).alias("__w"))
    joined = df.join(w, F.col(arm).eqNullSafe(F.col("__a")) & (F.col(at) == F.col("__t")))
    return joined.withColumn("weight", F.when(F.col(censored), 0.0).otherwise(F.col("__w"))).drop("__a", "__t", "__w")


def doubly_robust(df: DataFrame, outcome: str, follows: str, probability: str, prediction: str, groups: Sequence[str] = ()) -> DataFrame:
    """(groups, risk, se): augmented inverse probability risk from fitted columns, with the standard error of its scores."""
    score = F.col(prediction) + F.when(F.col(follows) == 1, (F.col(outcome) - F.col(prediction)) / F.col(probability)).otherwise(0.0)
    return df.groupBy(*groups).agg(F.avg(score).alias("risk"), (F.stddev_samp(score) / F.sqrt(F.count("*"))).alias("se"))


def folds(entity: Column, k: int, seed: int = 0) -> Column:
    """Fold of an entity, the same for all its rows."""
    return F.pmod(F.xxhash64(F.lit(seed), entity), F.lit(k)).cast("int")


def poisson_weight(*parts: Column) -> Column:
    """Poisson(1) draw from a hash of the parts."""
    u = F.pmod(F.xxhash64(*parts), F.lit(1 << 53)).cast("double") / float(1 << 53)
    total, p, weight = 0.0, math.exp(-1), F.lit(0)
    for k in range(8):  # inverse of the distribution function
        total += p / math.factorial(k)
        weight = weight + F.when(u >= total, 1).otherwise(0)
    return weight


def cluster_bootstrap(df: DataFrame, cluster: str, value: str, draws: int, seed: int = 0) -> DataFrame:
    """(draw, mean): means over draws that resample clusters, by Poisson(1) weights from a hash of cluster and draw, so nothing is gathered or shipped."""
    per = df.groupBy(F.col(cluster).alias("__c")).agg(F.sum(value).alias("s"), F.count(value).alias("n"))
    drawn = per.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).withColumn("w", poisson_weight(F.lit(seed), F.col("__c"), F.col("draw")))
    return drawn.groupBy("draw").agg(F.try_divide(F.sum(F.col("w") * F.col("s")), F.sum(F.col("w") * F.col("n"))).alias("mean"))


def cause_incidence(hazards: Column) -> Column:
    """Cumulative failure 1 - prod(1 - h) along an array of hazards."""
    return 1 - F.aggregate(hazards, F.lit(1.0), lambda a, h: a * (1 - h))


def any_of(probabilities: Column) -> Column:
    """Probability of at least one of independent events."""
    return 1 - F.aggregate(probabilities, F.lit(1.0), lambda a, p: a * (1 - p))


def all_of(probabilities: Column) -> Column:
    """Probability of all independent events."""
    return F.aggregate(probabilities, F.lit(1.0), lambda a, p: a * p)


def set_recall(observed: Column, generated: Column) -> Column:
    """Part of the distinct observed items that were generated; null without any."""
    n = F.size(F.array_distinct(observed))
    return F.when(n > 0, F.size(F.array_intersect(observed, generated)) / n)


def jaccard_distance(a: Column, b: Column) -> Column:
    n = F.size(F.array_union(a, b))
    return F.when(n > 0, 1 - F.size(F.array_intersect(a, b)) / n).otherwise(0.0)
