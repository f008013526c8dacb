"""Implausible readings of measured series (problem 2).

A *series* is one quantity of one source (a device run), ordered by time.
Three kinds of readings are reported:

* impossible: outside the physical range of the quantity;
* spikes: readings off the course of their series.  The course before and
  after a reading are the medians of its neighbours on that side, so a lasting
  step or a drift, which agrees with one side, leaves no residual, while an
  excursion of up to three readings disagrees with both.  What the series
  usually does at that hour of the day, its season, is taken off, and the rest
  divided by the series' own spread (from the median step between readings).
  The cutoff is set by peaks over threshold: a generalised Pareto tail, shape
  and scale, is fitted to the residuals of each series over their 90 %
  quantile and cut at a fixed risk per reading;
* stuck: stretches of one exact value that a series with this rate of
  repeats (the stretch itself left out) would show less often than a fixed
  risk.

The tail of a series of n readings is drawn towards the median series of its
quantity, in which every series counts once, however many readings it has: the
excursions of a short series are themselves its tail, and would raise its
cutoff over them.  Seasons are drawn towards none in the same way.

Scale: a series of more than 2 * MAX_SHARD readings is cut into shards of
about equal numbers of readings, by its own quantiles of time, so a burst is
spread like any other stretch.  A shard gets its neighbours' border readings as
a halo, so the windows give the same result as over the whole series;
stretches crossing shards are stitched from the outer stretches of each shard.
Readings are shuffled once, with their repeats collapsed, and staged; what
follows are aggregates with map-side partial results and joins with tables of
one row per series.  These are staged too, so that their size is known when a
join is planned: small ones are broadcast by the planner, others are not.

Defined results: null and NaN readings are skipped; readings without a source
or a time can only be impossible; other columns are ignored; the first and the
last reading of a series have no course on one side and are no spikes; a
repeated row is reported like its original; empty input gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventide.runtime import stage

SIDE = 7  # neighbours on each side; their median stands three outliers
MAX_SHARD = 4096
KNOTS = 256
RISK_SPIKE = 1e-4
RISK_STUCK = 1e-3
MIN_STUCK = 6
MIN_OTHERS = 10
SHRINK = 1 / RISK_SPIKE  # readings at which a series' own tail counts as much as the quantity's; in fewer, no reading is expected beyond the cutoff
SEASON_SHRINK = 30  # readings of one hour at which their mean counts by half
MAX_SHAPE = 0.5  # heavier tails have no variance
_RANKS = [0.6, 0.8, 0.9, 0.95]
_KEY = ["source", "field"]
_SHARD = [*_KEY, "shard"]
_HOUR = 3_600_000_000


def _sharded(readings: DataFrame) -> DataFrame:
    """Distinct ``readings`` with a shard number; series up to twice MAX_SHARD keep one shard.

    A row's place in its series is read off the time quantiles, linear between
    KNOTS of them.
    """
    large = stage(readings.groupBy(*_KEY).agg(F.count("*").alias("n")).where(F.col("n") > 2 * MAX_SHARD))
    ends = F.percentile_approx("t", [i / KNOTS for i in range(KNOTS + 1)], 10 * KNOTS)
    knots = stage(readings.join(large, _KEY).groupBy(*_KEY, "n").agg(ends.alias("knots")))
    i = F.least(F.greatest(F.size(F.filter("knots", lambda k: k <= F.col("t"))), F.lit(1)), F.lit(KNOTS))
    low, high = F.get("knots", i - 1), F.get("knots", i)
    place = (i - 1 + F.least(F.coalesce((F.col("t") - low) / F.nullif(high - low, F.lit(0)), F.lit(0.0)), F.lit(1.0))) / KNOTS
    shards = F.ceil(F.col("n") / MAX_SHARD)
    shard = F.greatest(F.least(F.floor(place * shards), shards - 1), F.lit(0))
    placed = readings.join(knots, _KEY, "left").select(*_KEY, "t", "v", F.coalesce(shard, F.lit(0)).cast("int").alias("shard"), F.col("n").isNotNull().alias("hot"))
    # partitioned like the windows to come, which then need no shuffle of their own
    return placed.repartition(*_SHARD).groupBy(*_SHARD, "hot", "t", "v").agg(F.lit(1).alias("one")).drop("one")


def _with_halo(readings: DataFrame) -> DataFrame:
    """Adds to each shard of a hot series the SIDE readings before and after it (``halo``)."""
    hot = readings.where("hot")
    first, last = Window.partitionBy(*_SHARD).orderBy("t", "v"), Window.partitionBy(*_SHARD).orderBy(F.desc("t"), F.desc("v"))
    one = F.struct("t", "v")
    ends = lambda w, name: hot.withColumn("r", F.row_number().over(w)).where(F.col("r") <= SIDE).groupBy(*_SHARD).agg(F.array_sort(F.collect_list(one)).alias(name))
    shards = ends(first, "head").join(ends(last, "tail"), _SHARD)
    w = Window.partitionBy(*_KEY).orderBy("shard")
    before = F.flatten(F.collect_list("tail").over(w.rowsBetween(-SIDE, -1)))
    after = F.flatten(F.collect_list("head").over(w.rowsBetween(1, SIDE)))
    near = shards.select(*_SHARD, before.alias("b"), after.alias("c"))
    near = near.select(*_SHARD, F.explode(F.concat(F.expr(f"slice(b, greatest(size(b) - {SIDE - 1}, 1), {SIDE})"), F.slice("c", 1, SIDE))).alias("x"))
    halo = near.select(*_SHARD, F.lit(True).alias("hot"), "x.t", "x.v", F.lit(True).alias("halo"))
    return readings.withColumn("halo", F.lit(False)).unionByName(halo)


def _median(a: Column) -> Column:
    s = F.sort_array(a)
    n = F.size(a)
    return F.when(n > 0, (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2)


def _neighbours(readings: DataFrame) -> DataFrame:
    """Per reading: distance to the course before and after it, step from the last reading, stretch number, hour of the day."""
    part = Window.partitionBy(*_SHARD).orderBy("t", "v")
    left = F.collect_list("v").over(part.rowsBetween(-SIDE, -1))
    right = F.collect_list("v").over(part.rowsBetween(1, SIDE))
    rows = _with_halo(readings).select("*", left.alias("l"), right.alias("r"), F.lag("v").over(part).alias("prev"))
    rows = rows.select(*_SHARD, "hot", "t", "v", (F.col("v") - _median(F.col("l"))).alias("a"), (F.col("v") - _median(F.col("r"))).alias("b"), F.abs(F.col("v") - F.col("prev")).alias("step"), "halo").where("not halo")
    fresh = F.when(F.col("step") == 0, 0).otherwise(1)
    hour = F.pmod(F.expr(f"t div {_HOUR}"), F.lit(24)).cast("int")
    return rows.select(*_SHARD, "hot", "t", "v", "a", "b", "step", hour.alias("hour"), F.sum(fresh).over(part.rowsBetween(Window.unboundedPreceding, 0)).alias("stretch"))


def _spreads(rows: DataFrame) -> DataFrame:
    """(source, field, n, k, scale, varies) of every series of n readings in k stretches."""
    # five quantiles of the step, over what noise of deviation 1 has there, stand rounding to few digits better than the median alone
    steps = F.aggregate(F.percentile_approx("step", [0.3, 0.4, 0.5, 0.6, 0.7], 500), F.lit(0.0), lambda a, x: a + x) / 4.896
    series = rows.groupBy(*_KEY).agg(steps.alias("m"), F.abs(F.avg("v")).alias("level"), F.count("*").alias("n"), F.count(F.when(F.coalesce(F.col("step"), F.lit(1.0)) != 0, 1)).alias("k"))
    scale = F.when(F.col("m") > 0, F.greatest(F.col("m"), F.col("level") * 0.001)).otherwise(F.greatest(F.col("level") * 0.02, F.lit(1e-9)))
    return series.select(*_KEY, "n", "k", scale.alias("scale"), F.coalesce(F.col("m") > 0, F.lit(False)).alias("varies"))


def _seasons(rows: DataFrame, spreads: DataFrame) -> DataFrame:
    """``spreads`` with ``season``: per hour of the day, in scales, what the series is off its course on average, outliers clipped."""
    off = (F.col("a") + F.col("b")) / 2 / F.col("scale")
    hours = rows.where("a is not null and b is not null").join(spreads, _KEY).groupBy(*_KEY, "hour").agg(F.sum(F.greatest(F.least(off, F.lit(2.0)), F.lit(-2.0))).alias("s"), F.count("*").alias("k"))
    season = hours.groupBy(*_KEY).agg(F.map_from_entries(F.collect_list(F.struct("hour", (F.col("s") / (F.col("k") + SEASON_SHRINK)).alias("s")))).alias("m"))
    by_hour = F.transform(F.sequence(F.lit(0), F.lit(23)), lambda h: F.coalesce(F.element_at("m", h), F.lit(0.0)))
    return spreads.join(season.select(*_KEY, by_hour.alias("season")), _KEY, "left")


def _residual() -> Column:
    """Signed distances to both courses less the season: the lesser one where they agree in sign, else 0; in scales."""
    s = F.coalesce(F.get("season", F.col("hour")), F.lit(0.0))
    a, b = F.col("a") / F.col("scale") - s, F.col("b") / F.col("scale") - s
    return F.when(a * b > 0, F.least(F.abs(a), F.abs(b))).otherwise(0.0)


def tail_cutoff(series: DataFrame, risk: float = RISK_SPIKE) -> DataFrame:
    """``series`` with ``shape``, ``spread`` and ``cut`` of a generalised Pareto tail of each of the rows (source, field, n, q, varies).

    ``q`` has the quantiles at _RANKS of the series' residuals.  The steps from
    the 60 to the 80 and the 90 % quantile, each halving the tail, give the
    shape, log2 of their ratio; excursions, which lie further out, leave it
    alone.  The spread follows from the 80 and 95 %.  Shapes stay within 0 and
    MAX_SHAPE: under 0 a tail would end, and readings rounded to few digits
    set that end among ordinary readings.  What n readings give weighs n
    against SHRINK of the field's, whose quantiles are medians over its series;
    series that do not vary have the field's.
    """
    ranks = range(len(_RANKS))
    typical = series.where("varies").groupBy("field").agg(F.array(*[F.percentile_approx(F.col("q")[i], 0.5, 10000) for i in ranks]).alias("f"))
    own = F.when(F.col("varies"), F.col("n") / (F.col("n") + SHRINK)).otherwise(0.0)

    def shape_of(q: Column) -> Column:
        return F.greatest(F.least(F.coalesce(F.log2((q[2] - q[1]) / F.nullif(q[1] - q[0], F.lit(0.0))), F.lit(0.0)), F.lit(MAX_SHAPE)), F.lit(0.0))

    pooled = series.join(typical, "field", "left").withColumn("shape", shape_of(F.col("q")) * own + shape_of(F.col("f")) * (1 - own))
    pooled = pooled.withColumn("p", F.array(*[F.col("q")[i] * own + F.col("f")[i] * (1 - own) for i in ranks])).drop("f")
    flat = F.col("shape") < 1e-6
    power = lambda x: F.pow(F.lit(x), F.col("shape"))
    # quantiles 80 and 95 % lie a factor 4 of the tail apart
    spread = (F.col("p")[3] - F.col("p")[1]) / F.when(flat, F.log(F.lit(4.0))).otherwise((power(2.0) - power(0.5)) / F.col("shape"))
    reach = F.when(flat, F.log(F.lit(0.1 / risk))).otherwise((power(0.1 / risk) - 1) / F.col("shape"))
    return pooled.withColumn("spread", spread).withColumn("cut", F.col("p")[2] + F.col("spread") * reach).drop("p")


def _chained(rows: DataFrame) -> DataFrame:
    """``rows`` with ``chain``, the shard and number of the stretch they belong to: a stretch no reading of its shard opened goes on from a shard before."""
    last = rows.where("hot").groupBy(*_SHARD).agg(F.max("stretch").alias("last"))
    opened = F.when(F.col("last") > 0, F.struct("shard", F.col("last").alias("stretch")))
    w = Window.partitionBy(*_KEY).orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    before = stage(last.select(*_SHARD, F.last(opened, ignorenulls=True).over(w).alias("before")))
    own = F.struct("shard", "stretch")
    return rows.join(before, _SHARD, "left").withColumn("chain", F.when(F.col("stretch") == 0, F.coalesce("before", own)).otherwise(own)).drop("before")


def _stuck(chained: DataFrame, series: DataFrame) -> DataFrame:
    """(source, field, chain) of stretches far longer than the series' rate of repeats gives."""
    # the readings that repeat the one before make a stretch one longer than they are
    long = chained.where("step = 0").groupBy(*_KEY, "chain").agg((F.count("*") + 1).alias("len")).where(F.col("len") >= MIN_STUCK).join(series, _KEY)
    p = (F.col("n") - F.col("k") - (F.col("len") - 1) + 0.5) / (F.col("n") - F.col("len") + 1)
    expected = F.log(F.col("n") * (1 - p)) + (F.col("len") - 1) * F.log(p)
    return long.where((F.col("n") - F.col("len") >= MIN_OTHERS) & (p < 1) & (expected < F.log(F.lit(RISK_STUCK)))).select(*_KEY, "chain")


def implausible(readings: DataFrame, limits: dict[str, tuple[float, float]]) -> DataFrame:
    """(record_id, field, reason) of the readings (record_id, source, field, t, v).

    ``t`` is in microseconds, ``v`` a double; ``limits`` gives the physical
    range of each field.
    """
    real = readings.select("record_id", "source", "field", "t", "v").where("v is not null and not isnan(v)").withColumn("v", F.round("v", 4))
    inside = F.lit(False)
    for field, (lo, hi) in limits.items():
        inside = inside | ((F.col("field") == field) & F.col("v").between(lo, hi))
    impossible = real.where(~inside).select("record_id", "field", F.lit("impossible").alias("reason"))
    placed = real.where(inside & F.col("source").isNotNull() & F.col("t").isNotNull())

    rows = stage(_neighbours(_sharded(placed.select(*_KEY, "t", "v"))))
    spreads = stage(_spreads(rows))
    seasons = stage(_seasons(rows, spreads))
    residuals = rows.join(seasons, _KEY).withColumn("off", _residual())
    tails = residuals.groupBy(*_KEY, "n", "varies").agg(F.percentile_approx("off", _RANKS, 500).alias("q"))
    cuts = stage(tail_cutoff(stage(tails)).select(*_KEY, "cut"))
    far = residuals.join(cuts, _KEY).where(F.col("off") > F.col("cut"))
    chained = _chained(rows)
    frozen = chained.join(stage(_stuck(chained, spreads)), [*_KEY, "chain"])
    cases = (
        far.select(*_KEY, "t", "v", F.lit("spike").alias("reason"))
        .unionByName(frozen.select(*_KEY, "t", "v", F.lit("stuck").alias("reason")))
        .groupBy(*_KEY, "t", "v")
        .agg(F.min("reason").alias("reason"))
    )
    flagged = placed.join(stage(cases), [*_KEY, "t", "v"]).select("record_id", "field", "reason")
    return flagged.unionByName(impossible)
