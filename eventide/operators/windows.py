"""Runs, episodes, trailing minima, sustained crossings.

What looks along the time of a key (the nearest earlier or later value, minima
of a trailing window) is done in time shards: each shard is ordered by itself
and gets from the shards beside it one carried value, so a key with a third of
all rows is many tasks, and every frame is a running one, linear in its rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def runs(df: DataFrame, key: Sequence[str], order: Sequence[str | Column], state: str, at: str) -> DataFrame:
    """Runs of one state: key.., run (from 1), state, n, first and last time, start of the next run."""
    w = Window.partitionBy(*key).orderBy(*order)
    new = (~F.col(state).eqNullSafe(F.lag(state).over(w)) | (F.row_number().over(w) == 1)).cast("int")
    numbered = df.withColumn("__new", new).withColumn("run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = numbered.groupBy(*key, "run").agg(F.first(state).alias(state), F.count("*").alias("n"), F.min(at).alias("first_at"), F.max(at).alias("last_at"))
    return out.withColumn("next_at", F.lead("first_at").over(Window.partitionBy(*key).orderBy("run")))


def stitch(run_rows: DataFrame, key: Sequence[str], max_gap_hours: float) -> DataFrame:
    """Episodes of runs that follow one another within the gap: key.., episode, runs, start and end."""
    w = Window.partitionBy(*key).orderBy("first_at", "last_at")
    gap = F.unix_micros("first_at") - F.unix_micros(F.max("last_at").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    new = F.when(gap <= int(max_gap_hours * 3_600_000_000), 0).otherwise(1)
    numbered = run_rows.withColumn("__new", new).withColumn("episode", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*key, "episode").agg(F.count("*").alias("n_runs"), F.min("first_at").alias("start_at"), F.max("last_at").alias("end_at"))


def after_first(df: DataFrame, key: Sequence[str], order: Sequence[str], event: Column, out: str = "after") -> DataFrame:
    """Flags rows from the first event on."""
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.sum(event.cast("int")).over(w) > 0)


def numbered(df: DataFrame, by: Sequence[str], shard: Column, order: Sequence[Column | str]) -> DataFrame:
    """``df`` with ``__i``, the place of a row in its group from 0, and ``__n``, the rows of the group.

    ``shard`` sorts no later than ``order`` does; rows are numbered within a
    shard and start from the counts of the shards before, so no task orders a
    whole group.
    """
    rows = df.withColumn("__shard", shard)
    counts = rows.groupBy(*by, "__shard").agg(F.count("*").alias("__k"))
    whole = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    ahead = whole.orderBy("__shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*[F.col(c).alias(f"__by_{c}") for c in by], F.col("__shard").alias("__s"), F.coalesce(F.sum("__k").over(ahead), F.lit(0)).alias("__start"), F.sum("__k").over(whole).alias("__n"))
    same = F.col("__shard").eqNullSafe(F.col("__s"))
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__by_{c}"))
    joined = rows.join(starts, same).drop(*[f"__by_{c}" for c in by], "__s")
    return joined.withColumn("__i", F.col("__start") + F.row_number().over(Window.partitionBy(*by, "__shard").orderBy(*order)) - 1).drop("__shard", "__start")


SHARDS_OF = 7 * 1440  # minutes


def nearest(df: DataFrame, key: Sequence[str], at: str, rank: str, *, earlier: dict[str, Column] | None = None, later: dict[str, Column] | None = None, width: int = SHARDS_OF) -> DataFrame:
    """``df`` with, per name, the last value that is not null at or before the row (``earlier``), or the first after it (``later``), in the order of (at, rank).

    A row sees itself among the earlier ones; where rows can share their place
    and rank, either may come first.  ``at`` is an integer.
    """
    earlier, later = earlier or {}, later or {}
    rows = df.withColumns({f"__{n}": c for n, c in {**earlier, **later}.items()}).withColumn("__shard", F.floor(F.col(at) / width))
    shard = [*key, "__shard"]
    place = F.struct(F.col(at), F.col(rank))
    ends = [F.max_by(f"__{n}", F.when(F.col(f"__{n}").isNotNull(), place)).alias(f"__{n}") for n in earlier] + [F.min_by(f"__{n}", F.when(F.col(f"__{n}").isNotNull(), place)).alias(f"__{n}") for n in later]
    outer = Window.partitionBy(*key)
    before = outer.orderBy("__shard").rowsBetween(Window.unboundedPreceding, -1)
    after = outer.orderBy(F.desc("__shard")).rowsBetween(Window.unboundedPreceding, -1)
    carry = rows.groupBy(*shard).agg(*ends).select(
        *shard, *[F.last(f"__{n}", ignorenulls=True).over(before).alias(f"__c_{n}") for n in earlier], *[F.last(f"__{n}", ignorenulls=True).over(after).alias(f"__c_{n}") for n in later]
    )
    inner = Window.partitionBy(*shard)
    up = inner.orderBy(at, rank).rowsBetween(Window.unboundedPreceding, 0)
    down = inner.orderBy(F.desc(at), F.desc(rank)).rowsBetween(Window.unboundedPreceding, -1)
    joined = rows.join(carry, shard, "left")
    found = {n: F.coalesce(F.last(f"__{n}", ignorenulls=True).over(up), f"__c_{n}") for n in earlier} | {n: F.coalesce(F.last(f"__{n}", ignorenulls=True).over(down), f"__c_{n}") for n in later}
    return joined.select(*df.columns, *[c.alias(n) for n, c in found.items()])


def _least_before(df: DataFrame, key: Sequence[str], minute: str, value: str, span: int, out: str) -> DataFrame:
    """``df`` with the least value from ``span`` minutes before a row to one minute before it.

    Time is cut into blocks of the span, so the window is the end of one block
    and the start of the next: the row asks both for a running minimum.
    """
    block = lambda m: F.floor(m / span)
    row = F.struct(*[F.col(c) for c in df.columns])
    m, kind = F.col(minute), df.schema[value].dataType
    readings = df.where(m.isNotNull()).select(*key, block(m).alias("__b"), m.alias("__m"), F.lit(0).alias("__ask"), F.col(value).alias("__v"), F.lit(None).cast(df.select(row.alias("r")).schema["r"].dataType).alias("__row"))
    # from its own place backwards in its block, and from the window's start onwards in the block before
    ask = lambda at, n: df.select(*key, block(at).alias("__b"), at.alias("__m"), F.lit(n).alias("__ask"), F.lit(None).cast(kind).alias("__v"), row.alias("__row"))
    both = readings.unionByName(ask(m, 1)).unionByName(ask(m - span, 2))
    w = Window.partitionBy(*key, "__b")
    past = w.orderBy(F.col("__m"), F.desc("__ask")).rowsBetween(Window.unboundedPreceding, 0)
    rest = w.orderBy(F.desc("__m"), F.col("__ask")).rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("__low", F.when(F.col("__ask") == 1, F.min("__v").over(past)).otherwise(F.min("__v").over(rest))).where("__ask > 0")
    return seen.groupBy("__row").agg(F.min("__low").alias("__low"), (F.count("*") / 2).cast("int").alias("__n")).select("__row.*", F.col("__low").alias(out), F.explode(F.sequence(F.lit(1), F.col("__n"))).alias("__i")).drop("__i")


def trailing_rise(df: DataFrame, key: Sequence[str], minute: str, value: str, *, absolute: float, absolute_minutes: int, relative: float, relative_minutes: int, out: str = "risen") -> DataFrame:
    """Flags values that rose by ``absolute`` over the least value of the last window, or to ``relative`` times that of the longer one; windows end a minute before."""
    low = _least_before(_least_before(df, key, minute, value, absolute_minutes, "__a"), key, minute, value, relative_minutes, "__r")
    rise = F.coalesce(F.col(value) - F.col("__a") >= absolute - 1e-9, F.lit(False))
    ratio = F.coalesce(F.col(value) >= F.col("__r") * relative - 1e-9, F.lit(False))
    return low.withColumn(out, rise | ratio).drop("__a", "__r")


def sustained(df: DataFrame, key: Sequence[str], minute: str, beyond: Column, *, readings: int, within: int) -> DataFrame:
    """First minute per key at which ``readings`` consecutive readings beyond the threshold span at most ``within`` minutes."""
    w = Window.partitionBy(*key).orderBy(minute)
    marked = df.withColumn("__b", F.coalesce(beyond, F.lit(False)))
    streak = F.sum((~F.col("__b")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    marked = marked.withColumn("__k", streak).where("__b")
    start = F.lag(minute, readings - 1).over(Window.partitionBy(*key, "__k").orderBy(minute))
    return marked.withColumn("__start", start).where(F.col(minute) - F.col("__start") <= within).groupBy(*key).agg(F.min(minute).alias("completed_min"))


def moving_count(df: DataFrame, key: Sequence[str], order: Sequence[str], item: str, width: int) -> DataFrame:
    """Per key the largest number of equal items in any ``width`` neighbouring rows."""
    pos = df.withColumn("__i", F.row_number().over(Window.partitionBy(*key).orderBy(*order)))
    w = Window.partitionBy(*key, item).orderBy("__i").rangeBetween(-(width - 1), 0)
    return pos.withColumn("__n", F.count("*").over(w)).groupBy(*key).agg(F.max("__n").alias("most_in_window"))


def first_per(df: DataFrame, key: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """First row of each key in the given order."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("__r = 1").drop("__r")


def latest_rows(df: DataFrame, key: Sequence[str], at: str) -> DataFrame:
    """All rows of the greatest time of each key."""
    return df.withColumn("__m", F.max(at).over(Window.partitionBy(*key))).where(F.col(at) == F.col("__m")).drop("__m")


def future_first(df: DataFrame, key: Sequence[str], minute: str, hit: Column) -> DataFrame:
    """Rows with ``next_hit_min``: the first later minute of the key at which ``hit`` holds (strictly later), else null."""
    hits = df.where(hit & F.col(minute).isNotNull()).select(*key, minute).distinct()
    row = F.struct(*[F.col(c) for c in df.columns])
    both = df.select(*key, F.col(minute), F.lit(1).alias("__side"), row.alias("__row")).unionByName(hits.withColumn("__side", F.lit(0)), allowMissingColumns=True)
    found = nearest(both, key, minute, "__side", later={"next_hit_min": F.when(F.col("__side") == 0, F.col(minute))})
    return found.where("__side = 1").select("__row.*", "next_hit_min")
