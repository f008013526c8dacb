"""Outcome labels at an anchor, first causes, time shares and leak checks."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventide.operators.windows import nearest


def incident(stays: DataFrame, observations: DataFrame, key: str, *, anchor: str, end: str, at: str, value: str, tie: str, beyond: Callable[[Column], Column], lookback_hours: int, min_readings: int) -> DataFrame:
    """(key, status, after_min) of an outcome at each stay's anchor, in one aggregation per stay.

    censored: the stay ends by the anchor; prevalent: the last value of the
    lookback is beyond the threshold; positive: a later value is, up to the
    end; not_ascertainable: fewer than ``min_readings`` later values; else
    negative.  ``stays`` has one row per key.
    """
    both = stays.join(observations, key, "left")
    t, v, a = F.col(at), F.col(value), F.col(anchor)
    recent = (t <= a) & (t >= a - F.make_dt_interval(F.lit(0), F.lit(lookback_hours)))
    later = (t > a) & (t <= F.col(end))
    g = both.groupBy(key, anchor, end).agg(
        F.max_by(F.when(recent, v), F.when(recent, F.struct(at, tie))).alias("last"), F.min(F.when(later & beyond(v), t)).alias("hit"), F.count(F.when(later, 1)).alias("n")
    )
    status = (
        F.when(F.col(end) <= a, "censored").when(F.coalesce(beyond(F.col("last")), F.lit(False)), "prevalent").when(F.col("hit").isNotNull(), "positive")
        .when(F.col("n") < min_readings, "not_ascertainable").otherwise("negative")
    )
    return g.withColumn("status", status).select(key, "status", F.when(F.col("status") == "positive", F.expr(f"(unix_micros(hit) - unix_micros({anchor})) div 60000000")).alias("after_min"))


def first_cause(df: DataFrame, causes: Sequence[str], last: str) -> DataFrame:
    """``df`` with ``cause`` (number of the earliest of the cause times, the earlier named on a tie; 0: none) and its time ``at``."""
    ranked = F.array_min(F.filter(F.array(*[F.struct(F.col(c).alias("t"), F.lit(i + 1).alias("c")) for i, c in enumerate(causes)]), lambda x: x["t"].isNotNull()))
    return df.withColumn("__f", ranked).withColumn("cause", F.coalesce("__f.c", F.lit(0))).withColumn("at", F.coalesce("__f.t", last)).drop("__f")


def leaks(df: DataFrame, entity: str, part: str) -> DataFrame:
    """Entities in more than one partition."""
    return df.where(F.col(entity).isNotNull()).groupBy(entity).agg(F.count_distinct(part).alias("partitions")).where("partitions > 1")


def time_share(df: DataFrame, key: str, at: str, ties: Sequence[str], condition: Column) -> DataFrame:
    """(key, share): part of the time between first and last row during which the condition held, each row standing until the next."""
    w = Window.partitionBy(key).orderBy(at, *ties)
    spans = df.withColumn("__d", F.lead(at).over(w) - F.col(at)).where("__d is not null")
    return spans.groupBy(key).agg(F.sum(F.when(condition, F.col("__d")).otherwise(0)).alias("x"), F.sum("__d").alias("all")).where(F.col("all") > 0).select(key, F.round(F.col("x") / F.col("all"), 9).alias("share"))


def _nearest_readings(anchors: DataFrame, readings: DataFrame, key: str, beyond: Column) -> DataFrame:
    """(key, m, now, next, later) of every anchor m: whether the last minute up to it is beyond, and the minutes of the next hit and the next reading."""
    minute = readings.where(F.col("minute").isNotNull()).groupBy(key, "minute").agg(F.max(F.coalesce(beyond, F.lit(False)).cast("int")).alias("hit"))
    both = minute.select(key, F.col("minute").alias("m"), F.lit(0).alias("side"), "hit").unionByName(
        anchors.where(F.col("anchor_min").isNotNull()).select(key, F.col("anchor_min").alias("m"), F.lit(1).alias("side")).distinct(), allowMissingColumns=True
    )
    read = F.col("side") == 0
    seen = nearest(both, [key], "m", "side", earlier={"now": F.when(read, F.col("hit"))}, later={"next": F.when(read & (F.col("hit") == 1), F.col("m")), "later": F.when(read, F.col("m"))})
    return seen.where("side = 1").drop("side", "hit")


def at_anchors(anchors: DataFrame, readings: DataFrame, key: str, beyond: Column, *, horizon_min: int | None = None) -> DataFrame:
    """Labels of many anchors per entity: anchors (key, anchor_min), readings (key, minute, ..).

    prevalent: the last minute up to the anchor has a reading beyond;
    positive: a strictly later minute (within the horizon) has one; negative:
    there are later readings; censored: there are none.  Both sides are
    united in time shards, and an anchor looks up the nearest reading before
    it and the nearest reading and hit after it, so anchors never multiply
    readings.
    """
    seen = _nearest_readings(anchors, readings, key, beyond)
    within = lambda c: F.coalesce(F.col(c).isNotNull() & (F.lit(True) if horizon_min is None else F.col(c) <= F.col("m") + horizon_min), F.lit(False))
    status = F.when(F.col("now") == 1, "prevalent").when(within("next"), "positive").when(within("later"), "negative").otherwise("censored")
    return seen.select(key, F.col("m").alias("anchor_min"), status.alias("status"), F.when(status == "positive", F.col("next") - F.col("m")).alias("after_min"))


def stream_labels(anchors: DataFrame, readings: DataFrame, ends: DataFrame, key: str, beyond: Column, *, horizon_min: int) -> DataFrame:
    """(key, anchor_min, status, after_min) of anchors in a stream that ends at each entity's ``end_min``.

    ended: the stream ends by the anchor; prevalent: the last minute up to the
    anchor has a reading beyond; positive: a later one within horizon and
    stream has; not_ascertainable: there is no later reading there; censored:
    the stream ends before the horizon; negative: else.  Entities without an
    end have no labels.
    """
    found = _nearest_readings(anchors, readings, key, beyond).join(ends.select(key, "end_min"), key)
    last = F.least(F.col("m") + horizon_min, F.col("end_min"))
    within = lambda c: F.coalesce(F.col(c) <= last, F.lit(False))
    status = (
        F.when(F.col("end_min") <= F.col("m"), "ended").when(F.col("now") == 1, "prevalent").when(within("next"), "positive")
        .when(~within("later"), "not_ascertainable").when(F.col("end_min") < F.col("m") + horizon_min, "censored").otherwise("negative")
    )
    return found.select(key, F.col("m").alias("anchor_min"), status.alias("status"), F.when(status == "positive", F.col("next") - F.col("m")).alias("after_min"))


def task_states(stays: DataFrame, observations: DataFrame, key: str, tasks: dict[str, Sequence[tuple[str, str, float]]]) -> DataFrame:
    """``stays`` (key, anchor, end; one row per key) with a status per task: any of its (concept, '>' or '<', threshold) up to or after the anchor.

    not_at_risk: the stay ends by the anchor; prevalent: beyond a threshold by
    then; positive: later, up to the end; negative: measured later, never
    beyond; not_ascertainable: not measured later.  One aggregation serves all
    tasks.
    """
    both = stays.select(key, "anchor", "end").join(observations.select(key, "at", "concept", "value"), key, "left")
    before, after = F.col("at") <= F.col("anchor"), (F.col("at") > F.col("anchor")) & (F.col("at") <= F.col("end"))
    any_ = lambda conditions: F.coalesce(F.bool_or(reduce(lambda a, b: a | b, conditions)), F.lit(False))
    hit = lambda c, op, x: (F.col("concept") == c) & ((F.col("value") > x) if op == ">" else (F.col("value") < x))
    sums = [x for t, rules in tasks.items() for x in (
        any_([before & hit(*r) for r in rules]).alias(f"__p_{t}"), any_([after & hit(*r) for r in rules]).alias(f"__q_{t}"), any_([after & (F.col("concept") == r[0]) for r in rules]).alias(f"__s_{t}"),
    )]
    g = both.groupBy(key).agg(F.bool_or(F.col("end") <= F.col("anchor")).alias("__gone"), *sums)
    state = lambda t: F.when(F.col("__gone"), "not_at_risk").when(F.col(f"__p_{t}"), "prevalent").when(F.col(f"__q_{t}"), "positive").when(F.col(f"__s_{t}"), "negative").otherwise("not_ascertainable")
    return g.select(key, *[state(t).alias(t) for t in tasks])


def sample_anchors(readings: DataFrame, key: str, per_entity: int, seed: int) -> DataFrame:
    """(key, anchor_min): at most ``per_entity`` distinct minutes per entity, in order of a seeded SHA-256, so they depend on nothing else."""
    rank = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(key), F.col("minute").cast("string")), 256)
    w = Window.partitionBy(key).orderBy(rank, "minute")
    return readings.select(key, "minute").where("minute is not null").distinct().withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= per_entity).select(key, F.col("minute").alias("anchor_min"))


def resolve_window(df: DataFrame, events: Sequence[str], followup: str, horizon: float) -> DataFrame:
    """``df`` with ``outcome`` and ``at`` of a right-closed window: the earliest event within the horizon (in the order given on a tie), else 'event_free' at the horizon, else 'censored' at the end of follow-up."""
    first = F.array_min(F.filter(F.array(*[F.struct(F.col(e).alias("t"), F.lit(i).alias("i"), F.lit(e).alias("e")) for i, e in enumerate(events)]), lambda x: x["t"] <= horizon))
    reached = F.col(followup) >= horizon
    out = df.withColumn("__f", first)
    return out.withColumn("outcome", F.coalesce("__f.e", F.when(reached, "event_free").otherwise("censored"))).withColumn("at", F.coalesce("__f.t", F.when(reached, F.lit(float(horizon))).otherwise(F.col(followup)))).drop("__f")
