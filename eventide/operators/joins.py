"""Window, as-of, semi and anti joins on keys; ranges are residuals of an equality join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventide.operators.windows import SHARDS_OF, nearest


def in_window(events: DataFrame, stays: DataFrame, key: str, at: str, lo: str, hi: str) -> DataFrame:
    """Events of the stays with lo <= time <= hi, plus ``pos_min``, the whole minutes from lo."""
    near = events.join(stays.select(key, lo, hi), key).where(F.col(at).between(F.col(lo), F.col(hi)))
    return near.withColumn("pos_min", F.timestamp_diff("MINUTE", lo, at))


def keep_ids(df: DataFrame, ids: DataFrame | None, column: str) -> DataFrame:
    """Rows whose id is listed; None keeps all, an empty list keeps none."""
    return df if ids is None else df.join(ids.select(column).distinct(), column, "left_semi")


def asof(left: DataFrame, right: DataFrame, key: str, at: str, right_at: str, value: str, *, strict: bool = False, out: str | None = None) -> DataFrame:
    """``left`` with the value of the latest right row of its key at or before (``strict``: before) its time.

    Right rows of one key and time are averaged first.  The two sides are
    united in time shards, and the last value of the shards before is carried
    into each, so no range join is made and no task sees a whole key.
    """
    out = out or value
    r = right.where(F.col(key).isNotNull() & F.col(right_at).isNotNull() & F.col(value).isNotNull()).groupBy(key, F.unix_micros(right_at).alias("__t")).agg(F.avg(value).alias("__v"))
    row = F.struct(*[F.col(c) for c in left.columns]).alias("__row")
    sides = left.select(F.col(key), F.unix_micros(at).alias("__t"), F.lit(0 if strict else 1).alias("__s"), row)
    marks = r.select(key, "__t", F.lit(1 if strict else 0).alias("__s"), "__v")
    placed = nearest(sides.where(F.col(key).isNotNull() & F.col("__t").isNotNull()).unionByName(marks, allowMissingColumns=True), [key], "__t", "__s", earlier={"__x": F.col("__v")}, width=SHARDS_OF * 60_000_000)
    lost = sides.where(F.col(key).isNull() | F.col("__t").isNull()).select("__row", F.lit(None).cast(r.schema["__v"].dataType).alias("__x"))
    return placed.where("__row is not null").select("__row", "__x").unionByName(lost).select("__row.*", F.col("__x").alias(out))


def latest_before(left: DataFrame, right: DataFrame, key: str, at: str, right_at: str, values: Sequence[str], lookback_hours: float | None = None) -> DataFrame:
    """``left`` with the values of the last right row strictly before its time, within the lookback; of one time the greatest values win.

    ``left`` has one row per key.
    """
    near = right.select(key, right_at, *values).join(left.select(key, at), key).where(F.col(right_at) < F.col(at))
    if lookback_hours is not None:
        near = near.where(F.unix_micros(at) - F.unix_micros(right_at) <= int(lookback_hours * 3_600_000_000))
    best = near.groupBy(key).agg(F.max(F.struct(right_at, *values)).alias("__b"))
    return left.join(best, key, "left").select(*left.columns, *[F.col(f"__b.{v}").alias(v) for v in values])


def lists_per_key(left: DataFrame, right: DataFrame, key: str, columns: Sequence[str], out: str) -> DataFrame:
    """``left`` with the sorted list of the right rows of its key; an empty list without any."""
    item = F.struct(*columns)
    lists = right.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias(out))
    kind = lists.schema[out].dataType
    return left.join(lists, key, "left").withColumn(out, F.coalesce(out, F.array().cast(kind)))


def previous_stay(stays: DataFrame, entity: str, start: str, end: str) -> DataFrame:
    """``stays`` with ``prior_end``: the latest end of a stay of the entity that ended before this start.

    The ends of an entity are in order, so the latest one before a start is
    the nearest.
    """
    ends = stays.where(F.col(entity).isNotNull() & F.col(end).isNotNull()).select(entity, F.unix_micros(end).alias("__t")).distinct()
    row = F.struct(*[F.col(c) for c in stays.columns]).alias("__row")
    asked = stays.select(entity, F.unix_micros(start).alias("__t"), F.lit(0).alias("__s"), row)
    both = asked.where(F.col(entity).isNotNull() & F.col("__t").isNotNull()).unionByName(ends.withColumn("__s", F.lit(1)), allowMissingColumns=True)
    found = nearest(both, [entity], "__t", "__s", earlier={"__x": F.when(F.col("__s") == 1, F.col("__t"))}, width=SHARDS_OF * 60_000_000 * 52).where("__s = 0")
    lost = asked.where(F.col(entity).isNull() | F.col("__t").isNull()).select("__row", F.lit(None).cast("bigint").alias("__x"))
    return found.select("__row", "__x").unionByName(lost).select("__row.*", F.timestamp_micros("__x").alias("prior_end"))
