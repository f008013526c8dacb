"""Melt, transitions, carried state, duplicates, aligned arrays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventide.functions.numbers import finite


def melt(df: DataFrame, ids: Sequence[str], columns: Sequence[str], *, concept: str = "concept", value: str = "value", kind: str = "double", qualifier: Column | None = None) -> DataFrame:
    """One row per filled cell: ids, concept (lower-case column name, after the qualifier if one is given; 'unknown' where it is null), value.

    Null cells, and NaN in numeric melts, are dropped.
    """
    cast = df.select(*ids, *([qualifier.alias("__q")] if qualifier is not None else []), *[F.col(c).cast(kind).alias(c) for c in columns])
    keep = [*ids, *(["__q"] if qualifier is not None else [])]
    long = cast.unpivot(keep, list(columns), "__c", value).where(F.col(value).isNotNull())
    if kind in ("double", "float"):
        long = long.where(~F.isnan(value))
    name = F.lower("__c")
    if qualifier is not None:
        name = F.concat(F.coalesce("__q", F.lit("unknown")), F.lit("_"), name)
    return long.select(*ids, name.alias(concept), value)


def transitions(df: DataFrame, key: Sequence[str], at: str, state: str) -> DataFrame:
    """First row and every row whose state differs from the one before, in order of (time, state)."""
    w = Window.partitionBy(*key).orderBy(F.col(at).asc_nulls_last(), F.col(state).asc_nulls_last())
    return df.withColumn("__p", F.lag(state).over(w)).where(F.col("__p").isNull() | ~F.col("__p").eqNullSafe(F.col(state))).drop("__p")


def state_at_start(states: DataFrame, stays: DataFrame, key: str, at: str, start: str, end: str) -> DataFrame:
    """States of an entity placed on its stays: all rows of the latest time up to the start, moved to it, and every later row up to the end."""
    both = states.join(stays, key).where(F.col(at) <= F.col(end))
    early = F.col(at) <= F.col(start)
    last = F.max(F.when(early, F.col(at))).over(Window.partitionBy(*[c for c in stays.columns]))
    placed = both.withColumn("__last", last).where(~early | (F.col(at) == F.col("__last")))
    return placed.withColumn("placed_at", F.greatest(at, start)).drop("__last")


def carry_forward(events: DataFrame, stays: DataFrame, key: str, at: str, concept: str, start: str, order: Sequence[str]) -> DataFrame:
    """Last event of each (entity, concept) before the start, moved to the start, with the events from the start on."""
    both = events.join(stays.select(key, start), key)
    before = both.where(F.col(at) < F.col(start))
    rank = F.struct(F.col(at), *[x for c in order for x in (F.col(c).isNull(), F.col(c))])
    cols = [c for c in events.columns if c != at]
    last = before.groupBy(key, concept, start).agg(F.max_by(F.struct(*cols), rank).alias("r"))
    moved = last.select("r.*", F.col(start).alias(at)).select(*events.columns)
    return moved.unionByName(both.where(F.col(at) >= F.col(start)).select(*events.columns))


def drop_shadowed(df: DataFrame, match: Sequence[str], category: str, drop: str, keep: str) -> DataFrame:
    """Without the rows of category ``drop`` that equal, null for null, a row of category ``keep`` in the match columns; the join is on equality only."""
    kept = df.where(F.col(category) == keep).select(*[F.col(c).alias(f"__{c}") for c in match]).distinct()
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in match]
    on = same[0]
    for s in same[1:]:
        on = on & s
    shadowed = df.where(F.col(category) == drop).join(kept, on, "left_anti")
    return df.where(~F.col(category).eqNullSafe(F.lit(drop))).unionByName(shadowed)


def explode_aligned(df: DataFrame, keys: Sequence[str], arrays: Sequence[str]) -> DataFrame:
    """One row per position of parallel arrays, with the position from 0."""
    zipped = df.select(*keys, F.posexplode(F.arrays_zip(*arrays)).alias("pos", "x"))
    return zipped.select(*keys, "pos", *[F.col(f"x.{a}").alias(a) for a in arrays])


def not_testable(events: DataFrame, *, verbal: str, eye: str, motor: str, total: str, codes: Sequence[str], numbers: Sequence[float], bands: Sequence[tuple[float, float, float]], value: str = "not_testable", marker: str = "total_source") -> DataFrame:
    """Events (hosp_id, dttm, concept, value, cat_value, ..) with scores that could not be tested made plain.

    A verbal score of one of the codes or numbers becomes the category
    ``value``.  A total charted then is no score: it is replaced by eye + motor
    + the verbal score that the bands (lo, hi of eye + motor, verbal) impute,
    and told by a marker event 'imputed' at that time; where eye and motor do
    not each have one value then, or no band holds their sum, it is dropped.
    """
    is_ = lambda c: F.col("concept") == c
    folded = F.regexp_replace(F.lower(F.trim("cat_value")), r"[\s_]+", "_")
    untested = F.coalesce(is_(verbal) & (F.coalesce(F.col("value").isin(*numbers), F.lit(False)) | F.coalesce(folded.isin(*codes), F.lit(False))), F.lit(False))
    of = lambda c: F.when(is_(c) & finite(F.col("value")), F.col("value"))
    one = lambda c: F.when(F.min(of(c)) == F.max(of(c)), F.min(of(c)))
    at = events.where(is_(verbal) | is_(eye) | is_(motor)).groupBy("hosp_id", "dttm").agg(F.bool_or(untested).alias("__u"), (one(eye) + one(motor)).alias("__em")).where("__u")
    band = F.lit(None).cast("double")
    for lo, hi, score in reversed(bands):
        band = F.when(F.col("__em").between(lo, hi), float(score)).otherwise(band)
    marked = events.withColumn("__nt", untested).join(at.select("hosp_id", "dttm", "__u", (F.col("__em") + band).alias("__total")), ["hosp_id", "dttm"], "left")
    replaced = is_(total) & F.col("__u")
    kept = marked.where(~F.coalesce(replaced & F.col("__total").isNull(), F.lit(False)))
    clean = kept.withColumn("value", F.when(F.col("__nt"), None).when(replaced, F.col("__total")).otherwise(F.col("value"))).withColumn("cat_value", F.when(F.col("__nt"), value).otherwise(F.col("cat_value")))
    marks = marked.where(replaced & F.col("__total").isNotNull()).select("hosp_id", "dttm").distinct().withColumn("concept", F.lit(marker)).withColumn("cat_value", F.lit("imputed"))
    return clean.drop("__nt", "__u", "__total").unionByName(marks, allowMissingColumns=True)
