"""Attributes as known at event time (problem 1).

A version of an attribute has the time from which it holds and the time at
which it became known; it is usable from the later of both.  An event at t
gets, of its entity's versions usable at t, the one with the greatest
(valid time, known time, tie columns).  That is a running maximum over the
versions in order of usability, so the merge can start anywhere if it is given
the maximum so far.

Entities are cut into time shards: the best version of every shard is
aggregated before the shuffle, a running maximum over these few rows per
entity gives each shard its carry-in, and every shard is merged locally.  No
task holds a whole entity; a hot entity is spread over its shards.

Defined results: versions with a null entity, valid time, known time or value
are never used; events with a null entity or time get no value (and are kept
only by ``how='left'``); of versions equal in both times the greatest tie
column wins; repeated versions change nothing; repeated events each get
their row; empty tables give no values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SHARD_SECONDS = 7 * 86400


def known_at(
    events: DataFrame,
    versions: DataFrame,
    *,
    entity: str,
    at: str,
    valid_from: str,
    known_from: str,
    value: str,
    tie: str,
    how: str = "inner",
    shard_seconds: int = SHARD_SECONDS,
) -> DataFrame:
    """``events`` with ``value`` as known at their time ``at``.

    ``events`` and ``versions`` both have the column ``entity``; a column of
    ``events`` named like ``value`` is replaced.
    """
    events = events.drop(value)
    width = shard_seconds * 1_000_000
    usable = F.unix_micros(F.greatest(valid_from, known_from))
    version = F.struct(
        F.unix_micros(valid_from).alias("v"), F.unix_micros(known_from).alias("k"), F.col(tie).alias("t"), F.col(value).alias("x")
    )
    known = (
        versions.where(F.col(entity).isNotNull() & F.col(valid_from).isNotNull() & F.col(known_from).isNotNull() & F.col(value).isNotNull())
        .select(F.col(entity).alias("__id"), usable.alias("__t"), version.alias("__v"))
        .withColumn("__shard", F.expr(f"__t - pmod(__t, {width}L)"))
    )
    row = F.struct(*[F.col(c) for c in events.columns])
    asked = (
        events.where(F.col(entity).isNotNull() & F.col(at).isNotNull())
        .select(F.col(entity).alias("__id"), F.unix_micros(at).alias("__t"), row.alias("__row"))
        .withColumn("__shard", F.expr(f"__t - pmod(__t, {width}L)"))
    )
    # carry-in of every shard: the best version usable before it
    best = known.groupBy("__id", "__shard").agg(F.max("__v").alias("__v"))
    needed = asked.groupBy("__id", "__shard").agg(F.first(F.lit(None).cast(best.schema["__v"].dataType)).alias("__v"))
    ahead = Window.partitionBy("__id").orderBy("__shard").rangeBetween(Window.unboundedPreceding, -1)
    carry = (
        best.unionByName(needed)
        .groupBy("__id", "__shard")
        .agg(F.max("__v").alias("__v"))
        .withColumn("__v", F.max("__v").over(ahead))
        .where("__v is not null")
        .withColumn("__t", F.col("__shard"))
    )
    # merge: carry-in and versions before the events of the same instant
    left = known.unionByName(carry).select("__id", "__shard", "__t", F.lit(0).alias("__side"), "__v", F.lit(None).cast(asked.schema["__row"].dataType).alias("__row"))
    right = asked.select("__id", "__shard", "__t", F.lit(1).alias("__side"), F.lit(None).cast(best.schema["__v"].dataType).alias("__v"), "__row")
    w = Window.partitionBy("__id", "__shard").orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, 0)
    merged = left.unionByName(right).withColumn("__best", F.max("__v").over(w)).where("__side = 1")
    out = merged.select("__row.*", F.col("__best.x").alias(value))
    if how == "inner":
        return out.where(F.col(value).isNotNull())
    unplaced = events.where(F.col(entity).isNull() | F.col(at).isNull())
    return out.unionByName(unplaced.withColumn(value, F.lit(None).cast(out.schema[value].dataType)))
