"""Merged periods and gaps of overlapping intervals per entity (problem 4).

Two levels, so that no task ever holds one entity whole:

1. every interval goes to the time shard of its start; intervals of one start
   are pre-aggregated to their latest end before the shuffle.  What reaches
   over a shard's end is clipped off and comes back as coverage: each shard is
   told the latest end of all shards before it, a running maximum over one row
   per shard.  Each (entity, shard) is then merged on its own, coverage first;
2. only the last merged piece of a shard, and one that goes on from coverage,
   can touch another shard, so at most two rows per shard go to the stitching
   pass, which coalesces them.  All other periods are final after level one,
   and so are all gaps, as a piece knows where coverage before it ended.

A hot entity is spread over as many tasks as it has shards, and a shard holds
at most one row per distinct start.  An interval is one row however far its end
lies.

Defined results: rows with a null entity, a null bound, or an end not after
the start take no part; repeated rows change nothing; touching intervals form
one period; an empty input gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SHARD_US = 7 * 86_400_000_000


def _sharded(df: DataFrame, entity: str, start: str, end: str, width: int) -> DataFrame:
    """Intervals (__id, __shard, s, e), one latest end per start, with ``__reach``, the latest end of the shards before."""
    rows = df.select(F.col(entity).alias("__id"), F.col(start).cast("bigint").alias("s"), F.col(end).cast("bigint").alias("e"))
    rows = rows.where("__id is not null and e > s")  # null bounds compare as unknown
    pieces = rows.withColumn("__shard", F.expr(f"s - pmod(s, {width}L)")).groupBy("__id", "__shard", "s").agg(F.max("e").alias("e"))
    ahead = Window.partitionBy("__id").orderBy("__shard").rowsBetween(Window.unboundedPreceding, -1)
    reach = pieces.groupBy("__id", "__shard").agg(F.max("e").alias("__end")).select("__id", "__shard", F.max("__end").over(ahead).alias("__reach"))
    return pieces.join(reach, ["__id", "__shard"])


def _merge(pieces: DataFrame) -> DataFrame:
    """Islands (__id, __shard, s, e, before, goes_on, last): ``before`` is where coverage ended before them, null if there was none."""
    w = Window.partitionBy("__id", "__shard").orderBy("s")
    before = F.greatest("__reach", F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    seen = pieces.withColumn("__before", before)
    opened = seen.withColumn("__new", F.when(F.col("__before") >= F.col("s"), 0).otherwise(1))
    numbered = opened.withColumn("__n", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    islands = numbered.groupBy("__id", "__shard", "__n").agg(F.min("s").alias("s"), F.max("e").alias("e"), F.min_by("__before", "s").alias("before"))
    after = F.lead("__n").over(Window.partitionBy("__id", "__shard").orderBy("__n"))
    return islands.select("__id", "s", "e", "before", (F.col("__n") == 0).alias("goes_on"), after.isNull().alias("last"))


def periods_and_gaps(df: DataFrame, entity: str, start: str, end: str, shard_us: int = SHARD_US) -> DataFrame:
    """(entity, kind 'period' or 'gap', start_us, end_us); bounds are microseconds since 1970 UTC."""
    islands = _merge(_sharded(df, entity, start, end, shard_us))
    # one row per island and kind: gaps and inner periods are final, outer islands go on to be stitched
    edge = F.col("goes_on") | F.col("last")
    kinds = F.array(
        F.when(~F.col("goes_on") & F.col("before").isNotNull(), F.struct(F.lit("gap").alias("kind"), F.col("before").alias("a"), F.col("s").alias("b"))),
        F.struct(F.when(edge, "edge").otherwise("period").alias("kind"), F.col("s").alias("a"), F.col("e").alias("b")),
    )
    parts = islands.select("__id", "goes_on", F.explode(F.filter(kinds, lambda x: x.isNotNull())).alias("x")).select("__id", "goes_on", "x.*")
    by = Window.partitionBy("__id").orderBy("a").rowsBetween(Window.unboundedPreceding, 0)
    chains = parts.where("kind = 'edge'").withColumn("__n", F.sum(F.when(F.col("goes_on"), 0).otherwise(1)).over(by))
    outer = chains.groupBy("__id", "__n").agg(F.min("a").alias("a"), F.max("b").alias("b")).select("__id", F.lit("period").alias("kind"), "a", "b")
    inner = parts.where("kind <> 'edge'").select("__id", "kind", "a", "b")
    return inner.unionByName(outer).select(F.col("__id").alias(entity), "kind", F.col("a").alias("start_us"), F.col("b").alias("end_us"))
