"""Splits that keep related records together (problem 6).

Records that share any entity belong together.  Every entity id is a node; a
record ties its first node, its *head*, to its other nodes.  A node that only
one head names is a leaf and settled with it, so an aggregate by node, with
map-side minimum and maximum of the heads, leaves the few nodes that tie
heads.  On these, connected components are found by alternating large-star and
small-star steps, which only ever join an edge list with its own minima: no
step gathers a node's neighbours, so a node tied to a third of all records
costs a pre-aggregated minimum and a join that adaptive skew handling splits.
Each round is staged in the shared folder and compared with the last one by a
count and a checksum, the only values that reach the driver; the rounds before
are deleted.

A component's smallest head, hashed with a seed, picks a split from ranges of
the given proportions, so a component never moves when others come or go.

Ids that identify nothing (placeholders) are found by what they tie: the ids of
one written form, letters and digits aside, are placeholders if most of them
tie two or more entities.

Defined results: null ids and placeholders tie nothing; a record with no usable
id is a component of its own, hashed by its columns; repeated records get the
same split; a giant component goes to one split whole, even where that breaks
the proportions (see ``shares``); an empty table gives no rows; columns named
component and split are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventide.runtime import drop_stage, stage

MAX_ROUNDS = 60


def without_placeholders(df: DataFrame, column: str, entity: str) -> DataFrame:
    """``df`` with the ids of ``column`` that identify nothing set to null."""
    form = F.regexp_replace(F.regexp_replace(F.upper(column), "[A-Z]", "A"), "[0-9]", "9")
    ties = df.where(F.col(column).isNotNull()).groupBy(column).agg((F.min(entity) < F.max(entity)).alias("ties"))
    empty = ties.groupBy(form.alias("__form")).agg(F.count("*").alias("n"), F.count_if("ties").alias("k")).where("2 * k > n").select("__form")
    kept = df.withColumn("__form", form).join(empty.withColumn("__empty", F.lit(True)), "__form", "left")
    return kept.withColumn(column, F.when(F.col("__empty").isNull(), F.col(column))).select(df.columns)


def nodes(record_ids: dict[str, Column]) -> Column:
    """Array of the nodes a record names; ``record_ids`` maps a kind to its id column (null: none)."""
    return F.filter(F.array(*[F.concat(F.lit(f"{kind}:"), c) for kind, c in record_ids.items()]), lambda x: x.isNotNull())


def _down(pairs: DataFrame, x: str, y: str) -> DataFrame:
    return pairs.where(F.col(x) != F.col(y)).groupBy(F.greatest(x, y).alias("a"), F.least(x, y).alias("b")).agg(F.lit(1).alias("one")).drop("one")


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return _down(both.where("v > u").join(low, "u"), "v", "m")


def _small_star(e: DataFrame) -> DataFrame:
    low = e.groupBy("a").agg(F.min("b").alias("m"))
    return _down(e.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("x"), "m"), F.struct(F.col("a").alias("x"), "m"))).alias("p")).select("p.*"), "x", "m")


def _state(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(records: DataFrame) -> DataFrame:
    """(node, component) of every node; ``records`` has the array column ``nodes``.

    A component is named after its smallest head.
    """
    named = records.where(F.size("nodes") > 0).select(F.col("nodes")[0].alias("head"), F.explode("nodes").alias("node"))
    ends = stage(named.groupBy("node").agg(F.min("head").alias("low"), F.max("head").alias("high")))
    ties = ends.where("low < high").select("node")
    pairs = named.join(ties, "node").groupBy("node", "head").agg(F.lit(1).alias("one")).select(F.concat(F.lit("~"), F.col("node")).alias("x"), "head")
    # a tying node is marked, so that it comes after all heads and never names a component
    edges = stage(_down(pairs, "x", "head"))
    state = _state(edges)
    for _ in range(MAX_ROUNDS):
        before, edges = edges, stage(_small_star(_large_star(edges)))
        drop_stage(before)
        if (new := _state(edges)) == state:
            break
        state = new
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    moved = edges.where("a not like '~%'").withColumnsRenamed({"a": "low", "b": "component"})
    return ends.join(moved, "low", "left").select("node", F.coalesce("component", "low").alias("component"))


def split_of(component: Column, proportions: dict[str, float], seed: int = 0) -> Column:
    """Name of the split whose range holds the component's hash in [0, 1)."""
    if not proportions or min(proportions.values()) < 0 or abs(sum(proportions.values()) - 1) > 1e-9:
        raise ValueError("proportions must be positive and sum to 1")
    u = F.pmod(F.xxhash64(F.lit(seed), component), F.lit(1 << 53)).cast("double") / float(1 << 53)
    end, out = 0.0, None
    names = list(proportions)
    for name in names[:-1]:
        end += proportions[name]
        out = F.when(u < end, name) if out is None else out.when(u < end, name)
    return F.lit(names[0]) if out is None else out.otherwise(names[-1])


def assign(records: DataFrame, ids: dict[str, Column], proportions: dict[str, float], seed: int = 0) -> DataFrame:
    """``records`` with ``component`` and ``split``."""
    kept = records.drop("component", "split")
    placed = kept.withColumn("__nodes", nodes(ids))
    labels = components(placed.select(F.col("__nodes").alias("nodes")))
    own = F.concat(F.lit("row:"), F.xxhash64(*[F.col(c).cast("string") for c in kept.columns]).cast("string"))
    joined = placed.withColumn("__node", F.coalesce(F.get("__nodes", F.lit(0)), own)).join(labels.withColumnRenamed("node", "__node"), "__node", "left")
    named = joined.withColumn("component", F.coalesce("component", "__node"))
    return named.withColumn("split", split_of(F.col("component"), proportions, seed)).drop("__nodes", "__node")


def shares(assigned: DataFrame) -> DataFrame:
    """(split, n_rows, n_components) reached."""
    per = assigned.groupBy("split", "component").agg(F.count("*").alias("n"))
    return per.groupBy("split").agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_components"))
