"""Mixing of sources to target weights (problem 9).

The mix is the largest one that holds the target shares exactly: the source
whose texts, each used as often as allowed, run out first fixes the total.  A
source then needs each of its texts q times on average, where q is the same
part of every text's allowance; q splits into whole copies and a fractional
copy probability.

Fractions are rounded by pivotal dependent rounding: two texts move size
between each other, keeping the size-weighted sum and every text's expected
copies, until one of them is integral.  A partition is streamed through with a
single open text per (source, bucket), so memory is constant; the open texts
left over are combined in a tree of wider and wider buckets until one per
source remains, which is rounded by its probability.  The size of a source is
thus met up to one text.  The tree is the same at every size: LEAVES buckets a
source, then FAN times fewer a level, so which texts are drawn depends only on
the texts and the seed.

Every text is cut into tokens once, where it lies; only hashes, sizes and keys
are shuffled.  Random numbers are hashes of the text and a seed: lost
executors recompute the same selection.

Defined results: texts are distinct by content, and an exact copy counts as
the same text: it is kept once, under the copy with the smallest key among
those in listed sources, with the smallest allowance among them.  Null, empty
and blank texts, texts of unlisted or null sources, and sources with an
allowance under one or no share are not used.  Targets whose source has no
usable text are reported with nothing reached; the others keep their
proportions among themselves.  Empty tables give an empty selection.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventide.llm import tokens
from eventide.runtime import stage

LEAVES = 1 << 16
FAN = 256
MAX_SOURCES = 100_000


def _pool(docs: DataFrame, targets: DataFrame, key: str, text: str, source: str, path: str | None) -> DataFrame:
    """(hash, key, source, cap, size) of every usable distinct text."""
    listed = targets.where("target_share > 0 and max_repeats >= 1").select(F.col("source").alias("__s"), F.col("max_repeats").alias("cap"))
    rows = docs.where(F.col(key).isNotNull() & F.col(text).isNotNull() & F.col(text).rlike(r"\S"))
    usable = rows.join(listed, F.col(source) == F.col("__s")).select(F.unhex(F.sha2(text, 256)).alias("hash"), F.col(key).alias("key"), F.col("__s").alias("source"), "cap", F.col(text).alias("text"))
    sized = tokens.count(usable, "text", path, out="size")
    owners = sized.groupBy("hash").agg(F.min(F.struct("key", "source")).alias("o"), F.min("cap").cast("bigint").alias("cap"), F.max("size").alias("size"))
    return owners.where("size > 0").select("hash", "o.key", "o.source", "cap", "size")


def rates(capacity: dict[str, int], shares: dict[str, float]) -> dict[str, float]:
    """Part of each source's capacity that the largest exact mix uses; ``capacity`` is size times allowance, summed."""
    there = {s: w for s, w in shares.items() if capacity.get(s, 0) > 0 and w > 0}
    if not there:
        return {}
    whole = sum(there.values())
    total = min(capacity[s] / (w / whole) for s, w in there.items())
    return {s: min(1.0, total * (w / whole) / capacity[s]) for s, w in there.items()}


def _settle(p: float, a: float, q: float, b: float, u: float) -> tuple[float, float]:
    """Move size between probabilities p (size a) and q (size b) until one is 0 or 1; ``u`` is uniform in [0, 1)."""
    up, down = min((1 - p) * a, q * b), min(p * a, (1 - q) * b)
    if u * (up + down) < down:
        return (1.0 if up == (1 - p) * a else p + up / a), (0.0 if up == q * b else q - up / b)
    return (0.0 if down == p * a else p - down / a), (1.0 if down == (1 - q) * b else q + down / b)


def _stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rounds rows (source, bucket, hash, size, p, u) in order; open rows keep 0 < p < 1."""
    held = None
    for batch in batches:
        out: list[tuple] = []
        for row in zip(batch["source"], batch["bucket"], batch["hash"], batch["size"], batch["p"], batch["u"]):
            if held is not None and held[:2] != row[:2]:
                out.append(held)
                held = None
            if not 0.0 < row[4] < 1.0:
                out.append(row)
                continue
            if held is None:
                held = row
                continue
            p, q = _settle(held[4], held[3], row[4], row[3], row[5])
            first, second = (*held[:4], p, held[5]), (*row[:4], q, row[5])
            if 0.0 < p < 1.0:
                out.append(second)
                held = first
            else:
                out.append(first)
                held = second if 0.0 < q < 1.0 else None
                if held is None:
                    out.append(second)
        if out:
            yield pd.DataFrame(out, columns=["source", "bucket", "hash", "size", "p", "u"])
    if held is not None:
        yield pd.DataFrame([held], columns=["source", "bucket", "hash", "size", "p", "u"])


_ITEM = "source string, bucket bigint, hash binary, size bigint, p double, u double"


def pivotal(items: DataFrame, seed: int) -> DataFrame:
    """(hash, up) of fractional items (source, hash, size, p)."""
    uniform = lambda level: F.pmod(F.xxhash64(F.lit(seed), F.lit(level), "hash"), F.lit(1 << 53)).cast("double") / float(1 << 53)
    bucket = lambda n: F.pmod(F.xxhash64("hash"), F.lit(n)).alias("bucket")
    level, buckets, done = 0, LEAVES, None
    open_rows = items.select("source", bucket(buckets), "hash", "size", "p", uniform(0).alias("u"))
    while True:
        ordered = open_rows.repartition("source", "bucket").sortWithinPartitions("source", "bucket", "size", "hash")
        rounded = stage(ordered.mapInPandas(_stream, _ITEM))
        ended = rounded.where("p <= 0 or p >= 1").select("hash", (F.col("p") >= 1).cast("int").alias("up"))
        done = ended if done is None else done.unionByName(ended)
        left = rounded.where("p > 0 and p < 1")
        level += 1
        if buckets == 1:
            last = left.select("hash", (uniform(level) < F.col("p")).cast("int").alias("up"))
            return done.unionByName(last)
        buckets = -(-buckets // FAN)
        open_rows = left.select("source", bucket(buckets), "hash", "size", "p", uniform(level).alias("u"))


def select(docs: DataFrame, targets: DataFrame, *, key: str = "doc_id", text: str = "text", source: str = "source", seed: int = 0, path: str | None = None) -> DataFrame:
    """(key, source, n_tokens, copies) of the texts used, each at least once.

    ``targets`` has source (key), target_share and max_repeats; it is read to
    the driver up to MAX_SOURCES rows, as are the sources' totals.
    """
    pool = stage(_pool(docs, targets, key, text, source, path))
    goals = {r["source"]: r["target_share"] for r in targets.where("source is not null").limit(MAX_SOURCES + 1).collect()}
    if len(goals) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    totals = pool.groupBy("source").agg(F.sum(F.col("cap") * F.col("size")).alias("c")).collect()
    rate = rates({r["source"]: r["c"] for r in totals}, goals)
    spark = docs.sparkSession
    plan = spark.createDataFrame([(s, float(x)) for s, x in rate.items()], "source string, rate double")
    wanted = pool.join(plan, "source").withColumn("q", F.col("cap") * F.col("rate"))
    whole = F.floor(F.col("q") + 1e-9)
    part = F.col("q") - whole
    planned = wanted.withColumn("base", whole).withColumn("p", F.when(part > 1e-9, part).otherwise(0.0))
    ups = pivotal(planned.where("p > 0").select("source", "hash", "size", "p"), seed)
    mixed = planned.join(ups, "hash", "left").withColumn("copies", (F.col("base") + F.coalesce("up", F.lit(0))).cast("bigint"))
    return mixed.where("copies >= 1").select(F.col("key").alias(key), F.col("source").alias(source), F.col("size").alias("n_tokens"), "copies")


def shares(selection: DataFrame, targets: DataFrame, source: str = "source") -> DataFrame:
    """Per target: share asked for and reached, texts, copies and tokens used."""
    used = selection.groupBy(source).agg(F.count("*").alias("n_texts"), F.sum("copies").alias("n_copies"), F.sum(F.col("copies") * F.col("n_tokens")).alias("n_tokens"), F.max("copies").alias("most_copies"))
    whole = used.agg(F.sum("n_tokens").alias("t")).first()["t"] or 0
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return targets.join(used, source, "left").select(
        source, "target_share", "max_repeats", zero("n_texts"), zero("n_copies"), zero("n_tokens"), zero("most_copies"),
        (F.coalesce("n_tokens", F.lit(0)) / F.lit(float(whole or 1))).alias("reached_share"),
    )
