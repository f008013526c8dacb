"""Generated and observed sequences: structural review, stop classes, masks over next tokens, batches and splits.

Sequences are tables of (key, pos, token), one row per token, so a long one is
no long row; counts come from windows and aggregates, never from Python.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventide.functions.text import split_token
from eventide.operators.windows import moving_count, numbered, runs

# Limits and weights of the review.
LONG_RUN, LOOP, LOOP_WINDOW = 4, 6, 8


def review(sequence: DataFrame, vocab: DataFrame, segments: DataFrame, context: str) -> DataFrame:
    """(key, n_tokens, n_unique, unknown, invalid_bins, structural, after_end, longest_run, most_in_window, in_context, score, status) of every sequence.

    Errors are tokens outside the vocabulary, bins a concept does not have, and
    padding, begin or unknown marks; warnings are tokens after the end mark, a
    run of LONG_RUN equal tokens and LOOP of one concept among LOOP_WINDOW
    neighbours.  The score loses by part of tokens in error and by warning.
    ``vocab`` has token, ``segments`` concept and bins (a number).
    """
    parts = split_token(F.col("token"))
    rows = sequence.select("key", "pos", "token").withColumn("concept", parts["concept"]).withColumn("__bin", F.when(parts["kind"] == "bin", parts["detail"].try_cast("int")))
    named = rows.join(vocab.select("token", F.lit(True).alias("__known")).distinct(), "token", "left").join(segments.select("concept", F.col("bins").alias("__bins")), "concept", "left")
    bad = F.col("__bins").isNotNull() & ((F.col("__bin") < 0) | (F.col("__bin") >= F.col("__bins")))
    counts = named.groupBy("key").agg(
        F.count("*").alias("n_tokens"), F.count_distinct("token").alias("n_unique"), F.count_if(F.col("__known").isNull()).alias("unknown"), F.count_if(bad).alias("invalid_bins"),
        F.count_if(F.col("token").isin("<pad>", "<bos>", "<unk>")).alias("structural"), F.max("pos").alias("__last"), F.max(F.when(F.col("token") == "<eos>", F.col("pos"))).alias("__eos"),
        F.bool_or(F.col("concept") == context).alias("in_context"),
    )
    longest = runs(rows, ["key"], ["pos"], "token", "pos").groupBy("key").agg(F.max("n").alias("longest_run"))
    loops = moving_count(rows, ["key"], ["pos"], "concept", LOOP_WINDOW)
    part = lambda c, weight, most: F.least(F.lit(most), F.col(c) / F.col("n_tokens") * weight)
    joined = counts.join(longest, "key").join(loops, "key").withColumn("after_end", F.coalesce(F.col("__eos") < F.col("__last"), F.lit(False)))
    warned = F.col("after_end") | (F.col("longest_run") >= LONG_RUN) | (F.col("most_in_window") >= LOOP)
    flags = F.when(F.col("longest_run") >= LONG_RUN, 0.08).otherwise(0.0) + F.when(F.col("most_in_window") >= LOOP, 0.05).otherwise(0.0) + F.when(F.col("in_context"), 0.0).otherwise(0.02)
    score = 1.0 - part("unknown", 1.2, 0.55) - part("invalid_bins", 1.5, 0.35) - part("structural", 1.0, 0.25) - flags
    status = F.when(F.col("unknown") + F.col("invalid_bins") + F.col("structural") > 0, "poor").when(warned, "review").otherwise("good")
    return joined.select("key", "n_tokens", "n_unique", "unknown", "invalid_bins", "structural", "after_end", "longest_run", "most_in_window", "in_context", F.round(F.greatest(F.least(score, F.lit(1.0)), F.lit(0.0)) + 1e-9, 4).alias("score"), status.alias("status"))


def stops(sequence: DataFrame, terminal: Sequence[int], end: Sequence[int]) -> DataFrame:
    """(key, stop, terminal, step): how every generated sequence (key, pos from 1, token id) stopped.

    'terminal' on the first terminal id, 'end' on the first end mark, whichever
    comes first; 'censored' without any, after all its tokens.
    """
    hit = F.col("token").isin(*terminal, *end)
    first = sequence.groupBy("key").agg(F.min(F.when(hit, F.struct("pos", "token"))).alias("s"), F.max("pos").alias("n"))
    is_terminal = F.col("s.token").isin(*terminal)
    stop = F.when(F.col("s").isNull(), "censored").when(is_terminal, "terminal").otherwise("end")
    return first.select("key", stop.alias("stop"), F.when(is_terminal, F.col("s.token")).alias("terminal"), F.coalesce("s.pos", "n").alias("step"))


def next_probabilities(
    logits: DataFrame, *, temperature: float = 1.0, forbidden: Sequence[int] = (), allowed: DataFrame | None = None, recent: DataFrame | None = None, penalty: float = 1.0, top_k: int | None = None, top_p: float | None = None
) -> DataFrame:
    """(key, token, p): next-token probabilities of every row's logits (key, token, logit) under constraints.

    Forbidden tokens go, and those outside the row's ``allowed`` (key, token);
    tokens of ``recent`` (key, token) are penalised: positive logits are
    divided, negative ones multiplied; then temperature, the ``top_k`` best,
    and the best up to a mass of ``top_p``, the one that reaches it included.
    A vocabulary bounds the rows of a key.
    """
    rows = logits.where(~F.col("token").isin(*forbidden)) if forbidden else logits
    if allowed is not None:
        rows = rows.join(allowed.select("key", "token"), ["key", "token"], "left_semi")
    value = F.col("logit")
    if recent is not None:
        rows = rows.join(recent.select("key", "token", F.lit(True).alias("__r")).distinct(), ["key", "token"], "left")
        value = F.when(F.col("__r"), F.when(value > 0, value / penalty).otherwise(value * penalty)).otherwise(value)
    rows = rows.select("key", "token", (value / temperature).alias("z"))
    best = Window.partitionBy("key").orderBy(F.desc("z"), "token")
    if top_k is not None:
        rows = rows.withColumn("__k", F.row_number().over(best)).where(F.col("__k") <= top_k).drop("__k")
    p = F.exp(F.col("z") - F.max("z").over(Window.partitionBy("key")))
    rows = rows.withColumn("p", p).withColumn("p", F.col("p") / F.sum("p").over(Window.partitionBy("key")))
    if top_p is not None:
        before = F.coalesce(F.sum("p").over(best.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
        rows = rows.withColumn("__b", before).where(F.col("__b") < top_p).withColumn("p", F.col("p") / F.sum("p").over(Window.partitionBy("key")))
    return rows.select("key", "token", "p")


def draw(probabilities: DataFrame, seed: int) -> DataFrame:
    """(key, token): one token per key, by the largest p-weighted exponential draw from a hash of key, token and seed."""
    u = (F.pmod(F.xxhash64(F.lit(seed), "key", "token"), F.lit(1 << 53)).cast("double") + 0.5) / float(1 << 53)
    return probabilities.where("p > 0").groupBy("key").agg(F.max_by("token", F.log(F.col("p")) - F.log(-F.log(u))).alias("token"))


def token_batches(lengths: DataFrame, key: str, length: str, budget: int, step: int, seed: int = 0) -> DataFrame:
    """(key, width, batch): sequences of like length, in a seeded order, in batches whose number times width stays within the budget.

    Widths are multiples of ``step``; a sequence wider than the budget has a
    batch of its own.  Sequences are numbered within shards of their hash.
    """
    order = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")), 256)
    rows = lengths.select(key, (F.ceil(F.col(length) / step) * step).alias("width"), order.alias("__o"))
    size = F.greatest(F.floor(F.lit(budget) / F.col("width")), F.lit(1))
    return numbered(rows, ["width"], F.substring("__o", 1, 3), ["__o", key]).select(key, "width", F.floor(F.col("__i") / size).alias("batch"))


def budget_chunks(lengths: DataFrame, key: str, length: str, budget: int) -> DataFrame:
    """(key, chunk): entities, whole and in order of key, in chunks that begin with every ``budget`` events.

    Running sums are taken within shards of the key's hash prefix order, so the
    order is that of the SHA-256 of the key.
    """
    rows = lengths.select(key, F.col(length).cast("bigint").alias("__l"), F.sha2(F.col(key).cast("string"), 256).alias("__o")).withColumn("__s", F.substring("__o", 1, 3))
    totals = rows.groupBy("__s").agg(F.sum("__l").alias("__t"))
    ahead = Window.partitionBy(F.lit(0)).orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)  # one row per shard, 4096 at most
    starts = totals.select("__s", F.coalesce(F.sum("__t").over(ahead), F.lit(0)).alias("__b"))
    inner = Window.partitionBy("__s").orderBy("__o").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("__b") + F.coalesce(F.sum("__l").over(inner), F.lit(0))
    return rows.join(starts, "__s").select(key, F.floor(before / budget).alias("chunk"))


def hold_out(df: DataFrame, entity: str, stratum: str, share: float, seed: str) -> DataFrame:
    """(entity, stratum, held_out, moved): of every stratum the rounded share of entities with the smallest hashes is held out.

    An entity whose hash alone would have put it elsewhere was moved to meet
    its stratum's target.  Ranks are counted in shards of the hash, so a
    stratum with a third of all entities is many tasks; null strata make one.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(entity).cast("string")), 256)
    rows = df.where(F.col(entity).isNotNull()).groupBy(entity).agg(F.min(stratum).alias(stratum)).withColumn("__o", digest)
    unit = F.conv(F.substring("__o", 1, 8), 16, 10).cast("double") / float(1 << 32)
    placed = numbered(rows, [stratum], F.substring("__o", 1, 3), ["__o", entity]).withColumn("held_out", F.col("__i") < F.round(F.col("__n") * share))
    return placed.select(entity, stratum, "held_out", (F.col("held_out") != (unit < share)).alias("moved"))


def with_header(windows: DataFrame, array: str, header: Column, index: str) -> DataFrame:
    """Windows with the entity's header tokens before those that continue a sequence."""
    return windows.withColumn(array, F.when(F.col(index) > 0, F.concat(header, F.col(array))).otherwise(F.col(array)))


def modal_outcome(rollouts: DataFrame, key: str, outcome: str, order: Sequence[str]) -> DataFrame:
    """(key, modal, n): most frequent outcome of an entity's rollouts, of equals the earlier in ``order``; unlisted and null ones do not count."""
    place = F.array_position(F.array(*[F.lit(o) for o in order]), F.col(outcome))
    n = rollouts.where(place > 0).groupBy(key, F.col(outcome).alias("modal"), place.alias("__p")).agg(F.count("*").alias("n"))
    return n.groupBy(key).agg(F.max(F.struct("n", (-F.col("__p")).alias("p"), "modal")).alias("x")).select(key, "x.modal", "x.n")
