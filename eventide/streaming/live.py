"""Structured Streaming twins of batch operators.

Event time is the time a value became available; rows later than the
watermark are dropped, never inserted afterwards.  Stateful operators keep a
bounded state per key and see a key's rows of one micro-batch in order; the
source's limit on files a batch bounds those.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from eventide.runtime import read, scratch


def open_table(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """A parquet table as a stream of its files."""
    schema = read(spark, folder, table).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{table}.parquet").parquet(folder)


def replay(df: DataFrame, order: str, parts: int, cuts: list[float] | None = None) -> DataFrame:
    """``df`` as a stream of ``parts`` micro-batches, or those between ``cuts``, in order of a numeric column, so that state is carried from one to the next; rows without it are left out."""
    spark, folder = df.sparkSession, scratch(df.sparkSession)
    cuts = cuts if cuts is not None else df.approxQuantile(order, [i / parts for i in range(1, parts)], 0.01) if parts > 1 else []
    bounds = [float("-inf"), *cuts, float("inf")]
    for i, (lo, hi) in enumerate(zip(bounds, bounds[1:])):
        df.where((F.col(order) >= lo) & (F.col(order) < hi)).coalesce(1).write.parquet(f"{folder}/{i:03}")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")


def available(events: DataFrame, at: str, lag_minutes: int, late: str, out: str = "available_at") -> DataFrame:
    """Events with the time they became available, a lag after their own, and a watermark on it."""
    shifted = F.col(at).cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(lag_minutes))
    return events.withColumn(out, shifted).withWatermark(out, late)


def in_window(events: DataFrame, stays: DataFrame, key: str, at: str, lo: str, hi: str) -> DataFrame:
    """Events of a stream within the windows of a static table of stays, plus whole minutes from the start."""
    near = events.join(stays.select(key, lo, hi), key).where(F.col(at).between(F.col(lo), F.col(hi)))
    return near.withColumn("pos_min", F.timestamp_diff("MINUTE", lo, at)).drop(lo, hi)


def windowed_counts(events: DataFrame, at: str, kind: str, value: str, width: str, late: str = "1 day") -> DataFrame:
    """Count and sum per kind and tumbling window, with a watermark."""
    stamped = events.withColumn("__at", F.col(at).cast("timestamp")).withWatermark("__at", late)
    return stamped.groupBy(F.col(kind), F.window("__at", width).alias("w")).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(kind, F.col("w.start").alias("start"), "n", "total")


def sessions(events: DataFrame, key: str, at: str, gap: str, late: str = "1 day") -> DataFrame:
    """(key, start, end, n): runs of events less than a gap apart; a session ends a gap after its last event."""
    stamped = events.withColumn("__at", F.col(at).cast("timestamp")).withWatermark("__at", late)
    return stamped.groupBy(F.col(key), F.session_window("__at", gap).alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def _stateful(events: DataFrame, key: str, schema: str, state: str, step) -> DataFrame:
    return events.groupBy(key).applyInPandasWithState(step, schema, state, "append", GroupStateTimeout.NoTimeout)


def state_changes(events: DataFrame, key: str, order: str, state: str) -> DataFrame:
    """Rows whose state differs from the one before in the key; only the last state of a key is kept."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], last: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(order)
        before = last.get[0] if last.exists else None
        previous = rows[state].shift(fill_value=before) if before is not None else rows[state].shift()
        changed = rows[(previous.isna()) | (previous != rows[state])]
        last.update((rows[state].iloc[-1],))
        yield pd.DataFrame({key: changed[key], order: changed[order], "state": changed[state]})

    kinds = dict(events.dtypes)
    return _stateful(events, key, f"{key} {kinds[key]}, {order} {kinds[order]}, state {kinds[state]}", f"last {kinds[state]}", step)


def carry_forward(events: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """(key, order, carried): every row with the last value known at it, its own if it has one; only that value is kept."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], last: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(order)
        before = last.get[0] if last.exists else None
        carried = rows[value].ffill()
        if before is not None:
            carried = carried.fillna(before)
        known = carried.dropna()
        if len(known):
            last.update((float(known.iloc[-1]),))
        yield pd.DataFrame({key: rows[key], order: rows[order], "carried": carried})

    kinds = dict(events.dtypes)
    return _stateful(events, key, f"{key} {kinds[key]}, {order} {kinds[order]}, carried double", "last double", step)


def sustained_crossings(events: DataFrame, key: str, minute: str, beyond: str, *, readings: int, within: int) -> DataFrame:
    """(key, completed_min): the first minute of a key at which ``readings`` consecutive readings beyond span at most ``within`` minutes.

    The state is the last ``readings`` - 1 minutes of the streak and whether
    the key is done; later rows of a done key give nothing.
    """

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        streak, done = (list(state.get[0]), state.get[1]) if state.exists else ([], False)
        found = None
        rows = pd.concat(list(batches)).sort_values(minute)
        for m, hit in zip(rows[minute].tolist(), rows[beyond].tolist()) if not done else ():
            streak = [*streak, int(m)][-readings:] if hit else []
            if len(streak) == readings and streak[-1] - streak[0] <= within:
                found, done = int(m), True
                break
        state.update((streak[-(readings - 1) :] if readings > 1 else [], done))
        yield pd.DataFrame({key: [] if found is None else [k[0]], "completed_min": [] if found is None else [found]})

    kinds = dict(events.dtypes)
    return _stateful(events, key, f"{key} {kinds[key]}, completed_min bigint", "streak array<bigint>, done boolean", step)


def run_to_end(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Result of a stream over all that is there now, written batch by batch and read back.

    A batch overwrites its own folder, so a repeated batch changes nothing;
    in complete mode the last batch is the result.
    """
    folder = scratch(stream.sparkSession)
    last: list[int] = []

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")
        last.append(number)

    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
    if not last:
        return stream.sparkSession.createDataFrame([], stream.schema)
    spark = stream.sparkSession
    return spark.read.schema(stream.schema).parquet(f"{folder}/out/batch={max(last)}") if mode == "complete" else spark.read.schema(stream.schema).parquet(f"{folder}/out/batch=*")
