"""From declared tables to encoded stays.

One scan of every table gives the events of the stays' first hours, staged.
Everything that is fitted (where a concept's bins come from, its edges, the
vocabulary) is fitted on the stays of the fit partition only, so nothing of
the others leaks into their encoding.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventide.functions import numbers as N
from eventide.functions import text as T
from eventide.functions.numbers import finite
from eventide.operators import bins, encode, joins
from eventide.runtime import read, stage
from eventide.sources import tables

N_BINS = 10
CATEGORY_FLOOR = 3
MAX_TOKENS = 8192
KERNEL = 1
FIT_SHARE = 0.8
SOURCES = (tables.ASSESSMENTS, tables.LABS, tables.CRRT, tables.ECMO)
#: Segments that are declared instead of fitted: (lo, hi, lo_closed, hi_closed).
DECLARED = {"sodium": [(None, 135.0, False, False), (135.0, 145.0, True, True), (145.0, None, False, False)]}
#: Labels of the frame's tokens.
ADMISSIONS = ("direct", "ed", "elective", "transfer", "other", "unknown")
DISCHARGES = ("expired", "home", "hospice", "facility", "other", "unknown")
_ADMISSION_OF = {"direct": "direct", "ed": "ed", "elective_surgery": "elective", "elective": "elective", "transfer": "transfer"}
_DISCHARGE_OF = {"expired": "expired", "home": "home", "hospice": "hospice", "skilled nursing facility (snf)": "facility", "acute care hospital": "facility"}
FRAME_TOKENS = tuple(f"ADMISSION//{x}" for x in ADMISSIONS) + tuple(f"DISCHARGE//{x}" for x in DISCHARGES)
_ORDER = ["pos_min", "dttm", "source", "concept", "value", "cat_value"]
_PAYLOAD = ["pos_min", "value", "soft_token", "soft_weight", "target_eligible"]


def stays_of(spark: SparkSession, folder: str, hours: int = 24) -> DataFrame:
    """Stays with their first admission, the end of the window, partition by patient, and labels of the frame."""
    rows = read(spark, folder, "hospitalization").where("hospitalization_id is not null and admission_dttm is not null")
    first = F.struct("admission_dttm", "discharge_dttm", "patient_id", "admission_type_category", "discharge_category")
    one = rows.groupBy(F.col("hospitalization_id").alias("hosp_id")).agg(F.min(first).alias("s")).select("hosp_id", "s.*")
    label = lambda c, of: F.when(F.col(c).isNull(), "unknown").otherwise(T.label(F.col(c), of, "other"))
    fit = N.unit_interval(F.coalesce("patient_id", "hosp_id"), seed="fit") < FIT_SHARE
    return one.select(
        "hosp_id", F.col("admission_dttm").alias("lo"), tables.with_lag(F.col("admission_dttm"), hours * 60).alias("hi"), F.when(fit, "train").otherwise("test").alias("partition"),
        F.timestamp_diff("MINUTE", "admission_dttm", F.coalesce("discharge_dttm", "admission_dttm")).alias("end_min"),
        label("admission_type_category", _ADMISSION_OF).alias("admission"), label("discharge_category", _DISCHARGE_OF).alias("disposition"),
    )


def windowed_events(spark: SparkSession, folder: str, stays: DataFrame, sources: Sequence[tables.TableSpec] = SOURCES) -> DataFrame:
    """Events of all declared tables within the stays' windows, with ``pos_min``, ``cat_token`` and the stay's partition."""
    events = tables.read_events(spark, folder, sources)
    near = joins.in_window(events, stays.select("hosp_id", "lo", "hi"), "hosp_id", "dttm", "lo", "hi").drop("lo", "hi")
    return near.join(stays.select("hosp_id", "partition"), "hosp_id").withColumn("cat_token", F.when(~F.coalesce(finite(F.col("value")), F.lit(False)), T.categorical_token(F.col("concept"), F.col("cat_value"))))


def fit_segments(fit: DataFrame, declared: Mapping[str, Sequence[bins.Row]] = DECLARED, n_bins: int = N_BINS) -> DataFrame:
    """(concept, source, segments): declared, ordinal (a point for every value) or quantile segments; concepts with too few values have none."""
    spark = fit.sparkSession
    kind = f"array<{bins.SEGMENT}>"
    given = spark.createDataFrame([(c, [tuple(s) for s in bins.merge_partition(v)]) for c, v in declared.items()], f"concept string, segments {kind}")
    values = fit.where(finite(F.col("value"))).select("concept", "value")
    source = stage(bins.binning_source(values, "concept", "value", given).select("concept", "source"))
    of = lambda s: source.where(F.col("source") == s).select("concept")
    point = lambda v: F.struct(v.alias("lo"), v.alias("hi"), F.lit(True).alias("lo_closed"), F.lit(True).alias("hi_closed"))
    points = values.join(of("ordinal"), "concept", "left_semi").groupBy("concept").agg(F.array_sort(F.collect_set("value")).alias("v"))
    edges = bins.quantile_edges(values.join(of("quantile"), "concept", "left_semi"), "concept", "value", n_bins)
    parts = [
        given.select("concept", F.lit("declared").alias("source"), "segments"),
        points.select("concept", F.lit("ordinal").alias("source"), F.transform("v", point).cast(kind).alias("segments")),
        edges.select("concept", F.lit("quantile").alias("source"), bins.segments_from_edges(F.col("edges")).cast(kind).alias("segments")),
    ]
    return stage(parts[0].unionByName(parts[1]).unionByName(parts[2]))


def encoded_stays(spark: SparkSession, folder: str, hours: int = 24) -> DataFrame:
    """Windows of at most MAX_TOKENS tokens per stay, framed by <bos> ADMISSION//x and DISCHARGE//y <eos>.

    Parallel arrays token, pos_min, value, soft_token, soft_weight and
    target_eligible (the disposition is a target, the rest of the frame is
    not); ``anchor_idx`` is the place of the last token of the window of
    ``hours``.  A stay without events has its frame only.
    """
    stays = stage(stays_of(spark, folder, hours))
    events = stage(windowed_events(spark, folder, stays))
    fit = events.where("partition = 'train'")
    segments = fit_segments(fit)
    vocab = stage(encode.segment_vocabulary(fit, segments.select("concept", "segments"), "hosp_id", CATEGORY_FLOOR, FRAME_TOKENS))
    coded = stage(encode.encode_events(events, segments.select("concept", "segments"), vocab, KERNEL).withColumn("target_eligible", F.lit(True)))
    width = 2 * KERNEL + 1
    number = lambda c, labels, first: F.lit(len(encode.SPECIALS) + first).cast("bigint") + F.array_position(F.array(*[F.lit(x) for x in labels]), F.col(c)) - 1
    admission, disposition = number("admission", ADMISSIONS, 0), number("disposition", DISCHARGES, len(ADMISSIONS))
    bos, eos = F.lit(1).cast("bigint"), F.lit(2).cast("bigint")
    none, hard = F.lit(None).cast("double"), F.array(F.lit(1.0), *[F.lit(0.0)] * (width - 1))
    fixed = {"head": ((bos, admission), F.lit(0).cast("bigint"), (False, False)), "tail": ((disposition, eos), F.greatest("end_min", F.lit(0)).cast("bigint"), (True, False))}
    frames = stays.select("hosp_id", *[
        c for part, (ids, at, eligible) in fixed.items() for c in (
            F.array(*ids).alias(part), F.array(at, at).alias(f"{part}_pos_min"), F.array(none, none).alias(f"{part}_value"), F.array(*[F.array_repeat(i, width) for i in ids]).alias(f"{part}_soft_token"),
            F.array(hard, hard).alias(f"{part}_soft_weight"), F.array(*[F.lit(x) for x in eligible]).alias(f"{part}_target_eligible"),
        )
    ])
    windows = encode.encode_windows(coded, vocab, "hosp_id", _ORDER, _PAYLOAD, MAX_TOKENS, frames=frames)
    upto = coded.groupBy("hosp_id").agg(F.count("*").alias("__k"))
    anchored = stays.join(upto, "hosp_id", "left").select("hosp_id", "partition", (1 + F.coalesce("__k", F.lit(0))).alias("anchor_idx"), F.lit(hours * 60).alias("anchor_min"))
    return windows.join(anchored, "hosp_id").withColumn("n_events", F.size("token"))
