"""The queries of the general training-data problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventide.operators import asof, intervals, spikes, timestamps, units
from eventide.runtime import read, stage


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Assessments with the code status known at their time.

    A stay filed under several patients belongs to none of them for sure, so
    its assessments are no cases.
    """
    stays = (
        read(spark, d, "hospitalization")
        .where("hospitalization_id is not null and patient_id is not null")
        .groupBy("hospitalization_id")
        .agg(F.min("patient_id").alias("patient_id"), F.max("patient_id").alias("other"))
        .where("patient_id = other")
        .drop("other")
    )
    events = (
        read(spark, d, "patient_assessments")
        .where("hospitalization_id is not null and recorded_dttm is not null")
        .select("assessment_id", "hospitalization_id", F.col("recorded_dttm").alias("at"))
        .join(stays, "hospitalization_id")
        .select("assessment_id", "patient_id", "at")
    )
    known = asof.known_at(
        events, read(spark, d, "code_status"), entity="patient_id", at="at",
        valid_from="start_dttm", known_from="recorded_dttm", value="code_status_category", tie="code_status_id",
    )
    return known.select("assessment_id", "code_status_category")


#: What a circuit can show, L/min.
CIRCUIT_LIMITS = {"flow": (0.0, 12.0), "sweep": (0.0, 30.0)}


def p2_readings(spark: SparkSession, d: str) -> DataFrame:
    """Implausible flow and sweep readings with the reason.

    Flows of 200 and more, of either sign, are mL/min and compared in L/min.
    """
    ecmo = read(spark, d, "ecmo_mcs")
    flow = F.col("flow").cast("double")
    series = F.array(
        F.struct(F.lit("flow").alias("field"), F.when(F.abs(flow) >= 200, flow / 1000).otherwise(flow).alias("v")),
        F.struct(F.lit("sweep").alias("field"), F.col("sweep").cast("double").alias("v")),
    )
    rows = ecmo.select(
        F.col("ecmo_id").alias("record_id"), F.col("hospitalization_id").alias("source"), F.unix_micros("recorded_dttm").alias("t"), F.inline(series)
    )
    return spikes.implausible(rows, CIRCUIT_LIMITS).select(F.col("record_id").alias("ecmo_id"), "field", "reason")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Implausible flow and sweep readings."""
    return p2_readings(spark, d).where("ecmo_id is not null").select("ecmo_id", "field")


def _adt_instants(spark: SparkSession, d: str) -> DataFrame:
    return timestamps.normalise(read(spark, d, "adt").select("adt_id", "hospitalization_id", "hospital_id", "in_dttm", "out_dttm"), "in_dttm", read(spark, d, "hospital_sites"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Periods of presence of each stay and the gaps between them."""
    rows = _adt_instants(spark, d).withColumn("out_us", F.unix_micros("out_dttm"))
    return intervals.periods_and_gaps(rows, "hospitalization_id", "instant_us", "out_us")


#: flow's common unit and what it plausibly is in it.
FLOW = ("ecmo_flow", "L/min", 0.2, 12.0)


def _delivered(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Staged numeric values of labs and pump flows with their unit key, and the common unit of each quantity."""
    labs = read(spark, d, "clif_lab_categories").select(F.col("lab_category").alias("quantity"), F.col("reference_unit").alias("unit"), F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"))
    common = labs.unionByName(spark.createDataFrame([FLOW], "quantity string, unit string, lo double, hi double"))
    number, unit = units.read_quantity(F.col("lab_value"), F.col("reference_unit"), F.col("lab_name"))
    values = (
        read(spark, d, "labs")
        .where("lab_category is not null and lab_value is not null")
        .select(F.lit("labs").alias("record_type"), F.col("lab_id").alias("record_id"), F.col("hospitalization_id").alias("entity"), F.col("lab_category").alias("quantity"), number.alias("v"), units.unit_key(unit).alias("key"))
        .where("v > 0")
    )
    flows = read(spark, d, "ecmo_mcs").select(F.lit("ecmo_mcs").alias("record_type"), F.col("ecmo_id").alias("record_id"), F.col("hospitalization_id").alias("entity"), F.when(F.col("flow") > 0, FLOW[0]).alias("quantity"), F.col("flow").cast("double").alias("v")).where("v > 0 and not isnan(v)")
    return stage(values.unionByName(units.keyed_by_size(flows))), common


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Lab values and pump flows that were delivered in a unit of another size, converted.

    A flow has no unit column; its sources are the sizes in which flows come,
    linked by the runs that have several.
    """
    placed, _ = units.to_common(*_delivered(spark, d))
    other = placed.where("(abs(ln(factor)) > 0.02 or offset <> 0) and record_id is not null").select("record_type", "record_id", (F.col("v") * F.col("factor") + F.col("offset")).alias("x"))
    kept = other.where(f"record_type = 'labs' or x between {FLOW[2]} and {FLOW[3]}")
    return kept.select("record_type", "record_id", units.two_digits_milli(F.col("x")).alias("value_milli"))


def unit_sources(spark: SparkSession, d: str) -> DataFrame:
    """Every way a unit is written, and every size flows come in: declared, estimated and settled conversion."""
    return units.source_graph(*_delivered(spark, d))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Texts of patient.death_dttm and adt.in_dttm that fix one instant."""
    deaths = timestamps.normalise(read(spark, d, "patient").select("patient_id", "hospital_id", "death_dttm"), "death_dttm", read(spark, d, "hospital_sites"))
    moves = _adt_instants(spark, d)
    return (
        deaths.select(F.lit("patient").alias("record_type"), F.col("patient_id").alias("record_key"), "instant_us")
        .unionByName(moves.select(F.lit("adt").alias("record_type"), F.col("adt_id").cast("string").alias("record_key"), "instant_us"))
        .where("record_key is not null and instant_us is not null")
    )


def queries() -> dict:
    return {"p1_found": p1_found, "p2_found": p2_found, "p2_readings": p2_readings, "p4_found": p4_found, "p5_found": p5_found, "p5_sources": unit_sources, "p7_found": p7_found}


def oracle_sql() -> dict:
    """SQL of the problems that are relational; the others are tested against brute force."""
    return {
        "p1_found": """WITH s AS (SELECT hospitalization_id, min(patient_id) AS patient_id FROM hospitalization WHERE hospitalization_id IS NOT NULL AND patient_id IS NOT NULL GROUP BY 1 HAVING count(DISTINCT patient_id) = 1),
            e AS (SELECT assessment_id, recorded_dttm AS t, patient_id FROM patient_assessments JOIN s USING (hospitalization_id) WHERE recorded_dttm IS NOT NULL)
            SELECT assessment_id, arg_max(code_status_category, (start_dttm, recorded_dttm, code_status_id)) AS code_status_category FROM e JOIN code_status c ON c.patient_id = e.patient_id AND c.start_dttm <= t AND c.recorded_dttm <= t
            WHERE code_status_category IS NOT NULL GROUP BY 1""",
    }
