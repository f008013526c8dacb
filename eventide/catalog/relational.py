"""Sources, scalar functions, reshaping, joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eventide.catalog.registry import query
from eventide.functions import numbers as N
from eventide.functions import text as T
from eventide.operators import joins, reshape, windows
from eventide.runtime import read
from eventide.sources import tables

RATES = ("blood_flow_rate", "pre_filter_replacement_fluid_rate", "post_filter_replacement_fluid_rate", "dialysate_flow_rate", "ultrafiltration_out")


@query("src_01_aliases", "SELECT code_status_id, patient_id AS person_id, code_status_category AS status FROM code_status")
def src_01(spark: SparkSession, d: str) -> DataFrame:
    return tables.read_table(spark, d, "code_status", aliases={"patient_id": "person_id", "code_status_category": "status"}).select("code_status_id", "person_id", "status")


@query(
    "src_02_present_columns",
    "SELECT adt_id, location_category, CAST(NULL AS VARCHAR) AS location_floor FROM adt",
)
def src_02(spark: SparkSession, d: str) -> DataFrame:
    return tables.with_optional(read(spark, d, "adt"), required=["adt_id"], optional={"location_category": "string", "location_floor": "string"})


@query(
    "src_03_long_events",
    """SELECT hospitalization_id AS hosp_id, epoch_us(recorded_dttm) AS at_us, lower(assessment_category) AS concept, numerical_value AS value, CAST(NULL AS VARCHAR) AS unit, categorical_value AS cat_value, 'patient_assessments' AS source
       FROM patient_assessments WHERE hospitalization_id IS NOT NULL AND recorded_dttm IS NOT NULL AND assessment_category IS NOT NULL AND (numerical_value IS NOT NULL OR categorical_value IS NOT NULL)
       UNION ALL
       SELECT hospitalization_id, epoch_us(lab_result_dttm), lower(lab_category), lab_value_numeric, reference_unit, NULL, 'labs' FROM labs
       WHERE hospitalization_id IS NOT NULL AND lab_result_dttm IS NOT NULL AND lab_category IS NOT NULL AND lab_value_numeric IS NOT NULL""",
)
def src_03(spark: SparkSession, d: str) -> DataFrame:
    events = tables.read_events(spark, d, [tables.ASSESSMENTS, tables.LABS])
    return events.select("hosp_id", F.unix_micros("dttm").alias("at_us"), "concept", "value", "unit", "cat_value", "source")


@query("src_05_id_filter", "SELECT lab_id FROM labs WHERE hospitalization_id IN (SELECT hospitalization_id FROM hospitalization WHERE discharge_category = 'Expired')")
def src_05(spark: SparkSession, d: str) -> DataFrame:
    ids = read(spark, d, "hospitalization").where("discharge_category = 'Expired' and hospitalization_id is not null")
    return joins.keep_ids(read(spark, d, "labs").select("lab_id", "hospitalization_id"), ids, "hospitalization_id").select("lab_id")


@query("src_06_sample", "SELECT patient_id FROM patient ORDER BY sha256('s1:' || patient_id), patient_id LIMIT 50")
def src_06(spark: SparkSession, d: str) -> DataFrame:
    return tables.sample_ids(read(spark, d, "patient"), "patient_id", 50, "s1")


@query("src_14_paged_search", "SELECT doc_id FROM documents WHERE text LIKE '%dressing%' ORDER BY doc_id LIMIT 20 OFFSET 40")
def src_14(spark: SparkSession, d: str) -> DataFrame:
    return tables.page(read(spark, d, "documents").where(F.contains(F.col("text"), F.lit("dressing"))).select("doc_id"), "doc_id", 40, 20)


@query(
    "sch_01_conformance",
    """SELECT code_status_category AS raw, COUNT(*) AS n, CASE WHEN code_status_category IS NULL THEN 'missing' WHEN code_status_category IN ('Full', 'DNR', 'DNR/DNI', 'AND', 'Other') THEN 'compliant'
       WHEN code_status_category = 'Presume Full' THEN 'aliased' ELSE 'failing' END AS status FROM code_status GROUP BY ALL""",
)
def sch_01(spark: SparkSession, d: str) -> DataFrame:
    return tables.conformance(read(spark, d, "code_status"), "code_status_category", ["Full", "DNR", "DNR/DNI", "AND", "Other"], {"Presume Full": "Full"})


@query(
    "sch_02_compliance_rollup",
    """WITH c AS (SELECT CASE WHEN code_status_category IS NULL THEN 'missing' WHEN code_status_category IN ('Full', 'DNR', 'DNR/DNI', 'AND', 'Other') THEN 'compliant'
       WHEN code_status_category = 'Presume Full' THEN 'aliased' ELSE 'failing' END AS status FROM code_status)
       SELECT 'code_status' AS source, COUNT(*) FILTER (status = 'aliased') AS aliased, COUNT(*) FILTER (status = 'compliant') AS compliant, COUNT(*) FILTER (status = 'failing') AS failing, COUNT(*) FILTER (status = 'missing') AS missing FROM c""",
)
def sch_02(spark: SparkSession, d: str) -> DataFrame:
    rows = sch_01(spark, d).withColumn("source", F.lit("code_status"))
    return rows.groupBy("source").pivot("status", ["aliased", "compliant", "failing", "missing"]).sum("n").na.fill(0)


@query(
    "sch_03_null_report",
    """SELECT COUNT(*) AS n_rows, COUNT(*) - COUNT(patient_id) AS null_patient_id, COUNT(*) - COUNT(hospitalization_id) AS null_hospitalization_id, COUNT(*) - COUNT(discharge_dttm) AS null_discharge_dttm FROM hospitalization""",
)
def sch_03(spark: SparkSession, d: str) -> DataFrame:
    return tables.null_report(read(spark, d, "hospitalization"), ["patient_id", "hospitalization_id", "discharge_dttm"])


@query("sch_04_single_source", "SELECT patient_id, COUNT(DISTINCT hospital_id) AS n_hospitals, COUNT(DISTINCT hospital_id) > 1 AS refused FROM hospitalization WHERE patient_id IS NOT NULL GROUP BY 1")
def sch_04(spark: SparkSession, d: str) -> DataFrame:
    """Patients with the number of hospitals that filed them; more than one is refused."""
    n = read(spark, d, "hospitalization").where("patient_id is not null").groupBy("patient_id").agg(F.count_distinct("hospital_id").alias("n_hospitals"))
    return n.withColumn("refused", F.col("n_hospitals") > 1)


@query("sch_07_row_hash", "SELECT canonical_id, sha256(concat_ws('|', list_name, canonical_id, canonical_name)) AS row_sha FROM canonical_names")
def sch_07(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "canonical_names").select("canonical_id", tables.row_sha("list_name", "canonical_id", "canonical_name").alias("row_sha"))


_NAME_SQL = "regexp_replace(regexp_replace(lower(trim({0})), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')"


@query("prj_01_normalize_name", f"SELECT crrt_id, {_NAME_SQL.format('crrt_mode_name')} AS name FROM crrt_therapy")
def prj_01(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "crrt_therapy").select("crrt_id", T.normalize_name(F.col("crrt_mode_name")).alias("name"))


_CAT_SQL = "regexp_replace(lower(trim({0})), '[\\s_]+', '_', 'g')"


@query(
    "prj_02_normalize_value",
    f"SELECT DISTINCT code_status_name AS raw, {_CAT_SQL.format('code_status_name')} AS key, regexp_replace({_CAT_SQL.format('code_status_name')}, '^_+|_+$', '', 'g') AS value, lower(trim(code_status_name)) AS plain FROM code_status",
)
def prj_02(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("code_status_name")
    return read(spark, d, "code_status").select(c.alias("raw"), T.category_key(c).alias("key"), T.norm_value(c).alias("value"), T.trim_lower(c).alias("plain")).distinct()


@query(
    "prj_03_mapped_value",
    """SELECT adt_id, CASE WHEN location_type = 'burn_icu' AND location_category = 'icu' THEN 'burn' WHEN location_category IS NULL THEN 'unmapped' WHEN location_category = 'icu' THEN 'intensive' ELSE location_category END AS mapped FROM adt""",
)
def prj_03(spark: SparkSession, d: str) -> DataFrame:
    rules = [(F.col("location_type") == "burn_icu", {"icu": "burn"}), (None, {None: "unmapped", "icu": "intensive"})]
    return read(spark, d, "adt").select("adt_id", T.mapped(F.col("location_category"), rules).alias("mapped"))


@query("prj_04_flag", "SELECT hospital_id, CASE WHEN hospital_type = 'academic' THEN '1' ELSE '0' END AS academic FROM hospital_sites")
def prj_04(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "hospital_sites").select("hospital_id", T.flag(F.col("hospital_type") == "academic").alias("academic"))


@query(
    "prj_05_categorical_token",
    f"""WITH t AS (SELECT assessment_id, assessment_category AS c, regexp_replace({_CAT_SQL.format('categorical_value')}, '^_+|_+$', '', 'g') AS v FROM patient_assessments)
        SELECT assessment_id, CASE WHEN v <> '' THEN c || '=' || CASE WHEN regexp_full_match(v, '[+-]?[0-9]+') THEN 'cat_' || v ELSE v END END AS token FROM t""",
)
def prj_05(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "patient_assessments").select("assessment_id", T.categorical_token(F.col("assessment_category"), F.col("categorical_value")).alias("token"))


@query("prj_06_convert", "SELECT crrt_id, CAST(blood_flow_rate AS DOUBLE) / 1000.0 AS litres, CAST(dialysate_flow_rate AS DOUBLE) * 24.0 AS per_day FROM crrt_therapy")
def prj_06(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "crrt_therapy").select("crrt_id", N.scale(F.col("blood_flow_rate").cast("double"), 0.001).alias("litres"), N.scale(F.col("dialysate_flow_rate").cast("double"), 24).alias("per_day"))


_DOSE_UNITS = [
    ("mcg/kg/min", "mass", 1.0, True, 1.0), ("MG / hr", "mass", 1000.0, False, 60.0), ("Units/hour", "units", 1.0, False, 60.0), ("milliunits/min", "units", 0.001, False, 1.0),
    ("g", "mass", 1e6, False, None), ("ml/kg/h", "volume", 1.0, True, 60.0), ("l/day", "volume", 1000.0, False, 1440.0), ("meq", "charge", 1.0, False, None), ("mg/furlong", None, None, None, None), ("per dose", None, None, None, None),
]


@query("prj_07_unit_parse", "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join("NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v) if isinstance(v, bool) else f"{v}::DOUBLE" for v in r) + ")" for r in _DOSE_UNITS) + ") AS t(text, kind, factor, per_kg, minutes)")
def prj_07(spark: SparkSession, d: str) -> DataFrame:
    """Spelled dose units with what they measure, how much of it, per weight or not, and in how many minutes."""
    from eventide.operators import doses

    rows = []
    for text, *_ in _DOSE_UNITS:
        powers, size = doses.dimensions(text) or (None, None)
        minutes = doses.minutes_of(text) if powers and "time" in powers else None
        rows.append((text, next(iter(powers)), size * (minutes or 1.0), "weight" in powers, minutes) if powers else (text, None, None, None, None))
    return spark.createDataFrame(rows, "text string, kind string, factor double, per_kg boolean, minutes double")


@query("prj_09_split_measure", "SELECT DISTINCT event_type AS name, CASE WHEN regexp_full_match(event_type, '.+_(in|out)') THEN regexp_extract(event_type, '^(.+)_(in|out)$', 1) ELSE event_type END AS what, CASE WHEN regexp_full_match(event_type, '.+_(in|out)') THEN regexp_extract(event_type, '^(.+)_(in|out)$', 2) END AS unit FROM events")
def prj_09(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").select(F.col("event_type").alias("name")).distinct().select("name", T.split_measure(F.col("name"), ["in", "out"]).alias("s")).select("name", "s.what", "s.unit")


@query(
    "prj_10_rename_concepts",
    "SELECT CASE lab_category WHEN 'bun' THEN 'urea_nitrogen' WHEN 'wbc' THEN 'white_cells' ELSE lab_category END AS concept, COUNT(*) AS n FROM labs GROUP BY 1",
)
def prj_10(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "labs").select(T.mapped(F.col("lab_category"), [(None, {"bun": "urea_nitrogen", "wbc": "white_cells"})]).alias("concept")).groupBy("concept").agg(F.count("*").alias("n"))


@query(
    "prj_11_floor_filter",
    """SELECT assessment_category, COUNT(*) AS n, COUNT(*) FILTER (numerical_value > 0 AND numerical_value < 3) AS dropped FROM patient_assessments GROUP BY 1""",
)
def prj_11(spark: SparkSession, d: str) -> DataFrame:
    low = (F.col("numerical_value") > 0) & (F.col("numerical_value") < 3)
    return read(spark, d, "patient_assessments").groupBy("assessment_category").agg(F.count("*").alias("n"), F.count_if(F.coalesce(low, F.lit(False))).alias("dropped"))


@query(
    "prj_12_to_utc",
    """WITH l AS (SELECT hospitalization_id, h.hospital_id, timezone AS z, discharge_dttm AT TIME ZONE 'UTC' AS wall FROM hospitalization h JOIN hospital_sites s USING (hospital_id) WHERE discharge_dttm IS NOT NULL),
            c AS (SELECT *, (wall AT TIME ZONE z) - to_minutes(k * 30) AS u FROM l, (SELECT unnest(range(0, 5)) AS k))
       SELECT hospitalization_id, hospital_id, epoch_us(min(u) FILTER (u AT TIME ZONE z = wall)) AS utc_us FROM c GROUP BY hospitalization_id, hospital_id, z, wall""",
)
def prj_12(spark: SparkSession, d: str) -> DataFrame:
    """Every discharge read as if it were a wall-clock time: the earlier instant of a repeated hour, null in a skipped one."""
    rows = read(spark, d, "hospitalization").where("discharge_dttm is not null").join(read(spark, d, "hospital_sites").select("hospital_id", "timezone"), "hospital_id")
    rows = rows.select("hospitalization_id", "hospital_id", "timezone", "discharge_dttm").distinct()
    return rows.select("hospitalization_id", "hospital_id", F.unix_micros(N.to_utc(F.col("discharge_dttm"), F.col("timezone"))).alias("utc_us"))


@query("prj_13_censor_open", "SELECT hospitalization_id, epoch_us(COALESCE(discharge_dttm, TIMESTAMPTZ '2026-01-01 00:00:00+00')) AS end_us FROM hospitalization")
def prj_13(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "hospitalization").select("hospitalization_id", F.unix_micros(F.coalesce("discharge_dttm", F.expr("timestamp'2026-01-01 00:00:00'"))).alias("end_us"))


@query("prj_14_availability_lag", "SELECT lab_id, epoch_us(lab_result_dttm) + 30 * 60000000 AS available_us FROM labs")
def prj_14(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "labs").select("lab_id", F.unix_micros(tables.with_lag(F.col("lab_result_dttm"), 30)).alias("available_us"))


@query("prj_15_labels", "SELECT hospitalization_id, CASE lower(trim(discharge_category)) WHEN 'home' THEN 'home' WHEN 'expired' THEN 'died' WHEN 'hospice' THEN 'hospice' ELSE 'unknown' END AS disposition FROM hospitalization")
def prj_15(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "hospitalization").select("hospitalization_id", T.label(F.col("discharge_category"), {"home": "home", "expired": "died", "hospice": "hospice"}).alias("disposition"))


@query(
    "prj_16_z_score",
    """WITH s AS (SELECT lab_category, avg(lab_value_numeric) AS c, stddev_pop(lab_value_numeric) AS sd FROM labs WHERE lab_value_numeric IS NOT NULL AND NOT isnan(lab_value_numeric) GROUP BY 1)
       SELECT lab_id, round(CASE WHEN NOT isnan(lab_value_numeric) AND sd > 0 AND abs((lab_value_numeric - c) / sd) <= 5 THEN (lab_value_numeric - c) / sd END, 6) AS z FROM labs JOIN s USING (lab_category)""",
)
def prj_16(spark: SparkSession, d: str) -> DataFrame:
    labs = read(spark, d, "labs")
    stats = labs.where(N.finite(F.col("lab_value_numeric"))).groupBy("lab_category").agg(F.avg("lab_value_numeric").alias("c"), F.stddev_pop("lab_value_numeric").alias("sd"))
    return labs.join(stats, "lab_category").select("lab_id", F.round(N.z_score(F.col("lab_value_numeric"), F.col("c"), F.col("sd"), 5), 6).alias("z"))


@query(
    "prj_18_prefix_any",
    "SELECT p_brand, bool_or(regexp_matches(regexp_replace(upper(p_type), '[^A-Z0-9]', '', 'g'), '^(?:PROMO|ECON)')) AS has_prefix FROM part GROUP BY 1",
)
def prj_18(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").groupBy("p_brand").agg(F.bool_or(T.matches_any_prefix(F.col("p_type"), ["PROMO", "ECON"])).alias("has_prefix"))


@query(
    "prj_19_split_token",
    """WITH t AS (SELECT DISTINCT lab_category || '#' || CAST(length(lab_name) % 7 AS VARCHAR) AS token FROM labs UNION SELECT DISTINCT 'mode=' || crrt_mode_category FROM crrt_therapy WHERE crrt_mode_category IS NOT NULL UNION SELECT DISTINCT device_category FROM ecmo_mcs WHERE device_category IS NOT NULL)
       SELECT token, CASE WHEN contains(token, '#') THEN 'bin' WHEN contains(token, '=') THEN 'category' ELSE 'bare' END AS kind, regexp_extract(token, '^([^#=]+)', 1) AS concept, CASE WHEN regexp_matches(token, '[#=]') THEN regexp_extract(token, '[#=](.*)$', 1) END AS detail FROM t WHERE token IS NOT NULL""",
)
def prj_19(spark: SparkSession, d: str) -> DataFrame:
    tokens = (
        read(spark, d, "labs").select(T.bin_token(F.col("lab_category"), F.length("lab_name") % 7).alias("token"))
        .unionByName(read(spark, d, "crrt_therapy").select(F.concat(F.lit("mode="), "crrt_mode_category").alias("token")))
        .unionByName(read(spark, d, "ecmo_mcs").select(F.col("device_category").alias("token")))
    )
    return tokens.where("token is not null").distinct().select("token", T.split_token(F.col("token")).alias("s")).select("token", "s.*")


@query(
    "prj_22_redact",
    """SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?i)(^|[^a-z0-9_])(patient_id|hospitalization_id|hosp_id|encounter_id|subject_id|stay_id|mrn)[\t ]*[=:][\t ]*[^\t\n\r\f ]+', '\\1\\2=<redacted>', 'g'), '(?:/[A-Za-z0-9._-]+){2,}', '<path>', 'g'), '"[^"]*"', '"<text>"', 'g'), '[0-9]{5,}', '<number>', 'g') AS clean FROM documents""",
)
def prj_22(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", T.redact(F.col("text")).alias("clean"))


@query("prj_23_unit_interval", "SELECT patient_id, round(CAST(('0x' || substr(sha256('7:' || patient_id), 1, 16))::UBIGINT AS DOUBLE) / 18446744073709551616.0, 9) AS u FROM patient")
def prj_23(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "patient").select("patient_id", F.round(N.unit_interval(F.col("patient_id"), seed="7"), 9).alias("u"))


@query("prj_24_time_bin", "SELECT lab_id, CAST(floor(date_diff('second', lab_order_dttm, lab_result_dttm) // 60 * 24.0 / 2880) AS INTEGER) AS bin FROM labs WHERE lab_result_dttm >= lab_order_dttm")
def prj_24(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "labs").where("lab_result_dttm >= lab_order_dttm")
    return rows.select("lab_id", N.time_bin(N.minutes("lab_order_dttm", "lab_result_dttm"), 24, 48).alias("bin"))


@query(
    "prj_25_before_anchor",
    "SELECT doc_id FROM documents JOIN (SELECT hospitalization_id, min(admission_dttm) AS a FROM hospitalization WHERE hospitalization_id IS NOT NULL GROUP BY 1) USING (hospitalization_id) WHERE note_dttm <= a + INTERVAL 24 HOUR",
)
def prj_25(spark: SparkSession, d: str) -> DataFrame:
    stays = read(spark, d, "hospitalization").where("hospitalization_id is not null").groupBy("hospitalization_id").agg(F.min("admission_dttm").alias("a"))
    return read(spark, d, "documents").select("doc_id", "hospitalization_id", "note_dttm").join(stays, "hospitalization_id").where(F.col("note_dttm") <= tables.with_lag(F.col("a"), 24 * 60)).select("doc_id")


@query(
    "prj_26_rules",
    """WITH f AS (SELECT patient_id, max(CASE WHEN code_status_category = 'DNR' THEN 1 ELSE 0 END) AS a, max(CASE WHEN code_status_category = 'AND' THEN 1 ELSE 0 END) AS b, max(CASE WHEN code_status_category = 'Full' THEN 1 ELSE 0 END) AS c FROM code_status WHERE patient_id IS NOT NULL GROUP BY 1)
       SELECT patient_id FROM f WHERE a + b + c >= 2 AND NOT (a = 1 AND b = 1)""",
)
def prj_26(spark: SparkSession, d: str) -> DataFrame:
    has = lambda v: F.coalesce(F.bool_or(F.col("code_status_category") == v), F.lit(False))
    f = read(spark, d, "code_status").where("patient_id is not null").groupBy("patient_id").agg(has("DNR").alias("a"), has("AND").alias("b"), has("Full").alias("c"))
    return f.where(tables.rule({"count_at_least": (["a", "b", "c"], 2)}) & ~tables.rule({"all_true": ["a", "b"]})).select("patient_id")


_MELT = " UNION ALL ".join(f"SELECT crrt_id, coalesce(crrt_mode_category, 'unknown') || '_{c}' AS concept, CAST({c} AS DOUBLE) AS value FROM crrt_therapy WHERE {c} IS NOT NULL AND NOT isnan({c})" for c in RATES)


@query("rsh_01_melt", _MELT)
def rsh_01(spark: SparkSession, d: str) -> DataFrame:
    return reshape.melt(read(spark, d, "crrt_therapy"), ["crrt_id"], RATES, qualifier=F.col("crrt_mode_category"))


@query(
    "rsh_02_transitions",
    """WITH o AS (SELECT patient_id, epoch_us(start_dttm) AS at_us, code_status_category AS status, lag(code_status_category) OVER w AS p, row_number() OVER w AS r FROM (SELECT DISTINCT patient_id, start_dttm, code_status_category FROM code_status WHERE patient_id IS NOT NULL AND start_dttm IS NOT NULL AND code_status_category IS NOT NULL)
       WINDOW w AS (PARTITION BY patient_id ORDER BY start_dttm, code_status_category)) SELECT patient_id, at_us, status FROM o WHERE p IS NULL OR p <> status""",
)
def rsh_02(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "code_status").where("patient_id is not null and start_dttm is not null and code_status_category is not null").select("patient_id", "start_dttm", "code_status_category").distinct()
    out = reshape.transitions(rows, ["patient_id"], "start_dttm", "code_status_category")
    return out.select("patient_id", F.unix_micros("start_dttm").alias("at_us"), F.col("code_status_category").alias("status"))


_STAYS = "(SELECT DISTINCT patient_id, hospitalization_id, admission_dttm, discharge_dttm FROM hospitalization WHERE patient_id IS NOT NULL AND hospitalization_id IS NOT NULL AND discharge_dttm IS NOT NULL)"


def _stays(spark: SparkSession, d: str) -> DataFrame:
    return (
        read(spark, d, "hospitalization").where("patient_id is not null and hospitalization_id is not null and discharge_dttm is not null")
        .select("patient_id", "hospitalization_id", "admission_dttm", "discharge_dttm").distinct()
    )


@query(
    "rsh_03_state_at_start",
    f"""WITH j AS (SELECT s.*, c.code_status_id, c.start_dttm, max(CASE WHEN c.start_dttm <= admission_dttm THEN c.start_dttm END) OVER (PARTITION BY s.patient_id, s.hospitalization_id, s.admission_dttm, s.discharge_dttm) AS l
        FROM {_STAYS} s JOIN code_status c USING (patient_id) WHERE c.start_dttm <= s.discharge_dttm)
        SELECT hospitalization_id, epoch_us(admission_dttm) AS admission_us, code_status_id, epoch_us(greatest(start_dttm, admission_dttm)) AS placed_us FROM j WHERE start_dttm > admission_dttm OR start_dttm = l""",
)
def rsh_03(spark: SparkSession, d: str) -> DataFrame:
    states = read(spark, d, "code_status").where("start_dttm is not null").select("patient_id", "code_status_id", "start_dttm")
    out = reshape.state_at_start(states, _stays(spark, d), "patient_id", "start_dttm", "admission_dttm", "discharge_dttm")
    return out.select("hospitalization_id", F.unix_micros("admission_dttm").alias("admission_us"), "code_status_id", F.unix_micros("placed_at").alias("placed_us"))


@query(
    "rsh_04_carry_forward",
    """WITH s AS (SELECT hospitalization_id, min(admission_dttm) + INTERVAL 24 HOUR AS st FROM hospitalization WHERE hospitalization_id IS NOT NULL GROUP BY 1),
       e AS (SELECT a.hospitalization_id, a.assessment_category AS concept, a.assessment_id, a.recorded_dttm, s.st FROM patient_assessments a JOIN s USING (hospitalization_id) WHERE a.recorded_dttm IS NOT NULL),
       b AS (SELECT hospitalization_id, concept, st, arg_max(assessment_id, (recorded_dttm, assessment_id)) AS assessment_id FROM e WHERE recorded_dttm < st GROUP BY ALL)
       SELECT assessment_id, epoch_us(st) AS at_us FROM b UNION ALL SELECT assessment_id, epoch_us(recorded_dttm) FROM e WHERE recorded_dttm >= st""",
)
def rsh_04(spark: SparkSession, d: str) -> DataFrame:
    stays = read(spark, d, "hospitalization").where("hospitalization_id is not null").groupBy("hospitalization_id").agg(tables.with_lag(F.min("admission_dttm"), 24 * 60).alias("st"))
    events = read(spark, d, "patient_assessments").where("recorded_dttm is not null").select("assessment_id", "hospitalization_id", F.col("assessment_category").alias("concept"), "recorded_dttm")
    out = reshape.carry_forward(events, stays, "hospitalization_id", "recorded_dttm", "concept", "st", ["assessment_id"])
    return out.select("assessment_id", F.unix_micros("recorded_dttm").alias("at_us"))


@query(
    "rsh_05_static_rows",
    """SELECT patient_id, 0 AS rank, 'sex' AS concept, min(sex_category) AS cat_value FROM patient GROUP BY 1 HAVING min(sex_category) IS NOT NULL UNION ALL
       SELECT patient_id, 1, 'race', min(race_category) FROM patient GROUP BY 1 HAVING min(race_category) IS NOT NULL UNION ALL
       SELECT patient_id, 2, 'ethnicity', min(ethnicity_category) FROM patient GROUP BY 1 HAVING min(ethnicity_category) IS NOT NULL""",
)
def rsh_05(spark: SparkSession, d: str) -> DataFrame:
    one = read(spark, d, "patient").groupBy("patient_id").agg(*[F.min(f"{c}_category").alias(c) for c in ("sex", "race", "ethnicity")])
    rows = F.array(*[F.struct(F.lit(i).alias("rank"), F.lit(c).alias("concept"), F.col(c).alias("cat_value")) for i, c in enumerate(("sex", "race", "ethnicity"))])
    return one.select("patient_id", F.inline(rows)).where("cat_value is not null")


@query(
    "rsh_06_derived_sum",
    """SELECT hospitalization_id, epoch_us(recorded_dttm) AS at_us, sum(CAST(v AS DOUBLE)) AS total FROM (SELECT hospitalization_id, recorded_dttm, unnest([pre_filter_replacement_fluid_rate, post_filter_replacement_fluid_rate, dialysate_flow_rate]) AS v FROM crrt_therapy WHERE hospitalization_id IS NOT NULL AND recorded_dttm IS NOT NULL)
       WHERE v IS NOT NULL AND NOT isnan(v) GROUP BY ALL HAVING count(*) >= 3 AND count(*) % 3 = 0 AND count(*) = 3""",
)
def rsh_06(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "crrt_therapy").where("hospitalization_id is not null and recorded_dttm is not null")
    long = reshape.melt(rows, ["hospitalization_id", "recorded_dttm"], RATES[1:4])
    return long.groupBy("hospitalization_id", F.unix_micros("recorded_dttm").alias("at_us")).agg(F.sum("value").alias("total"), F.count("*").alias("n")).where("n = 3").drop("n")


@query(
    "rsh_09_shadowed_duplicates",
    """SELECT o_orderkey FROM orders o WHERE NOT (o_orderstatus = 'P' AND EXISTS (SELECT 1 FROM orders k WHERE k.o_orderstatus = 'O' AND k.o_custkey = o.o_custkey AND k.o_orderpriority IS NOT DISTINCT FROM o.o_orderpriority))""",
)
def rsh_09(spark: SparkSession, d: str) -> DataFrame:
    return reshape.drop_shadowed(read(spark, d, "orders"), ["o_custkey", "o_orderpriority"], "o_orderstatus", "P", "O").select("o_orderkey")


@query(
    "rsh_11_aligned_arrays",
    "SELECT vec_id, CAST(i - 1 AS INTEGER) AS pos, CAST(embedding[i] AS DOUBLE) AS value FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)",
)
def rsh_11(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("value"))
    return reshape.explode_aligned(e, ["vec_id"], ["value"])


@query(
    "join_01_window",
    """SELECT a.assessment_id, s.patient_id, CAST(date_diff('second', admission_dttm, recorded_dttm) // 60 AS BIGINT) AS pos_min FROM patient_assessments a
       JOIN (SELECT DISTINCT patient_id, hospitalization_id, admission_dttm, discharge_dttm FROM hospitalization WHERE patient_id IS NOT NULL AND hospitalization_id IS NOT NULL AND discharge_dttm IS NOT NULL) s USING (hospitalization_id)
       WHERE recorded_dttm BETWEEN admission_dttm AND discharge_dttm""",
)
def join_01(spark: SparkSession, d: str) -> DataFrame:
    stays = _stays(spark, d)
    events = read(spark, d, "patient_assessments").select("assessment_id", "hospitalization_id", "recorded_dttm")
    near = events.join(stays, "hospitalization_id").where(F.col("recorded_dttm").between(F.col("admission_dttm"), F.col("discharge_dttm")))
    return near.select("assessment_id", "patient_id", N.minutes("admission_dttm", "recorded_dttm").alias("pos_min"))


_ASOF_RIGHT = "(SELECT hospitalization_id, lab_result_dttm AS rt, avg(lab_value_numeric) AS v FROM labs WHERE lab_category = 'creatinine' AND lab_value_numeric IS NOT NULL AND lab_result_dttm IS NOT NULL AND hospitalization_id IS NOT NULL GROUP BY 1, 2)"


@query(
    "join_02_asof",
    f"""SELECT a.crrt_id, round(r.v, 6) AS creatinine FROM (SELECT * FROM crrt_therapy WHERE hospitalization_id IS NOT NULL AND recorded_dttm IS NOT NULL) a ASOF LEFT JOIN {_ASOF_RIGHT} r ON a.hospitalization_id = r.hospitalization_id AND a.recorded_dttm >= r.rt""",
)
def join_02(spark: SparkSession, d: str) -> DataFrame:
    left = read(spark, d, "crrt_therapy").where("hospitalization_id is not null and recorded_dttm is not null").select("crrt_id", "hospitalization_id", "recorded_dttm")
    right = read(spark, d, "labs").where("lab_category = 'creatinine'").select("hospitalization_id", "lab_result_dttm", "lab_value_numeric")
    out = joins.asof(left, right, "hospitalization_id", "recorded_dttm", "lab_result_dttm", "lab_value_numeric", out="creatinine")
    return out.select("crrt_id", F.round("creatinine", 6).alias("creatinine"))


@query(
    "join_03_asof_strict",
    f"""SELECT a.lab_id, round(r.v, 6) AS before FROM (SELECT * FROM labs WHERE lab_category = 'creatinine' AND hospitalization_id IS NOT NULL AND lab_result_dttm IS NOT NULL) a ASOF LEFT JOIN {_ASOF_RIGHT} r ON a.hospitalization_id = r.hospitalization_id AND a.lab_result_dttm > r.rt""",
)
def join_03(spark: SparkSession, d: str) -> DataFrame:
    labs = read(spark, d, "labs").where("lab_category = 'creatinine' and hospitalization_id is not null and lab_result_dttm is not null").select("lab_id", "hospitalization_id", "lab_result_dttm", "lab_value_numeric")
    out = joins.asof(labs.drop("lab_value_numeric"), labs, "hospitalization_id", "lab_result_dttm", "lab_result_dttm", "lab_value_numeric", strict=True, out="before")
    return out.select("lab_id", F.round("before", 6).alias("before"))


@query(
    "join_04_latest_before",
    """WITH s AS (SELECT hospitalization_id, max(admission_dttm) AS a FROM hospitalization WHERE hospitalization_id IS NOT NULL GROUP BY 1),
       n AS (SELECT s.hospitalization_id, arg_max(assessment_id, (recorded_dttm, assessment_id)) AS last_id FROM s JOIN patient_assessments p USING (hospitalization_id) WHERE recorded_dttm < a + INTERVAL 48 HOUR AND recorded_dttm >= a + INTERVAL 24 HOUR GROUP BY 1)
       SELECT s.hospitalization_id, last_id FROM s LEFT JOIN n USING (hospitalization_id)""",
)
def join_04(spark: SparkSession, d: str) -> DataFrame:
    stays = read(spark, d, "hospitalization").where("hospitalization_id is not null").groupBy("hospitalization_id").agg(tables.with_lag(F.max("admission_dttm"), 48 * 60).alias("zero"))
    rows = read(spark, d, "patient_assessments").select("hospitalization_id", "recorded_dttm", F.col("assessment_id").alias("last_id"))
    return joins.latest_before(stays, rows, "hospitalization_id", "zero", "recorded_dttm", ["last_id"], lookback_hours=24).select("hospitalization_id", "last_id")


@query("join_07_anti", "SELECT patient_id FROM patient WHERE patient_id NOT IN (SELECT patient_id FROM code_status WHERE patient_id IS NOT NULL)")
def join_07(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "patient").select("patient_id").join(read(spark, d, "code_status").select("patient_id"), "patient_id", "left_anti")


@query("join_09_left_default", "SELECT p.patient_id, coalesce(n, 0) AS n_status FROM patient p LEFT JOIN (SELECT patient_id, COUNT(*) AS n FROM code_status GROUP BY 1) c ON p.patient_id = c.patient_id")
def join_09(spark: SparkSession, d: str) -> DataFrame:
    n = read(spark, d, "code_status").groupBy("patient_id").agg(F.count("*").alias("n"))
    return read(spark, d, "patient").select("patient_id").join(n, "patient_id", "left").select("patient_id", F.coalesce("n", F.lit(0)).alias("n_status"))


@query(
    "join_11_previous_stay",
    f"SELECT s.hospitalization_id, epoch_us(s.admission_dttm) AS admission_us, epoch_us(max(p.discharge_dttm)) AS prior_us FROM {_STAYS} s LEFT JOIN {_STAYS} p ON p.patient_id = s.patient_id AND p.discharge_dttm < s.admission_dttm GROUP BY s.patient_id, s.hospitalization_id, s.admission_dttm, s.discharge_dttm",
)
def join_11(spark: SparkSession, d: str) -> DataFrame:
    out = joins.previous_stay(_stays(spark, d), "patient_id", "admission_dttm", "discharge_dttm")
    return out.select("hospitalization_id", F.unix_micros("admission_dttm").alias("admission_us"), F.unix_micros("prior_end").alias("prior_us"))


@query(
    "join_13_lists",
    "SELECT c_custkey, coalesce(s, '') AS orders FROM customer LEFT JOIN (SELECT o_custkey, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS s FROM orders GROUP BY 1) ON o_custkey = c_custkey",
)
def join_13(spark: SparkSession, d: str) -> DataFrame:
    orders = read(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    out = joins.lists_per_key(read(spark, d, "customer").select("c_custkey"), orders, "c_custkey", ["o_orderkey"], "l")
    return out.select("c_custkey", F.array_join(F.transform("l", lambda x: x["o_orderkey"].cast("string")), ",").alias("orders"))


@query(
    "agg_02_first_per_key",
    "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r FROM orders) WHERE r = 1",
)
def agg_02(spark: SparkSession, d: str) -> DataFrame:
    return windows.first_per(read(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey")


@query(
    "agg_03_waterfall",
    """SELECT COUNT(*) AS n_rows, COUNT(*) FILTER (patient_id IS NULL) AS no_patient, COUNT(*) FILTER (patient_id IS NOT NULL AND discharge_dttm IS NULL) AS still_open, COUNT(*) FILTER (patient_id IS NOT NULL AND discharge_dttm IS NOT NULL AND (age_at_admission < 18 OR age_at_admission IS NULL)) AS not_adult,
       COUNT(*) FILTER (patient_id IS NOT NULL AND discharge_dttm IS NOT NULL AND age_at_admission >= 18) AS kept, COUNT(DISTINCT patient_id) AS patients FROM hospitalization""",
)
def agg_03(spark: SparkSession, d: str) -> DataFrame:
    reason = F.when(F.col("patient_id").isNull(), "no_patient").when(F.col("discharge_dttm").isNull(), "still_open").when(F.coalesce(F.col("age_at_admission") >= 18, F.lit(False)), "kept").otherwise("not_adult")
    rows = read(spark, d, "hospitalization").withColumn("r", reason)
    return rows.agg(F.count("*").alias("n_rows"), *[F.count_if(F.col("r") == x).alias(x) for x in ("no_patient", "still_open", "not_adult", "kept")], F.count_distinct("patient_id").alias("patients"))


@query(
    "agg_04_conditional",
    "SELECT hospitalization_id, bool_or(assessment_category = 'rass') AS any_rass, min(CASE WHEN assessment_category = 'gcs_total' THEN numerical_value END) AS worst, COUNT(*) FILTER (numerical_value > 8) AS n_high FROM patient_assessments WHERE hospitalization_id IS NOT NULL GROUP BY 1",
)
def agg_04(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "patient_assessments").where("hospitalization_id is not null").groupBy("hospitalization_id").agg(
        F.bool_or(F.col("assessment_category") == "rass").alias("any_rass"), F.min(F.when(F.col("assessment_category") == "gcs_total", F.col("numerical_value"))).alias("worst"), F.count_if(F.col("numerical_value") > 8).alias("n_high")
    )


@query("agg_05_entity_floor", "SELECT lab_name AS token, COUNT(DISTINCT hospitalization_id) AS stays FROM labs GROUP BY 1 HAVING COUNT(DISTINCT hospitalization_id) >= 20")
def agg_05(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "labs").groupBy(F.col("lab_name").alias("token")).agg(F.count_distinct("hospitalization_id").alias("stays")).where("stays >= 20")


@query(
    "agg_06_mode",
    "SELECT lab_category, reference_unit, n FROM (SELECT lab_category, reference_unit, COUNT(*) AS n, row_number() OVER (PARTITION BY lab_category ORDER BY COUNT(*) DESC, reference_unit) AS r FROM labs WHERE reference_unit IS NOT NULL GROUP BY 1, 2) WHERE r = 1",
)
def agg_06(spark: SparkSession, d: str) -> DataFrame:
    n = read(spark, d, "labs").where("reference_unit is not null").groupBy("lab_category", "reference_unit").agg(F.count("*").alias("n"))
    return windows.first_per(n, ["lab_category"], [F.desc("n"), "reference_unit"])


@query(
    "agg_07_range_report",
    """SELECT lab_category, COUNT(*) AS n, round(avg(CASE WHEN lab_value_numeric < 1 OR lab_value_numeric > 100 THEN 1.0 ELSE 0.0 END), 9) AS outside, round(quantile_cont(lab_value_numeric, 0.01), 6) AS p01, round(quantile_cont(lab_value_numeric, 0.5), 6) AS p50, round(quantile_cont(lab_value_numeric, 0.99), 6) AS p99
       FROM labs WHERE lab_value_numeric IS NOT NULL AND NOT isnan(lab_value_numeric) GROUP BY 1""",
)
def agg_07(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("lab_value_numeric")
    q = read(spark, d, "labs").where(N.finite(v)).groupBy("lab_category").agg(F.count("*").alias("n"), F.round(F.avg(F.when((v < 1) | (v > 100), 1.0).otherwise(0.0)), 9).alias("outside"), F.percentile(v, [0.01, 0.5, 0.99]).alias("q"))
    return q.select("lab_category", "n", "outside", *[F.round(F.col("q")[i], 6).alias(p) for i, p in enumerate(("p01", "p50", "p99"))])


@query(
    "agg_09_unit_mismatch",
    "SELECT l.lab_category, l.reference_unit AS unit, c.reference_unit AS expected, COUNT(*) AS n FROM labs l JOIN clif_lab_categories c USING (lab_category) WHERE l.reference_unit IS NOT NULL AND l.reference_unit <> c.reference_unit GROUP BY ALL",
)
def agg_09(spark: SparkSession, d: str) -> DataFrame:
    expected = read(spark, d, "clif_lab_categories").select("lab_category", F.col("reference_unit").alias("expected"))
    units = read(spark, d, "labs").where("reference_unit is not null").groupBy("lab_category", F.col("reference_unit").alias("unit")).agg(F.count("*").alias("n"))
    return units.join(expected, "lab_category").where("unit <> expected")


@query(
    "agg_14_token_report",
    """WITH t AS (SELECT hospitalization_id, COUNT(*) AS n, COUNT(*) FILTER (lab_category IS NULL) AS unk FROM labs WHERE hospitalization_id IS NOT NULL GROUP BY 1) SELECT COUNT(*) AS stays, CAST(sum(n) AS BIGINT) AS tokens, round(avg(n), 6) AS mean_n, round(quantile_cont(n, 0.99), 6) AS p99, CAST(sum(unk) AS BIGINT) AS unk FROM t""",
)
def agg_14(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "labs").where("hospitalization_id is not null").groupBy("hospitalization_id").agg(F.count("*").alias("n"), F.count_if(F.col("lab_category").isNull()).alias("unk"))
    return t.agg(F.count("*").alias("stays"), F.sum("n").alias("tokens"), F.round(F.avg("n"), 6).alias("mean_n"), F.round(F.percentile("n", 0.99), 6).alias("p99"), F.sum("unk").alias("unk"))


@query("agg_17_status_shares", "SELECT discharge_category AS status, COUNT(*) AS n, round(COUNT(*) / CAST(sum(COUNT(*)) OVER () AS DOUBLE), 9) AS share FROM hospitalization GROUP BY 1")
def agg_17(spark: SparkSession, d: str) -> DataFrame:
    n = read(spark, d, "hospitalization").groupBy(F.col("discharge_category").alias("status")).agg(F.count("*").alias("n"))
    return n.select("status", "n", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 9).alias("share"))


@query("agg_18_count_matrix", "SELECT hospitalization_id, lab_category AS token, COUNT(*) AS n FROM labs WHERE hospitalization_id IS NOT NULL AND lab_category IS NOT NULL GROUP BY 1, 2")
def agg_18(spark: SparkSession, d: str) -> DataFrame:
    from eventide.operators.encode import count_matrix

    return count_matrix(read(spark, d, "labs").where("hospitalization_id is not null and lab_category is not null").withColumnRenamed("lab_category", "token"), "hospitalization_id", "token")


@query(
    "agg_21_context_shares",
    """WITH t AS (SELECT hospitalization_id, COUNT(*) AS n FROM labs WHERE hospitalization_id IS NOT NULL GROUP BY 1)
       SELECT k AS context, round(sum(greatest(n - k, 0)) / sum(n), 9) AS lost, round(avg(CASE WHEN n > k THEN 1.0 ELSE 0.0 END), 9) AS over FROM t, (SELECT unnest([16, 64, 256]) AS k) GROUP BY 1""",
)
def agg_21(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "labs").where("hospitalization_id is not null").groupBy("hospitalization_id").agg(F.count("*").alias("n"))
    one = t.agg(F.sum("n").alias("all"), *[x for k in (16, 64, 256) for x in (F.sum(F.greatest(F.col("n") - k, F.lit(0))).alias(f"l{k}"), F.avg(F.when(F.col("n") > k, 1.0).otherwise(0.0)).alias(f"o{k}"))])
    return one.select(F.inline(F.array(*[F.struct(F.lit(k).alias("context"), F.round(F.col(f"l{k}") / F.col("all"), 9).alias("lost"), F.round(f"o{k}", 9).alias("over")) for k in (16, 64, 256)])))


@query("agg_22_pivot", "SELECT hospital_id, COUNT(*) FILTER (location_category = 'icu') AS icu, COUNT(*) FILTER (location_category = 'ward') AS ward, COUNT(*) FILTER (location_category = 'ed') AS ed FROM adt GROUP BY 1")
def agg_22(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "adt").groupBy("hospital_id").pivot("location_category", ["icu", "ward", "ed"]).count().na.fill(0, ["icu", "ward", "ed"])


@query("agg_23_coverage", "SELECT " + ", ".join(f"COUNT(*) FILTER ({c} IS NOT NULL AND NOT isnan({c})) AS {c}" for c in RATES) + ", COUNT(*) AS n_rows FROM crrt_therapy")
def agg_23(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "crrt_therapy").agg(*[F.count_if(F.col(c).isNotNull() & ~F.isnan(c)).alias(c) for c in RATES], F.count("*").alias("n_rows"))


@query(
    "set_01_union_missing",
    "SELECT adt_id AS record_id, location_category, CAST(NULL AS VARCHAR) AS device_category FROM adt UNION ALL SELECT ecmo_id, NULL, device_category FROM ecmo_mcs",
)
def set_01(spark: SparkSession, d: str) -> DataFrame:
    a = read(spark, d, "adt").select(F.col("adt_id").alias("record_id"), "location_category")
    return a.unionByName(read(spark, d, "ecmo_mcs").select(F.col("ecmo_id").alias("record_id"), "device_category"), allowMissingColumns=True)


@query("set_03_distinct", "SELECT DISTINCT location_category, location_type FROM adt")
def set_03(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "adt").select("location_category", "location_type").distinct()


@query("srt_03_top_k", "SELECT lab_category, COUNT(*) AS n FROM labs GROUP BY 1 ORDER BY n DESC, lab_category LIMIT 7")
def srt_03(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "labs").groupBy("lab_category").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lab_category").limit(7)
