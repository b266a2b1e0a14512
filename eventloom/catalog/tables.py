"""Sources, sinks, raw table preparation, lookups and extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventloom.catalog.registry import query, table, view
from eventloom.functions import numbers, times
from eventloom.operators import extract, prepare
from eventloom.plans.hospital import NARRATIVE_EVENTS
from eventloom.plans.timeline import run_folder
from eventloom.sources import tables as io

EOD = "+ INTERVAL 86399999999 MICROSECONDS"


def _scratch(spark, label: str) -> str:
    import uuid

    return f"{run_folder(spark)}/{label}-{uuid.uuid4().hex}"


# --- sources and sinks --------------------------------------------------------------------------------------------


@query("SELECT lpad(CAST(p_partkey AS VARCHAR), 8, '0') AS icd_code, '09' AS icd_version, p_name AS long_title FROM part")
def csv_text_scan(spark, folder):
    """Codes keep their leading zeros through CSV."""
    path = _scratch(spark, "codes")
    code = F.lpad(F.col("p_partkey").cast("string"), 8, "0").alias("icd_code")
    codes = table(spark, folder, "part").select(code, F.lit("09").alias("icd_version"), F.col("p_name").alias("long_title"))
    codes.write.option("header", "true").option("compression", "gzip").csv(path)
    return io.read_all_text(spark, path, ["icd_code", "icd_version", "long_title"])


QUOTED = "CASE doc_id % 4 WHEN 0 THEN 'a \"\"quoted\"\" \"title\", with comma' WHEN 1 THEN 'two' || chr(10) || 'lines, ' || source WHEN 2 THEN NULL ELSE '\"' END"


@query(f"SELECT doc_id, {QUOTED} AS title, lang FROM documents")
def csv_with_quotes(spark, folder):
    """Quotes, commas and line breaks inside quoted fields, and null fields, through standard CSV."""
    path = _scratch(spark, "quoted")
    rows = table(spark, folder, "documents").selectExpr("doc_id", f"{QUOTED.replace('chr(10)', 'char(10)')} AS title", "lang")
    rows.write.options(header=True, escape='"', compression="gzip").csv(path)
    return io.read_csv(spark, path, types={"doc_id": "bigint"})


@query("SELECT l_orderkey, l_quantity FROM lineitem WHERE l_shipdate >= TIMESTAMP '2000-01-01'")
def pruned_parquet_scan(spark, folder):
    recent = F.col("l_shipdate") >= F.lit("2000-01-01").cast("timestamp_ntz")
    return table(spark, folder, "lineitem").filter(recent).select("l_orderkey", "l_quantity")


PARTITIONED = """SELECT 'a' AS task, CASE WHEN o_custkey % 10 < 8 THEN 'train' ELSE 'held_out' END AS split,
    CAST(o_custkey % 3 AS VARCHAR) AS shard, o_custkey AS subject_id, o_orderdate AS prediction_time FROM orders
    UNION ALL SELECT 'b', 'train', CAST(c_custkey % 2 AS VARCHAR), c_custkey, NULL FROM customer"""


def partitioned_labels(spark, folder):
    split = F.when(F.col("o_custkey") % 10 < 8, "train").otherwise("held_out")
    a = table(spark, folder, "orders").select(
        F.lit("a").alias("task"), split.alias("split"), (F.col("o_custkey") % 3).cast("string").alias("shard"),
        F.col("o_custkey").alias("subject_id"), F.col("o_orderdate").alias("prediction_time"),
    )
    b = table(spark, folder, "customer").select(
        F.lit("b").alias("task"), F.lit("train").alias("split"), (F.col("c_custkey") % 2).cast("string").alias("shard"),
        F.col("c_custkey").alias("subject_id"), F.lit(None).cast("timestamp_ntz").alias("prediction_time"),
    )
    return a.unionByName(b)


@query(f"SELECT task, split, shard, count(*) AS n_rows FROM ({PARTITIONED}) WHERE split = 'train' GROUP BY ALL")
def discover_shards(spark, folder):
    """Partitioned write, then discovery with directories pruned by split."""
    path = _scratch(spark, "labels")
    io.write_partitioned(partitioned_labels(spark, folder), path)
    return io.discovered(io.read_partitioned(spark, path, split="train"))


@query(f"SELECT subject_id, prediction_time, split, shard FROM ({PARTITIONED}) WHERE task = 'a'")
def read_task_shards(spark, folder):
    path = _scratch(spark, "labels")
    io.write_partitioned(partitioned_labels(spark, folder), path)
    return io.read_partitioned(spark, path, tasks=["a"]).select("subject_id", "prediction_time", "split", "shard")


@query("SELECT r_regionkey, r_name FROM region")
def pass_through_table(spark, folder):
    return prepare.prepare_tables({"hosp/services": table(spark, folder, "region")})["hosp/services"]


@query("""SELECT task, shard, subject_id FROM (SELECT *, row_number() OVER (PARTITION BY task, shard ORDER BY subject_id) AS r
    FROM {dataset}) WHERE r <= 5""")
def cap_rows_per_shard(spark, folder):
    rows = view(spark, folder, "dataset").select("task", "shard", "subject_id")
    return io.cap_rows(rows, 5, by=("task", "shard"), order=("subject_id",))


SPLIT = "CASE WHEN subject_id % 3 = 0 THEN 'tuning' ELSE 'train' END"


@query(f"""SELECT task, split, shard, subject_id FROM (SELECT *, row_number() OVER (PARTITION BY task, split, shard ORDER BY subject_id) AS r
    FROM (SELECT *, {SPLIT} AS split FROM {{dataset}})) WHERE r <= 2""")
def cap_rows_per_split(spark, folder):
    """Shards are numbered within a split, so equal numbers of two splits are two shards."""
    rows = view(spark, folder, "dataset").selectExpr("task", f"{SPLIT} AS split", "shard", "subject_id")
    return io.cap_rows(rows, 2, order=("subject_id",))


# --- expressions used while preparing -----------------------------------------------------------------------------


@query("""SELECT icd_code, icd_version, long_title,
    CASE WHEN icd_version = '9' AND icd_code LIKE 'E%' THEN CASE WHEN length(icd_code) > 4 THEN icd_code[1:4] || '.' || icd_code[5:] ELSE icd_code END
    WHEN length(icd_code) > 3 THEN icd_code[1:3] || '.' || icd_code[4:] ELSE icd_code END AS norm_icd_code
    FROM (SELECT CASE WHEN length(icd_code) = 4 THEN 'E' || icd_code ELSE icd_code END AS icd_code, icd_version, long_title FROM {icd_titles})""")
def icd_diagnosis_dots(spark, folder):
    code = F.when(F.length("icd_code") == 4, F.concat(F.lit("E"), F.col("icd_code"))).otherwise(F.col("icd_code"))
    titles = view(spark, folder, "icd_titles").withColumn("icd_code", code)
    return prepare.prepare_tables({"hosp/d_icd_diagnoses": titles})["hosp/d_icd_diagnoses"]


@query("""SELECT *, CASE WHEN icd_version = '9' AND length(icd_code) > 2 THEN icd_code[1:2] || '.' || icd_code[3:] ELSE icd_code END AS norm_icd_code
    FROM {icd_titles}""")
def icd_procedure_dots(spark, folder):
    titles = view(spark, folder, "icd_titles")
    return prepare.prepare_tables({"hosp/d_icd_procedures": titles})["hosp/d_icd_procedures"]


@query(f"SELECT l_orderkey, l_linenumber, CAST(l_shipdate AS DATE) {EOD} AS chartdate FROM lineitem")
def date_to_end_of_day(spark, folder):
    rows = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_shipdate").alias("chartdate"))
    return prepare.promote_dates(rows)


DEMOGRAPHICS = """(SELECT subject_id, CASE gender WHEN 'F' THEN 'Female' WHEN 'M' THEN 'Male' ELSE gender END AS gender,
    anchor_year - anchor_age AS year_of_birth FROM {patients})"""


@query(f"SELECT * FROM {DEMOGRAPHICS}")
def demographics(spark, folder):
    return prepare.demographics(view(spark, folder, "patients"))


@query("SELECT stay_id, heartrate, charttime, CASE WHEN temperature > 45 THEN (temperature - 32) * 5 / 9 ELSE temperature END AS temperature FROM {vitals}")
def temperature_to_celsius(spark, folder):
    return prepare.to_celsius(view(spark, folder, "vitals"))


@query("SELECT result_name, result_value, TRY_CAST(result_value AS FLOAT) AS number FROM {measurements}")
def lenient_numbers(spark, folder):
    rows = view(spark, folder, "measurements").select("result_name", "result_value")
    return rows.withColumn("number", numbers.lenient_float(F.col("result_value")))


@query("""SELECT hadm_id, date_sub('day', make_date(1995, 1, 1)::TIMESTAMP, admittime) / 365.25 AS age FROM {admissions}""")
def age_in_years(spark, folder):
    rows = view(spark, folder, "admissions").select("hadm_id", "admittime", F.lit(1995).alias("year_of_birth"))
    return prepare.add_age(rows, "admittime").select("hadm_id", "age")


# --- lookups ------------------------------------------------------------------------------------------------------


@query("SELECT g.*, a.dischtime FROM {groups} g LEFT JOIN {admissions} a USING (hadm_id)")
def prepare_related_groups(spark, folder):
    """Time enrichment by id."""
    return prepare.discharge_times(view(spark, folder, "groups"), view(spark, folder, "admissions"))


@query("SELECT d.*, s.outtime FROM {ed_codes} d LEFT JOIN {stays} s USING (stay_id)")
def prepare_stay_diagnoses(spark, folder):
    return prepare.departure_times(view(spark, folder, "ed_codes"), view(spark, folder, "stays"))


@query("""SELECT l.subject_id, l.itemid, l.charttime, l.valuenum, coalesce(l.valueuom, '') AS valueuom, i.fluid, i.label
    FROM {labs} l LEFT JOIN {lab_items} i USING (itemid)""")
def prepare_lab_events(spark, folder):
    return prepare.lab_events(view(spark, folder, "labs"), view(spark, folder, "lab_items"))


CODED = """SELECT hadm_id, seq_num, CAST(icd_code AS VARCHAR) AS icd_code, CAST(icd_version AS VARCHAR) AS icd_version, dischtime, long_title{extra}
    FROM (SELECT c.*, a.dischtime FROM {source} c LEFT JOIN {admissions} a USING (hadm_id)) c
    LEFT JOIN (SELECT icd_code AS k, icd_version AS v, long_title FROM {icd_titles}) ON k = CAST(icd_code AS VARCHAR) AND v = CAST(icd_version AS VARCHAR)"""


@query(CODED.replace("{source}", "{diagnoses}").replace("{extra}", ""))
def prepare_diagnoses(spark, folder):
    raw = {
        "hosp/diagnoses_icd": view(spark, folder, "diagnoses"),
        "hosp/admissions": view(spark, folder, "admissions"),
        "hosp/patients": view(spark, folder, "patients"),
        "hosp/d_icd_diagnoses": view(spark, folder, "icd_titles"),
    }
    return prepare.prepare_tables(raw)["hosp/diagnoses_icd"]


@query(CODED.replace("{source}", "{procedures}").replace("{extra}", f", CAST(chartdate AS DATE) {EOD} AS chartdate"))
def prepare_procedures(spark, folder):
    return prepare.coded_events(*(view(spark, folder, v) for v in ("procedures", "admissions", "icd_titles")))


@query(f"""SELECT b.hadm_id, b.hcpcs_cd, CAST(b.chartdate AS DATE) {EOD} AS chartdate, coalesce(c.long_description, c.short_description) AS long_description
    FROM {{billing}} b LEFT JOIN {{billing_codes}} c ON b.hcpcs_cd = c.code""")
def prepare_billing(spark, folder):
    return prepare.procedure_billing(view(spark, folder, "billing"), view(spark, folder, "billing_codes"))


@query(f"""SELECT a.*, d.gender, date_sub('day', make_date(d.year_of_birth, 1, 1)::TIMESTAMP, a.admittime) / 365.25 AS age
    FROM {{admissions}} a LEFT JOIN {DEMOGRAPHICS} d USING (subject_id)""")
def prepare_admissions(spark, folder):
    return prepare.admissions_with_demographics(view(spark, folder, "admissions"), view(spark, folder, "patients"))


@query("SELECT subject_id, min(deathtime) AS deathtime FROM {admissions} GROUP BY subject_id")
def earliest_death(spark, folder):
    return prepare.death_times(view(spark, folder, "admissions"))


@query(f"""SELECT p.subject_id, coalesce(d.deathtime, CAST(p.dod AS DATE) {EOD}) AS dod, CAST(anchor_year - anchor_age AS VARCHAR) AS year_of_birth
    FROM {{patients}} p LEFT JOIN (SELECT subject_id, min(deathtime) AS deathtime FROM {{admissions}} GROUP BY 1) d USING (subject_id)""")
def prepare_patients(spark, folder):
    return prepare.static_patients(view(spark, folder, "patients"), view(spark, folder, "admissions"))


@query(f"""SELECT t.subject_id, t.stay_id, CASE WHEN t.temperature > 45 THEN (t.temperature - 32) * 5 / 9 ELSE t.temperature END AS temperature,
    t.acuity, s.intime, d.gender, date_sub('day', make_date(d.year_of_birth, 1, 1)::TIMESTAMP, s.intime) / 365.25 AS age
    FROM {{triage_rows}} t LEFT JOIN (SELECT stay_id, intime FROM {{stays}}) s USING (stay_id) LEFT JOIN {DEMOGRAPHICS} d USING (subject_id)""")
def prepare_triage(spark, folder):
    return prepare.triage(*(view(spark, folder, v) for v in ("triage_rows", "stays", "patients")))


@query("""SELECT v.stay_id, v.heartrate, v.charttime, CASE WHEN v.temperature > 45 THEN (v.temperature - 32) * 5 / 9 ELSE v.temperature END AS temperature,
    s.intime FROM {vitals} v LEFT JOIN {stays} s USING (stay_id)""")
def prepare_vital_signs(spark, folder):
    return prepare.vital_signs(view(spark, folder, "vitals"), view(spark, folder, "stays"))


@query(f"""SELECT subject_id, CAST(chartdate AS DATE) {EOD} AS chartdate, seq_num, result_name, result_num FROM (
    SELECT subject_id, chartdate, seq_num, 'SYSTOLIC_BLOOD_PRESSURE_MMHG' AS result_name, TRY_CAST(split_part(result_value, '/', 1) AS FLOAT) AS result_num
      FROM {{measurements}} WHERE contains(result_name, 'Blood Pressure') AND len(string_split(result_value, '/')) = 2
    UNION ALL SELECT subject_id, chartdate, seq_num, 'DIASTOLIC_BLOOD_PRESSURE_MMHG', TRY_CAST(split_part(result_value, '/', 2) AS FLOAT)
      FROM {{measurements}} WHERE contains(result_name, 'Blood Pressure') AND len(string_split(result_value, '/')) = 2
    UNION ALL SELECT subject_id, chartdate, seq_num, regexp_replace(result_name, '[()]', '', 'g'), TRY_CAST(result_value AS FLOAT)
      FROM {{measurements}} WHERE result_name IN ('BMI (kg/m2)', 'Height (Inches)', 'Weight (Lbs)')) WHERE result_num IS NOT NULL""")
def prepare_measurements(spark, folder):
    return prepare.outpatient_measurements(view(spark, folder, "measurements"))


@query("""SELECT subject_id, chartdate, seq_num, result_name, result_value FROM {measurements}
    WHERE (contains(result_name, 'Blood Pressure') AND len(string_split(result_value, '/')) = 2) OR result_name IN ('BMI (kg/m2)', 'Height (Inches)', 'Weight (Lbs)')""")
def measurement_name_filter(spark, folder):
    return prepare.kept_measurements(view(spark, folder, "measurements"))


@query("""SELECT l_orderkey, l_linenumber, 'l_discount' AS result_name, l_discount AS result_num FROM lineitem
    UNION ALL SELECT l_orderkey, l_linenumber, 'l_tax', l_tax FROM lineitem""")
def unpivot_columns(spark, folder):
    return prepare.unpivot_measurements(
        table(spark, folder, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_discount", "l_tax"]
    )


# --- extraction ---------------------------------------------------------------------------------------------------

NO_NUMBER, NO_TEXT = "CAST(NULL AS DOUBLE)", "CAST(NULL AS VARCHAR)"
HOSPITAL_SPECS = f"""
    SELECT subject_id, admittime AS time, 'HOSPITAL_ADMISSION//TYPE//' || admission_type AS code, {NO_NUMBER} AS numeric_value, {NO_TEXT} AS text_value FROM adm
    UNION ALL SELECT subject_id, admittime, 'HOSPITAL_ADMISSION//INSURANCE', {NO_NUMBER}, insurance FROM adm
    UNION ALL SELECT subject_id, admittime, 'HOSPITAL_ADMISSION//MARITAL_STATUS', {NO_NUMBER}, marital_status FROM adm
    UNION ALL SELECT subject_id, admittime, 'HOSPITAL_ADMISSION//RACE', {NO_NUMBER}, race FROM adm
    UNION ALL SELECT subject_id, admittime, 'HOSPITAL_ADMISSION//GENDER', {NO_NUMBER}, gender FROM adm
    UNION ALL SELECT subject_id, admittime, 'HOSPITAL_ADMISSION//AGE', age, NULL FROM adm
    UNION ALL SELECT subject_id, dischtime, 'HOSPITAL_DISCHARGE//DISCHARGE_LOCATION//' || coalesce(discharge_location, 'UNK'), {NO_NUMBER}, NULL FROM adm
    UNION ALL SELECT subject_id, make_date(CAST(year_of_birth AS INT), 1, 1)::TIMESTAMP, 'BIRTH//BORN', {NO_NUMBER}, NULL FROM pat
    UNION ALL SELECT subject_id, dod, 'DEATH//DIED', {NO_NUMBER}, NULL FROM pat WHERE dod IS NOT NULL
    UNION ALL SELECT subject_id, charttime, 'LABORATORY_RESULT//' || coalesce(fluid, 'UNK') || '//' || coalesce(label, 'UNK') || '//' || valueuom, valuenum, NULL FROM lab"""
HOSPITAL_EVENTS = """WITH adm AS (SELECT a.*, d.gender, date_sub('day', make_date(d.year_of_birth, 1, 1)::TIMESTAMP, a.admittime) / 365.25 AS age
      FROM {admissions} a LEFT JOIN """ + DEMOGRAPHICS + """ d USING (subject_id)),
    pat AS (SELECT p.subject_id, coalesce(d.deathtime, CAST(p.dod AS DATE) """ + EOD + """) AS dod, anchor_year - anchor_age AS year_of_birth
      FROM {patients} p LEFT JOIN (SELECT subject_id, min(deathtime) AS deathtime FROM {admissions} GROUP BY 1) d USING (subject_id)),
    lab AS (SELECT l.subject_id, l.charttime, l.valuenum, coalesce(l.valueuom, '') AS valueuom, i.fluid, i.label
      FROM {labs} l LEFT JOIN {lab_items} i USING (itemid)),
    hosp AS (""" + HOSPITAL_SPECS + ")"


def hospital_events(spark, folder):
    """Raw tables to event table with the shipped specifications."""
    raw = {
        "hosp/admissions": view(spark, folder, "admissions"),
        "hosp/patients": view(spark, folder, "patients"),
        "hosp/labevents": view(spark, folder, "labs"),
        "hosp/d_labitems": view(spark, folder, "lab_items"),
    }
    return extract.extract_events(prepare.prepare_tables(raw), NARRATIVE_EVENTS)


@query(HOSPITAL_EVENTS + " SELECT * FROM hosp")
def extract_hospital_events(spark, folder):
    return hospital_events(spark, folder)


@query("""SELECT o_custkey AS subject_id, strptime(strftime(o_orderdate, '%Y'), '%Y') AS time, 'ORDER//' || o_orderpriority AS code,
    o_totalprice AS numeric_value, CAST(NULL AS VARCHAR) AS text_value, o_orderkey AS order_id FROM orders
    UNION ALL SELECT o_custkey, NULL, 'STATUS', NULL, o_orderstatus, NULL FROM orders""")
def extract_with_formats_and_static_rows(spark, folder):
    """Text times with a list of formats, pass-through columns, and events without a time."""
    orders = table(spark, folder, "orders").withColumns({
        "year": F.date_format("o_orderdate", "yyyy"), "subject_id": F.col("o_custkey")})
    spec = {"orders": {
        "order": {"code": ["ORDER", "col(o_orderpriority)"], "time": "col(year)", "time_format": ["%Y-%m-%d", "%Y"],
                  "numeric_value": "o_totalprice", "order_id": "o_orderkey"},
        "status": {"code": "STATUS", "time": None, "text_value": "col(o_orderstatus)"},
    }}
    return extract.extract_events({"orders": orders}, spec)


@query("SELECT DISTINCT o_custkey AS subject_id, o_orderdate AS time, 'ORDER' AS code, CAST(NULL AS DOUBLE) AS numeric_value, CAST(NULL AS VARCHAR) AS text_value FROM orders")
def extract_distinct_events(spark, folder):
    spec = {"subject_id_col": "o_custkey", "orders": {"order": {"code": "ORDER", "time": "col(o_orderdate)"}}}
    return extract.extract_events({"orders": table(spark, folder, "orders")}, spec, dedup=True)


SPLITS = """SELECT subject_id, split, (r - lo - 1) // 20 AS shard FROM (SELECT subject_id, r,
      CASE WHEN r <= a THEN 'train' WHEN r <= b THEN 'tuning' ELSE 'held_out' END AS split,
      CASE WHEN r <= a THEN 0 WHEN r <= b THEN a ELSE b END AS lo FROM (
        SELECT subject_id, row_number() OVER (ORDER BY md5('7:' || subject_id), subject_id) AS r,
          CAST(round(0.8 * count(*) OVER ()) AS BIGINT) AS a, CAST(round(0.9 * count(*) OVER ()) AS BIGINT) AS b
        FROM (SELECT DISTINCT user_id AS subject_id FROM events)))"""
FRACTIONS = {"train": 0.8, "tuning": 0.1, "held_out": 0.1}


def splits(spark, folder):
    return extract.split_subjects(view(spark, folder, "ev"), FRACTIONS, n_subjects_per_shard=20, seed=7)


@query(SPLITS)
def split_and_shard_subjects(spark, folder):
    return splits(spark, folder)


@query(f"""SELECT e.*, s.split, s.shard, row_number() OVER (PARTITION BY s.split, s.shard ORDER BY subject_id, time, code, numeric_value NULLS LAST, text_value NULLS LAST, event_id) AS row
    FROM {{ev}} e JOIN ({SPLITS}) s USING (subject_id)""")
def merge_cohort(spark, folder):
    return extract.merge_cohort(view(spark, folder, "ev"), splits(spark, folder))


@query("""SELECT CAST(subject_id AS BIGINT) AS subject_id, time, code, CAST(numeric_value AS DOUBLE) AS numeric_value, text_value, order_id FROM {ord}""")
def finalise_events(spark, folder):
    loose = view(spark, folder, "ord").withColumn("numeric_value", F.col("numeric_value").cast("string"))
    return extract.finalise_events(loose)


@query("""SELECT code, count(*) AS n_events, count(numeric_value) AS n_numeric, min(time) AS first_time, max(time) AS last_time FROM {ord} GROUP BY code""")
def code_metadata(spark, folder):
    return extract.code_metadata(view(spark, folder, "ord"))


@query("""SELECT 'orders' AS dataset_name, '1.0' AS dataset_version, count(*) AS n_events, count(DISTINCT subject_id) AS n_subjects,
    count(DISTINCT code) AS n_codes, min(time) AS first_time, max(time) AS last_time FROM {ord}""")
def dataset_metadata(spark, folder):
    return extract.dataset_metadata(view(spark, folder, "ord"), "orders", "1.0")


VOCABULARY = "SELECT code, row_number() OVER (ORDER BY n DESC, code) - 1 AS code_id, n FROM (SELECT code, count(*) AS n FROM {from} GROUP BY code)"


@query(VOCABULARY.replace("{from}", "{ev}"))
def build_vocabulary(spark, folder):
    return extract.vocabulary(view(spark, folder, "ev"))


@query(f"""SELECT e.*, v.code_id FROM {{ev}} e LEFT JOIN ({VOCABULARY.replace("{from}", "(SELECT * FROM {ev} e JOIN (" + SPLITS + ") USING (subject_id) WHERE split = 'train')")}) v USING (code)""")
def map_codes_to_vocabulary(spark, folder):
    """Ids frozen from the training split; unseen codes get null."""
    events = view(spark, folder, "ev")
    train = extract.with_splits(events, splits(spark, folder)).filter("split = 'train'")
    return extract.map_codes(events, extract.vocabulary(train))


@query(name="prepare_end_of_day_marker", sql=f"SELECT count(*) AS n FROM lineitem WHERE l_shipdate {EOD} IS NOT NULL")
def _end_of_day_marker(spark, folder):
    rows = table(spark, folder, "lineitem").select(times.end_of_day(F.col("l_shipdate")).alias("t"))
    return rows.filter(times.is_end_of_day(F.col("t"))).agg(F.count(F.lit(1)).alias("n"))
