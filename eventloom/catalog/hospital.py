"""Extraction of every shipped event specification over all sixteen raw tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from eventloom.catalog.registry import query, table
from eventloom.operators import extract, prepare
from eventloom.operators.extract import SPECIAL_KEYS, UNKNOWN, column_name
from eventloom.plans.hospital import NARRATIVE_EVENTS, STRUCTURED_EVENTS, STRUCTURED_EVENTS_WITHOUT_ED

DAY = "substring(CAST({0} AS VARCHAR(30)), 1, 10)"
ORDER_IDS = ["o_custkey AS subject_id", "o_orderkey AS hadm_id", "o_orderkey + 3 AS stay_id"]
LINE_IDS = ["l_suppkey AS subject_id", "l_orderkey AS hadm_id", "l_orderkey + 3 AS stay_id"]
CODE = ["CAST(l_partkey AS VARCHAR(20)) AS icd_code", "CASE WHEN l_linenumber % 2 = 0 THEN '9' ELSE '10' END AS icd_version"]
CHARTED = [
    "l_quantity * 2 AS temperature", "CAST(l_linenumber AS DOUBLE) AS heartrate", "l_quantity / 2 AS resprate", "l_quantity + 50 AS o2sat",
    "l_quantity * 3 AS sbp", "CASE WHEN l_linenumber > 2 THEN l_quantity END AS dbp", "CASE WHEN l_linenumber > 1 THEN l_returnflag END AS pain",
]

# The raw tables, each a projection that Spark and the checking engine both understand.
RAW: dict[str, tuple[str, list[str]]] = {
    "ed/edstays": (
        "orders",
        [*ORDER_IDS, "o_orderdate AS intime", "o_orderdate + INTERVAL 5 HOUR AS outtime", "o_orderstatus AS arrival_transport", "o_orderpriority AS disposition"],
    ),
    "ed/triage": ("lineitem", [*LINE_IDS, *CHARTED, "CAST(l_linenumber % 5 AS DOUBLE) AS acuity"]),
    "ed/diagnosis": ("lineitem", [*LINE_IDS, *CODE, "l_linestatus AS icd_title"]),
    "hosp/admissions": (
        "orders",
        [
            *ORDER_IDS, "o_orderdate AS admittime", "o_orderdate + INTERVAL 3 DAY AS dischtime", "o_orderpriority AS admission_type",
            "CASE WHEN o_orderkey % 11 = 0 THEN o_orderdate + INTERVAL 2 DAY END AS deathtime", "o_orderstatus AS admission_location",
            "CASE WHEN o_orderkey % 4 > 0 THEN 'MEDICARE' END AS insurance", "CASE WHEN o_orderkey % 3 > 0 THEN 'EN' END AS language",
            "CASE WHEN o_orderkey % 6 > 0 THEN 'MARRIED' END AS marital_status", "o_orderstatus AS race",
            "CASE WHEN o_orderkey % 7 > 0 THEN 'HOME' END AS discharge_location",
            "CASE WHEN o_orderkey % 5 > 0 THEN o_orderdate END AS edregtime", "CASE WHEN o_orderkey % 5 > 0 THEN o_orderdate + INTERVAL 4 HOUR END AS edouttime",
        ],
    ),
    "hosp/diagnoses_icd": ("lineitem", [*LINE_IDS, *CODE]),
    "hosp/procedures_icd": ("lineitem", [*LINE_IDS, *CODE, f"{DAY.format('l_shipdate')} AS chartdate"]),
    "hosp/drgcodes": (
        "lineitem",
        [*LINE_IDS, "l_returnflag AS drg_type", "l_partkey AS drg_code", "l_linestatus AS description", "l_linenumber AS drg_severity", "l_linenumber % 3 AS drg_mortality"],
    ),
    "hosp/emar": (
        "lineitem",
        [*LINE_IDS, "l_partkey AS emar_id", "l_linenumber AS emar_seq", "l_linestatus AS medication", "CASE WHEN l_linenumber > 1 THEN 'Given' END AS event_txt", "l_shipdate AS charttime"],
    ),
    "ed/pyxis": ("lineitem", [*LINE_IDS, "l_linestatus AS name", "l_shipdate AS charttime"]),
    "hosp/hcpcsevents": (
        "lineitem",
        [*LINE_IDS, "'H' || CAST(l_partkey AS VARCHAR(20)) AS hcpcs_cd", "l_linestatus AS short_description", f"{DAY.format('l_shipdate')} AS chartdate"],
    ),
    "hosp/labevents": (
        "lineitem",
        [
            *LINE_IDS, "l_partkey AS itemid", "l_shipdate AS charttime", "l_quantity AS valuenum", "CAST(l_linenumber AS VARCHAR(9)) AS value",
            "CASE WHEN l_returnflag <> 'N' THEN l_returnflag END AS valueuom", "l_linestatus AS priority",
        ],
    ),
    "ed/vitalsign": ("lineitem", [*LINE_IDS, *CHARTED, "l_shipdate AS charttime"]),
    "hosp/omr": (
        "lineitem",
        [
            "l_suppkey AS subject_id", f"{DAY.format('l_shipdate')} AS chartdate", "l_linenumber AS seq_num",
            "CASE l_linenumber WHEN 1 THEN 'Blood Pressure' WHEN 2 THEN 'BMI (kg/m2)' ELSE 'eGFR' END AS result_name",
            "CASE WHEN l_linenumber = 1 THEN '120/' || CAST(l_partkey % 90 AS VARCHAR(9)) ELSE CAST(l_partkey % 40 AS VARCHAR(9)) || '.5' END AS result_value",
        ],
    ),
    "hosp/patients": (
        "customer",
        [
            "c_custkey AS subject_id", "CASE WHEN c_custkey % 3 = 0 THEN 'F' WHEN c_custkey % 3 = 1 THEN 'M' ELSE 'X' END AS gender",
            "1990 + c_nationkey AS anchor_year", "20 + CAST(c_custkey % 60 AS INT) AS anchor_age",
            "CAST(1970 + c_nationkey - CAST(c_custkey % 60 AS INT) AS VARCHAR(9)) AS year_of_birth", "CASE WHEN c_custkey % 5 = 0 THEN '2001-06-01' END AS dod",
        ],
    ),
    "hosp/transfers": ("orders", [*ORDER_IDS, "o_orderstatus AS eventtype", "CASE WHEN o_orderkey % 3 > 0 THEN o_orderpriority END AS careunit", "o_orderdate AS intime"]),
    "icu/icustays": (
        "orders",
        [*ORDER_IDS, "o_orderpriority AS first_careunit", "o_orderstatus AS last_careunit", "o_orderdate AS intime", "o_orderdate + INTERVAL 40 HOUR AS outtime"],
    ),
    "hosp/d_icd_diagnoses": ("part", ["CAST(p_partkey AS VARCHAR(20)) AS icd_code", "CASE WHEN p_size % 2 = 0 THEN '9' ELSE '10' END AS icd_version", "p_name AS long_title"]),
    "hosp/d_icd_procedures": ("part", ["CAST(p_partkey AS VARCHAR(20)) AS icd_code", "'9' AS icd_version", "p_type AS long_title"]),
    "hosp/d_labitems": ("part", ["p_partkey + 7 AS itemid", "p_type AS fluid", "p_name AS label"]),
    "hosp/d_hcpcs": (
        "part",
        ["'H' || CAST(p_partkey AS VARCHAR(20)) AS code", "CASE WHEN p_size % 2 = 0 THEN p_name END AS long_description", "CASE WHEN p_size % 3 > 0 THEN p_brand END AS short_description"],
    ),
}


def raw_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {name: table(spark, folder, source).selectExpr(*columns) for name, (source, columns) in RAW.items()}


# The departure and discharge times that the comparison schema expects in its tables, added to the columns that its events read.
TIMES = {
    "ed/triage": ("ed/edstays", "stay_id", "intime"),
    "ed/diagnosis": ("ed/edstays", "stay_id", "outtime"),
    "hosp/diagnoses_icd": ("hosp/admissions", "hadm_id", "dischtime"),
    "hosp/drgcodes": ("hosp/admissions", "hadm_id", "dischtime"),
}


def timed_tables(spark: SparkSession, folder: str, config: Mapping) -> dict[str, DataFrame]:
    raw, read = raw_tables(spark, folder), extract.columns_read(config)
    timed = {
        name: prepare.look_up(prepare.only(raw[name], {key, *read[name]}), raw[source], [key], [wanted])
        for name, (source, key, wanted) in TIMES.items()
        if name in read
    }
    return raw | timed


# --- the same in SQL ----------------------------------------------------------------------------------------------


def named(name: str) -> str:
    return name.replace("/", "_")


END_OF_DAY = "CAST({0} AS DATE) + INTERVAL 86399999999 MICROSECONDS"
CELSIUS = "CASE WHEN temperature > 45 THEN (temperature - 32) * 5 / 9 ELSE temperature END AS temperature"
BORN = """(SELECT subject_id, CASE gender WHEN 'F' THEN 'Female' WHEN 'M' THEN 'Male' ELSE gender END AS gender,
    anchor_year - anchor_age AS year_of_birth FROM raw_hosp_patients)"""
AGE = "date_sub('day', make_date(d.year_of_birth, 1, 1)::TIMESTAMP, {0}) / 365.25 AS age"
DISCHARGED = "SELECT x.*, a.dischtime FROM raw_{0} x LEFT JOIN raw_hosp_admissions a USING (hadm_id)"
TITLED = "SELECT x.*{1}, t.long_title FROM ({0}) x LEFT JOIN raw_{2} t ON x.icd_code = t.icd_code AND x.icd_version = t.icd_version"
PARTS = "len(string_split(result_value, '/')) = 2 AND contains(result_name, 'Blood Pressure')"
PREPARED = {
    "ed/triage": f"SELECT x.* REPLACE ({CELSIUS.replace(' AS temperature', '')} AS temperature), s.intime, d.gender, {AGE.format('s.intime')} FROM raw_ed_triage x "
    f"LEFT JOIN raw_ed_edstays s USING (stay_id) LEFT JOIN {BORN} d ON d.subject_id = x.subject_id",
    "ed/diagnosis": "SELECT x.*, s.outtime FROM raw_ed_diagnosis x LEFT JOIN raw_ed_edstays s USING (stay_id)",
    "ed/vitalsign": f"SELECT * REPLACE ({CELSIUS.replace(' AS temperature', '')} AS temperature) FROM (SELECT x.* FROM raw_ed_vitalsign x LEFT JOIN raw_ed_edstays s USING (stay_id))",
    "hosp/admissions": f"SELECT x.*, d.gender, {AGE.format('x.admittime')} FROM raw_hosp_admissions x LEFT JOIN {BORN} d ON d.subject_id = x.subject_id",
    "hosp/diagnoses_icd": TITLED.format(DISCHARGED.format("hosp_diagnoses_icd"), "", "hosp_d_icd_diagnoses"),
    "hosp/procedures_icd": TITLED.format(DISCHARGED.format("hosp_procedures_icd"), f" REPLACE ({END_OF_DAY.format('chartdate')} AS chartdate)", "hosp_d_icd_procedures"),
    "hosp/drgcodes": DISCHARGED.format("hosp_drgcodes"),
    "hosp/hcpcsevents": f"SELECT x.* REPLACE ({END_OF_DAY.format('chartdate')} AS chartdate), coalesce(c.long_description, c.short_description) AS long_description "
    "FROM raw_hosp_hcpcsevents x LEFT JOIN raw_hosp_d_hcpcs c ON x.hcpcs_cd = c.code",
    "hosp/labevents": "SELECT x.* REPLACE (coalesce(valueuom, '') AS valueuom), i.fluid, i.label FROM raw_hosp_labevents x LEFT JOIN raw_hosp_d_labitems i USING (itemid)",
    "hosp/omr": f"""SELECT subject_id, {END_OF_DAY.format('chartdate')} AS chartdate, seq_num, result_name, result_num FROM (
        SELECT *, 'SYSTOLIC_BLOOD_PRESSURE_MMHG' AS result_name, TRY_CAST(split_part(result_value, '/', 1) AS FLOAT) AS result_num FROM (SELECT * EXCLUDE (result_name) FROM raw_hosp_omr WHERE {PARTS})
        UNION ALL BY NAME SELECT *, 'DIASTOLIC_BLOOD_PRESSURE_MMHG' AS result_name, TRY_CAST(split_part(result_value, '/', 2) AS FLOAT) AS result_num FROM (SELECT * EXCLUDE (result_name) FROM raw_hosp_omr WHERE {PARTS})
        UNION ALL BY NAME SELECT * REPLACE (regexp_replace(result_name, '[()]', '', 'g') AS result_name), TRY_CAST(result_value AS FLOAT) AS result_num FROM raw_hosp_omr
          WHERE result_name IN ('BMI (kg/m2)', 'Height (Inches)', 'Weight (Lbs)')) WHERE result_num IS NOT NULL""",
    "hosp/patients": f"""SELECT x.subject_id, coalesce(d.deathtime, {END_OF_DAY.format('x.dod')}) AS dod, CAST(anchor_year - anchor_age AS VARCHAR) AS year_of_birth
        FROM raw_hosp_patients x LEFT JOIN (SELECT subject_id, min(deathtime) AS deathtime FROM raw_hosp_admissions GROUP BY 1) d USING (subject_id)""",
}
TIMED = {
    "ed/triage": "SELECT x.*, s.intime FROM raw_ed_triage x LEFT JOIN raw_ed_edstays s USING (stay_id)",
    "ed/diagnosis": PREPARED["ed/diagnosis"],
    "hosp/diagnoses_icd": DISCHARGED.format("hosp_diagnoses_icd"),
    "hosp/drgcodes": PREPARED["hosp/drgcodes"],
}


def events_sql(config: Mapping, tables: Mapping[str, str], text_times: set[str]) -> str:
    """The union of all events of a specification; `text_times` are time columns held as text."""
    views = [f"raw_{named(n)} AS (SELECT {', '.join(columns)} FROM {source})" for n, (source, columns) in RAW.items()]
    views += [f"{named(n)} AS ({tables.get(n, f'SELECT * FROM raw_{named(n)}')})" for n in RAW]
    selects = []
    for name, events in config.items():
        if name == "subject_id_col":
            continue
        for spec in events.values():
            parts = [spec["code"]] if isinstance(spec["code"], str) else spec["code"]
            code = " || '//' || ".join(f"'{p}'" if column_name(p) is None else f"coalesce(CAST({column_name(p)} AS VARCHAR), '{UNKNOWN}')" for p in parts)
            column = {key: column_name(value) or value for key, value in spec.items() if key not in ("code", "time_format") and value}
            time, formats = column.get("time"), spec.get("time_format")
            if time in text_times:
                formats = [formats] if isinstance(formats, str) else formats
                time = f"try_strptime({time}, {list(formats)})" if formats else f"TRY_CAST({time} AS TIMESTAMP)"
            number = f"CAST({column['numeric_value']} AS DOUBLE)" if "numeric_value" in column else "CAST(NULL AS DOUBLE)"
            text = f"CAST({column['text_value']} AS VARCHAR)" if "text_value" in column else "CAST(NULL AS VARCHAR)"
            extras = "".join(f", {source} AS {key}" for key, source in column.items() if key not in SPECIAL_KEYS)
            where = f" WHERE {time} IS NOT NULL" if time else ""
            selects.append(f"SELECT subject_id, {time or 'NULL::TIMESTAMP'} AS time, {code} AS code, {number} AS numeric_value, {text} AS text_value{extras} FROM {named(name)}{where}")
    return f"WITH {', '.join(views)} {' UNION ALL BY NAME '.join(selects)}"


@query(events_sql(NARRATIVE_EVENTS, PREPARED, {"year_of_birth"}))
def extract_all_tables(spark, folder):
    """All forty events of the sixteen prepared tables."""
    prepared = prepare.prepare_tables(raw_tables(spark, folder), extract.columns_read(NARRATIVE_EVENTS))
    return extract.extract_events(prepared, NARRATIVE_EVENTS)


@query(events_sql(STRUCTURED_EVENTS, TIMED, {"year_of_birth", "dod", "chartdate"}))
def extract_structured_events(spark, folder):
    """The comparison schema, with ids passed through and static rows."""
    return extract.extract_events(timed_tables(spark, folder, STRUCTURED_EVENTS), STRUCTURED_EVENTS)


@query(events_sql(STRUCTURED_EVENTS_WITHOUT_ED, TIMED, {"year_of_birth", "dod", "chartdate"}))
def extract_structured_events_without_ed(spark, folder):
    """The comparison schema of hospitals without emergency tables."""
    return extract.extract_events(timed_tables(spark, folder, STRUCTURED_EVENTS_WITHOUT_ED), STRUCTURED_EVENTS_WITHOUT_ED)
