"""Registration of queries and the table views they start from.

A view is a projection written once, in SQL that Spark and the checking engine both understand. The benchmark tables hold
no hospital data, so views give them the column names and shapes of the event table and of the raw hospital tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

# props is {"k": <number>}
DIGITS = "substring(props, 7, length(props) - 7)"
K = f"CAST({DIGITS} AS INT)"
EVENT = ["user_id AS subject_id", "ts AS time"]
VALUES = ["value AS numeric_value", "props AS text_value"]

VIEWS: dict[str, tuple[str, list[str]]] = {
    # web events as an event table
    "ev": ("events", [*EVENT, f"upper(event_type) || '//K' || {DIGITS} AS code", *VALUES, "event_id"]),
    # the same events under the codes of a hospital record
    "hospital": (
        "events",
        [
            *EVENT,
            "CASE event_type WHEN 'signup' THEN 'EMERGENCY_DEPARTMENT_REGISTRATION//ARRIVAL_TRANSPORT' "
            f"WHEN 'click' THEN 'EMERGENCY_DEPARTMENT_DISCHARGE//DISCHARGE_LOCATION//' || CASE WHEN {K} % 3 = 0 THEN 'ADMITTED' ELSE 'HOME' END "
            f"WHEN 'view' THEN 'ICU_ADMISSION//UNIT_' || {DIGITS} "
            f"WHEN 'purchase' THEN 'HOSPITAL_DISCHARGE//DISCHARGE_LOCATION//' || CASE WHEN {K} % 4 = 0 THEN 'DIED' ELSE 'HOME' END "
            f"ELSE CASE WHEN {K} < 10 THEN 'BIRTH//BORN' ELSE 'HOSPITAL_DIAGNOSIS//ICD//10//' || {DIGITS} END END AS code",
            "CASE WHEN event_type IN ('signup', 'view') THEN value END AS numeric_value",
            f"CASE WHEN event_type = 'error' AND {K} % 5 > 0 THEN 'code  of kind_' || {DIGITS} WHEN event_type = 'signup' THEN 'ON FOOT' END AS text_value",
            "event_id",
        ],
    ),
    # orders as an event table over several years
    "ord": (
        "orders",
        [
            "o_custkey AS subject_id",
            "o_orderdate AS time",
            "'ORDER//' || o_orderpriority AS code",
            "CASE WHEN o_orderkey % 5 > 0 THEN o_totalprice END AS numeric_value",
            "CASE WHEN o_orderkey % 3 > 0 THEN o_orderstatus END AS text_value",
            "o_orderkey AS order_id",
        ],
    ),
    # raw hospital tables
    "admissions": (
        "orders",
        [
            "o_custkey AS subject_id",
            "o_orderkey AS hadm_id",
            "o_orderdate AS admittime",
            "o_orderdate + INTERVAL 1 DAY * CAST(o_orderkey % 10 AS INT) AS dischtime",
            "CASE WHEN o_orderkey % 11 = 0 THEN o_orderdate + INTERVAL 5 DAY END AS deathtime",
            "o_orderpriority AS admission_type",
            "CASE WHEN o_orderkey % 4 > 0 THEN 'MEDICARE' END AS insurance",
            "CASE WHEN o_orderkey % 6 > 0 THEN 'MARRIED' END AS marital_status",
            "o_orderstatus AS race",
            "CASE WHEN o_orderkey % 7 > 0 THEN 'HOME' END AS discharge_location",
        ],
    ),
    "patients": (
        "customer",
        [
            "c_custkey AS subject_id",
            "CASE CAST(c_custkey % 3 AS INT) WHEN 0 THEN 'F' WHEN 1 THEN 'M' ELSE 'X' END AS gender",
            "1990 + c_nationkey AS anchor_year",
            "20 + CAST(c_custkey % 60 AS INT) AS anchor_age",
            "CASE WHEN c_custkey % 5 = 0 THEN '2001-06-01' END AS dod",
        ],
    ),
    "diagnoses": (
        "lineitem",
        [
            "l_orderkey AS hadm_id",
            "l_linenumber AS seq_num",
            "l_partkey AS icd_code",
            "CASE WHEN l_linenumber % 2 = 0 THEN 9 ELSE 10 END AS icd_version",
        ],
    ),
    "procedures": (
        "lineitem",
        [
            "l_orderkey AS hadm_id",
            "l_linenumber AS seq_num",
            "substring(CAST(l_shipdate AS VARCHAR(30)), 1, 10) AS chartdate",
            "l_partkey AS icd_code",
            "CASE WHEN l_linenumber % 2 = 0 THEN 9 ELSE 10 END AS icd_version",
        ],
    ),
    "icd_titles": (
        "part",
        [
            "CAST(p_partkey AS VARCHAR(20)) AS icd_code",
            "CASE WHEN p_size % 2 = 0 THEN '9' ELSE '10' END AS icd_version",
            "p_name AS long_title",
        ],
    ),
    "groups": (
        "lineitem",
        ["l_orderkey AS hadm_id", "l_returnflag AS drg_type", "l_partkey AS drg_code", "l_linenumber AS drg_severity"],
    ),
    "labs": (
        "lineitem",
        [
            "l_suppkey AS subject_id",
            "l_partkey AS itemid",
            "l_shipdate AS charttime",
            "l_quantity AS valuenum",
            "CASE WHEN l_returnflag <> 'N' THEN l_returnflag END AS valueuom",
        ],
    ),
    "lab_items": ("part", ["p_partkey + 7 AS itemid", "p_type AS fluid", "p_name AS label"]),
    "billing": (
        "lineitem",
        [
            "l_orderkey AS hadm_id",
            "substring(CAST(l_shipdate AS VARCHAR(30)), 1, 10) AS chartdate",
            "'H' || CAST(l_partkey AS VARCHAR(20)) AS hcpcs_cd",
        ],
    ),
    "billing_codes": (
        "part",
        [
            "'H' || CAST(p_partkey AS VARCHAR(20)) AS code",
            "CASE WHEN p_size % 2 = 0 THEN p_name END AS long_description",
            "CASE WHEN p_size % 3 > 0 THEN p_brand END AS short_description",
        ],
    ),
    "measurements": (
        "lineitem",
        [
            "l_suppkey AS subject_id",
            "substring(CAST(l_shipdate AS VARCHAR(30)), 1, 10) AS chartdate",
            "l_linenumber AS seq_num",
            "CASE l_linenumber WHEN 1 THEN 'Blood Pressure' WHEN 2 THEN 'Blood Pressure Sitting' WHEN 3 THEN 'BMI (kg/m2)' "
            "WHEN 4 THEN 'Height (Inches)' WHEN 5 THEN 'Weight (Lbs)' ELSE 'eGFR' END AS result_name",
            "CASE WHEN l_linenumber <= 2 THEN CAST(CAST(l_quantity AS INT) AS VARCHAR(9)) || CASE WHEN l_partkey % 9 = 0 THEN '' "
            "WHEN l_partkey % 7 = 0 THEN '/a' ELSE '/' || CAST(l_partkey % 90 AS VARCHAR(9)) END "
            "WHEN l_partkey % 8 = 0 THEN 'n/a' ELSE CAST(CAST(l_quantity AS INT) AS VARCHAR(9)) || '.5' END AS result_value",
        ],
    ),
    "stays": (
        "orders",
        [
            "o_custkey AS subject_id",
            "o_orderkey AS stay_id",
            "o_orderdate AS intime",
            "o_orderdate + INTERVAL 1 HOUR * CAST(o_orderkey % 30 AS INT) AS outtime",
        ],
    ),
    "triage_rows": (
        "orders",
        [
            "o_custkey AS subject_id",
            "o_orderkey + 3 AS stay_id",
            "CASE WHEN o_orderkey % 9 > 0 THEN 30.0 + CAST(o_orderkey % 75 AS DOUBLE) END AS temperature",
            "CAST(o_orderkey % 5 AS DOUBLE) AS acuity",
        ],
    ),
    "vitals": (
        "lineitem",
        ["l_orderkey AS stay_id", "l_quantity * 2 AS temperature", "l_linenumber AS heartrate", "l_shipdate AS charttime"],
    ),
    "ed_codes": ("lineitem", ["l_orderkey + 5 AS stay_id", "l_linenumber AS seq_num", "l_partkey AS icd_code"]),
    # labelled documents as scored predictions
    "predictions": (
        "documents",
        ["doc_id", "doc_id % 3 = 0 OR doc_id % 7 = 2 AS boolean_value",
         "CASE WHEN doc_id % 13 > 0 THEN CAST((doc_id * 37) % 101 AS VARCHAR(9)) ELSE 'unsure' END AS parsed_probability"],
    ),
    # documents as histories of three tasks, one of them unknown
    "dataset": (
        "documents",
        ["doc_id AS subject_id", "text",
         "CASE doc_id % 3 WHEN 0 THEN 'hospitalisation' WHEN 1 THEN 'ed_reattendance' ELSE 'undescribed' END AS task",
         "source AS shard"],
    ),
    "answers": (
        "conversations",
        ["conv_id", "turn",
         "CASE WHEN (conv_id + turn) % 3 = 0 THEN '<think> ' || text || ' </think>' ELSE '' END || "
         "CASE WHEN (conv_id + turn) % 5 > 0 THEN 'Explanation: ' || text || ' ' ELSE text END || "
         "CASE (conv_id + turn) % 4 WHEN 0 THEN 'Answer: Yes ' WHEN 1 THEN 'answer:  no ' WHEN 2 THEN 'Answer: maybe ' ELSE '' END || "
         "CASE (conv_id + turn) % 6 WHEN 0 THEN 'probability: 50' WHEN 1 THEN '' ELSE 'Probability: ' || CAST((conv_id * 31 + turn) % 250 AS VARCHAR(9)) END AS model_output"],
    ),
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def view(spark: SparkSession, folder: str, name: str) -> DataFrame:
    source, columns = VIEWS[name]
    return table(spark, folder, source).selectExpr(*columns)


def view_sql(name: str) -> str:
    source, columns = VIEWS[name]
    return f"(SELECT {', '.join(columns)} FROM {source})"


def with_views(sql: str) -> str:
    """Replace `{name}` by the view's subquery."""
    for name in VIEWS:
        sql = sql.replace("{" + name + "}", view_sql(name))
    return sql


def query(sql: str | None = None, name: str | None = None):
    """Register a function of (spark, folder), optionally with the SQL that gives the same rows."""

    def register(fn):
        key = name or fn.__name__
        if key in QUERIES:
            raise ValueError(f"{key} is registered twice")
        QUERIES[key] = fn
        if sql is not None:
            SQL[key] = with_views(sql)
        return fn

    return register
