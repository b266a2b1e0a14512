"""Predicates, windows, cohort labels, and label checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventloom.catalog.registry import query, view
from eventloom.catalog.tables import PARTITIONED, partitioned_labels
from eventloom.operators import cohort, narrative
from eventloom.plans.cohorts import COHORTS, CRITICAL_OUTCOME, READMISSION_30D
from eventloom.plans.timeline import Run, lay_out, written

ARRIVAL = "code = 'EMERGENCY_DEPARTMENT_REGISTRATION//ARRIVAL_TRANSPORT'"
LEAVING = "regexp_matches(code, 'EMERGENCY_DEPARTMENT_DISCHARGE//DISCHARGE_LOCATION//.*')"
EMPTY = "CAST(NULL AS BIGINT) AS integer_value, CAST(NULL AS DOUBLE) AS float_value, CAST(NULL AS VARCHAR) AS categorical_value"


def label_sql(trigger: str, end: str, label: str, after: str | None = None, index: str = "t", strict: bool = False, source="{hospital}") -> str:
    """Labels by joining events: trigger at t, next `end` event at e; the window is [t, e], or [e, e + after]."""
    window = f"h.time >= {'e' if after else 't'} AND h.time <= e" + (f" + INTERVAL {after}" if after else "")
    window = window.replace("h.time >= e", "h.time > e") if strict else window
    return f"""(SELECT subject_id, {index} AS prediction_time, coalesce(bool_or({label}), false) AS boolean_value, {EMPTY} FROM (
        SELECT a.subject_id, a.t, min(b.time) AS e FROM (SELECT DISTINCT subject_id, time AS t FROM {source} WHERE {trigger}) a
        JOIN (SELECT subject_id, time FROM {source} WHERE {end}) b ON a.subject_id = b.subject_id AND b.time > a.t GROUP BY 1, 2) w
        LEFT JOIN (SELECT subject_id AS s, * EXCLUDE (subject_id) FROM {source}) h ON s = w.subject_id AND {window} GROUP BY w.subject_id, t, e)"""


HOSPITALISATION = label_sql(ARRIVAL, LEAVING, "code = 'EMERGENCY_DEPARTMENT_DISCHARGE//DISCHARGE_LOCATION//ADMITTED'")
REATTENDANCE = label_sql(ARRIVAL, LEAVING, ARRIVAL, "72 HOURS")
ICU = label_sql(ARRIVAL, LEAVING, "regexp_matches(code, 'ICU_ADMISSION//.*')", "12 HOURS")
NOT_ADMITTED = (
    "regexp_matches(code, 'HOSPITAL_DISCHARGE//DISCHARGE_LOCATION//.*|EMERGENCY_DEPARTMENT_DISCHARGE//DISCHARGE_LOCATION//"
    "(OTHER|TRANSFER|LEFT_WITHOUT_BEING_SEEN|LEFT_AGAINST_MEDICAL_ADVICE|HOME|ELOPED)')"
)
MORTALITY = label_sql(ARRIVAL, NOT_ADMITTED, "code = 'HOSPITAL_DISCHARGE//DISCHARGE_LOCATION//DIED'")
CRITICAL = f"""(SELECT i.subject_id, i.prediction_time, i.boolean_value OR m.boolean_value AS boolean_value, i.integer_value, i.float_value, i.categorical_value
    FROM {ICU} i JOIN {MORTALITY} m USING (subject_id, prediction_time))"""
TASKS = {
    "hospitalisation": HOSPITALISATION,
    "ed_reattendance": REATTENDANCE,
    "critical_outcome_icu_12h": ICU,
    "critical_outcome_hospital_mortality": MORTALITY,
}
ALL_LABELS = " UNION ALL ".join(f"SELECT '{task}' AS task, * FROM {sql}" for task, sql in TASKS.items())


def labels(spark, folder, task: str):
    return cohort.label_cohort(view(spark, folder, "hospital"), COHORTS[task])


def stored_labels(spark, folder, task: str):
    """Labels as a stored table, as later steps read them more than once."""
    return written(labels(spark, folder, task), "labels")


@query(f"SELECT * FROM {HOSPITALISATION}")
def cohort_hospitalisation(spark, folder):
    return labels(spark, folder, "hospitalisation")


@query(f"SELECT * FROM {REATTENDANCE}")
def cohort_ed_reattendance(spark, folder):
    return labels(spark, folder, "ed_reattendance")


@query(f"SELECT * FROM {ICU}")
def cohort_icu_within_12h(spark, folder):
    return labels(spark, folder, "critical_outcome_icu_12h")


@query(f"SELECT * FROM {MORTALITY}")
def cohort_hospital_mortality(spark, folder):
    return labels(spark, folder, "critical_outcome_hospital_mortality")


@query(f"SELECT * FROM {CRITICAL}")
def cohort_critical_outcome(spark, folder):
    """Either of two outcomes at the same prediction time."""
    both = cohort.label_cohorts(view(spark, folder, "hospital"), {task: COHORTS[task] for task in CRITICAL_OUTCOME})
    stored = written(both, "labels")
    icu, mortality = (stored.filter(F.col("task") == task).drop("task") for task in CRITICAL_OUTCOME)
    return cohort.combine_labels(icu, mortality)


@query(f"SELECT * FROM ({ALL_LABELS})")
def all_cohorts(spark, folder):
    """Four cohorts from one pass over the events."""
    return cohort.label_cohorts(view(spark, folder, "hospital"), COHORTS)


# A cohort whose windows hang on one another: departure after the arrival, ICU admission after that, and from six hours
# later to the next arrival.
CHAINED = {
    "predicates": {
        "arrival": {"code": "EMERGENCY_DEPARTMENT_REGISTRATION//ARRIVAL_TRANSPORT"},
        "leaving": {"code": {"regex": "EMERGENCY_DEPARTMENT_DISCHARGE//DISCHARGE_LOCATION//.*"}},
        "icu": {"code": {"regex": "ICU_ADMISSION//.*"}},
        "discharge": {"code": {"regex": "HOSPITAL_DISCHARGE//.*"}},
    },
    "trigger": "arrival",
    "windows": {
        "stay": {"start": "trigger", "end": "start -> leaving"},
        "ward": {"start": "stay.end", "end": "start -> icu", "index_timestamp": "end"},
        "after": {"start": "ward.end", "end": "start + 6h"},
        "target": {"start": "after.end", "end": "start -> arrival", "label": "discharge", "start_inclusive": False},
    },
}


def next_after(rows: str, start: str, condition: str, name: str) -> str:
    return f"""(SELECT r.*, (SELECT min(h.time) FROM {{hospital}} h WHERE h.subject_id = r.subject_id AND h.time > r.{start} AND {condition}) AS {name} FROM {rows} r)"""


CHAIN = next_after(next_after(f"(SELECT DISTINCT subject_id, time AS t FROM {{hospital}} WHERE {ARRIVAL})", "t", LEAVING, "e"),
                   "e", "regexp_matches(code, 'ICU_ADMISSION//.*')", "i")
CHAIN = next_after(f"(SELECT *, i + INTERVAL 6 HOURS AS a FROM {CHAIN})", "a", ARRIVAL, "z")


READMISSION_EVENTS = """(SELECT user_id AS subject_id, ts AS time, CASE event_type WHEN 'signup' THEN 'Hospital Admission' WHEN 'purchase' THEN 'Hospital Discharge' ELSE 'Other' END AS prefix,
    CASE event_type WHEN 'signup' THEN 'Gender F' WHEN 'purchase' THEN 'Location Home' ELSE 'Gender Location' END AS code FROM events)"""


@query("SELECT * FROM " + label_sql("prefix = 'Hospital Admission' AND regexp_matches(code, 'Gender.*')",
       "prefix = 'Hospital Discharge' AND regexp_matches(code, 'Location.*')",
       "prefix = 'Hospital Admission' AND regexp_matches(code, 'Gender.*')", "30 DAYS", index="e", strict=True, source=READMISSION_EVENTS))
def cohort_readmission_30d(spark, folder):
    kind = F.substring_index("code", "//", 1)
    prefix = F.when(kind == "SIGNUP", "Hospital Admission").when(kind == "PURCHASE", "Hospital Discharge").otherwise("Other")
    code = F.when(kind == "SIGNUP", "Gender F").when(kind == "PURCHASE", "Location Home").otherwise("Gender Location")
    events = view(spark, folder, "ev").withColumns({"prefix": prefix, "code": code})
    return cohort.label_cohort(events, READMISSION_30D)


@query(f"""SELECT * FROM ({ALL_LABELS}) UNION ALL SELECT 'chained', r.subject_id, i AS prediction_time, EXISTS (SELECT 1 FROM {{hospital}} h WHERE h.subject_id = r.subject_id
    AND h.time > r.a AND h.time <= r.z AND regexp_matches(code, 'HOSPITAL_DISCHARGE//.*')) AS boolean_value, {EMPTY} FROM {CHAIN} r WHERE z IS NOT NULL""")
def cohorts_with_chained_windows(spark, folder):
    """The four cohorts and one whose windows start at one another's ends, labelled together level by level."""
    return cohort.label_cohorts(view(spark, folder, "hospital"), {**COHORTS, "chained": CHAINED})


@query("""SELECT subject_id, time, count(*) FILTER (code LIKE 'SIGNUP//%') AS signup, count(*) FILTER (regexp_matches(code, '^(ERROR|VIEW)//K1') AND text_value = '{"k": 12}') AS odd
    FROM {ev} WHERE code LIKE 'SIGNUP//%' OR (regexp_matches(code, '^(ERROR|VIEW)//K1') AND text_value = '{"k": 12}') GROUP BY 1, 2""")
def predicate_counts(spark, folder):
    predicates = {
        "signup": {"code": {"regex": "^SIGNUP//"}},
        "odd": {"code": {"regex": "^(ERROR|VIEW)//K1"}, "text_value": '{"k": 12}'},
    }
    return cohort.predicate_counts(view(spark, folder, "ev"), predicates)


TIMES = {"buy": "PURCHASE", "enter": "SIGNUP"}


def history_of(spark, folder):
    predicates = {name: {"code": {"regex": f"^{code}//"}} for name, code in TIMES.items()}
    found = cohort.History.of(cohort.predicate_counts(view(spark, folder, "ev"), predicates))
    return found, found.counts.filter("enter > 0").select("subject_id", F.col("time").alias("trigger"))


@query("""SELECT subject_id, a.time AS trigger, (SELECT min(b.time) FROM events b WHERE b.user_id = subject_id AND b.event_type = 'purchase' AND b.ts > a.time) AS next_buy
    FROM (SELECT user_id AS subject_id, ts AS time FROM events WHERE event_type = 'signup') a""".replace("min(b.time)", "min(b.ts)"))
def next_event_lookup(spark, folder):
    """First matching event after each trigger."""
    found, points = history_of(spark, folder)
    return found.next_time(points, "trigger", "buy", "next_buy")


@query("""SELECT a.user_id AS subject_id, a.ts AS trigger, a.ts + INTERVAL 72 HOURS AS upto, count(b.ts) AS both_ends, count(b.ts) FILTER (b.ts > a.ts) AS after_start
    FROM (SELECT DISTINCT user_id, ts FROM events WHERE event_type = 'signup') a LEFT JOIN (SELECT user_id, ts FROM events WHERE event_type = 'signup') b
    ON a.user_id = b.user_id AND b.ts BETWEEN a.ts AND a.ts + INTERVAL 72 HOURS GROUP BY a.user_id, a.ts""")
def duration_window_counts(spark, folder):
    """Events within a fixed time of each trigger, with and without the start itself."""
    found, points = history_of(spark, folder)
    points = points.withColumn("upto", F.col("trigger") + F.make_dt_interval(hours=F.lit(72)))
    counted = found.count_between(points, "trigger", "upto", "enter", "both_ends")
    return found.count_between(counted, "trigger", "upto", "enter", "after_start", inclusive=(False, True))


@query("""SELECT event_id, count(*) FILTER (code LIKE 'ERROR//%') OVER (PARTITION BY subject_id ORDER BY time, event_id) AS errors_so_far,
    min(CASE WHEN code LIKE 'ERROR//%' THEN time END) OVER (PARTITION BY subject_id ORDER BY time, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_error FROM {ev}""")
def running_counts_and_next_times(spark, folder):
    is_error = F.col("code").startswith("ERROR//")
    line = lay_out(view(spark, folder, "ev"), ["subject_id"], ["time", "event_id"])
    line = line.run(errors_so_far=Run("sum", F.when(is_error, 1).otherwise(0)))
    line = line.run(reverse=True, next_error=Run("min", F.when(is_error, F.col("time")), strict=True))
    return line.rows().select("event_id", "errors_so_far", "next_error")


# --- label tables -------------------------------------------------------------------------------------------------

SIDE = "SELECT o_custkey AS subject_id, o_orderdate AS prediction_time, CASE CAST(o_orderkey % 3 AS INT) WHEN {a} THEN true WHEN {b} THEN false END AS boolean_value FROM orders WHERE o_orderkey % 5 <> {c}"
SIDES = [SIDE.replace("{a}", "0").replace("{b}", "1").replace("{c}", "0"), SIDE.replace("{a}", "1").replace("{b}", "2").replace("{c}", "1")]


def label_side(spark, folder, true: int, false: int, left_out: int):
    orders = view(spark, folder, "ord").filter(F.col("order_id") % 5 != left_out)
    value = F.when(F.col("order_id") % 3 == true, True).when(F.col("order_id") % 3 == false, False)
    return orders.select("subject_id", F.col("time").alias("prediction_time"), value.alias("boolean_value"))


@query(f"SELECT subject_id, prediction_time, a.boolean_value OR b.boolean_value AS boolean_value FROM ({SIDES[0]}) a JOIN ({SIDES[1]}) b USING (subject_id, prediction_time)")
def combine_labels(spark, folder):
    """Three-valued OR over labels present on both sides."""
    return cohort.combine_labels(label_side(spark, folder, 0, 1, 0), label_side(spark, folder, 1, 2, 1))


THREE = f"""(SELECT task, split, shard, subject_id, prediction_time FROM ({PARTITIONED}) WHERE task = 'a'
    UNION ALL SELECT 'c', split, shard, subject_id, prediction_time FROM ({PARTITIONED}) WHERE task = 'a' AND NOT (split = 'train' AND shard = '1' AND subject_id % 7 = 0)
    UNION ALL SELECT 'd', split, shard, subject_id, prediction_time FROM ({PARTITIONED}) WHERE task = 'a' AND shard <> '2')"""
NUMBERED = "(SELECT task, split, shard, subject_id, prediction_time, count(*) AS n FROM " + THREE + " GROUP BY ALL)"


def three_tasks(spark, folder):
    a = partitioned_labels(spark, folder).filter("task = 'a'")
    gone = (F.col("split") == "train") & (F.col("shard") == "1") & (F.col("subject_id") % 7 == 0)
    c = a.filter(~gone).withColumn("task", F.lit("c"))
    d = a.filter("shard <> '2'").withColumn("task", F.lit("d"))
    return a.unionByName(c).unionByName(d)


@query(f"""WITH n AS {NUMBERED}, pairs AS (SELECT t.task, r.split, r.shard, r.n AS nr, coalesce(x.n, 0) AS nt FROM n r CROSS JOIN (SELECT unnest(['c', 'd']) AS task) t
      LEFT JOIN n x ON x.task = t.task AND x.split = r.split AND x.shard = r.shard AND x.subject_id = r.subject_id AND x.prediction_time = r.prediction_time WHERE r.task = 'a')
    SELECT task, split, shard, CASE WHEN sum(nt) = 0 THEN 'missing' WHEN sum(greatest(nr - nt, 0)) = 0 THEN 'ok' ELSE 'mismatch' END AS status,
      CAST(sum(nr) AS BIGINT) AS n_reference, CAST(sum(nt) AS BIGINT) AS n_task, CAST(sum(greatest(nr - nt, 0)) AS BIGINT) AS n_only_in_reference FROM pairs GROUP BY ALL""")
def validate_labels(spark, folder):
    """Verdict per task and shard against the first task."""
    return cohort.validate_labels(three_tasks(spark, folder))


@query(f"""SELECT split, shard, subject_id, prediction_time FROM {THREE} r WHERE task = 'a' AND NOT EXISTS (SELECT 1 FROM {THREE} c WHERE c.task = 'c'
    AND c.split = r.split AND c.shard = r.shard AND c.subject_id = r.subject_id AND c.prediction_time = r.prediction_time) ORDER BY ALL LIMIT 5""")
def mismatch_report(spark, folder):
    """The first five reference keys another task lacks."""
    return cohort.mismatched_keys(three_tasks(spark, folder), "c", "a")


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def keys_without_partner(spark, folder):
    orders, lines = view(spark, folder, "admissions"), view(spark, folder, "diagnoses")
    return cohort.keys_without_partner(orders, lines, ["hadm_id"]).withColumnRenamed("hadm_id", "o_orderkey")


@query(f"SELECT h.* FROM {{hospital}} h WHERE subject_id IN (SELECT subject_id FROM {HOSPITALISATION} WHERE boolean_value)")
def labelled_subjects(spark, folder):
    """Events of subjects that occur among the labels."""
    wanted = labels(spark, folder, "hospitalisation").filter("boolean_value")
    return narrative.labelled_subjects(view(spark, folder, "hospital"), wanted)


@query(f"SELECT l.subject_id, l.prediction_time, h.event_id FROM {HOSPITALISATION} l JOIN {{hospital}} h ON h.subject_id = l.subject_id AND h.time <= l.prediction_time")
def events_before_labels(spark, folder):
    rows = narrative.events_before(view(spark, folder, "hospital"), labels(spark, folder, "hospitalisation"))
    return rows.select("subject_id", "prediction_time", "event_id")
