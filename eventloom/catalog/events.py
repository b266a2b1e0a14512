"""Transforms of the event table, ordering, windows, counts, quantiles and time tokens."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventloom.catalog.registry import query, table, view
from eventloom.catalog.tables import FRACTIONS, HOSPITAL_EVENTS, SPLITS, hospital_events, partitioned_labels, splits
from eventloom.functions import numbers
from eventloom.operators import extract
from eventloom.operators import statistics as st
from eventloom.operators import transforms as t
from eventloom.plans import history
from eventloom.plans.timeline import lay_out, written

PREFIX = "split_part(code, '//', 1)"
REST = "array_to_string(string_split(code, '//')[2:], '//')"
PREFIXED = f"(SELECT subject_id, time, {PREFIX} AS prefix, {REST} AS code, numeric_value, text_value, event_id FROM {{ev}})"


def sig_sql(x: str, figures: int = 3) -> str:
    """Rounded text of a double whose magnitude prints without an exponent."""
    scale = f"pow(10.0::DOUBLE, {figures - 1} - floor(log10(abs({x}))))"
    return (
        f"CASE WHEN {x} IS NULL THEN NULL WHEN {x} = floor({x}) THEN CAST(CAST({x} AS BIGINT) AS VARCHAR) "
        f"ELSE regexp_replace(CAST(round({x} * {scale}) / {scale} AS VARCHAR), '\\.0$', '') END"
    )


def title_sql(x: str) -> str:
    return (
        f"CASE WHEN {x} IS NULL THEN NULL ELSE array_to_string([CASE WHEN i = 1 OR NOT regexp_matches(substr({x}, i - 1, 1), "
        f"'[\\p{{L}}\\p{{N}}]') THEN upper(substr({x}, i, 1)) ELSE lower(substr({x}, i, 1)) END "
        f"FOR i IN range(1, length({x}) + 1)], '') END"
    )


def append_sql(code: str, join: str) -> str:
    return f"CASE WHEN {code} IS NULL THEN NULL ELSE concat_ws('{join}', {code}, {sig_sql('numeric_value')}, text_value) END"


def prefixed(spark, folder):
    return t.create_prefix_column(view(spark, folder, "ev"))


# --- row-wise transforms ------------------------------------------------------------------------------------------


@query(f"SELECT * FROM {PREFIXED}")
def create_prefix_column(spark, folder):
    return prefixed(spark, folder)


@query(f"SELECT order_id, {append_sql('code', '//')} AS code FROM {{ord}}")
def append_values(spark, folder):
    return t.append_values(view(spark, folder, "ord")).select("order_id", "code")


@query(f"SELECT event_id, {sig_sql('value', 2)} AS two, {sig_sql('value', 3)} AS three, {sig_sql('value', 5)} AS five FROM events")
def significant_figures(spark, folder):
    value = F.col("value")
    texts = [numbers.significant_text(value, n).alias(name) for n, name in ((2, "two"), (3, "three"), (5, "five"))]
    return table(spark, folder, "events").select("event_id", *texts)


CLEANED = "trim(regexp_replace(regexp_replace(x, '_|//', ' ', 'g'), '(\\s){2,}', ' ', 'g'))"


@query("SELECT p_partkey, upper(regexp_replace(regexp_replace(trim('  ' || p_name || ' __  ' || p_type || ' '), '_+', '//', 'g'), '(\\s){1,}', '_', 'g')) AS code FROM part")
def clean_string_columns(spark, folder):
    padded = F.concat(F.lit("  "), F.col("p_name"), F.lit(" __  "), F.col("p_type"), F.lit(" "))
    rows = table(spark, folder, "part").select("p_partkey", padded.alias("code"))
    patterns = [{"pattern": "_+", "replacement": "//"}, {"pattern": r"(\s){1,}", "replacement": "_"}]
    return t.clean_string_columns(rows, "code", patterns, strip_whitespace=True, to_uppercase=True)


@query(f"SELECT p_partkey, {title_sql('a')} AS code, {title_sql('p_brand')} AS prefix FROM (SELECT p_partkey, p_name || '/' || lower(p_type) || ' (' || p_size || ' HIGH)' AS a, p_brand FROM part)")
def title_case_columns(spark, folder):
    text = F.concat(F.col("p_name"), F.lit("/"), F.lower("p_type"), F.lit(" ("), F.col("p_size").cast("string"), F.lit(" HIGH)"))
    rows = table(spark, folder, "part").select("p_partkey", text.alias("code"), F.col("p_brand").alias("prefix"))
    return t.clean_string_columns(rows, ["code", "prefix"], to_titlecase=True)


@query("SELECT order_id, prefix, CASE WHEN prefix IN ('1-URGENT', '5-LOW') THEN text_value ELSE code END AS code FROM (SELECT order_id, code, text_value, split_part(code, '//', 2) AS prefix FROM {ord})")
def replace_code_with_text_value_by_prefix(spark, folder):
    rows = view(spark, folder, "ord").withColumn("prefix", F.split_part("code", F.lit("//"), F.lit(2)))
    return t.replace_code_with_text_value_by_prefix(rows, ["1-URGENT", "5-LOW"]).select("order_id", "prefix", "code")


@query("SELECT event_id, strftime(time, '%H:%M') AS time_of_day FROM {ev}")
def add_time_column(spark, folder):
    return t.add_time_column(view(spark, folder, "ev"), "%H:%M").select("event_id", "time_of_day")


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 1 THEN 'All day' ELSE strftime(time, '%I:%M %p') END AS time_of_day
    FROM (SELECT *, l_shipdate + INTERVAL 1 MINUTE * CAST(l_partkey % 1440 AS INT) AS time FROM lineitem)""")
def add_time_column_end_of_day(spark, folder):
    last = F.col("l_shipdate") + F.make_dt_interval(F.lit(0), F.lit(23), F.lit(59), F.lit(59.999999))
    other = F.col("l_shipdate") + F.make_dt_interval(mins=(F.col("l_partkey") % 1440).cast("int"))
    rows = table(spark, folder, "lineitem").withColumn("time", F.when(F.col("l_linenumber") == 1, last).otherwise(other))
    shown = t.add_time_column(rows, "%I:%M %p", replace_end_of_day=True, end_of_day_fill_value="All day")
    return shown.select("l_orderkey", "l_linenumber", "time_of_day")


AGES = """SELECT {id}, age_year, date_sub('day', birth + to_years(CAST(age_year AS INT)), time) AS age_day FROM (SELECT *,
    year(time) - year(birth) - CASE WHEN month(time) < month(birth) OR (month(time) = month(birth) AND day(time) < day(birth)) THEN 1 ELSE 0 END AS age_year
    FROM {source} LEFT JOIN (SELECT subject_id, min(time) AS birth FROM {source} WHERE prefix = '{prefix}' GROUP BY 1) USING (subject_id))"""
ORD_PREFIXED = "(SELECT subject_id, time, order_id, split_part(code, '//', 2) AS prefix FROM {ord})"


@query(AGES.replace("{id}", "order_id").replace("{source}", ORD_PREFIXED).replace("{prefix}", "1-URGENT"))
def calculate_age(spark, folder):
    rows = view(spark, folder, "ord").withColumn("prefix", F.split_part("code", F.lit("//"), F.lit(2)))
    return t.calculate_age(rows, "1-URGENT").select("order_id", "age_year", "age_day")


@query(AGES.replace("{id}", "event_id").replace("{source}", PREFIXED).replace("{prefix}", "SIGNUP") + " WHERE prefix <> 'SIGNUP'")
def calculate_age_without_birth_rows(spark, folder):
    return t.calculate_age(prefixed(spark, folder), "SIGNUP", drop_birth_rows=True).select("event_id", "age_year", "age_day")


@query("""SELECT e.event_id, b.birth_time FROM {ev} e LEFT JOIN (SELECT subject_id, min(time) AS birth_time FROM {ev}
    WHERE code LIKE 'SIGNUP//%' GROUP BY 1) b USING (subject_id)""")
def first_matching_time_over_subject(spark, folder):
    timeline = lay_out(prefixed(spark, folder), ["subject_id"], ["time"])
    births = t.birth_times(timeline.rows(), "SIGNUP")
    return timeline.attach(births).rows().select("event_id", "birth_time")


# --- filters ------------------------------------------------------------------------------------------------------


@query("SELECT * FROM {ev} WHERE NOT (regexp_matches(code, '^ERROR//K1') OR (regexp_matches(code, '^VIEW//.*') AND NOT regexp_matches(code, '^VIEW//K(5|6)')))")
def drop_by_regex(spark, folder):
    patterns = ["^ERROR//K1", {"regex": "^VIEW//.*", "except_regex": "^VIEW//K(5|6)"}]
    return t.drop_by_regex(view(spark, folder, "ev"), patterns)


@query("SELECT * FROM {ord} WHERE split_part(code, '//', 1) <> 'ORDER' OR (split_part(code, '//', 1) = 'ORDER' AND text_value IN ('F', 'O'))")
def filter_by_text_value(spark, folder):
    return t.filter_by_text_value(view(spark, folder, "ord"), {"ORDER": ["F", "O"], "SHIPMENT": ["X"]})


@query("SELECT * FROM {ord} WHERE numeric_value IS NOT NULL OR text_value IS NOT NULL")
def filter_null_values(spark, folder):
    return t.filter_null_values(view(spark, folder, "ord"))


@query("SELECT * FROM {hospital} WHERE split_part(code, '//', 1) NOT IN ('EMERGENCY_DEPARTMENT_DISCHARGE') OR numeric_value IS NOT NULL OR text_value IS NOT NULL")
def filter_null_values_by_prefix(spark, folder):
    return t.filter_null_values(view(spark, folder, "hospital"), ["EMERGENCY_DEPARTMENT_DISCHARGE"])


@query(f"SELECT * FROM {PREFIXED} WHERE prefix <> 'SIGNUP'")
def drop_birth_rows(spark, folder):
    return t.drop_birth_rows(prefixed(spark, folder), "SIGNUP")


@query("SELECT * FROM {ev} WHERE NOT (starts_with(code, 'ERROR//') OR starts_with(code, 'VIEW//K7'))")
def filter_codes_by_prefix(spark, folder):
    return t.filter_codes(view(spark, folder, "ev"), ["ERROR//", "VIEW//K7"], is_prefix=True)


@query("SELECT * FROM {ord} WHERE code NOT IN ('ORDER//5-LOW', 'ORDER//2-HIGH')")
def filter_codes_exact(spark, folder):
    return t.filter_codes(view(spark, folder, "ord"), ["ORDER//5-LOW", "ORDER//2-HIGH"])


@query("SELECT * FROM {ord} WHERE numeric_value IS NOT NULL OR text_value IS NOT NULL OR NOT starts_with(code, 'ORDER//')")
def numeric_results_only(spark, folder):
    """Rows of one category without any value go."""
    return t.filter_null_values(view(spark, folder, "ord"), ["ORDER"])


@query("SELECT * FROM {ev} WHERE NOT (regexp_matches(code, '^VIEW//.*') AND NOT regexp_matches(code, '^VIEW//(K1|K2).*'))")
def keep_listed_transfers(spark, folder):
    """Only the wanted kinds of one category remain; other categories are untouched."""
    return t.drop_by_regex(view(spark, folder, "ev"), [{"regex": "^VIEW//.*", "except_regex": "^VIEW//(K1|K2).*"}])


# --- order --------------------------------------------------------------------------------------------------------

ORDERED = """SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY time NULLS LAST,
    CASE WHEN starts_with(code, 'ORDER//5') THEN 0 WHEN starts_with(code, 'ORDER//1') THEN 1 ELSE 2 END,
    code NULLS LAST, numeric_value NULLS LAST, text_value NULLS LAST, order_id) AS event_seq FROM {ord}"""


@query(ORDERED)
def order_events(spark, folder):
    return t.order_events(view(spark, folder, "ord"), ["ORDER//5", "ORDER//1"], tie_breakers=["order_id"]).rows()


@query(f"SELECT *, row_number() OVER (ORDER BY subject_id, event_seq) AS position FROM ({ORDERED})")
def order_events_globally(spark, folder):
    ordered = t.order_events(view(spark, folder, "ord"), ["ORDER//5", "ORDER//1"], tie_breakers=["order_id"])
    return t.globally_sorted(ordered.rows(), "position")


@query("""SELECT event_id, row_number() OVER (PARTITION BY subject_id ORDER BY time, CASE WHEN starts_with(code, 'DEATH') THEN 0
    WHEN starts_with(code, 'DISCHARGE') THEN 1 ELSE 2 END, code, numeric_value, text_value, event_id) AS event_seq FROM
    (SELECT user_id AS subject_id, date_trunc('day', ts) AS time, CASE event_type WHEN 'view' THEN 'DEATH' WHEN 'click' THEN 'DISCHARGE' ELSE 'ADMIT' END AS code,
     value AS numeric_value, props AS text_value, event_id FROM events)""")
def death_before_discharge(spark, folder):
    """Among events of one time, death comes first."""
    kind = F.when(F.col("event_type") == "view", "DEATH").when(F.col("event_type") == "click", "DISCHARGE").otherwise("ADMIT")
    rows = table(spark, folder, "events").select(
        F.col("user_id").alias("subject_id"), F.date_trunc("day", "ts").cast("timestamp_ntz").alias("time"), kind.alias("code"),
        F.col("value").alias("numeric_value"), F.col("props").alias("text_value"), "event_id",
    )
    return t.order_events(rows, ["DEATH", "DISCHARGE"], tie_breakers=["event_id"]).rows().select("event_id", "event_seq")


@query("""SELECT event_id, coalesce(prefix <> lag(prefix) OVER w, true) AS prefix_changed, date_sub('microsecond', lag(time) OVER w, time) / 1000000.0::DOUBLE AS gap
    FROM """ + PREFIXED + """ WINDOW w AS (PARTITION BY subject_id ORDER BY time, event_id)""")
def change_detection(spark, folder):
    """Previous-row comparison per subject."""
    from eventloom.plans.timeline import Run

    seen = lay_out(prefixed(spark, folder), ["subject_id"], ["time", "event_id"]).run(
        __p=Run("lag", F.col("prefix")), __t=Run("lag", F.col("time")))
    changed = F.coalesce(F.col("prefix") != F.col("__p"), F.lit(True)).alias("prefix_changed")
    return seen.rows().select("event_id", changed, st.gap_seconds(F.col("__t"), F.col("time")).alias("gap"))


# --- stage lists --------------------------------------------------------------------------------------------------

PRIORITIES = " ".join(f"WHEN starts_with(code, '{p}') THEN {i}" for i, p in enumerate(history.ORDER_PREFIXES))
CLEAN_HOSPITAL = f"""SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY time, CASE {PRIORITIES} ELSE 20 END, code, numeric_value NULLS LAST,
    text_value NULLS LAST, event_id) AS event_seq FROM (SELECT subject_id, time, upper(regexp_replace(trim(code), '(\\s)+', '_', 'g')) AS code, numeric_value, text_value, event_id
    FROM {{hospital}} WHERE split_part(code, '//', 1) NOT IN ('EMERGENCY_DEPARTMENT_TRIAGE', 'EMERGENCY_DEPARTMENT_VITAL_SIGNS', 'LABORATORY_RESULT')
      OR numeric_value IS NOT NULL OR text_value IS NOT NULL)"""


def clean_hospital(spark, folder):
    return history.clean_events(view(spark, folder, "hospital"), tie_breakers=["event_id"], stored=True)


@query(CLEAN_HOSPITAL)
def clean_event_table(spark, folder):
    """The configured clean-up stages, then ordering."""
    return clean_hospital(spark, folder).rows()


@query(HOSPITAL_EVENTS + f""" SELECT subject_id, time, code, numeric_value, text_value,
    row_number() OVER (PARTITION BY subject_id ORDER BY time, CASE {PRIORITIES} ELSE 20 END, code, numeric_value NULLS LAST, text_value NULLS LAST) AS event_seq
    FROM (SELECT subject_id, time, upper(regexp_replace(trim(code), '(\\s)+', '_', 'g')) AS code, numeric_value, text_value FROM hosp
    WHERE split_part(code, '//', 1) <> 'LABORATORY_RESULT' OR numeric_value IS NOT NULL)""")
def raw_tables_to_ordered_events(spark, folder):
    """Preparation and extraction into a stored event table, then clean-up and ordering."""
    return history.clean_events(hospital_events(spark, folder)).rows()


def text_sql(source: str, age: str = "''") -> str:
    """The text stages over ordered events."""
    appended = append_sql("code", " ")
    cleaned = "regexp_replace(regexp_replace({x}, '_|//', ' ', 'g'), '(\\s){2,}', ' ', 'g')"
    code, prefix = cleaned.replace("{x}", "code"), cleaned.replace("{x}", "prefix")
    described = ", ".join(f"'{p}'" for p in history.DESCRIBED_PREFIXES)
    return f"""(SELECT * EXCLUDE (birth), CASE WHEN strftime(time, '%H:%M:%S.%f') = '23:59:59.999999' THEN NULL ELSE strftime(time, '%H:%M') END AS time_of_day,
        date_sub('day', birth + to_years(CAST(age_year AS INT)), time) AS age_day FROM (SELECT *,
          year(time) - year(birth) - CASE WHEN month(time) < month(birth) OR (month(time) = month(birth) AND day(time) < day(birth)) THEN 1 ELSE 0 END AS age_year
        FROM (SELECT *, min_by(time, event_seq) FILTER (prefix = 'Birth') OVER (PARTITION BY subject_id) AS birth
        FROM (SELECT subject_id, time, event_seq, numeric_value, text_value, event_id, {title_sql("code")} AS code, {title_sql("prefix")} AS prefix
        FROM (SELECT * REPLACE ({code} AS code, {prefix} AS prefix)
        FROM (SELECT * REPLACE (CASE WHEN prefix IN ({described}) THEN text_value ELSE code END AS code)
        FROM (SELECT * REPLACE ({REST} AS code), {PREFIX} AS prefix
        FROM (SELECT * REPLACE ({appended} AS code) FROM ({source}) WHERE NOT regexp_matches(code, '^EMERGENCY_DEPARTMENT_TRIAGE//AGE|^HOSPITAL_ADMISSION//AGE'))))))))
        WHERE prefix <> 'Birth')"""


TEXT_EVENTS = text_sql(CLEAN_HOSPITAL)


@query(f"SELECT * FROM {TEXT_EVENTS}")
def text_event_stages(spark, folder):
    """The configured text stages in their fixed order."""
    return history.text_events(clean_hospital(spark, folder)).rows()


@query(f"SELECT prefix, count(*) AS n FROM {TEXT_EVENTS} GROUP BY prefix")
def events_per_category(spark, folder):
    texts = history.text_events(clean_hospital(spark, folder)).rows()
    return texts.groupBy("prefix").agg(F.count(F.lit(1)).alias("n"))


# --- counts, quantiles, tokens ------------------------------------------------------------------------------------


@query("SELECT code, count(*) AS n FROM {ev} GROUP BY code")
def code_counts(spark, folder):
    return st.code_counts(view(spark, folder, "ev"))


QUANTILES = "[" + ", ".join(f"{i / 10}" for i in range(1, 10)) + "]"
TRAIN_ORD = f"(SELECT o.* FROM {{ord}} o JOIN ({SPLITS.replace('user_id AS subject_id FROM events', 'o_custkey AS subject_id FROM orders')}) s USING (subject_id) WHERE split = 'train')"
CUTS = f"""(SELECT code, CASE WHEN min(numeric_value) < max(numeric_value) THEN quantile_cont(numeric_value, {QUANTILES}) ELSE [] END AS cuts
    FROM {TRAIN_ORD} WHERE numeric_value IS NOT NULL AND starts_with(code, 'ORDER//') GROUP BY code)"""


def train_cuts(spark, folder):
    orders = view(spark, folder, "ord")
    placed = extract.split_subjects(orders, FRACTIONS, n_subjects_per_shard=20, seed=7)
    train = extract.with_splits(orders, placed).filter("split = 'train'")
    return st.quantile_cuts(train, 10, ["ORDER//"])


@query(f"SELECT code, i AS position, round(cuts[i], 4) AS cut FROM (SELECT code, cuts, unnest(range(1, len(cuts) + 1)) AS i FROM {CUTS})")
def quantile_cuts(spark, folder):
    """Exact cut points per code, fitted on the training split."""
    cuts = train_cuts(spark, folder).select("code", F.posexplode("cuts").alias("position", "cut"))
    return cuts.select("code", (F.col("position") + 1).alias("position"), F.round("cut", 4).alias("cut"))


@query(f"SELECT o.order_id, CASE WHEN numeric_value IS NOT NULL THEN 1 + len(list_filter(cuts, lambda c: c < numeric_value)) END AS quantile FROM {{ord}} o LEFT JOIN {CUTS} USING (code)")
def value_to_quantile_token(spark, folder):
    rows = st.to_quantile_tokens(view(spark, folder, "ord"), train_cuts(spark, folder))
    return rows.select("order_id", F.col("quantile").cast("bigint").alias("quantile"))


ACCURACY = 100


@query(f"SELECT code, p, count(*) AS n, true AS bounded FROM {{ord}}, (SELECT unnest({QUANTILES}) AS p) WHERE numeric_value IS NOT NULL GROUP BY code, p HAVING min(numeric_value) < max(numeric_value)")
def sketched_cuts_within_bounds(spark, folder):
    """Every cut of the sketch is a value whose rank is off by at most n / accuracy rows and the step of one row."""
    rows = view(spark, folder, "ord")
    cuts = written(st.sketched_cuts(rows, 10, accuracy=ACCURACY), "cuts")
    errors = st.rank_errors(rows, cuts)
    bounded = F.col("error") <= F.col("n") / ACCURACY + 1
    return errors.select("code", F.round("p", 9).alias("p"), "n", bounded.alias("bounded"))


@query("SELECT l_returnflag, p, round(q[i], 4) AS quantile FROM (SELECT l_returnflag, unnest([1, 2, 3]) AS i, unnest([0.25, 0.5, 0.75]::DOUBLE[]) AS p, quantile_cont(l_extendedprice, [0.25, 0.5, 0.75]) AS q FROM lineitem GROUP BY 1)")
def exact_quantiles(spark, folder):
    rows = st.exact_quantiles(table(spark, folder, "lineitem"), ["l_returnflag"], "l_extendedprice", [0.25, 0.5, 0.75])
    return rows.select("l_returnflag", "p", F.round("quantile", 4).alias("quantile"))


BUCKETS = " ".join(f"WHEN gap >= {s} THEN '{name}'" for name, s in reversed(st.TIME_INTERVALS.items()))
EV_GAPS = "(SELECT *, date_sub('microsecond', lag(time) OVER w, time) / 1000000.0::DOUBLE AS gap, row_number() OVER w AS event_seq FROM {src} WINDOW w AS (PARTITION BY subject_id ORDER BY time, code, numeric_value NULLS LAST, text_value NULLS LAST, {id}))"
EV_BUCKETS = f"(SELECT *, CASE {BUCKETS} END AS bucket FROM {EV_GAPS})"
ORD_BUCKETS = EV_BUCKETS.replace("{src}", "{ord}").replace("{id}", "order_id")


def ordered(spark, folder, name: str, tie: str):
    return t.order_events(view(spark, folder, name), ["~"], tie_breakers=[tie])


@query(f"""SELECT subject_id, time, code, numeric_value, text_value, CAST(event_seq AS DOUBLE) AS event_seq FROM {ORD_BUCKETS}
    UNION ALL SELECT subject_id, time, bucket, NULL, NULL, event_seq - 0.5 FROM (SELECT *, unnest(range(CASE WHEN bucket = '=6mt'
      THEN greatest(1, CAST(round(gap / {180 * 86400}.0::DOUBLE) AS INT)) ELSE 1 END)) FROM {ORD_BUCKETS} WHERE bucket IS NOT NULL)""")
def time_interval_tokens(spark, folder):
    return st.time_interval_tokens(ordered(spark, folder, "ord", "order_id"))


@query(f"""SELECT bucket, count(*) AS n, round(avg(gap), 3) AS mean, min(gap) AS min, max(gap) AS max, round(quantile_cont(gap, 0.25), 3) AS q1,
    round(quantile_cont(gap, 0.5), 3) AS median, round(quantile_cont(gap, 0.75), 3) AS q3
    FROM {EV_BUCKETS.replace("{src}", "{ev}").replace("{id}", "event_id")} WHERE bucket IS NOT NULL GROUP BY bucket""")
def interval_statistics(spark, folder):
    rows = st.interval_statistics(ordered(spark, folder, "ev", "event_id"))
    rounded = [F.round(c, 3).alias(c) for c in ("mean", "q1", "median", "q3")]
    return rows.select("bucket", "n", "min", "max", *rounded)


@query("""SELECT subject_id, arg_min(code, (time, code)) FILTER (code LIKE 'SIGNUP//%') AS "SIGNUP", arg_min(code, (time, code)) FILTER (code LIKE 'ERROR//%') AS "ERROR"
    FROM {ev} WHERE code LIKE 'SIGNUP//%' OR code LIKE 'ERROR//%' GROUP BY subject_id""")
def static_attributes(spark, folder):
    return st.static_attributes(view(spark, folder, "ev"), ["SIGNUP", "ERROR"], order=("time", "code"))


@query("SELECT DISTINCT subject_id FROM {ev}")
def distinct_subjects(spark, folder):
    return st.distinct_subjects(view(spark, folder, "ev"))


@query("""WITH l AS (SELECT CASE WHEN o_custkey % 10 < 8 THEN 'train' ELSE 'held_out' END AS split, CAST(o_custkey % 3 AS VARCHAR) AS shard, 'a' AS task FROM orders
    UNION ALL SELECT 'train', CAST(c_custkey % 2 AS VARCHAR), 'b' FROM customer)
    SELECT task, split, shard, count(*) AS n_rows FROM l GROUP BY ALL UNION ALL SELECT NULL, NULL, NULL, count(*) FROM l""")
def dataset_counters(spark, folder):
    return st.dataset_counters(partitioned_labels(spark, folder))


@query(f"""SELECT s.split, count(*) AS n_events, count(DISTINCT subject_id) AS n_subjects FROM {{ev}} JOIN ({SPLITS}) s USING (subject_id) GROUP BY s.split""")
def split_sizes(spark, folder):
    rows = extract.with_splits(view(spark, folder, "ev"), splits(spark, folder))
    return rows.groupBy("split").agg(F.count(F.lit(1)).alias("n_events"), F.count_distinct("subject_id").alias("n_subjects"))
