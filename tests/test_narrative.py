import random
import re
from datetime import datetime

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from eventloom.operators import narrative, prompts
from eventloom.plans import history
from eventloom.plans.timeline import DEFAULT_MAX_ROWS, MAX_ROWS_CONF, lay_out

RENDERED = "subject_id long, event_seq long, time timestamp_ntz, code string, prefix string, age_year long, age_day long, time_of_day string"
LABELS = "subject_id long, prediction_time timestamp_ntz, boolean_value boolean, integer_value long, float_value double, categorical_value string"
TITLE = "# Patient's Electronic Health Record\n\n"


@pytest.fixture(autouse=True)
def short_pages(monkeypatch):
    """Sliced histories are put together from pages of two lines."""
    monkeypatch.setattr(narrative, "LINES_PER_PAGE", 2)


def at(hour, day=1):
    return datetime(2020, 1, day, hour)


ROWS = [
    (1, 1, at(1), "A", "P", 3, 4, "01:00"), (1, 2, at(1), "B", "P", 3, 4, "01:00"), (1, 3, at(2), "C", "P", 3, 4, "02:00"),
    (1, 4, at(2), "D", "Q", 3, 4, "02:00"), (1, 5, at(2, 2), "E", "Q", 3, 5, None), (1, 6, at(3, 2), None, "Q", 3, 5, None),
    (1, 7, at(3, 2), "F", "Q", None, None, None), (1, 8, None, "Z", "Q", 3, 5, "x"), (2, 1, at(5), "G", "P", 1, 1, "05:00"),
]
FIRST = "## Age 3 years 4 days\n### 01:00\n#### P\nA\nB\n### 02:00\n#### P\nC\n#### Q\nD\n"
SECOND = "## Age 3 years 5 days\n### Time Unspecified\n#### Q\nE\n"
THIRD = "## Age -1 years -1 days\n### Time Unspecified\n#### Q\nF"


def test_whole_history(spark, layout):
    df = spark.createDataFrame(ROWS, RENDERED)
    got = {r.subject_id: r.text for r in narrative.patient_texts(df).collect()}
    assert got[1] == TITLE + FIRST + SECOND + THIRD
    assert got[2] == TITLE + "## Age 1 years 1 days\n### 05:00\n#### P\nG"
    with pytest.raises(PySparkException):
        narrative.patient_texts(df, on_null="fail").collect()


def test_null_codes_at_the_start_of_a_section(spark, layout):
    rows = [
        (1, 1, at(1), "A", "Lab", 3, 4, "01:00"), (1, 2, at(1, 2), None, "Diag", 3, 5, "01:00"), (1, 3, at(1, 2), "B", "Diag", 3, 5, "01:00"),
        (1, 4, at(2, 2), "C", None, 3, 5, "02:00"), (1, 5, at(2, 2), "D", "Diag", 3, 5, "02:00"),
    ]
    df = spark.createDataFrame(rows, RENDERED)
    (row,) = narrative.patient_texts(df).collect()
    wanted = "## Age 3 years 4 days\n### 01:00\n#### Lab\nA\n## Age 3 years 5 days\n### 01:00\n#### Diag\nB\n### 02:00\n#### Diag\nD"
    assert row.text == TITLE + wanted
    assert sorted(r.event_seq for r in narrative.without_line(df).collect()) == [2, 4]


def test_narratives(spark, layout):
    df = spark.createDataFrame(ROWS, RENDERED)
    rows = [(1, at(2), True), (1, at(2), True), (1, at(23, 3), None), (1, at(0), False), (3, at(5), True), (2, at(5), False)]
    labels = spark.createDataFrame([(*r, 1, None, "c") for r in rows], LABELS)
    got = narrative.narratives(df, labels).collect()
    texts = sorted((r.subject_id, r.prediction_time, r.text) for r in got)
    assert texts == [
        (1, at(2), TITLE + FIRST.rstrip()), (1, at(2), TITLE + FIRST.rstrip()), (1, at(23, 3), TITLE + FIRST + SECOND + THIRD),
        (2, at(5), TITLE + "## Age 1 years 1 days\n### 05:00\n#### P\nG"),
    ]
    assert {(r.integer_value, r.float_value, r.categorical_value) for r in got} == {(1, None, "c")}
    pages = narrative.narrative_pages(df, labels.distinct(), lines_per_page=2).filter("subject_id = 1").collect()
    whole = "".join(r.text for r in sorted((p for p in pages if p.prediction_time == at(2)), key=lambda p: p.page))
    assert whole == FIRST


def test_configured_stages(spark, layout):
    rows = [
        (1, datetime(1980, 1, 1), "BIRTH//BORN", None, None), (1, at(9), "EMERGENCY_DEPARTMENT_TRIAGE//AGE", 40.0, None),
        (1, at(9), "EMERGENCY_DEPARTMENT_TRIAGE//TEMPERATURE_°C", 37.62, None),
        (1, datetime(2020, 1, 1, 23, 59, 59, 999999), "HOSPITAL_DIAGNOSIS//ICD//10//A00", None, "Cholera  due_to vibrio"),
        (1, at(9), "LABORATORY_RESULT//Blood//Glucose//mg", None, None), (1, at(8), "DIAGNOSIS_RELATED_GROUPS//APR//1", None, "x"),
    ]
    df = spark.createDataFrame(rows, "subject_id long, time timestamp_ntz, code string, numeric_value double, text_value string")
    ordered = history.clean_events(df)
    as_stored = history.clean_events(df, stored=True)
    assert sorted(map(str, as_stored.rows().collect())) == sorted(map(str, ordered.rows().collect()))
    assert (ordered.hot is not None) == (layout == "sliced")
    labels = spark.createDataFrame([(1, at(0, 5), True, None, None, None)], LABELS)
    text = history.text_dataset(ordered, labels).first().text
    assert text == TITLE + (
        "## Age 40 years 0 days\n### 09:00\n#### Emergency Department Triage\nTemperature °C 37.6\n"
        "### Time Unspecified\n#### Hospital Diagnosis\nCholera Due To Vibrio"
    )


def test_training_rows_and_joins(spark):
    df = spark.createDataFrame(ROWS, RENDERED)
    labels = spark.createDataFrame([(1, at(1), True, None, None, None), (7, at(1), True, None, None, None)], LABELS)
    assert narrative.events_before(df, labels).count() == 2
    assert narrative.labelled_subjects(df, labels).select("subject_id").distinct().count() == 1
    row = narrative.training_rows(narrative.narratives(lay_out(df, ["subject_id"], ["event_seq"]), labels), "\nTask").first()
    assert row.text.endswith("B\nTask") and row.label


def test_many_lines_and_labels_of_one_subject(spark):
    """A subject with 200,000 lines and 10,000 labels among others: no page is repeated, no task holds the subject."""
    lines, labels = 200_000, 10_000
    start = datetime(2000, 1, 1)
    moment = F.lit(start) + F.make_dt_interval(mins=F.col("n").cast("int"))
    rows = spark.range(1, lines + 1).select(F.lit(1).cast("long").alias("subject_id"), F.col("id").alias("n"))
    rows = rows.union(spark.range(2, 40).select("id", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(20).cast("long")))))
    events = rows.select(
        "subject_id", F.col("n").alias("event_seq"), moment.cast("timestamp_ntz").alias("time"), F.concat(F.lit("CODE "), "n").alias("code"),
        F.lit("P").alias("prefix"), (F.col("n") / 5000).cast("long").alias("age_year"), F.lit(1).cast("long").alias("age_day"), F.lit("01:00").alias("time_of_day"),
    )
    wanted = spark.range(labels).select(F.lit(1).cast("long").alias("subject_id"), (F.col("id") * 20 + 7).alias("n")).union(spark.range(2, 40).select("id", F.lit(13).cast("long")))
    wanted = wanted.select("subject_id", moment.cast("timestamp_ntz").alias("prediction_time"), F.lit(True).alias("boolean_value"), *[F.lit(None).cast(t).alias(n) for n, t in (("integer_value", "long"), ("float_value", "double"), ("categorical_value", "string"))])
    spark.conf.set(MAX_ROWS_CONF, "50000")
    try:
        pages, cuts = narrative.paged_histories(events, wanted, lines_per_page=2000)
        pages, cuts = pages.cache(), cuts.select("subject_id", "prediction_time", "page", F.length("text").alias("n"), F.substring_index(F.rtrim("text"), "\n", -2).alias("end")).cache()
        assert pages.groupBy("subject_id", "page").count().filter("count > 1").isEmpty()
        assert pages.filter("subject_id = 1").count() == 100 and cuts.count() == labels + 38
        of_one = cuts.filter("subject_id = 1").select("page", "end", F.timestamp_diff("MINUTE", F.lit(start), "prediction_time").alias("n")).collect()
        assert all(r.page == (r.n - 1) // 2000 and r.end == f"CODE {r.n}\n" for r in of_one)
        few = wanted.filter("subject_id > 1 OR prediction_time = '2000-01-06 22:47:00'")
        texts = {(r.subject_id): r.text for r in narrative.narratives(events, few).collect()}
        assert len(texts) == 39 and texts[1].endswith("CODE 8567") and texts[1].count("CODE") == 8567
        assert all(texts[s].endswith("CODE 13") for s in range(2, 40))
    finally:
        spark.conf.set(MAX_ROWS_CONF, str(DEFAULT_MAX_ROWS))


def test_events_before_meets_sections(spark, layout, monkeypatch):
    monkeypatch.setattr(narrative, "EVENTS_PER_SECTION", 3)
    rows = [(s, at(h), f"{s}-{h}-{i}") for s in (1, 2) for i, h in enumerate([1, 1, 2, 3, 3, 3, 3, 5, 8])] + [(3, None, "x"), (None, at(1), "y")]
    labels = [(1, at(3)), (1, at(3)), (1, at(0)), (2, at(9)), (3, at(9)), (1, None), (None, at(4))]
    events = spark.createDataFrame(rows, "subject_id long, time timestamp_ntz, name string")
    table = spark.createDataFrame([(*r, True, None, None, None) for r in labels], LABELS)
    got = sorted((r.subject_id, r.prediction_time, r.name) for r in narrative.events_before(events, table).collect())
    assert got == sorted((s, p, n) for s, p in labels if s and p for s2, t, n in rows if s2 == s and t and t <= p)


@pytest.mark.parametrize("limit", [75, 80, 90, 110, 150, 100_000])
def test_limits_by_running_counts(spark, layout, limit):
    """The same texts as limiting the whole histories."""
    rng = random.Random(2)
    rows = []
    for s in range(1, 6):
        for n in range(1, 30):
            known = rng.random() < 0.8
            words = " ".join(rng.choices(["alpha", "beta", "gamma delta", "x"], k=rng.randrange(1, 6)))
            rows.append((s, n, datetime(2020, 1, 1 + n // 6, n % 6), words, rng.choice("PQ"), n // 9 if known else None, n // 6 if known else None, f"0{n % 6}:00"))
    events = spark.createDataFrame(rows, RENDERED)
    cuts = [(s, datetime(2020, 1, d, 3), True, None, None, None) for s in range(1, 6) for d in (1, 2, 3, 5)] * 2
    labels = spark.createDataFrame(cuts, LABELS).withColumn("task_description", F.lit("What comes next?"))
    whole = narrative.narratives(events, labels, keep=["task_description"])
    key = ["subject_id", "prediction_time", "available_tokens", "text"]
    got = prompts.limited_narratives(events, labels, limit).select(key).collect()
    want = prompts.limit_history(whole, limit).select(key).collect()
    assert sorted(map(str, got)) == sorted(map(str, want))
    same = prompts.limit_history_with(whole, limit, lambda: (re.compile(r"\s*\S+").findall, "".join)).select(key).collect()
    assert sorted((str(r.available_tokens), (r.text or "").strip()) for r in same) == sorted((str(r.available_tokens), (r.text or "").strip()) for r in want)
