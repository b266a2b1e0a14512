from datetime import datetime

import pytest

from eventloom.operators import extract, prepare
from eventloom.plans import lookups
from eventloom.plans.hospital import NARRATIVE_EVENTS, STRUCTURED_EVENTS, STRUCTURED_EVENTS_WITHOUT_ED
from eventloom.plans.timeline import MAX_ROWS_CONF
from eventloom.sources import tables as io
from pyspark.sql import functions as F

LAST = (23, 59, 59, 999999)


@pytest.mark.parametrize(
    ("kind", "version", "code", "want"),
    [
        ("diagnosis", "9", "40211", "402.11"), ("diagnosis", "9", "E8120", "E812.0"), ("diagnosis", "9", "V4582", "V45.82"),
        ("diagnosis", "10", "E1165", "E11.65"), ("diagnosis", "10", "I10", "I10"), ("diagnosis", "9", "E812", "E812"),
        ("procedure", "9", "8856", "88.56"), ("procedure", "10", "02HV33Z", "02HV33Z"), ("procedure", "9", "88", "88"),
        ("diagnosis", "9", None, None),
    ],
)
def test_dots(spark, kind, version, code, want):
    df = spark.createDataFrame([(version, code)], "icd_version string, icd_code string")
    assert df.select(prepare.dotted(kind).alias("x")).first().x == want


def test_omr(spark):
    rows = [
        (1, "2020-01-01", 1, "Blood Pressure", "120/80"), (1, "2020-01-01", 2, "Blood Pressure Sitting", "120"),
        (1, "2020-01-01", 3, "Blood Pressure", "a/b"), (1, "2020-01-01", 4, "BMI (kg/m2)", "25.5"), (1, "2020-01-01", 5, "Weight (Lbs)", "1d"),
        (1, "2020-01-01", 6, "eGFR", "60"), (1, "2020-01-01", 7, "Blood Pressure", "1/2/3"), (1, "2020-01-01", 8, "Height (Inches)", None),
    ]
    df = spark.createDataFrame(rows, "subject_id long, chartdate string, seq_num long, result_name string, result_value string")
    got = sorted((r.seq_num, r.result_name, r.result_num) for r in prepare.outpatient_measurements(df).collect())
    assert got == [(1, prepare.DIASTOLIC, 80.0), (1, prepare.SYSTOLIC, 120.0), (4, "BMI kg/m2", 25.5)]
    assert {r.chartdate for r in prepare.outpatient_measurements(df).collect()} == {datetime(2020, 1, 1, *LAST)}


def raw(spark):
    frame = spark.createDataFrame
    return {
        "hosp/patients": frame(
            [(1, "F", 2000, 40, "2021-05-05"), (2, "M", 2000, 20, None), (3, "?", 2000, 30, "2022-01-01")],
            "subject_id long, gender string, anchor_year long, anchor_age long, dod string"),
        "hosp/admissions": frame(
            [(1, 10, "2020-01-01 08:00:00", "2020-01-03 09:00:00", "2021-05-01 01:00:00", "EW", "HOME"),
             (1, 11, "2021-01-01 08:00:00", "2021-01-03 09:00:00", "2021-05-04 01:00:00", "EW", None),
             (9, 12, "2021-01-01 08:00:00", "bad", None, "EW", "HOME")],
            "subject_id long, hadm_id long, admittime string, dischtime string, deathtime string, admission_type string, discharge_location string")
        .withColumns({c: F.lit(None).cast("string") for c in ("insurance", "marital_status", "race", "language", "admission_location")}),
        "hosp/labevents": frame([(1, 50, None, 1.5, "2020-01-01 10:00:00"), (1, 51, "mg", 2.5, "2020-01-01 11:00:00")],
                                "subject_id long, itemid long, valueuom string, valuenum double, charttime string"),
        "hosp/d_labitems": frame([(50, "Glucose", "Blood")], "itemid long, label string, fluid string"),
        "ed/edstays": frame([(1, 7, "2020-01-01 07:00:00", "2020-01-01 12:00:00", "WALK IN", "HOME")],
                            "subject_id long, stay_id long, intime string, outtime string, arrival_transport string, disposition string"),
        "ed/vitalsign": frame([(7, 98.6), (7, 37.0), (8, None)], "stay_id long, temperature double"),
    }


def test_preparations(spark):
    done = prepare.prepare_tables(raw(spark))
    patients = {r.subject_id: (r.dod, r.year_of_birth) for r in done["hosp/patients"].collect()}
    assert patients == {1: (datetime(2021, 5, 1, 1), "1960"), 2: (None, "1980"), 3: (datetime(2022, 1, 1, *LAST), "1970")}
    labs = {r.itemid: (r.fluid, r.label, r.valueuom) for r in done["hosp/labevents"].collect()}
    assert labs == {50: ("Blood", "Glucose", ""), 51: (None, None, "mg")}
    admissions = {r.hadm_id: (r.gender, r.age) for r in done["hosp/admissions"].collect()}
    assert admissions[10] == ("Female", 21915 / 365.25) and admissions[12] == (None, None)
    assert "year_of_birth" not in done["hosp/admissions"].columns
    vitals = [(r.temperature, r.intime) for r in done["ed/vitalsign"].collect()]
    assert [round(x, 6) if x else x for x, _ in vitals] == [37.0, 37.0, None] and vitals[2][1] is None
    with pytest.raises(KeyError):
        prepare.prepare_tables({"ed/vitalsign": raw(spark)["ed/vitalsign"]})


def test_extraction(spark):
    tables = prepare.prepare_tables({k: v for k, v in raw(spark).items() if k != "ed/vitalsign"})
    events = extract.extract_events(tables, NARRATIVE_EVENTS)
    codes = {(r.subject_id, r.code): (r.time, r.numeric_value, r.text_value) for r in events.collect()}
    assert codes[1, "LABORATORY_RESULT//Blood//Glucose//"][1] == 1.5
    assert codes[1, "LABORATORY_RESULT//UNK//UNK//mg"][1] == 2.5
    assert codes[1, "HOSPITAL_DISCHARGE//DISCHARGE_LOCATION//UNK"][0] == datetime(2021, 1, 3, 9)
    assert codes[2, "BIRTH//BORN"][0] == datetime(1980, 1, 1)
    assert codes[1, "EMERGENCY_DEPARTMENT_REGISTRATION//ARRIVAL_TRANSPORT"][2] == "WALK IN"
    assert (9, "HOSPITAL_DISCHARGE//DISCHARGE_LOCATION//HOME") not in codes  # its time cannot be parsed
    assert (2, "DEATH//DIED") not in codes


def test_structured_extraction_passes_ids_and_static_rows(spark):
    tables = raw(spark)
    patients = tables["hosp/patients"].withColumn("year_of_birth", F.lit("1960"))
    stays = tables["ed/edstays"].withColumn("hadm_id", F.lit(10).cast("long"))
    events = extract.extract_events({"hosp/patients": patients, "ed/edstays": stays}, STRUCTURED_EVENTS)
    static = events.filter("code = 'GENDER//F'").first()
    assert static.time is None and static.stay_id is None
    out = events.filter("code = 'ED_OUT'").first()
    assert (out.hadm_id, out.stay_id, out.text_value) == (10, 7, "HOME")


def test_specifications_are_complete():
    sizes = {name: len(events) for name, events in NARRATIVE_EVENTS.items() if name != "subject_id_col"}
    assert len(sizes) == 16 and sum(sizes.values()) == 40
    assert "text_value" in STRUCTURED_EVENTS["hosp/drgcodes"]["drg"]
    assert "text_value" not in STRUCTURED_EVENTS_WITHOUT_ED["hosp/drgcodes"]["drg"]
    assert not any(name.startswith("ed/") for name in STRUCTURED_EVENTS_WITHOUT_ED)


def test_csv_and_partitions(spark, tmp_path):
    (tmp_path / "d_icd_diagnoses.csv").write_text("icd_code,icd_version,long_title\n0010,9,Cholera\n")
    codes = io.read_all_text(spark, str(tmp_path / "d_icd_diagnoses.csv")).first()
    assert (codes.icd_code, codes.icd_version) == ("0010", "9")
    (tmp_path / "x.csv").write_text("subject_id,valuenum,code\n1,2.5,007\n")
    row = io.read_csv(spark, str(tmp_path / "x.csv")).first()
    assert (row.subject_id, row.valuenum, row.code) == (1, 2.5, "007")
    df = spark.createDataFrame([("a", "train", "007", 1), ("b", "train", "1", 2)], "task string, split string, shard string, subject_id long")
    io.write_partitioned(df, str(tmp_path / "set"))
    (tmp_path / "set" / ".hidden").mkdir()
    back = io.read_partitioned(spark, str(tmp_path / "set"), tasks=["a"], split="train")
    assert [(r.shard, r.subject_id) for r in back.collect()] == [("007", 1)]


def test_standard_csv(spark, tmp_path):
    (tmp_path / "t.csv").write_text('id,title,note\n1,"a ""quoted"" title, with comma","two\nlines"\n2,,""\n003,plain,"x,y"\n')
    rows = [tuple(r) for r in io.read_all_text(spark, str(tmp_path / "t.csv")).collect()]
    assert rows == [("1", 'a "quoted" title, with comma', "two\nlines"), ("2", None, ""), ("003", "plain", "x,y")] or rows[1][2] is None
    assert [r.title for r in io.read_csv(spark, str(tmp_path / "t.csv")).collect()] == ['a "quoted" title, with comma', None, "plain"]


def test_cap_follows_splits(spark):
    rows = [("a", s, "0", i) for s in ("train", "tuning", "held_out") for i in range(4)]
    df = spark.createDataFrame(rows, "task string, split string, shard string, subject_id int")
    assert io.cap_rows(df, 4, order=("subject_id",)).count() == 12
    assert io.cap_rows(df, 1, order=("subject_id",)).count() == 3 and io.cap_rows(df, 0).count() == 12


def _joins(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Join ")


def test_unread_lookup_is_not_joined(spark):
    tables = raw(spark)
    spec = {"ed/vitalsign": {"temperature": {"code": "T", "time": "col(charttime)", "numeric_value": "temperature"}}}
    vitals = spark.createDataFrame(
        [(1, 7, 37.0, "2020-01-01 10:00:00"), (1, 8, 36.0, "2020-01-01 11:00:00"), (1, None, 35.0, "2020-01-01 12:00:00")],
        "subject_id long, stay_id long, temperature double, charttime string")
    needed = {"ed/vitalsign": vitals, "ed/edstays": tables["ed/edstays"]}
    lean = extract.extract_events(prepare.prepare_tables(needed, extract.columns_read(spec)), spec)
    assert _joins(lean) == 0
    assert sorted(r.numeric_value for r in lean.collect()) == [35.0, 36.0, 37.0]
    # repeated keys repeat rows, so the join stays; null keys match nothing
    none = tables["ed/edstays"].withColumn("stay_id", F.lit(None).cast("long"))
    needed["ed/edstays"] = tables["ed/edstays"].union(tables["ed/edstays"]).union(none).union(none)
    twice = extract.extract_events(prepare.prepare_tables(needed, extract.columns_read(spec)), spec)
    assert sorted(r.numeric_value for r in twice.collect()) == [35.0, 36.0, 37.0, 37.0]


def test_dates_are_promoted_before_the_joins(spark):
    rows = spark.createDataFrame([(10, "88", "9", "2020-01-01")], "hadm_id long, icd_code string, icd_version string, chartdate string")
    titles = spark.createDataFrame([("88", "9", "x")], "icd_code string, icd_version string, long_title string")
    got = prepare.coded_events(rows, raw(spark)["hosp/admissions"], titles)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("make_dt_interval" if "make_dt_interval" in plan else "INTERVAL") > plan.rindex("Join LeftOuter")
    assert [r.chartdate for r in got.collect()] == [datetime(2020, 1, 1, *LAST)]


@pytest.fixture
def stored_joins(spark, monkeypatch):
    """Every table is long, every lookup too large to broadcast, and keys of over four rows are frequent."""
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", lookups.STORED_ROWS_CONF: "1", MAX_ROWS_CONF: "4"}
    before = {name: spark.conf.get(name, None) for name in settings}
    monkeypatch.setattr(lookups, "LEAST_BUCKET_ROWS", 3)
    for name, value in settings.items():
        spark.conf.set(name, value)
    yield
    for name, value in before.items():
        spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(("nulls", "same"), [(1, 1), (9, 1), (9, 9)])
def test_stored_lookup_gives_the_rows_of_a_join(spark, stored_joins, nulls, same):
    rows = [(i, f"c{i % 7}", i) for i in range(20)] + [(None, "c1", -1), (3, None, -2)] * nulls + [(5, "c5", 100)] * same
    df = spark.createDataFrame(rows, "k long, c string, v long")
    found = [(i, f"c{i % 5}", f"t{i}") for i in range(15)] + [(5, "c5", "again"), (5, "c5", None), (4, "c4", "twice"), (None, "c1", "no"), (None, None, "no")] * 2
    lookup = spark.createDataFrame(found, "k long, c string, t string")
    for on in (["k"], ["c"], ["k", "c"]):
        wanted = [*on, "t"]
        got = lookups.join_lookup(df, lookup.select(*wanted), on)
        want = df.join(lookup.select(*wanted), on, "left")
        assert got.columns == want.columns
        key = lambda r: tuple(map(str, r))
        assert sorted(map(tuple, got.collect()), key=key) == sorted(map(tuple, want.collect()), key=key)
        assert "Exchange hashpartitioning" in _plan(want) and "Exchange hashpartitioning" not in _plan(got)
    assert not [t.name for t in spark.catalog.listTables() if "eventloom" in t.name]


def test_frequent_keys_are_found(spark, stored_joins):
    df = spark.createDataFrame([(i % 6 if i < 24 else 7, None if i % 9 == 0 else "x") for i in range(40)], "k long, c string")
    assert lookups.frequent_keys(df, ["k"]) == (40, 0, [df.filter("k = 7").select(F.xxhash64("k")).first()[0]])
    rows, absent, hashes = lookups.frequent_keys(df, ["k", "c"])
    assert (rows, absent, len(hashes)) == (40, 5, 1)


def test_stored_tables_hold_what_events_read_and_are_not_shuffled(spark, stored_joins):
    tables = raw(spark)
    spec = {"ed/triage": {name: {"code": name, "time": "col(intime)", "numeric_value": name} for name in ("temperature", "age")},
            "ed/diagnosis": {"d": {"code": "D", "time": "col(outtime)", "text_value": "icd_title"}}}
    triage = [(i % 4, 7 if i % 3 else 8, 36.0 + i, "unread") for i in range(9)] + [(1, None, 30.0, "unread")]
    needed = {
        "ed/triage": spark.createDataFrame(triage, "subject_id long, stay_id long, temperature double, other string"),
        "ed/diagnosis": spark.createDataFrame([(1, 7, "x"), (2, 8, "y")], "subject_id long, stay_id long, icd_title string"),
        "ed/edstays": tables["ed/edstays"], "hosp/patients": tables["hosp/patients"], "hosp/admissions": tables["hosp/admissions"],
    }
    prepared = prepare.prepare_tables(needed, extract.columns_read(spec))
    assert "other" not in prepared["ed/triage"].columns and "other" in prepare.prepare_tables(needed)["ed/triage"].columns
    events = extract.extract_events(prepared, spec)
    assert "Exchange" not in _plan(events)
    got = sorted((r.subject_id, r.code, r.numeric_value) for r in events.collect())
    spark.conf.set(lookups.STORED_ROWS_CONF, "1000")
    plain = extract.extract_events(prepare.prepare_tables(needed), spec)
    assert got == sorted((r.subject_id, r.code, r.numeric_value) for r in plain.collect()) and len(got) == 13
