from datetime import datetime

import pytest

from eventloom.functions import numbers
from eventloom.operators import transforms as t
from eventloom.plans import history
from pyspark.sql import functions as F

VALUE_FORM = "subject_id long, time long, code string, numeric_value double, text_value string"
NTZ = "subject_id long, time timestamp_ntz, code string, prefix string"


def column(df, name, order=None):
    return [row[name] for row in (df.orderBy(order) if order else df).collect()]


def test_prefix_column(spark):
    codes = ["VITAL//pulse//resting", "VITAL//x//y//z", "pulse", None, "B//", "//c"]
    got = [(r.prefix, r.code) for r in t.create_prefix_column(spark.createDataFrame([(c,) for c in codes], "code string")).collect()]
    assert got == [("VITAL", "pulse//resting"), ("VITAL", "x//y//z"), ("pulse", ""), (None, None), ("B", ""), ("", "c")]
    none = t.create_prefix_column(spark.createDataFrame([], "code string"))
    assert none.isEmpty() and sorted(none.columns) == ["code", "prefix"]


@pytest.mark.parametrize(
    ("row", "options", "want"),
    [
        (("pulse", 61.0, "bpm"), {}, "pulse//61//bpm"),
        (("lactate", 1.849, "mmol/L"), {}, "lactate//1.85//mmol/L"),
        (("triage", None, "urgent"), {}, "triage//urgent"),
        (("height", 180.25, None), {}, "height//180"),
        (("arrival", None, None), {}, "arrival"),
        (("pulse", 61.0, "bpm"), {"join_char": "; "}, "pulse; 61; bpm"),
        ((None, 7.0, "bpm"), {}, None),
    ],
)
def test_append_values(spark, row, options, want):
    df = spark.createDataFrame([(5, 9, *row)], VALUE_FORM)
    out = t.append_values(df, **options)
    assert column(out, "code") == [want] and out.columns == df.columns


@pytest.mark.parametrize(
    ("value", "figures", "want"),
    [
        (1.0, 3, "1"), (100.0, 3, "100"), (0.0, 3, "0"), (1.234, 3, "1.23"), (12.34, 3, "12.3"), (123.4, 3, "123"),
        (1234.0, 3, "1234"), (1.23456, 2, "1.2"), (9.87654, 2, "9.9"), (1.23456, 5, "1.2346"), (9.87654, 5, "9.8765"),
        (-0.5, 3, "-0.5"), (0.00012345, 3, "0.000123"), (999.96, 3, "1000"), (123456.7, 3, "123000"), (-1234.56, 3, "-1230"),
        (1.5e-31, 3, "0." + "0" * 30 + "15"), (-9.996e-25, 3, "-0." + "0" * 23 + "1"), (1e-300, 3, "0." + "0" * 299 + "1"),
        (2.5e-310, 2, "0." + "0" * 309 + "25"), (4.25e-21, 3, "0." + "0" * 20 + "425"),
    ],
)
def test_significant_text(spark, value, figures, want):
    row = spark.range(1).select(numbers.significant_text(F.lit(value), figures).alias("x")).first()
    assert row.x == want


def test_float_values_keep_their_text(spark):
    df = spark.createDataFrame([("a", 37.6, None)], "code string, numeric_value float, text_value string")
    assert column(t.append_values(df, sig_figs=9), "code") == ["a//37.6"]


def test_clean_patterns_in_order(spark):
    codes = ["VITAL//pulse", "WARD//N/A", "DRUG  //  heparin", "WARD//???", None]
    df = spark.createDataFrame([(c,) for c in codes], "code string")
    patterns = [{"pattern": "//", "replacement": " "}, {"pattern": r"N/A|\?+", "replacement": "-"}, {"pattern": " +", "replacement": " "}]
    assert column(t.clean_string_columns(df, patterns=patterns), "code") == ["VITAL pulse", "WARD -", "DRUG heparin", "WARD -", None]


@pytest.mark.parametrize(
    ("text", "options", "want"),
    [
        ("room 7b", {"patterns": [{"pattern": r"\d+", "replacement": "#"}]}, "room #b"),
        ("  indented", {"strip_whitespace": True}, "indented"),
        (" both\t\n", {"strip_whitespace": True}, "both"),
        ("CHEST PAIN", {"to_titlecase": True}, "Chest Pain"),
        ("left ANKLE sprain", {"to_titlecase": True}, "Left Ankle Sprain"),
        ("breaths/MIN (1 high)", {"to_titlecase": True}, "Breaths/Min (1 High)"),
        ("élan vital-état", {"to_titlecase": True}, "Élan Vital-État"),
        ("breaths/min", {"to_titlecase": True, "boundary": "whitespace"}, "Breaths/min"),
        ("Mixed Case String", {"to_uppercase": True}, "MIXED CASE STRING"),
        (None, {"to_titlecase": True, "strip_whitespace": True}, None),
    ],
)
def test_clean_options(spark, text, options, want):
    df = spark.createDataFrame([(text,)], "code string")
    assert column(t.clean_string_columns(df, **options), "code") == [want]


def test_clean_several_columns_and_errors(spark):
    df = spark.createDataFrame([(" a ", " b ", " c ")], "code string, prefix string, other string")
    row = t.clean_string_columns(df, ["code", "prefix"], strip_whitespace=True).first()
    assert (row.code, row.prefix, row.other) == ("a", "b", " c ")
    with pytest.raises(ValueError):
        t.clean_string_columns(df)


def test_replace_code_by_prefix(spark):
    df = spark.createDataFrame([("c1", "P", "t1"), ("c2", "Q", "t2"), ("c3", "P", None)], "code string, prefix string, text_value string")
    assert column(t.replace_code_with_text_value_by_prefix(df, ["P"]), "code") == ["t1", "c2", None]
    assert column(t.replace_code_with_text_value_by_prefix(df, []), "code") == ["c1", "c2", "c3"]


@pytest.mark.parametrize(
    ("time", "options", "want"),
    [
        (datetime(2020, 1, 1, 10, 30, 45), {}, "10:30:45"),
        (datetime(2020, 1, 1, 10, 30, 45), {"time_format": "%H:%M"}, "10:30"),
        (datetime(2020, 1, 1, 10, 30, 45), {"time_format": "%I:%M %p"}, "10:30 AM"),
        (datetime(2020, 1, 1, 23, 59, 59, 999999), {"replace_end_of_day": True, "end_of_day_fill_value": "No Clock Time"}, "No Clock Time"),
        (datetime(2020, 1, 1, 23, 59, 59, 999999), {"replace_end_of_day": True}, None),
        (datetime(2020, 1, 1, 23, 59, 59, 999999), {}, "23:59:59"),
        (datetime(2020, 1, 1, 23, 59, 59, 999998), {"replace_end_of_day": True}, "23:59:59"),
        (datetime(2020, 1, 1, 23, 59, 59), {"replace_end_of_day": True}, "23:59:59"),
        (None, {"replace_end_of_day": True}, None),
    ],
)
def test_time_of_day(spark, time, options, want):
    df = spark.createDataFrame([(time,)], "time timestamp_ntz")
    assert column(t.add_time_column(df, **options), "time_of_day") == [want]


def test_drop_by_regex(spark):
    df = spark.createDataFrame([("MATCH",), ("NOPE",), ("PARTIAL_MATCH_SUFFIX",), (None,)], "code string")
    assert column(t.drop_by_regex(df, ["MATCH"]), "code") == ["NOPE"]
    groups = spark.createDataFrame([("DRG//HCFA//1",), ("DRG//APR//2",), ("LAB//x",)], "code string")
    kept = t.drop_by_regex(groups, [{"regex": "^DRG//.*", "except_regex": "^DRG//HCFA.*"}, "nothing"])
    assert column(kept, "code") == ["DRG//HCFA//1", "LAB//x"]
    for bad in ([], [{"except_regex": "x"}]):
        with pytest.raises(ValueError):
            t.drop_by_regex(df, bad)


def test_filter_by_text_value(spark):
    rows = [(1, "TRANSFER//a", "ADMIT"), (2, "TRANSFER//b", "DISCHARGE"), (3, "LAB//c", "x"), (4, "TRANSFER//d", "TRANSFER"), (5, "TRANSFER//e", None)]
    df = spark.createDataFrame(rows, "subject_id long, code string, text_value string")
    assert column(t.filter_by_text_value(df, {"TRANSFER": ["ADMIT", "TRANSFER"]}), "subject_id") == [1, 3, 4]
    assert column(t.filter_by_text_value(df, {"TRANSFER": ["ADMIT"], "LAB": ["y"]}), "subject_id") == [1]
    assert t.filter_by_text_value(df, {}).count() == 5 and t.filter_by_text_value(df, None).count() == 5


def test_filter_null_values(spark):
    rows = [(1, "LAB//a", None, None), (2, "LAB//b", None, "t"), (3, "LAB//c", 1.0, None), (4, "VITAL//d", None, None)]
    df = spark.createDataFrame(rows, "subject_id long, code string, numeric_value double, text_value string")
    assert column(t.filter_null_values(df, ["LAB"]), "subject_id") == [2, 3, 4]
    assert column(t.filter_null_values(df), "subject_id") == [2, 3]
    assert column(t.filter_null_values(df.drop("text_value")), "subject_id") == [3]
    assert t.filter_null_values(df.select("subject_id", "code")).count() == 4


def test_filter_codes(spark):
    df = spark.createDataFrame([("A//1",), ("AB",), ("B",)], "code string")
    assert column(t.filter_codes(df, ["A"], is_prefix=True), "code") == ["B"]
    assert column(t.filter_codes(df, ["B"]), "code") == ["A//1", "AB"]


BIRTHS = [
    (1, datetime(2000, 1, 1), "Birth", 0, 0), (1, datetime(2010, 1, 1), "x", 10, 0), (1, datetime(2000, 1, 2, 12), "x", 0, 1),
    (1, datetime(2001, 1, 21), "x", 1, 20), (1, datetime(2030, 1, 1), "x", 30, 0), (1, datetime(2000, 7, 1), "x", 0, 182),
    (2, datetime(2010, 1, 1), "x", None, None), (3, datetime(2004, 2, 29), "Birth", 0, 0), (3, datetime(2005, 2, 28), "x", 0, 365),
    (3, datetime(2005, 3, 1), "x", 1, 1), (1, None, "x", None, None), (4, datetime(2000, 5, 1), "x", -1, 121), (4, datetime(2001, 1, 1), "Birth", 0, 0),
]


def test_ages(spark, layout):
    df = spark.createDataFrame([(s, time, f"c{i}", p) for i, (s, time, p, _, _) in enumerate(BIRTHS)], NTZ)
    want = {f"c{i}": (y, d) for i, (_, _, _, y, d) in enumerate(BIRTHS)}
    assert {r.code: (r.age_year, r.age_day) for r in t.calculate_age(df).collect()} == want
    timeline = t.lay_out(df, ["subject_id"], ["time", "code"])
    assert (timeline.hot is not None) == (layout == "sliced")
    assert {r.code: (r.age_year, r.age_day) for r in t.calculate_age(timeline).rows().collect()} == want
    kept = t.calculate_age(df, drop_birth_rows=True)
    assert kept.filter("prefix = 'Birth'").count() == 0 and kept.count() == len(BIRTHS) - 3
    assert t.calculate_age(df, "Arrival").filter("age_year is not null").count() == 0


ORDER_FORM = VALUE_FORM + ", val long"


@pytest.mark.parametrize(
    ("rows", "prefixes", "options", "want"),
    [
        ([(1, 1, "MEDICATION//a", None, None, 1), (1, 1, "LAB//g", None, None, 2), (1, 1, "ADMISSION//e", None, None, 3)],
         ["ADMISSION", "LAB", "MEDICATION"], {}, [3, 2, 1]),
        ([(2, 1, "LAB", None, None, 3), (1, 1, "LAB", None, None, 1), (1, 1, "ADMISSION", None, None, 2), (2, 1, "ADMISSION", None, None, 4)],
         ["ADMISSION", "LAB"], {}, [2, 1, 4, 3]),
        ([(1, 1, "XLAB//x", None, None, 1), (1, 1, "LABORATORY//y", None, None, 2)], ["LAB"], {}, [2, 1]),
        ([(1, 1, "LAB", 2.0, "b", 1), (1, 1, "LAB", 1.0, "b", 2), (1, 1, "LAB", 1.0, "a", 3), (1, 1, "LAB", None, "a", 4)], ["LAB"], {}, [3, 2, 1, 4]),
        ([(1, 1, "LAB//b", 1.0, None, 1), (1, 1, "LAB//a", 2.0, None, 2)], ["LAB"], {}, [2, 1]),
        ([(1, None, "LAB", None, None, 1), (1, 5, "LAB", None, None, 2)], ["LAB"], {}, [2, 1]),
    ],
)
def test_order(spark, layout, rows, prefixes, options, want):
    df = spark.createDataFrame(rows, ORDER_FORM)
    ordered = t.order_events(df, prefixes, **options).rows()
    assert [r.val for r in ordered.orderBy("subject_id", "event_seq").collect()] == want
    assert "__priority" not in ordered.columns


def test_order_by_another_column(spark):
    df = spark.createDataFrame([(1, 1, "b", None, None, 1), (1, 1, "a", None, None, 2)], ORDER_FORM).withColumn("prefix", F.when(F.col("val") == 1, "Z").otherwise("Y"))
    assert [r.val for r in t.order_events(df, ["Z"], column="prefix").rows().orderBy("event_seq").collect()] == [1, 2]
    with pytest.raises(ValueError):
        t.order_events(df, [])


def test_codes_are_cleaned_once(spark):
    rows = [(1, None, " birth//born ", None, None), (1, None, "hospital_transfer//other", None, None)]
    df = spark.createDataFrame(rows, "subject_id long, time timestamp_ntz, code string, numeric_value double, text_value string")
    cleaned = history.clean_events(df, stored=True).rows()
    assert cleaned._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") == 1
    assert [r.code for r in cleaned.collect()] == ["BIRTH//BORN"]
