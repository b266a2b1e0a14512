import random
from datetime import datetime, timedelta

import pytest

from eventloom.operators import cohort
from eventloom.plans.cohorts import COHORTS

START = datetime(2024, 1, 1)
LABELS = "subject_id long, prediction_time long, boolean_value boolean"
KEYS = "task string, split string, shard string, subject_id long, prediction_time long"
ARRIVE, LEAVE, ICU = "EMERGENCY_DEPARTMENT_REGISTRATION//ARRIVAL_TRANSPORT", "EMERGENCY_DEPARTMENT_DISCHARGE//DISCHARGE_LOCATION//", "ICU_ADMISSION//X"


def events(spark, rows):
    table = [(s, START + timedelta(hours=h), code) for s, h, code in rows]
    return spark.createDataFrame(table, "subject_id long, time timestamp_ntz, code string")


def labels_of(df):
    return {(r.subject_id, (r.prediction_time - START) / timedelta(hours=1)): r.boolean_value for r in df.collect()}


def brute(rows, hours, is_label):
    """Arrival, next departure strictly later, label event within [departure, departure + hours]."""
    out = {}
    for s, h, code in rows:
        if code != ARRIVE:
            continue
        ends = [h2 for s2, h2, c in rows if s2 == s and h2 > h and c.startswith(LEAVE)]
        if ends:
            end = min(ends)
            out[s, h] = any(s2 == s and end <= h2 <= end + hours and is_label(c) for s2, h2, c in rows)
    return out


def test_cohorts_against_brute_force(spark, layout):
    rng = random.Random(5)
    codes = [ARRIVE, LEAVE + "HOME", LEAVE + "ADMITTED", ICU, "LAB//x"]
    rows = [(1 if i % 3 == 0 else rng.randrange(2, 9), rng.randrange(400), rng.choice(codes)) for i in range(300)]
    df = events(spark, rows)
    assert labels_of(cohort.label_cohort(df, COHORTS["critical_outcome_icu_12h"])) == brute(rows, 12, ICU.__eq__)
    assert labels_of(cohort.label_cohort(df, COHORTS["ed_reattendance"])) == brute(rows, 72, ARRIVE.__eq__)
    every = cohort.label_cohorts(df, COHORTS)
    assert labels_of(every.filter("task = 'ed_reattendance'")) == brute(rows, 72, ARRIVE.__eq__)


CHAIN = {
    "predicates": {"a": {"code": "A"}, "b": {"code": "B"}, "c": {"code": "C"}, "d": {"code": "D"}},
    "trigger": "a",
    "windows": {
        "one": {"start": "trigger", "end": "start -> b"},
        "two": {"start": "one.end", "end": "start + 3h"},
        "three": {"start": "two.end", "end": "start -> c", "index_timestamp": "end"},
        "four": {"start": "three.end", "end": "start -> b", "label": "d", "start_inclusive": False},
    },
}
BRANCHES = {
    "predicates": {"a": {"code": "A"}, "b": {"code": "B"}, "c": {"code": "C"}},
    "trigger": "a",
    "windows": {
        "first": {"start": "trigger", "end": "start -> b"},
        "left": {"start": "first.end", "end": "start -> c"},
        "right": {"start": "first.end", "end": "start -> a", "index_timestamp": "end"},
        "target": {"start": "left.start", "end": "left.end", "label": "b"},
    },
}


def chained(rows):
    """Both chains by looking through the rows."""

    def after(s, h, code):
        return min((h2 for s2, h2, c in rows if s2 == s and h2 > h and c == code), default=None)

    chain, branches = {}, {}
    for s, h in {(s, h) for s, h, c in rows if c == "A"}:
        b = after(s, h, "B")
        c = None if b is None else after(s, b + 3, "C")
        end = None if c is None else after(s, c, "B")
        if end is not None:
            chain.setdefault((s, c), []).append(any(s2 == s and c < h2 <= end and code == "D" for s2, h2, code in rows))
        left, right = (None, None) if b is None else (after(s, b, "C"), after(s, b, "A"))
        if left is not None and right is not None:
            branches.setdefault((s, right), []).append(any(s2 == s and b <= h2 <= left and code == "B" for s2, h2, code in rows))
    return chain, branches


def every_label(df):
    out = {}
    for r in df.collect():
        out.setdefault((r.subject_id, (r.prediction_time - START) / timedelta(hours=1)), []).append(r.boolean_value)
    return {k: sorted(v) for k, v in out.items()}


def test_chained_windows(spark, layout):
    rng = random.Random(8)
    rows = [(1 if i % 3 == 0 else rng.randrange(2, 7), rng.randrange(300), rng.choice("ABCD")) for i in range(260)]
    df = events(spark, rows)
    every = cohort.label_cohorts(df, {"chain": CHAIN, "branches": BRANCHES, "shipped": COHORTS["ed_reattendance"]})
    chain, branches = chained(rows)
    assert every_label(every.filter("task = 'chain'")) == {k: sorted(v) for k, v in chain.items()}
    assert every_label(every.filter("task = 'branches'")) == {k: sorted(v) for k, v in branches.items()}
    assert every_label(cohort.label_cohort(df, CHAIN)) == {k: sorted(v) for k, v in chain.items()}
    assert chain and branches


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return sum("Exchange hashpartitioning(subject_id" in line for line in plan.split("Initial Plan")[0].splitlines())


def test_levels_cost_two_exchanges_each(spark):
    df = events(spark, [(s, h, c) for s in range(3) for h, c in enumerate("ABCDABCD")])
    one = exchanges(cohort.label_cohorts(df, COHORTS))
    more = exchanges(cohort.label_cohorts(df, {**COHORTS, "chain": CHAIN, "branches": BRANCHES}))
    assert one <= 4 and more - one <= 4  # two further levels


def test_boundaries(spark):
    rows = [(1, 0, ARRIVE), (1, 5, LEAVE + "HOME"), (1, 17, ICU), (2, 0, ARRIVE), (2, 5, LEAVE + "HOME"), (2, 18, ICU),
            (3, 0, ARRIVE), (4, 0, ARRIVE), (4, 0, LEAVE + "ADMITTED"), (4, 2, LEAVE + "HOME")]
    df = events(spark, rows)
    # the end is included; a stay without departure has no label; a departure at the arrival's time does not end the stay
    assert labels_of(cohort.label_cohort(df, COHORTS["critical_outcome_icu_12h"])) == {(1, 0): True, (2, 0): False, (4, 0): False}
    assert labels_of(cohort.label_cohort(df, COHORTS["hospitalisation"]))[4, 0]


def test_bad_specifications(spark):
    df = events(spark, [(1, 0, ARRIVE)])
    base = COHORTS["hospitalisation"]
    without_index = base | {"windows": {"target": base["windows"]["target"]}}
    with pytest.raises(ValueError):
        cohort.label_cohort(df, without_index)
    with pytest.raises(ValueError):
        cohort.duration_seconds("soon")
    assert cohort.duration_seconds("30 days") == 30 * 86400 and cohort.duration_seconds("1d 12h") == 36 * 3600


def test_combine(spark):
    left = spark.createDataFrame([(1, 1, True), (1, 2, False), (1, 3, True), (1, 4, False), (1, 5, True)], LABELS)
    right = spark.createDataFrame([(1, 1, False), (1, 2, False), (1, 3, None), (1, 4, None), (2, 5, True)], LABELS)
    got = {r.prediction_time: r.boolean_value for r in cohort.combine_labels(left, right).collect()}
    assert got == {1: True, 2: False, 3: True, 4: None}


def test_validation(spark):
    ref = [("a", "train", "0", 1, 1), ("a", "train", "0", 1, 1), ("a", "train", "0", 2, 1), ("a", "train", "1", 3, 1)]
    ok = [("b", *r[1:]) for r in ref]
    extra = [("c", *r[1:]) for r in ref] + [("c", "train", "0", 9, 9), ("c", "tuning", "5", 1, 1)]
    moved = [("d", "train", "0", 1, 1), ("d", "train", "0", 1, 2), ("d", "train", "0", 2, 1)]
    df = spark.createDataFrame(ref + ok + extra + moved, KEYS)
    got = {(r.task, r.shard): (r.status, r.n_reference, r.n_task, r.n_only_in_reference) for r in cohort.validate_labels(df).collect()}
    assert got == {
        ("b", "0"): ("ok", 3, 3, 0), ("b", "1"): ("ok", 1, 1, 0), ("c", "0"): ("mismatch", 3, 4, 0), ("c", "1"): ("ok", 1, 1, 0),
        ("d", "0"): ("mismatch", 3, 3, 1), ("d", "1"): ("missing", 1, 0, 1),
    }
    assert not cohort.labels_are_valid(df) and cohort.labels_are_valid(df.filter("task < 'c'"))
    assert cohort.labels_are_valid(df.filter("task = 'a'")) and not cohort.labels_are_valid(df.limit(0))


def test_cohorts_share_two_exchanges(spark):
    rows = [(s, datetime(2020, 1, 1 + d), c, None) for s in range(5) for d, c in enumerate(["EMERGENCY_DEPARTMENT_REGISTRATION//ARRIVAL_TRANSPORT", "EMERGENCY_DEPARTMENT_DISCHARGE//DISCHARGE_LOCATION//ADMITTED"])]
    events = spark.createDataFrame(rows, "subject_id long, time timestamp_ntz, code string, text_value string")
    labels = cohort.label_cohorts(events, COHORTS)
    plan = labels._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 2
    assert {(r.task, r.boolean_value) for r in labels.collect()} == {("hospitalisation", True), ("ed_reattendance", False), ("critical_outcome_icu_12h", False)}


def test_equal_shards_exchange_no_keys(spark):
    a = [("a", s, str(n), i, i * 2) for s in ("train", "test") for n in range(2) for i in range(20)]
    same = spark.createDataFrame(a + [("b", *r[1:]) for r in reversed(a)], KEYS)
    checked = cohort.validate_labels(same)
    assert "subject_id" not in checked._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.status, r.n_reference, r.n_task, r.n_only_in_reference) for r in checked.collect()} == {("ok", 20, 20, 0)}
    one_off = spark.createDataFrame(a + [("b", *r[1:]) for r in a[1:]] + [("b", "train", "0", 99, 1)] + [(None, "train", "0", 1, 1)], KEYS)
    found = {(r.split, r.shard): (r.status, r.n_task, r.n_only_in_reference) for r in cohort.validate_labels(one_off).collect()}
    assert found["train", "0"] == ("mismatch", 20, 1) and set(found.values()) == {("mismatch", 20, 1), ("ok", 20, 0)}


def test_repeated_keys_and_null_shards(spark):
    a = [("a", "train", None, 1, 1), ("a", "train", None, 1, 1), ("a", None, "0", 2, 2), ("a", "x", "y", 5, 5)]
    b = [("b", "train", None, 1, 1), ("b", "train", None, 3, 3), ("b", None, "0", 2, 2)]
    found = {(r.split, r.shard): (r.status, r.n_task, r.n_only_in_reference) for r in cohort.validate_labels(spark.createDataFrame(a + b, KEYS)).collect()}
    assert found == {("train", None): ("mismatch", 2, 1), (None, "0"): ("ok", 1, 0), ("x", "y"): ("missing", 0, 1)}
