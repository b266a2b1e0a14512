import random
from datetime import datetime, timedelta

from eventloom.operators import statistics as st
from eventloom.operators.extract import merge_cohort, split_subjects, vocabulary
from eventloom.operators.transforms import order_events
from eventloom.plans import timeline
from eventloom.plans.timeline import DEFAULT_MAX_ROWS, MAX_ROWS_CONF, SLICE, Layout, Run, lay_out
from eventloom.sources.tables import cap_rows
from pyspark.sql import functions as F


def skewed(spark, n=600):
    """One key has a third of all rows, times repeat, values are partly null."""
    rng = random.Random(3)
    rows = [(1 if i % 3 == 0 else rng.randrange(2, 40), rng.randrange(20), i, rng.choice([None, 1, 2, 3])) for i in range(n)]
    return rows, spark.createDataFrame(rows, "k long, t long, i long, v long")


def brute(rows, reverse):
    out = {}
    for key in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2]), reverse=reverse)
        for at, row in enumerate(mine):
            seen = [r[3] for r in mine[: at + 1]]
            known, before = [v for v in seen if v is not None], [v for v in seen[:-1] if v is not None]
            out[row[2]] = (
                at + 1, sum(known) if known else None, min(before, default=None), max(known, default=None),
                known[-1] if known else None, mine[at - 1][3] if at else None, len(known),
            )
    return out


def test_runs_against_brute_force(spark, layout):
    rows, df = skewed(spark)
    for reverse in (False, True):
        line = lay_out(df, ["k"], ["t", "i"])
        assert (line.hot is not None) == (layout == "sliced")
        v = F.col("v")
        line = line.run(
            reverse=reverse, n=Run("count"), s=Run("sum", v), low=Run("min", v, strict=True), high=Run("max", v),
            last=Run("last", v), prev=Run("lag", v), known=Run("count", v),
        )
        got = {r.i: (r.n, r.s, r.low, r.high, r.last, r.prev, r.known) for r in line.rows().collect()}
        assert got == brute(rows, reverse)


def test_one_slice_continues_at_most_one_key(spark):
    _, df = skewed(spark)
    line = lay_out(df, ["k"], ["t", "i"], Layout(8))
    starts = line.df.groupBy("k").agg(F.min(SLICE).alias("first")).join(line.sizes(), "k").filter(F.col(SLICE) > F.col("first"))
    assert starts.groupBy(SLICE).count().filter("count > 1").count() == 0
    assert line.df.filter("k = 1").select(SLICE).distinct().count() > 1


def test_global_runs(spark, layout):
    rows, df = skewed(spark)
    got = lay_out(df, [], ["-t", "i"]).run(n=Run("count")).rows().collect()
    want = sorted(rows, key=lambda r: (-r[1], r[2]))
    assert [r.i for r in sorted(got, key=lambda r: r.n)] == [r[2] for r in want]


def test_quantiles(spark, layout):
    rows, df = skewed(spark)
    got = {(r.k, r.p): r.quantile for r in st.exact_quantiles(df, ["k"], "v", [0.1, 0.5, 0.9]).collect()}
    want = df.groupBy("k").agg(F.percentile("v", [0.1, 0.5, 0.9]).alias("q")).filter("q is not null").collect()
    for row in want:
        for p, q in zip((0.1, 0.5, 0.9), row.q, strict=True):
            assert abs(got[row.k, p] - q) < 1e-12
    assert len(got) == 3 * len(want)


def test_quantile_tokens(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(1, 11)] + [("b", 5.0), ("b", 5.0), ("c", None)], "code string, numeric_value double")
    cuts = st.quantile_cuts(df, 4)
    got = {(r.code, r.numeric_value): r.quantile for r in st.to_quantile_tokens(df, cuts).collect()}
    assert [got["a", float(i)] for i in range(1, 11)] == [1, 1, 1, 2, 2, 3, 3, 4, 4, 4]
    assert got["b", 5.0] == 1 and got["c", None] is None


def test_value_on_a_cut_stays_below(spark):
    df = spark.createDataFrame([("a", 2.0), ("a", 2.5)], "code string, numeric_value double")
    cuts = spark.createDataFrame([("a", [2.0, 3.0])], "code string, cuts array<double>")
    assert sorted(r.quantile for r in st.to_quantile_tokens(df, cuts).collect()) == [1, 2]


def test_time_tokens(spark, layout):
    start = datetime(2024, 1, 1)
    steps = [0, 4, 5, 20, 60 * 24 * 400]  # minutes between events
    times = [start + timedelta(minutes=sum(steps[: i + 1])) for i in range(len(steps))]
    df = spark.createDataFrame([(1, x, "c", None, None) for x in times], "subject_id long, time timestamp_ntz, code string, numeric_value double, text_value string")
    tokens = st.time_interval_tokens(order_events(df, ["c"])).orderBy("event_seq", "code").collect()
    assert [r.code for r in tokens] == ["c", "c", "5m-15m", "c", "15m-45m", "c", "=6mt", "=6mt", "c"]


def test_splits_are_complete_and_stable(spark, layout):
    df = spark.range(100).select(F.col("id").alias("subject_id"))
    fractions = {"train": 0.8, "tuning": None, "held_out": 0.2}
    first = {r.subject_id: (r.split, r.shard) for r in split_subjects(df, fractions, 30, seed=1).collect()}
    again = {r.subject_id: (r.split, r.shard) for r in split_subjects(df.orderBy(F.desc("subject_id")), fractions, 30, seed=1).collect()}
    assert first == again and len(first) == 100
    assert sorted(set(first.values())) == [("held_out", 0), ("train", 0), ("train", 1), ("train", 2)]
    assert sum(s == "train" for s, _ in first.values()) == 80


def test_vocabulary_and_cap(spark, layout):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("c",), (None,)], "code string")
    assert [(r.code, r.code_id) for r in vocabulary(df).orderBy("code_id").collect()] == [("b", 0), ("a", 1), ("c", 2)]
    rows = spark.range(20).select(F.lit("t").alias("task"), F.lit("0").alias("shard"), F.col("id").alias("subject_id"), F.col("id").alias("prediction_time"))
    assert sorted(r.subject_id for r in cap_rows(rows, 3).collect()) == [0, 1, 2] and cap_rows(rows, None).count() == 20


def test_large_lookup_with_a_frequent_key(spark, monkeypatch):
    """Half of the rows have one key: they stay where they are, and only the others are shuffled."""
    monkeypatch.setattr(timeline, "BROADCAST_ROWS", 100)
    spark.conf.set(MAX_ROWS_CONF, "1000")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        key = F.when(F.col("id") % 2 == 0, "hot").when(F.col("id") % 31 == 0, None).otherwise(F.concat(F.lit("k"), F.col("id") % 1500))
        rows = spark.range(0, 20_000, 1, 8).select("id", key.alias("code"))
        lookup = spark.range(1000).select(F.when(F.col("id") == 0, "hot").otherwise(F.concat(F.lit("k"), "id")).alias("code"), F.col("id").alias("v"))
        joined = timeline.join_measured(rows, lookup, "code")
        plain = rows.join(lookup, "code", "left")
        assert joined.columns == plain.columns
        assert sorted(map(str, joined.collect())) == sorted(map(str, plain.collect()))
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
        assert max(sizes) < 3000  # 20,000 rows, 10,000 of them of one key
        plan = joined._jdf.queryExecution().optimizedPlan().toString()
        assert "strategy=broadcast" in plan and "strategy=merge" in plan
        small = timeline.join_measured(rows, lookup.limit(50), "code")
        assert small.count() == 20_000
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set(MAX_ROWS_CONF, str(DEFAULT_MAX_ROWS))


def test_one_hot_key_leaves_the_others_alone(spark):
    """Only the hot key's rows are written and range-partitioned; the plan of the rest is that of whole keys."""
    rows = [(1, i % 50, i) for i in range(300)] + [(k, t, 1000 * k + t) for k in range(2, 30) for t in range(5)] + [(None, 1, 5)]
    df = spark.createDataFrame(rows, "k long, t long, i long")
    spark.conf.set(MAX_ROWS_CONF, "100")
    try:
        line = lay_out(df, ["k"], ["t", "i"])
        assert not line.sliced and line.hot.sliced
        assert {r.k for r in line.hot.df.select("k").distinct().collect()} == {1}
        assert line.hot.df.select(SLICE).distinct().count() > 1
        counted = line.run(n=Run("count"))
        plan = counted.df._jdf.queryExecution().executedPlan().toString()
        assert "rangepartitioning" not in plan and SLICE not in plan
        assert plan.count("Exchange hashpartitioning(k") == 1
        got = {(r.k, r.i): r.n for r in counted.rows().collect()}
    finally:
        spark.conf.set(MAX_ROWS_CONF, str(DEFAULT_MAX_ROWS))
    whole = {(r.k, r.i): r.n for r in lay_out(df, ["k"], ["t", "i"]).run(n=Run("count")).rows().collect()}
    assert got == whole and len(got) == len(rows)


def test_a_hot_null_key(spark):
    df = spark.createDataFrame([(None, i) for i in range(50)] + [(1, i) for i in range(5)], "k long, i long")
    spark.conf.set(MAX_ROWS_CONF, "10")
    try:
        line = lay_out(df, ["k"], ["i"])
        assert line.hot.df.count() == 50
        assert sorted(r.n for r in line.numbered("n").rows().collect()) == sorted([*range(1, 51), *range(1, 6)])
    finally:
        spark.conf.set(MAX_ROWS_CONF, str(DEFAULT_MAX_ROWS))


def test_sketched_cuts_are_near_the_exact_ranks(spark):
    rng = random.Random(1)
    values = {"a": [rng.gauss(0, 1) for _ in range(5000)], "b": [float(rng.randrange(7)) for _ in range(3000)], "c": [2.0] * 50, "d": [1.0, 2.0]}
    rows = [(c, v) for c, vs in values.items() for v in vs] + [("a", None), (None, 1.0)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "code string, numeric_value double").repartition(6)
    for accuracy in (50, 1000):
        cuts = {r.code: r.cuts for r in st.sketched_cuts(df, 10, accuracy=accuracy).collect()}
        assert cuts["c"] == [] and len(cuts["a"]) == 9
        for code in "abd":
            own = sorted(values[code])
            for i, cut in enumerate(cuts[code]):
                wanted = (i + 1) / 10 * len(own)
                below, upto = sum(v < cut for v in own), sum(v <= cut for v in own)
                assert cut in own and below + 1 - wanted <= len(own) / accuracy + 1 and wanted - upto <= len(own) / accuracy + 1
        errors = st.rank_errors(df, st.sketched_cuts(df, 10, accuracy=accuracy)).filter("code = 'a'").collect()
        assert len(errors) == 9 and all(r.n == 5000 and 0 <= r.error <= 5000 / accuracy + 1 for r in errors)


def test_shards_are_ordered_and_numbered(spark, layout):
    rng = random.Random(2)
    rows = [(rng.randrange(12), rng.randrange(30), rng.choice("xyz"), i) for i in range(150)]
    events = spark.createDataFrame(rows, "subject_id long, time long, code string, extra long")
    splits = spark.createDataFrame([(s, "train" if s < 8 else "test", str(s % 2)) for s in range(11)], "subject_id long, split string, shard string")
    got = merge_cohort(events, splits).collect()
    assert len(got) == sum(r[0] < 11 for r in rows)
    shards = {}
    for r in got:
        shards.setdefault((r.split, r.shard), []).append(r)
    for own in shards.values():
        by_number = sorted(own, key=lambda r: r.row)
        assert [r.row for r in by_number] == list(range(1, len(own) + 1))
        keys = [(r.subject_id, r.time, r.code, r.extra) for r in by_number]
        assert keys == sorted(keys)
