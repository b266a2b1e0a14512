"""Counts, exact quantiles, time-gap tokens and their statistics over the event table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.functions.text import first_part, starts_with_any
from eventloom.operators.extract import union_by_name
from eventloom.plans.timeline import Run, Timeline, join_measured, lay_out, written

MINUTE, HOUR, DAY = 60, 3600, 86400

# Lower bounds of the gap buckets, in seconds.
TIME_INTERVALS = {
    "5m-15m": 5 * MINUTE,
    "15m-45m": 15 * MINUTE,
    "45m-1h15m": 45 * MINUTE,
    "1h15m-2h": HOUR + 15 * MINUTE,
    "2h-3h": 2 * HOUR,
    "3h-5h": 3 * HOUR,
    "5h-8h": 5 * HOUR,
    "8h-12h": 8 * HOUR,
    "12h-18h": 12 * HOUR,
    "18h-1d": 18 * HOUR,
    "1d-2d": DAY,
    "2d-4d": 2 * DAY,
    "4d-7d": 4 * DAY,
    "7d-12d": 7 * DAY,
    "12d-20d": 12 * DAY,
    "20d-30d": 20 * DAY,
    "30d-2mt": 30 * DAY,
    "2mt-6mt": 60 * DAY,
    "=6mt": 180 * DAY,
}


def code_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("code").agg(F.count(F.lit(1)).alias("n"))


def exact_quantiles(df: DataFrame, by: Sequence[str], value: str, probabilities: Sequence[float]) -> DataFrame:
    """Quantiles with linear interpolation between order statistics: one row per group and probability.

    Values are counted first, so repeated values cost one row. The running counts are computed over a timeline, which
    keeps a group of any size spread over tasks. A quantile is read off the one or two rows whose ranks it needs.
    """
    return counted_quantiles(value_counts(df, by, value), by, value, probabilities)


def value_counts(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """The number of rows (`__n`) of every group and value that is not null, written once."""
    return written(df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("__n")), "counts")


def counted_quantiles(counts: DataFrame, by: Sequence[str], value: str, probabilities: Sequence[float]) -> DataFrame:
    """`exact_quantiles` from `value_counts`."""
    totals = counts.groupBy(*by).agg(F.sum("__n").alias("__total"))
    line = lay_out(counts, by, [value]).run(__upto=Run("sum", F.col("__n")))
    line = line.attach(totals) if by else line.pipe(lambda d: d.withColumn("__total", totals.scalar()))
    points = F.array(*(F.lit(float(p)) for p in probabilities))
    last, first = F.col("__upto") - 1, F.col("__upto") - F.col("__n")

    def read(p: Column) -> Column:
        position = p * (F.col("__total") - 1)
        low, high = F.floor(position), F.ceil(position)
        return F.struct(
            p.alias("p"),
            F.when(low.between(first, last), F.col(value)).alias("low"),
            F.when(high.between(first, last), F.col(value)).alias("high"),
            (position - low).alias("fraction"),
        )

    hits = F.filter(F.transform(points, read), lambda h: h["low"].isNotNull() | h["high"].isNotNull())
    found = line.rows().select(*by, F.explode(hits).alias("__hit")).groupBy(*by, F.col("__hit.p").alias("p"))
    ends = found.agg(
        F.max("__hit.low").alias("low"), F.max("__hit.high").alias("high"), F.max("__hit.fraction").alias("f")
    )
    low, high = F.col("low").cast("double"), F.col("high").cast("double")
    return ends.select(*by, "p", (low + (high - low) * F.col("f")).alias("quantile"))


def quantile_cuts(df: DataFrame, num_quantiles: int = 10, code_prefixes: Sequence[str] | None = None) -> DataFrame:
    """Ascending interior cut points per code; codes with a single distinct value get none."""
    values = df.filter(F.col("numeric_value").isNotNull())
    if code_prefixes is not None:
        values = values.filter(starts_with_any(F.col("code"), code_prefixes))
    probabilities = [i / num_quantiles for i in range(1, num_quantiles)]
    counts = value_counts(values, ["code"], "numeric_value")
    cuts = counted_quantiles(counts, ["code"], "numeric_value", probabilities)
    listed = cuts.groupBy("code").agg(F.sort_array(F.collect_list("quantile")).alias("cuts"))
    spread = counts.groupBy("code").agg((F.min("numeric_value") < F.max("numeric_value")).alias("__spread"))
    joined = listed.join(spread, "code")
    return joined.select("code", F.when(F.col("__spread"), F.col("cuts")).otherwise(F.slice("cuts", 1, 0)).alias("cuts"))


def sketched_cuts(
    df: DataFrame, num_quantiles: int = 10, code_prefixes: Sequence[str] | None = None, accuracy: int = 1_000
) -> DataFrame:
    """Cut points per code from one pass with a mergeable sketch, instead of an order over all values.

    Each cut is a value of its code whose rank lies within n / accuracy of the wanted rank among the code's n values. A task
    keeps a sketch for each code, whose size depends on the accuracy and not on the number of values, and the sketches of all
    tasks are merged. `quantile_cuts` gives the exact cuts, with interpolation.
    """
    values = df.filter(F.col("numeric_value").isNotNull())
    if code_prefixes is not None:
        values = values.filter(starts_with_any(F.col("code"), code_prefixes))
    probabilities = [i / num_quantiles for i in range(1, num_quantiles)]
    found = values.groupBy("code").agg(
        F.percentile_approx("numeric_value", probabilities, accuracy).alias("cuts"), (F.min("numeric_value") < F.max("numeric_value")).alias("__spread")
    )
    return found.select("code", F.when(F.col("__spread"), F.col("cuts")).otherwise(F.slice("cuts", 1, 0)).alias("cuts"))


def rank_errors(df: DataFrame, cuts: DataFrame, num_quantiles: int = 10) -> DataFrame:
    """Per code and wanted quantile `p`, the rows `n` and how far (in rows) the cut's rank is from the wanted one.

    A value that occurs several times has a range of ranks; the error is the distance to the nearest of them.
    """
    asked = cuts.select("code", F.posexplode("cuts").alias("at", "cut"))
    values = df.filter(F.col("numeric_value").isNotNull()).select("code", "numeric_value")
    counted = values.join(asked, "code").groupBy("code", "at").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("numeric_value") < F.col("cut")).alias("below"), F.count_if(F.col("numeric_value") <= F.col("cut")).alias("upto")
    )
    p = (F.col("at") + 1) / num_quantiles
    wanted = p * F.col("n")
    error = F.greatest(F.col("below") + 1 - wanted, wanted - F.col("upto"), F.lit(0.0))
    return counted.select("code", p.alias("p"), "n", error.alias("error"))


def to_quantile_tokens(df: DataFrame, cuts: DataFrame) -> DataFrame:
    """Add `quantile`: 1 plus the number of cuts below the value; null without a value or cuts.

    A code has at most `num_quantiles - 1` cuts, so the joined array is short whatever the data.
    """
    below = F.size(F.filter("cuts", lambda c: c < F.col("numeric_value"))) + 1
    joined = join_measured(df, cuts, "code")
    usable = F.col("numeric_value").isNotNull() & F.col("cuts").isNotNull()
    return joined.withColumn("quantile", F.when(usable, below)).drop("cuts")


def gap_seconds(start: Column, end: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", start, end) / F.lit(1_000_000)


def bucket_name(gap: Column, intervals: Mapping[str, int] = TIME_INTERVALS) -> Column:
    """Name of the last bucket whose lower bound is reached; null below the first."""
    name = F.lit(None).cast("string")
    for label, lower in intervals.items():
        name = F.when(gap >= lower, F.lit(label)).otherwise(name)
    return name


def with_gaps(timeline: Timeline) -> Timeline:
    """Seconds since the previous event of the subject, over events that have a time."""
    timed = timeline.pipe(lambda df: df.filter(F.col("time").isNotNull()))
    seen = timed.run(__previous=Run("lag", F.col("time")))
    return seen.pipe(lambda df: df.withColumn("gap", gap_seconds(F.col("__previous"), F.col("time"))).drop("__previous"))


def time_interval_tokens(timeline: Timeline, intervals: Mapping[str, int] = TIME_INTERVALS) -> DataFrame:
    """Events with a token row before each gap of at least the first bound.

    Tokens sit half a step before the event that ends the gap. The last bucket is repeated, once per its own length.
    """
    longest, lower = list(intervals.items())[-1]
    gaps = with_gaps(timeline).rows().withColumn("__bucket", bucket_name(F.col("gap"), intervals))
    repeats = F.when(
        F.col("__bucket") == longest, F.greatest(F.lit(1), F.round(F.col("gap") / lower).cast("int"))
    ).otherwise(1)
    # a row emits itself and, when its gap has a bucket, the tokens before it: one pass, no second scan and no shuffle
    itself = F.array(F.lit(None).cast("string"))
    emitted = F.when(F.col("__bucket").isNull(), itself).otherwise(
        F.concat(F.array_repeat(F.col("__bucket"), repeats), itself)
    )
    rows = gaps.withColumn("__token", F.explode(emitted))
    is_token = F.col("__token").isNotNull()
    return rows.select(
        "subject_id",
        "time",
        F.coalesce("__token", "code").alias("code"),
        F.when(~is_token, F.col("numeric_value")).alias("numeric_value"),
        F.when(~is_token, F.col("text_value")).alias("text_value"),
        (F.col("event_seq") - F.when(is_token, 0.5).otherwise(0.0)).alias("event_seq"),
    )


def interval_statistics(timeline: Timeline, intervals: Mapping[str, int] = TIME_INTERVALS) -> DataFrame:
    """Count, mean, extremes and quartiles of the gaps in each bucket."""
    gaps = with_gaps(timeline).rows().select("gap", bucket_name(F.col("gap"), intervals).alias("bucket"))
    gaps = gaps.filter(F.col("bucket").isNotNull())
    counts = value_counts(gaps, ["bucket"], "gap")
    simple = counts.groupBy("bucket").agg(
        F.sum("__n").alias("n"),
        (F.sum(F.col("gap") * F.col("__n")) / F.sum("__n")).alias("mean"),
        F.min("gap").alias("min"),
        F.max("gap").alias("max"),
    )
    quartiles = counted_quantiles(counts, ["bucket"], "gap", [0.25, 0.5, 0.75])
    wide = quartiles.groupBy("bucket").agg(*(
        F.max(F.when(F.abs(F.col("p") - p) < 1e-9, F.col("quantile"))).alias(name)
        for p, name in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))
    ))
    return simple.join(wide, "bucket")


def static_attributes(df: DataFrame, prefixes: Sequence[str], order: Sequence[str] = ("event_seq",)) -> DataFrame:
    """First code of each listed category per subject, one column per category."""
    rank = F.struct(*order)
    category = first_part(F.col("code"))
    firsts = [F.min_by("code", F.when(category == p, rank)).alias(p) for p in prefixes]
    return df.filter(category.isin(list(prefixes))).groupBy("subject_id").agg(*firsts)


def dataset_counters(df: DataFrame, by: Sequence[str] = ("task", "split", "shard")) -> DataFrame:
    """Rows per shard and in total (the row whose shard columns are null)."""
    per_shard = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"))
    total = per_shard.agg(F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n_rows"))
    return union_by_name([per_shard, total])


def distinct_subjects(df: DataFrame) -> DataFrame:
    return df.select("subject_id").distinct()
