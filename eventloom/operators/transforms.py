"""Row-wise and per-subject transforms of the event table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.functions import numbers, text, times
from eventloom.functions.rows import computed_once
from eventloom.plans.timeline import Layout, Timeline, lay_out

Pattern = str | Mapping[str, str]


def create_prefix_column(df: DataFrame) -> DataFrame:
    """Split `code` at its first separator into `prefix` and the rest."""
    code = F.col("code")
    return df.withColumns({"prefix": text.first_part(code), "code": text.remaining_parts(code)})


def append_values(df: DataFrame, column: str = "code", join_char: str = "//", sig_figs: int = 3) -> DataFrame:
    """Append the formatted number and the text value to `column`; a null in `column` stays null."""
    number = numbers.significant_text(numbers.as_double(df, "numeric_value"), sig_figs)
    joined = F.concat_ws(join_char, F.col(column), number, F.col("text_value"))
    return df.withColumn(column, F.when(F.col(column).isNotNull(), joined))


def clean_string_columns(
    df: DataFrame,
    column: str | Sequence[str] = "code",
    patterns: Sequence[Mapping[str, str]] = (),
    strip_whitespace: bool = False,
    to_titlecase: bool = False,
    to_uppercase: bool = False,
    boundary: str = "nonalnum",
    once: bool = False,
) -> DataFrame:
    """Strip, replace patterns in order, then change case. `patterns` holds {pattern, replacement} entries.

    `once` is for columns that a filter reads next: the optimizer does not repeat the cleaning in it then.
    """
    if not (patterns or strip_whitespace or to_titlecase or to_uppercase):
        raise ValueError("ask for at least one of patterns, strip_whitespace, to_titlecase, to_uppercase")

    def cleaned(name: str) -> Column:
        col = text.strip(F.col(name)) if strip_whitespace else F.col(name)
        col = text.replace_all(col, [(p["pattern"], p["replacement"]) for p in patterns])
        col = text.title_case(col, boundary) if to_titlecase else col
        return F.upper(col) if to_uppercase else col

    names = [column] if isinstance(column, str) else list(column)
    columns = {name: cleaned(name) for name in names}
    return computed_once(df, columns) if once else df.withColumns(columns)


def replace_code_with_text_value_by_prefix(df: DataFrame, prefixes: Sequence[str]) -> DataFrame:
    """Where `prefix` is listed, `code` becomes `text_value`, even when that is null."""
    if not prefixes:
        return df
    code = F.when(F.col("prefix").isin(list(prefixes)), F.col("text_value")).otherwise(F.col("code"))
    return df.withColumn("code", code)


def add_time_column(
    df: DataFrame,
    time_format: str = "%H:%M:%S",
    replace_end_of_day: bool = False,
    end_of_day_fill_value: str | None = None,
) -> DataFrame:
    """Add `time_of_day`; the last microsecond of a day may be replaced by a fill value."""
    shown = F.date_format("time", times.spark_format(time_format))
    if replace_end_of_day:
        fill = F.lit(end_of_day_fill_value).cast("string")
        shown = F.when(times.is_end_of_day(F.col("time")), fill).otherwise(shown)
    return df.withColumn("time_of_day", shown)


def drop_by_regex(df: DataFrame, patterns: Sequence[Pattern], column: str = "code") -> DataFrame:
    """Drop rows in which any pattern is found and its exception is not; null values are dropped."""
    if not patterns:
        raise ValueError("patterns must not be empty")
    for pattern in patterns:
        if not isinstance(pattern, str) and "regex" not in pattern:
            raise ValueError("a pattern entry needs the key 'regex'")

    def dropped(col: Column) -> Column:
        drop = F.lit(False)
        for pattern in patterns:
            pattern = {"regex": pattern} if isinstance(pattern, str) else pattern
            hit = col.rlike(text.unicode_regex(pattern["regex"]))
            if pattern.get("except_regex"):
                hit = hit & ~col.rlike(text.unicode_regex(pattern["except_regex"]))
            drop = drop | hit
        return drop

    # The optimizer moves the filter below the step that computed the column and would repeat that computation for every
    # pattern; bound to a lambda variable it is evaluated once per row.
    return df.filter(F.exists(F.array(column), lambda c: ~dropped(c)))


def filter_by_text_value(df: DataFrame, prefix_to_text_values: Mapping[str, Sequence[str]] | None) -> DataFrame:
    """Keep rows of a configured category only when their text value is allowed; other categories stay."""
    if not prefix_to_text_values:
        return df
    prefix = text.first_part(F.col("code"))
    keep = ~prefix.isin(list(prefix_to_text_values))
    for name, allowed in prefix_to_text_values.items():
        allowed = [allowed] if isinstance(allowed, str) else list(allowed)
        keep = keep | ((prefix == name) & F.col("text_value").isin(allowed))
    return df.filter(keep)


def filter_null_values(df: DataFrame, prefixes: Sequence[str] | None = None) -> DataFrame:
    """Drop rows without any value, in the listed categories or everywhere."""
    present = [c for c in ("numeric_value", "text_value") if c in df.columns]
    if not present:
        return df
    has_value = F.coalesce(*(F.when(F.col(c).isNotNull(), True) for c in present), F.lit(False))
    if not prefixes:
        return df.filter(has_value)
    return df.filter(~text.first_part(F.col("code")).isin(list(prefixes)) | has_value)


def filter_codes(df: DataFrame, codes_to_remove: Sequence[str], is_prefix: bool = False) -> DataFrame:
    """Remove rows whose code is listed, or starts with a listed text."""
    code = F.col("code")
    hit = text.starts_with_any(code, codes_to_remove) if is_prefix else code.isin(list(codes_to_remove))
    return df.filter(~hit)


def drop_birth_rows(df: DataFrame, birth_prefix: str = "Birth") -> DataFrame:
    return df.filter(F.col("prefix") != birth_prefix)


def _rank(order: Sequence[str]) -> Column:
    """A sortable value for ascending order with nulls last."""
    return F.struct(*(part for c in order for part in (F.col(c).isNull(), F.col(c))))


def birth_times(df: DataFrame, birth_prefix: str = "Birth", order: Sequence[str] = ("time",)) -> DataFrame:
    """Time of each subject's first birth row, one row per subject, combined before the shuffle."""
    births = df.filter(F.col("prefix") == birth_prefix)
    return births.groupBy("subject_id").agg(F.min_by("time", _rank(order)).alias("birth_time"))


def with_ages(df: DataFrame) -> DataFrame:
    """Ages from `birth_time`, which is dropped."""
    birth, time = F.col("birth_time"), F.col("time")
    years = times.complete_years(birth, time)
    days = times.whole_days(times.add_years(birth, years), time)
    return df.withColumns({"age_year": years.cast("long"), "age_day": days.cast("long")}).drop("birth_time")


def calculate_age(
    events: DataFrame | Timeline,
    birth_prefix: str = "Birth",
    drop_birth_rows: bool = False,
    order: Sequence[str] = ("time",),
) -> DataFrame | Timeline:
    """Add complete years and days since the last birthday; subjects without a birth row get nulls.

    Given a plain table, birth times are aggregated and joined back. Given a timeline, whole keys take them from a window
    over the partitioning they already have (no second scan), and sliced keys have them attached slice by slice.
    """
    if not isinstance(events, Timeline):
        births = birth_times(events, birth_prefix, order)
        aged = with_ages(events.join(births, "subject_id", "left"))
        return aged.filter(F.col("prefix") != birth_prefix) if drop_birth_rows else aged

    def timed(part: Timeline) -> Timeline:
        if part.sliced:
            return part.attach(birth_times(part.df, birth_prefix, part.order))
        first = F.min_by("time", F.when(F.col("prefix") == birth_prefix, _rank(part.order)))
        return part.pipe(lambda df: df.withColumn("birth_time", first.over(Window.partitionBy("subject_id"))))

    aged = events.each(timed).pipe(with_ages)
    return aged.pipe(lambda df: df.filter(F.col("prefix") != birth_prefix)) if drop_birth_rows else aged


def priority(column: Column, prefixes: Sequence[str]) -> Column:
    """Position of the first listed text that `column` starts with; unmatched values come last."""
    hits = [F.when(column.startswith(p), F.lit(i)) for i, p in enumerate(prefixes)]
    return F.coalesce(*hits, F.lit(len(prefixes)))


EVENT_ORDER = ("time", "__priority", "code", "numeric_value", "text_value")


def order_events(
    df: DataFrame,
    prefixes: Sequence[str],
    column: str = "code",
    tie_breakers: Sequence[str] = (),
    layout: Layout | None = None,
) -> Timeline:
    """Order events per subject and number them in `event_seq`.

    Keys: time, priority of the category, code, number, text; ascending, nulls last. `layout` is given when it is
    known already.
    """
    if not prefixes:
        raise ValueError("prefixes must not be empty")
    ranked = df.withColumn("__priority", priority(F.col(column), prefixes))
    timeline = lay_out(ranked, ["subject_id"], EVENT_ORDER, layout, tie_breakers).numbered("event_seq")
    return timeline.pipe(lambda d: d.drop("__priority")).ordered_by("event_seq")


def globally_sorted(df: DataFrame, number: str | None = None) -> DataFrame:
    """One total order over all subjects, for output files; range-partitioned, so no subject is bound to one task.

    `number` names a column for the position of each row, from 1.
    """
    if number is not None:
        df = lay_out(df, [], ["subject_id", "event_seq"]).numbered(number).rows()
    return df.orderBy(F.col("subject_id").asc_nulls_last(), F.col("event_seq").asc_nulls_last())
