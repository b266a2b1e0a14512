"""Raw tables to one long event table, subject splits, and code metadata."""

from __future__ import annotations

import functools
import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.functions import numbers, times
from eventloom.plans.timeline import Run, join_measured, lay_out, written

UNKNOWN = "UNK"
SPECIAL_KEYS = {"code", "time", "time_format", "numeric_value", "text_value"}
EVENT_TYPES = {
    "subject_id": "bigint",
    "time": "timestamp_ntz",
    "code": "string",
    "numeric_value": "double",
    "text_value": "string",
}


def column_name(spec: str) -> str | None:
    """The column named by `col(x)`, or None for a literal."""
    found = re.fullmatch(r"col\((.+)\)", spec)
    return found.group(1) if found else None


def code_column(parts: str | Sequence[str]) -> Column:
    """Literals and columns joined by `//`; a null part is shown as UNK."""
    parts = [parts] if isinstance(parts, str) else parts
    columns = []
    for part in parts:
        name = column_name(part)
        columns.append(F.lit(part) if name is None else F.coalesce(F.col(name).cast("string"), F.lit(UNKNOWN)))
    return F.concat_ws("//", *columns)


def time_column(df: DataFrame, spec: Mapping) -> Column:
    source = spec.get("time")
    if source is None:
        return F.lit(None).cast("timestamp_ntz")
    name = column_name(source)
    kind = df.schema[name].dataType.typeName()
    if kind in ("timestamp", "timestamp_ntz", "date"):
        return F.col(name).cast("timestamp_ntz")
    formats = spec.get("time_format")
    formats = [formats] if isinstance(formats, str) else formats
    if not formats:
        return F.col(name).try_cast("timestamp_ntz")
    return times.parse_time(F.col(name).cast("string"), list(formats))


def event_struct(df: DataFrame, spec: Mapping, extras: Mapping[str, str]) -> Column:
    """One event of a row; `extras` are the pass-through columns of all events of the table with their types."""

    def source(key: str) -> str | None:
        return None if spec.get(key) is None else column_name(spec[key]) or spec[key]

    number, text = source("numeric_value"), source("text_value")
    passed = []
    for name, kind in extras.items():
        value = F.col(source(name)) if name in spec else F.lit(None).cast(kind)
        passed.append(value.alias(name))
    return F.struct(
        time_column(df, spec).alias("time"),
        code_column(spec["code"]).alias("code"),
        (F.lit(None).cast("double") if number is None else numbers.as_double(df, number)).alias("numeric_value"),
        (F.lit(None) if text is None else F.col(text)).cast("string").alias("text_value"),
        *passed,
        F.lit(spec.get("time") is None).alias("__static"),
    )


def extract_table(df: DataFrame, events: Mapping[str, Mapping], subject_id: str = "subject_id") -> DataFrame:
    """All events of one table. A row yields an array of events that is flattened in place, so the table, with
    whatever joins prepared it, is computed once however many events it has. Events with an unusable time are dropped.
    """
    extras = {}
    for spec in events.values():
        for name, source in spec.items():
            if name not in SPECIAL_KEYS:
                extras[name] = df.schema[column_name(source) or source].dataType.simpleString()
    entries = F.array(*(event_struct(df, spec, extras) for spec in events.values()))
    subject = F.col(subject_id).cast("bigint").alias("subject_id")
    rows = df.select(subject, F.inline(entries))
    return rows.filter(F.col("time").isNotNull() | F.col("__static")).drop("__static")


def columns_read(config: Mapping[str, Mapping[str, Mapping]]) -> dict[str, set[str]]:
    """The columns of each configured table that its events read."""
    read = {}
    for name, events in config.items():
        if name == "subject_id_col":
            continue
        read[name] = {config.get("subject_id_col", "subject_id")}
        for spec in events.values():
            parts = [spec["code"]] if isinstance(spec["code"], str) else spec["code"]
            read[name] |= {found for part in parts if (found := column_name(part))}
            read[name] |= {column_name(v) or v for k, v in spec.items() if k not in ("code", "time_format") and v is not None}
    return read


def union_by_name(frames: Sequence[DataFrame]) -> DataFrame:
    return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def extract_events(
    tables: Mapping[str, DataFrame], config: Mapping[str, Mapping[str, Mapping]], dedup: bool = False
) -> DataFrame:
    """All events of all configured tables that are present; one scan per table, nothing shuffled unless `dedup`."""
    config = dict(config)
    subject = config.pop("subject_id_col", "subject_id")
    present = [name for name in config if name in tables]
    frames = [extract_table(tables[name], config[name], subject) for name in present]
    if not frames:
        raise ValueError("no configured table is present")
    events = union_by_name(frames)
    return events.distinct() if dedup else events


def split_subjects(
    df: DataFrame,
    fractions: Mapping[str, float | None],
    n_subjects_per_shard: int = 20_000,
    seed: int = 0,
) -> DataFrame:
    """Split and shard of every subject: one row per subject, the same for the same seed.

    Subjects are ordered by a seeded hash; cumulative fractions of that order give the splits. The order is global, so
    it is computed over slices when there are many subjects.
    """
    subjects = written(df.select("subject_id").distinct(), "subjects")
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("subject_id").cast("string")))
    ranked = lay_out(subjects.withColumn("__hash", key), [], ["__hash", "subject_id"]).numbered("__rank").rows()
    total = subjects.agg(F.count(F.lit(1)).alias("n")).scalar()
    present = {name: f for name, f in fractions.items() if f is not None}
    split, start, bound = F.lit(None).cast("string"), F.lit(None).cast("bigint"), 0.0
    lower = F.lit(0).cast("bigint")
    for i, (name, fraction) in enumerate(present.items()):
        bound += fraction
        upper = total if i == len(present) - 1 and abs(bound - 1) < 1e-9 else F.round(F.lit(bound) * total).cast("bigint")
        inside = (F.col("__rank") > lower) & (F.col("__rank") <= upper)
        split, start, lower = F.when(inside, F.lit(name)).otherwise(split), F.when(inside, lower).otherwise(start), upper
    shard = F.floor((F.col("__rank") - start - 1) / n_subjects_per_shard).cast("bigint")
    placed = ranked.select("subject_id", split.alias("split"), shard.alias("shard"))
    return placed.filter(F.col("split").isNotNull())


def with_splits(df: DataFrame, splits: DataFrame) -> DataFrame:
    """Tag rows with their subject's split and shard; subjects outside every split are left out."""
    return df.join(splits, "subject_id", "inner")


def finalise_events(df: DataFrame) -> DataFrame:
    """The event schema, extra columns after it."""
    known = [F.col(c).cast(t).alias(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in EVENT_TYPES.items()]
    return df.select(*known, *[c for c in df.columns if c not in EVENT_TYPES])


def merge_cohort(df: DataFrame, splits: DataFrame, order: Sequence[str] = ("time", "code"), number: str = "row") -> DataFrame:
    """All events with split and shard, each shard's rows together, in order and numbered, ready to be written per shard.

    Rows are ordered within their shard only, by subject, `order` and then all other columns. A shard with too many rows
    for a task is divided into ranges of that order.
    """
    first = ["subject_id", *order]
    rest = [c for c in df.columns if c not in first]  # ties by all other columns, so that the order is total
    return lay_out(with_splits(df, splits), ["split", "shard"], [*first, *rest]).numbered(number).gather(
        lambda part: part.sortWithinPartitions("split", "shard", number)
    )


def code_metadata(df: DataFrame) -> DataFrame:
    """One row per code with counts and the time span in which it occurs."""
    return df.groupBy("code").agg(
        F.count(F.lit(1)).alias("n_events"),
        F.count("numeric_value").alias("n_numeric"),
        F.min("time").alias("first_time"),
        F.max("time").alias("last_time"),
    )


def dataset_metadata(df: DataFrame, name: str, version: str) -> DataFrame:
    """A one-row description of a finished event table."""
    return df.agg(
        F.count(F.lit(1)).alias("n_events"),
        F.count_distinct("subject_id").alias("n_subjects"),
        F.count_distinct("code").alias("n_codes"),
        F.min("time").alias("first_time"),
        F.max("time").alias("last_time"),
    ).select(F.lit(name).alias("dataset_name"), F.lit(version).alias("dataset_version"), "*")


def vocabulary(df: DataFrame) -> DataFrame:
    """Integer ids by falling frequency, then code. Written once, it is the frozen vocabulary of later runs."""
    counts = written(df.filter(F.col("code").isNotNull()).groupBy("code").agg(F.count(F.lit(1)).alias("n")), "codes")
    ranked = lay_out(counts, [], ["-n", "code"]).run(__id=Run("count")).rows()
    return ranked.select("code", (F.col("__id") - 1).alias("code_id"), "n")


def map_codes(df: DataFrame, vocab: DataFrame) -> DataFrame:
    """Add `code_id`; codes outside the vocabulary get null.

    The vocabulary is stored and measured, so that events are not dealt by their code unless it is very large.
    """
    return join_measured(df, vocab.select("code", "code_id"), "code")
