"""Joins of long tables with lookups too large to broadcast, dealt by their keys through column files.

A shuffle writes rows one by one, so it takes several times the room that the same columns take in Parquet, and a union of
many such joins keeps all their shuffles until it ends. Here both sides are written once as tables bucketed by the key: a
join then reads bucket beside bucket and shuffles nothing.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.plans.timeline import BROADCAST_ROWS, max_rows_per_key, run_folder

STORED_ROWS_CONF = "spark.eventloom.storedJoinRows"
DEFAULT_STORED_ROWS = 5_000_000  # tables with fewer rows are left to the planner
BUCKET_ROWS = 2_000_000
LEAST_BUCKET_ROWS = 500_000  # where more buckets would only serve more cores
FREQUENT_KEYS = 1_000  # fewer keys than that are frequent, as each has more than one row in so many
HASH_PARTS = 16_384  # by which keys are counted first, many more than frequent keys
KEY_TYPES = {"tinyint", "smallint", "int", "bigint", "string", "date"}  # equal values have equal hashes


def _any(conditions: Sequence[Column]) -> Column:
    return functools.reduce(Column.__or__, conditions)


def broadcast_by_planner(lookup: DataFrame) -> bool:
    """Whether the planner's estimate of the lookup is within the session's broadcast threshold."""
    bound = lookup.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return int(str(lookup._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= bound


def bucketed(df: DataFrame, by: Sequence[str], buckets: int, label: str) -> DataFrame:
    """Write `df` to the shared folder in buckets of `by` and read it back. The catalog keeps no trace of it."""
    spark, name = df.sparkSession, f"{label}_{uuid.uuid4().hex}"
    table = f"spark_catalog.default.eventloom_{name}"
    writer = df.coalesce(buckets).write.format("parquet").option("compression", "zstd").bucketBy(buckets, *by)
    writer.option("path", f"{run_folder(spark)}/{name}").saveAsTable(table)
    stored = spark.table(table)
    spark.sql(f"DROP TABLE {table}")  # its files lie outside the warehouse and stay
    return stored


def buckets_for(spark: SparkSession, rows: int) -> int:
    wide = min(spark.sparkContext.defaultParallelism, -(-rows // LEAST_BUCKET_ROWS))
    return max(-(-rows // BUCKET_ROWS), wide, 1)


def frequent_keys(keys: DataFrame, on: Sequence[str]) -> tuple[int, int, list[int]]:
    """Rows, rows without a key, and the hashes of all keys with more rows than a task should hold.

    Counts by a remainder of the hash first, of which a frequent key fills one; keys are counted in such remainders only.
    """
    hashed = keys.select(F.xxhash64(*on).alias("key"), _any([F.col(c).isNull() for c in on]).alias("absent"))
    dealt = hashed.withColumn("part", F.pmod("key", F.lit(HASH_PARTS)))
    parts = dealt.groupBy("part").agg(F.count(F.lit(1)).alias("rows"), F.count(F.when(F.col("absent"), 1)).alias("absent")).collect()
    rows, absent = sum(p.rows for p in parts), sum(p.absent for p in parts)
    bound = max(max_rows_per_key(keys.sparkSession), rows // FREQUENT_KEYS)
    full = [p.part for p in parts if p.rows - p.absent > bound]
    if not full:
        return rows, absent, []
    counts = dealt.filter(~F.col("absent") & F.col("part").isin(full)).groupBy("key").agg(F.count(F.lit(1)).alias("rows"))
    return rows, absent, [x.key for x in counts.filter(F.col("rows") > bound).collect()]


def join_lookup(df: DataFrame, lookup: DataFrame, on: Sequence[str], keys: DataFrame | None = None) -> DataFrame:
    """Left join like `df.join(lookup, on, "left")`; keys may repeat on both sides.

    Left to the planner when it broadcasts the lookup or `df` is short (`spark.eventloom.storedJoinRows`). Otherwise both
    sides are stored in buckets of the key. Rows of frequent keys, and those without a key if there are many, stay out of
    the buckets and get the lookup's rows for these keys by broadcast. `df` is stored with all its columns, so only those that
    are read should be left in it. `keys` is a table with about the keys of `df` that is cheaper to read.
    """
    on, spark = list(on), df.sparkSession
    plain = df.join(lookup, on, "left")
    kinds, dealt = dict(df.dtypes), dict(lookup.dtypes)
    storable = len({c.lower() for c in df.columns}) == len(df.columns) and "void" not in kinds.values()
    if broadcast_by_planner(lookup) or not storable or any(kinds[c] != dealt[c] or kinds[c] not in KEY_TYPES for c in on):
        return plain
    keys = (df if keys is None else keys).select(*on)
    if keys.count() < int(spark.conf.get(STORED_ROWS_CONF, str(DEFAULT_STORED_ROWS))):
        return plain
    rows, absent, frequent = frequent_keys(keys, on)
    known = lookup.dropna(subset=on)  # null keys match nothing
    few = known.filter(F.xxhash64(*on).isin(frequent))
    if frequent and few.count() > BROADCAST_ROWS:
        return plain
    kept = [F.xxhash64(*on).isin(frequent)] if frequent else []
    if absent > max_rows_per_key(spark):
        kept += [F.col(c).isNull() for c in on]
    stays = _any(kept) if kept else None
    n = buckets_for(spark, rows)
    moving = bucketed(df if stays is None else df.filter(~stays), on, n, "rows")
    joined = moving.join(bucketed(known, on, n, "lookup").hint("merge"), on, "left")
    return joined if stays is None else joined.union(df.filter(stays).join(F.broadcast(few), on, "left"))
