"""Ordered, per-key computation that survives keys of any size.

A plain window over ``partitionBy(key)`` puts every row of a key in one task. That is the best plan while keys are
small, and it fails when one key holds a large share of the table. A `Timeline` keeps the two kinds of keys apart:

* **whole keys**: nothing is added; windows partition by the key alone, one hash exchange.
* **sliced keys**, the few with more rows than `spark.eventloom.maxRowsPerKey`: their rows are range-partitioned on (key,
  order columns), written once to the shared scratch folder, and every row remembers the number of its partition (`SLICE`).
  Windows then run per (key, slice), so a task never holds more than one range partition of a key, and the running state is
  carried from slice to slice.

One hot key therefore changes nothing for all others: they are neither written nor range-partitioned, and the results of
both parts are put together at the end. A computation without key (a global ranking) is sliced as a whole when it is large.

The carry is small by construction: in range order a slice can continue at most one key from the slice before it, so the
table of carries has at most one row per slice. That bound is what makes broadcasting it safe.
"""

from __future__ import annotations

import atexit
import functools
import shutil
import tempfile
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SLICE = "__slice"
MAX_ROWS_CONF = "spark.eventloom.maxRowsPerKey"
SLICE_ROWS_CONF = "spark.eventloom.rowsPerSlice"
DEFAULT_MAX_ROWS = 200_000
DEFAULT_SLICE_ROWS = 4_000_000
BROADCAST_ROWS = 500_000  # of a measured lookup with a key and a few values


def max_rows_per_key(spark: SparkSession) -> int:
    return int(spark.conf.get(MAX_ROWS_CONF, str(DEFAULT_MAX_ROWS)))


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for cut lineage: the cluster's `spark.checkpoint.dir`, else a local one in local mode only."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    return _local_scratch()


@functools.cache
def _local_scratch() -> str:
    folder = tempfile.mkdtemp(prefix="eventloom-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def run_folder(spark: SparkSession) -> str:
    """The folder in the shared one that holds this application's tables; delete it when the run is over."""
    return f"{scratch_dir(spark)}/eventloom-{spark.sparkContext.applicationId}"


def written(df: DataFrame, label: str) -> DataFrame:
    """Write `df` to the shared folder and read it back: cuts lineage, survives executor loss, keeps column pruning."""
    spark = df.sparkSession
    path = f"{run_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def join_measured(df: DataFrame, lookup: DataFrame, on: str) -> DataFrame:
    """Left join with a lookup of one row per key, whose estimate the planner may get wrong.

    The lookup is stored and its rows are counted. Up to BROADCAST_ROWS it is broadcast, so a skewed key of `df` is never
    shuffled. A larger one is split by the keys of `df`: the lookup's rows for the frequent keys, those with more rows than
    a task should hold, are broadcast to the rows of these keys, which stay where they are, and only the other rows are
    shuffled by their key. Frequent keys are few, as each stands for many rows; rows without a key are not shuffled either.
    """
    stored = written(lookup, "lookup")
    if stored.count() <= BROADCAST_ROWS:
        return df.join(F.broadcast(stored), on, "left")
    bound = max_rows_per_key(df.sparkSession)
    counts = df.filter(F.col(on).isNotNull()).groupBy(on).agg(F.count(F.lit(1)).alias("__n"))
    frequent = written(counts.filter(F.col("__n") > bound).select(on, F.lit(True).alias("__frequent")), "frequent-keys")
    if frequent.count() > BROADCAST_ROWS:  # so many that no key holds much of the table: adaptive execution splits partitions
        return df.join(stored, on, "left")
    told = df.join(F.broadcast(frequent), on, "left")
    stays = F.col("__frequent").isNotNull() | F.col(on).isNull()
    few = stored.join(F.broadcast(frequent.select(on)), on, "left_semi")
    staying = told.filter(stays).drop("__frequent").join(F.broadcast(few), on, "left")
    moving = told.filter(~stays).drop("__frequent").join(stored.hint("shuffle_merge"), on, "left")
    return staying.unionByName(moving)


@dataclass(frozen=True)
class Layout:
    """How rows are laid out: the number of slices, and the keys that are sliced (None: all rows)."""

    slices: int = 0
    hot: DataFrame | None = None


def layout_of(df: DataFrame, by: Sequence[str]) -> Layout:
    """The layout that a table needs: no slices when every key fits one task.

    Reads only the key columns and counts before the shuffle; two numbers reach the driver. Hot keys, of which there are
    at most as many as the rows divided by the bound, are stored as a table.
    """
    spark, bound = df.sparkSession, max_rows_per_key(df.sparkSession)
    if by:
        counts = df.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"))
        rows = counts.agg(F.sum(F.when(F.col("__n") > bound, F.col("__n")))).first()[0] or 0
    else:
        rows = df.count()
        rows = rows if rows > bound else 0
    if not rows:
        return Layout()
    size = int(spark.conf.get(SLICE_ROWS_CONF, str(DEFAULT_SLICE_ROWS)))
    slices = max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), -(-rows // size))
    return Layout(slices, written(counts.filter(F.col("__n") > bound).select(*by), "hot-keys") if by else None)


def _hot_and_rest(df: DataFrame, by: Sequence[str], hot: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of hot keys and all other rows; a null key may be hot as well."""
    keys = hot.select(*[F.col(c).alias(f"__hot_{c}") for c in by])
    keys = F.broadcast(keys) if hot.count() <= BROADCAST_ROWS else keys
    same = functools.reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"__hot_{c}")) for c in by])
    return df.join(keys, same, "left_semi"), df.join(keys, same, "left_anti")


def sort_keys(order: Sequence[str], reverse: bool = False) -> list[Column]:
    """Ascending with nulls last, `-name` for descending with nulls last; `reverse` flips the whole order."""
    keys = []
    for item in order:
        col = F.col(item.lstrip("-"))
        if item.startswith("-"):
            keys.append(col.asc_nulls_first() if reverse else col.desc_nulls_last())
        else:
            keys.append(col.desc_nulls_first() if reverse else col.asc_nulls_last())
    return keys


@dataclass(frozen=True)
class Run:
    """One running column: `how` over `value` from the start of the key to the current row.

    `how` is sum, count, min, max, last (most recent non-null value) or lag (the previous row's value, null or not).
    `strict` leaves the current row out.
    """

    how: str
    value: Column | None = None
    strict: bool = False


@dataclass(frozen=True)
class Timeline:
    """Rows in a layout. `hot` holds the rows of sliced keys when `df` holds those of whole keys."""

    df: DataFrame
    by: tuple[str, ...]
    order: tuple[str, ...]
    sliced: bool
    hot: Timeline | None = None

    def each(self, fn: Callable[[Timeline], Timeline]) -> Timeline:
        """Apply `fn` to the whole keys and to the sliced keys, each a timeline of one layout."""
        if self.hot is None:
            return fn(self)
        return replace(fn(replace(self, hot=None)), hot=fn(self.hot))

    def pipe(self, fn: Callable[[DataFrame], DataFrame]) -> Timeline:
        """Apply a row-wise step that keeps the key, order and slice columns."""
        return self.each(lambda part: replace(part, df=fn(part.df)))

    def pipe_whole(self, fn: Callable[[DataFrame], DataFrame]) -> Timeline:
        """Apply a step that brings the rows of a key together, such as a join by key, to the whole keys only."""
        return self if self.sliced else replace(self, df=fn(self.df))

    def ordered_by(self, *order: str) -> Timeline:
        """The same rows in the same order, which `order` now names."""
        return self.each(lambda part: replace(part, order=order))

    def parts(self) -> list[DataFrame]:
        """The rows of whole keys and those of sliced keys, as far as there are any, without the bookkeeping column."""
        return [self.df.drop(SLICE), *(self.hot.parts() if self.hot else [])]

    def gather(self, fn: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """The union of `fn` over the parts; for aggregates whose groups lie within a key."""
        return functools.reduce(DataFrame.unionByName, map(fn, self.parts()))

    @property
    def cluster(self) -> list[str]:
        """The columns that name a bounded group of rows."""
        return [*self.by, SLICE] if self.sliced else list(self.by)

    def window(self, reverse: bool = False):
        spec = Window.partitionBy(*self.cluster) if self.cluster else Window
        return spec.orderBy(*sort_keys(self.order, reverse))

    def rows(self) -> DataFrame:
        """All rows without the bookkeeping column."""
        return self.gather(lambda df: df)

    def sizes(self) -> DataFrame:
        """Every (key, slice) that occurs; one row per key plus at most one per slice."""
        return self.df.select(*self.cluster).distinct()

    def run(self, reverse: bool = False, **runs: Run) -> Timeline:
        """Add running columns."""
        return self.each(lambda part: part._run(reverse, runs))

    def _run(self, reverse: bool, runs: dict[str, Run]) -> Timeline:
        window = self.window(reverse)
        frame = window.rowsBetween(Window.unboundedPreceding, 0)
        before = window.rowsBetween(Window.unboundedPreceding, -1)
        local = {}
        for name, run in runs.items():
            over = before if run.strict else frame
            if run.how == "lag":
                local[name] = F.lag(run.value, 1).over(window)
            elif run.how == "last":
                local[name] = F.last(run.value, ignorenulls=True).over(over)
            elif run.how == "count":
                local[name] = F.count(F.lit(1) if run.value is None else run.value).over(over)
            else:
                local[name] = getattr(F, run.how)(run.value).over(over)
        if not self.sliced:
            return replace(self, df=self.df.withColumns(local))

        kept = {f"__v_{name}": run.value for name, run in runs.items() if run.value is not None}
        numbered = self.df.withColumns({**kept, **local, "__at": F.row_number().over(window)})
        carries = self._carries(numbered, runs, reverse)
        null_safe = [numbered[c].eqNullSafe(carries[f"__k_{c}"]) for c in self.cluster]
        joined = numbered.join(F.broadcast(carries), null_safe, "left")
        out = [F.col(f"`{c}`") for c in self.df.columns if c not in runs]
        for name, run in runs.items():
            here, carry = F.col(name), F.col(f"__c_{name}")
            if run.how == "lag":
                value = F.when(F.col("__at") == 1, carry).otherwise(here)
            elif run.how == "last":
                value = F.coalesce(here, carry)
            elif run.how == "count":
                value = here + F.coalesce(carry, F.lit(0))
            elif run.how == "sum":
                value = F.coalesce(here + carry, here, carry)
            elif run.how == "min":
                value = F.least(here, carry)
            else:
                value = F.greatest(here, carry)
            out.append(value.alias(name))
        return replace(self, df=joined.select(*out))

    def _carries(self, numbered: DataFrame, runs: dict[str, Run], reverse: bool) -> DataFrame:
        """For each slice that continues a key, the state at the end of the key's earlier slices."""
        totals = []
        for name, run in runs.items():
            value = F.col(f"__v_{name}") if run.value is not None else F.lit(1)
            if run.how == "lag":
                total = F.max_by(value, F.col("__at"))
            elif run.how == "last":
                total = F.max_by(value, F.when(value.isNotNull(), F.col("__at")))
            elif run.how == "count":
                total = F.count(value)
            else:
                total = getattr(F, run.how)(value)
            totals.append(total.alias(name))
        per_slice = numbered.groupBy(*self.cluster).agg(*totals)
        spec = Window.partitionBy(*self.by) if self.by else Window
        earlier = spec.orderBy(F.col(SLICE).desc() if reverse else F.col(SLICE).asc())
        span = earlier.rowsBetween(Window.unboundedPreceding, -1)
        carried = []
        for name, run in runs.items():
            if run.how == "lag":
                state = F.lag(name, 1).over(earlier)
            elif run.how == "last":
                state = F.last(name, ignorenulls=True).over(span)
            elif run.how in ("sum", "count"):
                state = F.sum(name).over(span)
            else:
                state = getattr(F, run.how)(name).over(span)
            carried.append(state.alias(f"__c_{name}"))
        keys = [F.col(c).alias(f"__k_{c}") for c in self.cluster]
        ranked = per_slice.select(*keys, *carried, F.row_number().over(earlier).alias("__rank"))
        return ranked.filter("__rank > 1").drop("__rank")

    def numbered(self, name: str = "event_seq") -> Timeline:
        """Dense 1-based position of each row within its key."""
        return self.run(**{name: Run("count")})

    def attach(self, per_key: DataFrame) -> Timeline:
        """Left-join a table with one row per key. Sliced keys are joined slice by slice, never in one task."""
        if not self.by:
            raise ValueError("attach needs a keyed timeline")
        return self.each(lambda part: part._attach(per_key))

    def _attach(self, per_key: DataFrame) -> Timeline:
        if not self.sliced:
            return replace(self, df=self.df.join(per_key, list(self.by), "left"))
        spread = self.sizes().join(per_key, list(self.by), "inner")
        return replace(self, df=self.df.join(spread, self.cluster, "left"))


def lay_out(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    layout: Layout | None = None,
    tie_breakers: Sequence[str] = (),
) -> Timeline:
    """Arrange `df` for ordered computation per key.

    `layout=None` decides from the sizes of the keys; a known layout of the same keys can be given. `tie_breakers` are
    appended to the order so that equal rows may be spread over slices as well. With hot keys `df` is read for their rows
    and for the others, so an expensive one should be stored before.
    """
    by, order = tuple(by), tuple(order) + tuple(tie_breakers)
    if layout is None:
        layout = layout_of(df, by)
    if not layout.slices:
        return Timeline(df, by, order, False)
    few, rest = _hot_and_rest(df, by, layout.hot) if layout.hot is not None else (df, None)
    keys = [*(F.col(c).asc_nulls_last() for c in by), *sort_keys(order)]
    placed = few.repartitionByRange(layout.slices, *keys).withColumn(SLICE, F.spark_partition_id())
    sliced = Timeline(written(placed, "slices"), by, order, True)
    return sliced if rest is None else Timeline(rest, by, order, False, sliced)
