"""Small helpers that several operators use."""

from __future__ import annotations

import contextlib
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.plans.timeline import written
from eventloom.session import ARROW_ROWS, ROWS_AT_ONCE, small_batches

__all__ = ["ROWS_AT_ONCE", "absent", "arrow_rows", "complete_groups", "held_out", "read", "remainder", "small_batches", "spread", "text_of", "written"]

def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def remainder(id_col: str = "doc_id") -> Column:
    """The fold of a row: crc32 of its id as text, modulo 5. A row without id is in fold 0 of the empty text."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(0)) % 5


def held_out(fold: int, id_col: str = "doc_id") -> Column:
    return remainder(id_col) == fold


@contextlib.contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Hand at most `rows` rows at a time to Python in the jobs that run inside the block; the setting is restored after it."""
    before = spark.conf.get(ARROW_ROWS)
    spark.conf.set(ARROW_ROWS, str(rows))
    try:
        yield
    finally:
        spark.conf.set(ARROW_ROWS, before)


def text_of(text_col: str = "text") -> Column:
    return F.coalesce(F.col(text_col).cast("string"), F.lit(""))


def absent(df: DataFrame, name: str) -> str:
    """`name`, made longer until no column of `df` has it (column names ignore case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Deal the rows of each key to one task, keys in order within the task; groups must be bounded by construction."""
    return df.repartition(*keys).sortWithinPartitions(*keys)


def complete_groups(frames: Iterable[pd.DataFrame], keys: Sequence[str]) -> Iterator[pd.DataFrame]:
    """Regroup consecutive frames of key-ordered rows so that no key is cut by the end of a frame."""
    keys, kept = list(keys), None
    for frame in frames:
        if not len(frame):
            continue
        if kept is not None:
            frame = pd.concat([kept, frame], ignore_index=True)
        last = np.logical_and.reduce([(frame[k] == frame[k].iloc[-1]).to_numpy() for k in keys])
        cut = int(np.flatnonzero(~last)[-1]) + 1 if not last.all() else 0
        if cut:
            yield frame.iloc[:cut].reset_index(drop=True)
        kept = frame.iloc[cut:].reset_index(drop=True)
    if kept is not None and len(kept):
        yield kept
