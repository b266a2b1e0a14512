"""Steps on rows that keep an expression's cost in one place."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def computed_once(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """Add or replace columns like `withColumns`, for costly expressions that later filters or columns read.

    The optimizer moves filters below a projection and merges projections, and so repeats what they compute; it does neither
    with the elements of an array.
    """
    kept = [F.col(f"`{c}`") for c in df.columns if c not in columns]
    computed = F.inline(F.array(F.struct(*[value.alias(name) for name, value in columns.items()])))
    order = [*df.columns, *[name for name in columns if name not in df.columns]]
    return df.select(*kept, computed).select(*[F.col(f"`{c}`") for c in order])
