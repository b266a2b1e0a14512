"""Whitening of embeddings with Spark MLlib's distributed block matrices.

1. Every finite entry c becomes the whole number floor(1024 * c) + 100000. The rows are written once with a number, and the
   sums of the dimensions are added up exactly, in the tasks first.
2. The rows are numbered without gaps, centred, and cut into blocks of a BlockMatrix. Its transpose times itself is the
   scatter matrix. Products of blocks are added up over `SPLITS` groups of the long dimension first, so no task sees all blocks.
3. The scatter matrix, dimensions squared and nothing else, goes to the driver; `eigh` gives the components.
4. The BlockMatrix of the rows times the matrix of whitening components gives the projected rows, which meet their ids again
   by row number. The same product gives the covariance of the result, from which its distance to the identity is taken.

MLlib keeps the list of a matrix's blocks on the driver, so a matrix has at most `MOST_BLOCKS` blocks; a longer table is
several matrices (slabs of consecutive rows), whose scatter matrices are added up.

Nulls, ties, repeats: a vector that is null, empty, or holds a null or non-finite entry drops out, and so do vectors whose
entries pass 2**52 once scaled, and vectors that have not the most frequent length (the longest of equally frequent ones).
Repeated and null ids are rows like any other. `deviation` is null where it does not fit in 64 bits. A component without
variance (its eigenvalue is not above the rounding error of the largest) has a null `whitened` and no part in
`identity_error`, which is null when no component has variance. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import Matrices
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eventloom.llm.common import written

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
BLOCK_ROWS = 1_024  # of a block, at least
BLOCK_BYTES = 8 << 20  # of a block, at most, where that leaves it BLOCK_ROWS rows
MOST_BLOCKS = 20_000
SPLITS = 64  # groups of blocks whose products are added up before the groups are
_MOST = 2.0**52


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int]:
    """(index, vec_id, length, x array<bigint>) of the vectors that take part, written, and the length that counts.

    The index is the row's place in its task's part, plus the rows of all parts before it; there is one sum for each part.
    """
    c = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), c.alias("c"))
    fits = F.forall("c", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < _MOST / SCALE))
    whole = F.transform("c", lambda v: F.floor(v * SCALE).cast("bigint") + SHIFT)
    rows = rows.filter(F.col("c").isNotNull() & (F.size("c") > 0) & fits)
    rows = written(rows.select("vec_id", whole.alias("x"), F.size("c").alias("length"), F.monotonically_increasing_id().alias("uid")), "vectors")
    part = F.shiftright("uid", 33)
    counts = rows.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("rows"))
    before = F.sum("rows").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("part", F.coalesce(before, F.lit(0)).alias("start"))
    place = F.col("start") + F.col("uid") - F.shiftleft("part", 33)
    numbered = rows.withColumn("part", part).join(starts, "part").select(place.alias("index"), "vec_id", "length", "x")
    best = rows.groupBy("length").count().orderBy(F.desc("count"), F.desc("length")).first()
    return numbered, best.length if best else 0


def sums(rows: DataFrame) -> tuple[int, list[int]]:
    """The number of rows and the exact sum of each dimension; a task sends one row for each dimension."""

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, total = 0, None
        for frame in frames:
            if len(frame):
                x = np.stack(frame["x"].to_numpy())
                far = max(abs(int(x.min())), abs(int(x.max()))) * len(x) >= 1 << 62
                part = [int(v) for v in (x.astype(object) if far else x).sum(axis=0).tolist()]
                total = part if total is None else [a + b for a, b in zip(total, part, strict=True)]
                n += len(frame)
        if n:
            yield pd.DataFrame({"n": n, "dimension": range(len(total)), "total": [str(t) for t in total]})

    parts = rows.select("x").mapInPandas(add, "n bigint, dimension int, total string")
    found = parts.groupBy("dimension").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(28,0)")).alias("total")).orderBy("dimension").collect()
    return (found[0].n, [int(r.total) for r in found]) if found else (0, [])


def centred(rows: DataFrame, n: int, totals: list[int]) -> DataFrame:
    """(index, vec_id, deviation, z): z is x minus the mean, the deviation the exact sum of (n*x-S)^2."""

    @F.pandas_udf("deviation bigint, z array<double>")
    def centre(frames: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if not len(frame):
                yield pd.DataFrame({"deviation": [], "z": []}, dtype=object)
                continue
            x = np.stack(frame.to_numpy())
            far = max(abs(int(x.min())), abs(int(x.max()))) * n + max(map(abs, totals)) >= 1 << 62
            off = (x.astype(object) if far else x) * n - np.array(totals, object if far else np.int64)
            if far or (off.astype(float) ** 2).sum(axis=1).max() > 9e18:
                size = [d if d < 1 << 63 else None for d in (off.astype(object) ** 2).sum(axis=1).tolist()]
            else:
                size = (off**2).sum(axis=1).tolist()
            yield pd.DataFrame({"deviation": pd.Series(size, dtype=object), "z": list((off / n).astype(float))})

    return written(rows.select("index", "vec_id", centre("x").alias("c")).select("index", "vec_id", "c.deviation", "c.z"), "centred")


def block_rows(n: int, width: int) -> int:
    """Rows of a block: more for longer tables, but a block stays within BLOCK_BYTES or BLOCK_ROWS rows."""
    return max(BLOCK_ROWS, min(-(-n // MOST_BLOCKS), BLOCK_BYTES // (8 * width)))


def slabs(rows: DataFrame, n: int, width: int, column: str) -> Iterator[tuple[int, BlockMatrix]]:
    """The rows as block matrices of at most MOST_BLOCKS blocks each, every one a column of blocks, with their first index.

    An index that no row has is a row of zeros, which changes no product.
    """
    size = block_rows(n, width)
    step = size * MOST_BLOCKS
    for start in range(0, n, step):
        part = rows.filter(F.col("index").between(start, start + step - 1)) if n > step else rows
        part = part.select((F.col("index") - start).alias("index"), array_to_vector(column).alias("vector"))
        table = MLUtils.convertVectorColumnsFromML(part, "vector")
        yield start, IndexedRowMatrix(table, min(step, n - start), width).toBlockMatrix(size, width)


def gram(matrix: BlockMatrix) -> np.ndarray:
    """The transpose times the matrix. The blocks' products are added up in groups, so no task gets all blocks."""
    splits = max(1, min(SPLITS, -(-matrix.numRows() // matrix.rowsPerBlock)))
    wrapper = matrix.transpose()._java_matrix_wrapper
    product = wrapper.call("multiply", matrix._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(product, matrix.colsPerBlock, matrix.colsPerBlock).toLocalMatrix().toArray()


def whitening(covariance: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues, falling, and for those above rounding the matrix that projects and divides by the deviation."""
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    real = int((values > max(values[0], 0.0) * len(covariance) * np.finfo(float).eps).sum())
    return values, vectors[:, :real] / np.sqrt(values[:real])


def project(matrix: BlockMatrix, by: np.ndarray, start: int) -> DataFrame:
    """(index, y array<double>) of the matrix times a small one."""
    block = Matrices.dense(*by.shape, by.ravel(order="F").tolist())
    small = SparkSession.active().sparkContext.parallelize([((0, 0), block)], 1)
    rows = matrix.multiply(BlockMatrix(small, *by.shape)).toIndexedRowMatrix()
    made = callMLlibFunc("getIndexedRows", rows._java_matrix_wrapper._java_model)
    return made.select((F.col("index") + start).alias("index"), vector_to_array("vector").alias("y"))


def whiten(vectors: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """A row for each vector and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    spark = vectors.sparkSession
    rows, width = usable(vectors, id_col, vector_col)
    every = rows.count()
    rows = rows.filter(F.col("length") == width)
    n, totals = sums(rows)
    if not n:
        return spark.createDataFrame(
            [], "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
        )
    table = centred(rows, n, totals)
    covariance = sum(gram(m) for _, m in slabs(table, every, width, "z")) / n
    values, by = whitening(covariance, components)
    trace, real, error = float(np.trace(covariance)), by.shape[1], None
    if real:
        parts = [project(m, by, start) for start, m in slabs(table, every, width, "z")]
        projected = written(functools.reduce(DataFrame.union, parts), "projected")
        out = written(table.drop("z").join(projected, "index"), "whitened")
        means = out.agg(*[F.avg(F.element_at("y", i + 1)).alias(f"m{i}") for i in range(real)]).first()
        shift = F.array(*[F.lit(float(m)) for m in means])
        level = out.select("index", F.zip_with("y", shift, lambda y, m: y - m).alias("y"))
        again = sum(gram(m) for _, m in slabs(level, every, real, "y")) / n
        error = float(np.abs(again - np.eye(real)).max())
    else:
        out = table.select("*", F.array().cast("array<double>").alias("y")).drop("z")
    explained = [max(float(v), 0.0) / trace if trace > 0 else 0.0 for v in values]
    each = [
        F.struct(F.lit(i + 1).alias("component"), (F.element_at("y", i + 1) if i < real else F.lit(None).cast("double")).alias("whitened"), F.lit(e).alias("explained"))
        for i, e in enumerate(explained)
    ]
    return out.select("vec_id", "deviation", F.explode(F.array(*each)).alias("c")).select(
        "vec_id", "c.component", F.lit(n).cast("bigint").alias("n"), "deviation", "c.whitened", "c.explained",
        F.lit(error).cast("double").alias("identity_error"),
    )
