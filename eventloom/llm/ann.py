"""Nearest neighbours by an inverted multi-index.

The two halves of a vector are quantised apart, each to the nearest of `k` centroids that Spark's k-means fits on a bounded
sample; a pair of centroids is a cell. For a query the cells are visited in the order of the summed distance of its halves
to the two centroids (the negative inner product), from the best pair outwards with a heap, until they hold `share` of all
vectors. The entries of the visited cells are ranked by their exact inner product.

How large a share the data need is measured when it is not given: the true neighbours of a bounded sample of queries are
found by comparing them with all vectors, and the share is what holds `recall` of these neighbours on the queries' own paths.
Clustered vectors need few cells, isotropic ones most.

Vectors with the same first centroid form a shelf. Shelves are divided into blocks of bounded size and the queries into
blocks of bounded size; every (shelf block, query block) is one unit of work and gives each query's best few. So a cell that
holds a third of all vectors, or any number of queries, is spread over many tasks.

Nulls, ties, repeats: a row without id, and a vector that is null, zero, empty, or holds null or non-finite components takes no
part, nor does one that has not the most frequent length (the longest of equally frequent ones). Every row is a query or
candidate of its own, also when its id is repeated: a query leaves out its own row only, and rows that share its id are
found like any others. Equal scores are ranked by id. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.llm.common import written

SAMPLE_ROWS = 20_000  # vectors that the centroids are fitted on, at most
RECALL = 0.95  # of the sampled queries' neighbours that the share must hold
SAMPLE_QUERIES = 200  # queries that the share is measured with, at most
BLOCK = 8_192
QUERY_BLOCK = 4_096


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(row, vec_id, vec array<double>), stored: rows with an id, without null, zero, or non-finite vectors, of the most frequent length.

    Of equally frequent lengths the longest counts.
    """
    vec = F.col(vector_col).cast("array<double>")
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), vec.alias("vec"))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("vec").isNotNull() & finite & F.exists("vec", lambda x: x != 0))
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "ann-vectors")
    lengths = rows.groupBy(F.size("vec").alias("length")).count().orderBy(F.desc("count"), F.desc("length")).first()
    return rows.filter(F.size("vec") == (lengths.length if lengths else 0))


def fit(rows: DataFrame, n: int, centroids: int | None = None) -> list[np.ndarray]:
    """The centroids of both halves: by default 2 * n ** 0.25 of each, so that there are some 4 * sqrt(n) cells."""
    length = len(rows.first().vec)
    k = max(1, min(n, round(2 * n**0.25) if centroids is None else centroids)) if length > 1 else 1
    sample = rows.select("vec").orderBy(F.xxhash64("row")).limit(SAMPLE_ROWS) if n > SAMPLE_ROWS else rows.select("vec")
    sample = written(sample.repartition(8), "ann-sample")
    cut = length // 2
    halves = [F.slice("vec", 1, cut), F.slice("vec", cut + 1, 1 << 30)]
    out = []
    for half in halves:
        if k < 2:
            out.append(np.array([sample.select(half.alias("half")).first().half]))
            continue
        data = sample.select(array_to_vector(half).alias("features"))
        out.append(np.array(KMeans(k=k, maxIter=10, seed=11, initMode="random").fit(data).clusterCenters()))
    return out


def nearest(half: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.argmin((centroids**2).sum(axis=1) - 2 * half @ centroids.T, axis=1)


def traverse(one: np.ndarray, two: np.ndarray, sizes: np.ndarray, wanted: int) -> dict[int, list[int]]:
    """Visit pairs (i, j) in ascending order of one[i] + two[j] until the visited cells hold `wanted` entries: {i: [j, ...]}."""
    first, second = np.argsort(one, kind="stable"), np.argsort(two, kind="stable")
    heap, held, out = [(one[first[0]] + two[second[0]], 0, 0)], 0, {}
    while heap and held < wanted:
        _, a, b = heapq.heappop(heap)
        i, j = int(first[a]), int(second[b])
        if sizes[i, j]:
            out.setdefault(i, []).append(j)
            held += int(sizes[i, j])
        if b + 1 < len(second):
            heapq.heappush(heap, (one[i] + two[second[b + 1]], a, b + 1))
        if b == 0 and a + 1 < len(first):
            heapq.heappush(heap, (one[first[a + 1]] + two[second[0]], a + 1, 0))
    return out


_FOUND = "query bigint, query_id bigint, vec_id bigint, score double"


def best(queries: pd.DataFrame, entries: pd.DataFrame, top: int) -> pd.DataFrame:
    """The `top` entries of each query among the cells that it visits, by exact inner product, ties to the smaller id."""
    if not len(queries) or not len(entries):
        return pd.DataFrame({"query": [], "query_id": [], "vec_id": [], "score": []}).astype({"query": "int64", "query_id": "int64", "vec_id": "int64", "score": "float64"})
    ids, numbers, cells = entries["vec_id"].to_numpy(), entries["row"].to_numpy(), entries["two"].to_numpy()
    vectors = np.stack(entries["vec"].to_numpy())
    made = []
    for a in range(0, len(queries), 256):
        part = queries.iloc[a : a + 256]
        asked = np.stack(part["vec"].to_numpy())
        visited = np.zeros((len(part), int(cells.max()) + 1), bool)
        for n, cols in enumerate(part["cells"]):
            visited[n, [c for c in cols if c < visited.shape[1]]] = True
        scores = np.where(visited[:, cells], asked @ vectors.T, -np.inf)
        for n, (number, own) in enumerate(zip(part["row"].tolist(), part["vec_id"].tolist(), strict=True)):
            row = scores[n]
            row[numbers == number] = -np.inf
            if len(row) > top:
                least = np.partition(row, -top)[-top]
                keep = np.flatnonzero((row >= least - 1e-9 * (1 + abs(least))) & np.isfinite(row)) if np.isfinite(least) else np.flatnonzero(np.isfinite(row))
            else:
                keep = np.flatnonzero(np.isfinite(row))
            exact = (vectors[keep] * asked[n]).sum(axis=1)  # one order of summation, so equal vectors tie exactly
            order = np.lexsort((ids[keep], -exact))[:top]
            made.append((np.full(len(order), number), np.full(len(order), own), ids[keep][order], exact[order]))
    columns = ["query", "query_id", "vec_id", "score"]
    return pd.DataFrame({c: np.concatenate([m[i] for m in made]) for i, c in enumerate(columns)})


def needed_share(index: DataFrame, asked: DataFrame, centers: list[np.ndarray], sizes: np.ndarray, top: int, recall: float, queries: int) -> float:
    """The share of all vectors that the paths of sampled queries must hold for `recall` of their true neighbours."""
    sample = asked.orderBy(F.xxhash64("row")).limit(queries).select("row", "vec").collect()
    if not sample:
        return 1.0
    vecs, own, cut = np.array([r.vec for r in sample]), np.array([r.row for r in sample]), len(centers[0][0])

    def nearest_here(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if not len(frame):
                continue
            scores = vecs @ np.stack(frame["vec"].to_numpy()).T
            scores[frame["row"].to_numpy()[None, :] == own[:, None]] = -np.inf
            few = min(top, len(frame))
            at = np.argpartition(-scores, few - 1, axis=1)[:, :few]
            query = np.repeat(np.arange(len(vecs)), few)
            value = np.take_along_axis(scores, at, axis=1).ravel()
            at = at.ravel()[np.isfinite(value)]
            yield pd.DataFrame({
                "query": query[np.isfinite(value)], "score": value[np.isfinite(value)], "one": frame["one"].to_numpy()[at], "two": frame["two"].to_numpy()[at],
            })

    found = index.select("row", "vec", "one", "two").mapInPandas(nearest_here, "query int, score double, one int, two int")
    order = Window.partitionBy("query").orderBy(F.desc("score"))
    true = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).collect()  # `top` rows for a query
    reached = []
    for n, vec in enumerate(vecs):
        path = np.argsort((-(centers[0] @ vec[:cut]))[:, None] + (-(centers[1] @ vec[cut:]))[None, :], axis=None, kind="stable")
        held = np.empty(sizes.size)
        held[path] = np.cumsum(sizes.ravel()[path])
        reached += [held[r.one * sizes.shape[1] + r.two] / sizes.sum() for r in true if r.query == n]
    return float(np.quantile(reached, recall, method="higher")) if reached else 1.0


def search(
    vectors: DataFrame,
    every: int = 20,
    top: int = 20,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    share: float | None = None,
    recall: float = RECALL,
    centroids: int | None = None,
    sample_queries: int = SAMPLE_QUERIES,
    block: int = BLOCK,
    query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the nearest rows of every row whose id is divisible by `every`.

    A query finds any row but itself; fewer other rows than `top` give all of them. `share` sets the share of all vectors that
    a query visits; without it, it is measured for `recall`.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vector_col)
    n = rows.count()
    if not n:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    centers = fit(rows, n, centroids)
    cut, shape = len(centers[0][0]), (len(centers[0]), len(centers[1]))

    def quantise(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                vecs = np.stack(frame["vec"].to_numpy())
                yield frame.assign(one=nearest(vecs[:, :cut], centers[0]), two=nearest(vecs[:, cut:], centers[1]))

    index = written(rows.select("row", "vec_id", "vec").mapInPandas(quantise, "row bigint, vec_id bigint, vec array<double>, one int, two int"), "ann-index")
    sizes = np.zeros(shape, np.int64)
    for r in index.groupBy("one", "two").count().collect():  # a row for each cell
        sizes[r.one, r.two] = r["count"]
    blocks = np.maximum(1, -(-sizes.sum(axis=1) // block)).tolist()
    of_shelf = F.array(*map(F.lit, blocks))
    asked = index.filter(F.col("vec_id") % every == 0)
    query_blocks = max(1, -(-asked.count() // query_block))
    if share is None:
        share = needed_share(index, asked, centers, sizes, top, recall, sample_queries)
    wanted = max(top + 1, int(np.ceil(share * n)))

    def plan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            made = []
            for number, own, vec in zip(frame["row"].tolist(), frame["vec_id"].tolist(), frame["vec"], strict=True):
                for shelf, cells in traverse(-(centers[0] @ vec[:cut]), -(centers[1] @ vec[cut:]), sizes, wanted).items():
                    made.append((number, own, vec, shelf, cells))
            yield pd.DataFrame(made, columns=["row", "vec_id", "vec", "one", "cells"])

    def spread(count: Column) -> Column:
        return F.explode(F.sequence(F.lit(0), count - 1))

    shelf_blocks = F.element_at(of_shelf, F.col("one") + 1)
    visits = asked.select("row", "vec_id", "vec").mapInPandas(plan, "row bigint, vec_id bigint, vec array<double>, one int, cells array<int>")
    visits = visits.withColumn("ask", F.pmod(F.hash("row"), F.lit(query_blocks))).withColumn("block", spread(shelf_blocks))
    entries = index.withColumn("block", F.pmod(F.hash("row"), shelf_blocks)).withColumn("ask", spread(F.lit(query_blocks)))
    unit = ["one", "block", "ask"]
    found = visits.groupBy(*unit).cogroup(entries.groupBy(*unit)).applyInPandas(
        lambda q, e: best(q, e, top), _FOUND
    )
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.select("query_id", "rank", "vec_id", "score")
