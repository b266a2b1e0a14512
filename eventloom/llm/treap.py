"""Ranked lexical search with K2-treaps over term-document grids.

The documents are dealt into shards of bounded size, in the order in which they are read. A shard is a grid with a row for
each of its terms (the most frequent first) and a column for each of its documents (the shortest first). The grid is a
compressed quadtree: a level holds, for each cell that is not empty, four bits that tell which quadrants are not empty and
the largest impact inside, rounded up to 16 bits; children lie in Morton order, so a child is found by counting bits and no empty cell is stored.
A cell of the last level is one term in one document and its impact is exact.

An item descends with the paths of its terms' rows together: a state is a range of documents with the cell of every term
over that range, and the sum of weight times impact bounds the score of each document in the range. States are taken best
first, in small chunks; a range whose bound is under the item's `top`-th score is dropped. The first few shards give
each item a score that `top` documents reach, so that later shards start with a bound; the rest follow in parallel, and the
best of all shards are ranked together. The result is exact: a bound is never below a score, and ties are kept.

Nulls, ties, repeats: a null or empty text, and a text without terms, is no document. Every row is a document of its own, also
when its id is repeated or null; equal scores are ranked by id, null ids last. Items without terms have no rows, and rows
with a repeated item id are ranked apart. Empty tables give no rows. Other columns are ignored. Terms are known by 64-bit
hashes.
"""

from __future__ import annotations

import heapq
import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventloom.llm.common import ROWS_AT_ONCE, arrow_rows, text_of, written
from eventloom.llm.words import groups, hash_terms
from eventloom.plans.timeline import run_folder

SHARD_DOCUMENTS = 4_096
SHARD_POSTINGS = 300_000
ROW_GROUP_BYTES = 16 << 20
ITEM_BLOCK = 10_000  # items that the driver and each task hold at once
FIRST_SHARDS = 8
STEP_BITS = 4  # cells above the last level keep their impact in steps of 2**STEP_BITS, rounded up, in 16 bits
CHUNK = 512  # document ranges that are taken from the heap at once
TOP = 20

_SHARD = (
    "shard string, ids binary, unnamed binary, terms binary, lines binary, counts binary, masks array<binary>, impacts array<binary>"
)
_BITS = np.array([bin(i).count("1") for i in range(16)], np.uint8)


def spread_bits(x: np.ndarray) -> np.ndarray:
    """The low 32 bits of each number with a zero between any two of them."""
    x = x.astype(np.uint64)
    for shift, mask in [
        (16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555),
    ]:
        x = (x | (x << np.uint64(shift))) & np.uint64(mask)
    return x


def quadtree(rows: np.ndarray, columns: np.ndarray, impacts: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Per level, from the whole grid down: the bits of the quadrants in use (not for the last level), the largest impact."""
    height = max(1, int(max(rows.max(), columns.max())).bit_length())
    codes = spread_bits(rows) << np.uint64(1) | spread_bits(columns)
    order = np.argsort(codes)
    codes, values = codes[order], impacts[order].astype(np.uint32)
    masks, largest = [], [values]
    for _ in range(height):
        bits = (1 << (codes & np.uint64(3)).astype(np.uint8)).astype(np.uint8)
        codes = codes >> np.uint64(2)
        starts = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
        codes, values = codes[starts], np.maximum.reduceat(values, starts)
        masks.append(np.bitwise_or.reduceat(bits, starts))
        largest.append(values)
    return masks[::-1], largest[::-1]


def impact(tf: np.ndarray, length: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """The impact of a term that occurs `tf` times in a document of `length` terms; whole numbers throughout."""
    m = np.array([75 + 25 * int(n) * documents // terms for n in length.tolist()], object)
    small = np.minimum(m, 1 << 50).astype(np.int64)  # beyond, every impact is 0 all the same
    return (1_000_000_000 * tf) // (1000 * tf + 12 * small)


class _Grid:
    """The postings of a shard in the making."""

    def __init__(self) -> None:
        self.ids: list = []
        self.lengths: list[np.ndarray] = []
        self.postings: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, ids: list, texts: list[str]) -> None:
        words = hash_terms(texts)
        lengths = np.diff(words.offsets)
        held = np.flatnonzero(lengths)
        own = np.repeat(np.arange(len(held)), lengths[held])
        order = np.lexsort((words.hashes, own))
        own, terms = own[order], words.hashes[order]
        if len(terms):
            starts = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (terms[1:] != terms[:-1])]))
            tf = np.diff(np.append(starts, len(terms)))
            self.postings.append((own[starts] + len(self.ids), terms[starts], tf))
            self.held += len(starts)
        self.ids += [ids[i] for i in held.tolist()]
        self.lengths.append(lengths[held])

    def full(self, documents: int, postings: int) -> bool:
        return len(self.ids) >= documents or self.held >= postings

    def row(self, shard: str, documents: int, terms: int) -> dict:
        length = np.concatenate(self.lengths)
        own, words, tf = (np.concatenate(parts) for parts in zip(*self.postings, strict=True))
        known, which, counts = np.unique(words, return_inverse=True, return_counts=True)
        lines = np.empty(len(known), np.uint32)
        lines[np.argsort(-counts, kind="stable")] = np.arange(len(known), dtype=np.uint32)
        by_length = np.argsort(length, kind="stable")
        column = np.empty(len(length), np.int64)
        column[by_length] = np.arange(len(length))
        masks, largest = quadtree(lines[which].astype(np.int64), column[own], impact(tf, length[own], documents, terms))
        return {
            "shard": shard,
            "ids": np.array([i or 0 for i in self.ids], np.int64)[by_length].tobytes(),
            "unnamed": np.array([i is None for i in self.ids])[by_length].tobytes(),
            "terms": known.tobytes(),
            "lines": lines.tobytes(),
            "counts": counts.astype(np.uint32).tobytes(),
            "masks": [m.tobytes() for m in masks],
            "impacts": [(-(-v.astype(np.int64) >> STEP_BITS)).astype(np.uint16).tobytes() for v in largest[:-1]] + [largest[-1].tobytes()],
        }


@dataclass(frozen=True)
class Index:
    """A stored index: a row for each shard, the documents that have terms, and all their terms."""

    shards: DataFrame
    documents: int
    terms: int


def build(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_documents: int = SHARD_DOCUMENTS, shard_postings: int = SHARD_POSTINGS
) -> Index:
    """Index all documents: one pass counts documents and terms, one makes and stores the shards. Nothing is shuffled."""
    spark = docs.sparkSession
    number = F.col(id_col).cast("bigint")
    rows = docs.select(F.coalesce(number, F.lit(0)).alias("id"), number.isNull().alias("unnamed"), text_of(text_col).alias("text"))

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        documents = terms = 0
        for frame in frames:
            texts = frame["text"].tolist()
            for a, b in groups(texts):
                lengths = np.diff(hash_terms(texts[a:b]).offsets)
                documents, terms = documents + int((lengths > 0).sum()), terms + int(lengths.sum())
        yield pd.DataFrame({"documents": [documents], "terms": [terms]})

    with arrow_rows(spark, ROWS_AT_ONCE):
        sums = rows.select("text").mapInPandas(count, "documents bigint, terms bigint").agg(F.sum("documents"), F.sum("terms")).first()
    documents, terms = int(sums[0] or 0), int(sums[1] or 0)

    def make(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, made, grid = TaskContext.get().partitionId(), 0, _Grid()
        for frame in frames:
            ids = [None if none else i for i, none in zip(frame["id"].tolist(), frame["unnamed"].tolist(), strict=True)]
            texts = frame["text"].tolist()
            for a, b in groups(texts):
                grid.add(ids[a:b], texts[a:b])
                if grid.full(shard_documents, shard_postings):
                    yield pd.DataFrame([grid.row(f"{task}-{made}", documents, terms)])
                    made, grid = made + 1, _Grid()
        if grid.ids:
            yield pd.DataFrame([grid.row(f"{task}-{made}", documents, terms)])

    place = f"{run_folder(spark)}/k2-treap-{uuid.uuid4().hex}"
    with arrow_rows(spark, ROWS_AT_ONCE):
        # a row has megabytes, so its size is looked at after each row; Parquet does so after a hundred otherwise
        sizes = {"parquet.block.size": str(ROW_GROUP_BYTES), "parquet.page.size.row.check.min": "1"}
        rows.mapInPandas(make, _SHARD).write.options(**sizes).parquet(place)
    return Index(spark.read.schema(_SHARD).parquet(place), documents, terms)


class _Shard:
    """A shard of the index in memory, for descents."""

    def __init__(self, row) -> None:
        self.ids = np.frombuffer(row.ids, np.int64)
        self.unnamed = np.frombuffer(row.unnamed, bool)
        self.known = np.frombuffer(row.terms, np.uint64)
        self.lines = np.frombuffer(row.lines, np.uint32).astype(np.int64)
        self.masks = [np.frombuffer(m, np.uint8) for m in row.masks]
        self.impacts = [np.frombuffer(v, np.uint16).astype(np.uint32) << STEP_BITS for v in row.impacts[:-1]]
        self.impacts.append(np.frombuffer(row.impacts[-1], np.uint32))
        self.first = [np.cumsum(_BITS[m], dtype=np.int64) - _BITS[m] for m in self.masks]

    def lines_of(self, terms: np.ndarray) -> np.ndarray:
        """The row of each term, -1 for a term that the shard does not hold."""
        at = np.minimum(np.searchsorted(self.known, terms), len(self.known) - 1)
        return np.where(self.known[at] == terms, self.lines[at], -1)

    def descend(self, lines: np.ndarray, weights: np.ndarray, top: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """Scores and columns of all documents that reach `floor` and the `top`-th score, by joint best-first descent."""
        height = len(self.masks)
        scores, columns = np.zeros(0, np.int64), np.zeros(0, np.int64)
        bound = int((weights * int(self.impacts[0][0])).sum())
        # a chunk: level, first column of each range, bound of each range, range of each path, term and cell of each path
        start = (0, np.zeros(1, np.int64), np.array([bound]), np.zeros(len(lines), np.int64), np.arange(len(lines)), np.zeros(len(lines), np.int64))
        heap, pushed = [(-bound, 0, start)], 1
        while heap:
            least, _, (level, columns_at, bounds, of, term, cell) = heapq.heappop(heap)
            if -least < floor:
                break
            alive = bounds >= floor  # the floor may have risen since
            if not alive.all():
                path = alive[of]
                of, term, cell = (np.cumsum(alive) - 1)[of[path]], term[path], cell[path]
                columns_at = columns_at[alive]
            mask, first = self.masks[level][cell], self.first[level][cell]
            down = (lines[term] >> (height - 1 - level) & 1) << 1
            parts = []
            for right in (0, 1):
                quadrant = down | right
                there = mask >> quadrant & 1 == 1
                before = _BITS[mask & ((1 << quadrant) - 1)]
                parts.append((2 * of[there] + right, term[there], (first + before)[there]))
            of, term, cell = (np.concatenate(p) for p in zip(*parts, strict=True))
            if not len(of):
                continue
            order = np.argsort(of, kind="stable")
            of, term, cell = of[order], term[order], cell[order]
            edges = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
            bounds = np.add.reduceat(weights[term] * self.impacts[level + 1][cell].astype(np.int64), edges)
            found = of[edges]
            columns_at = columns_at[found >> 1] + ((found & 1) << (height - 1 - level))
            if level + 1 == height:
                good = bounds >= floor
                scores, columns = np.concatenate([scores, bounds[good]]), np.concatenate([columns, columns_at[good]])
                if len(scores) >= top:
                    floor = max(floor, int(np.partition(scores, -top)[-top]))
                    scores, columns = scores[scores >= floor], columns[scores >= floor]
                continue
            sizes = np.diff(np.append(edges, len(of)))
            best = np.argsort(-bounds, kind="stable")
            best = best[bounds[best] >= floor]
            for a in range(0, len(best), CHUNK):
                chosen = best[a : a + CHUNK]
                length = sizes[chosen]
                path = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length) + np.repeat(edges[chosen], length)
                state = (level + 1, columns_at[chosen], bounds[chosen], np.repeat(np.arange(len(chosen)), length), term[path], cell[path])
                heapq.heappush(heap, (-int(bounds[chosen[0]]), pushed, state))
                pushed += 1
        return scores, columns


@dataclass(frozen=True)
class _Asked:
    """Items in the form in which tasks need them: `terms` all different terms, per item their places and weights."""

    terms: np.ndarray
    weights: np.ndarray
    offsets: np.ndarray
    which: np.ndarray
    times: np.ndarray

    @staticmethod
    def of(texts: list[str]) -> _Asked:
        words = hash_terms(texts)
        known, place = np.unique(words.hashes, return_inverse=True)
        offsets, which, times = [0], [], []
        for a, b in zip(words.offsets[:-1], words.offsets[1:], strict=True):
            own, repeats = np.unique(place[a:b], return_counts=True)
            which.append(own)
            times.append(repeats)
            offsets.append(offsets[-1] + len(own))
        empty = np.zeros(0, np.int64)
        return _Asked(known, np.zeros(len(known), np.int64), np.array(offsets), np.concatenate([empty, *which]), np.concatenate([empty, *times]))


def _document_counts(index: Index, terms: np.ndarray) -> np.ndarray:
    """How many documents hold each term."""

    def look_up(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(len(terms), np.int64)
        for frame in frames:
            for known, counts in zip(frame["terms"], frame["counts"], strict=True):
                known, counts = np.frombuffer(known, np.uint64), np.frombuffer(counts, np.uint32)
                at = np.minimum(np.searchsorted(known, terms), len(known) - 1)
                total += np.where(known[at] == terms, counts[at], 0)
        held = np.flatnonzero(total)
        yield pd.DataFrame({"term": held, "n": total[held]})

    out = np.zeros(len(terms), np.int64)
    if len(terms):
        found = index.shards.select("terms", "counts").mapInPandas(look_up, "term bigint, n bigint")
        with arrow_rows(index.shards.sparkSession, 1):
            for r in found.groupBy("term").agg(F.sum("n").alias("n")).collect():  # at most a row for each term of the items
                out[r.term] = r.n
    return out


def _answers(shards: DataFrame, asked: _Asked, floors: np.ndarray, top: int) -> DataFrame:
    """(item, doc_id, score): each shard's best documents of each item."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                shard = _Shard(row)
                lines, out = shard.lines_of(asked.terms), []
                for item, (a, b) in enumerate(zip(asked.offsets[:-1].tolist(), asked.offsets[1:].tolist(), strict=True)):
                    own = lines[asked.which[a:b]]
                    weight = asked.weights[asked.which[a:b]] * asked.times[a:b]
                    use = (own >= 0) & (weight > 0)
                    if not use.any():
                        continue
                    scores, columns = shard.descend(own[use], weight[use], top, int(floors[item]))
                    ids, unnamed = shard.ids[columns], shard.unnamed[columns]
                    best = np.lexsort((ids, unnamed, -scores))[:top]
                    named = [None if u else i for i, u in zip(ids[best].tolist(), unnamed[best].tolist(), strict=True)]
                    out += [(item, i, s) for i, s in zip(named, scores[best].tolist(), strict=True)]
                yield pd.DataFrame(out, columns=["item", "doc_id", "score"], dtype=object)

    found = shards.select("ids", "unnamed", "terms", "lines", "masks", "impacts").mapInPandas(run, "item int, doc_id bigint, score bigint")
    with arrow_rows(shards.sparkSession, 1):  # one shard at a time
        return written(found, "found")


def search(
    index: Index,
    items: DataFrame,
    id_col: str = "item_id",
    text_col: str = "text",
    top: int = TOP,
    item_block: int = ITEM_BLOCK,
    first_shards: int = FIRST_SHARDS,
) -> DataFrame:
    """(item_id, rank, doc_id, score): the `top` documents of every item with a score above 0, in blocks of items."""
    spark = items.sparkSession
    items = written(
        items.select(F.col(id_col).cast("bigint").alias("item_id"), text_of(text_col).alias("text"), F.monotonically_increasing_id().alias("uid")), "items"
    )
    shards, n = index.shards, index.shards.count()
    blocks = -(-items.count() // item_block)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    out = None
    for block in range(blocks if n else 0):
        rows = items.filter(F.pmod(F.xxhash64("uid"), F.lit(blocks)) == block).orderBy("uid").collect()
        asked = _Asked.of([r.text for r in rows])
        counts = _document_counts(index, asked.terms)
        for i, df in enumerate(counts.tolist()):
            asked.weights[i] = math.floor(1000 * math.log((2 * index.documents + 2) / (2 * df + 1)))
        floors = np.ones(len(rows), np.int64)
        if n >= 4 * first_shards:
            few = shards.filter(F.pmod(F.xxhash64("shard"), F.lit(n // first_shards)) == 0)
            ranked = _answers(few, asked, floors, top).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") == top)
            for r in ranked.collect():  # at most a row for each item of the block
                floors[r.item] = max(1, r.score)
        found = _answers(shards, asked, floors, top).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
        names = spark.createDataFrame([(i, r.item_id) for i, r in enumerate(rows)], "item int, item_id bigint")
        part = found.join(names, "item").select("item_id", "rank", "doc_id", "score")
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint") if out is None else out


def rank(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """Index the documents and search them for every item."""
    return search(build(docs), items, top=top)
