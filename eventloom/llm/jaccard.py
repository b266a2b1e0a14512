"""Join of texts by the Jaccard similarity of their word shingles, with Bayesian pruning of candidate pairs.

1. Every text becomes its set of hashed five-word shingles and `VALUES` MinHash values, written once as a table. Texts
   with equal sets are copies of one *class*; only one row of a class goes on.
2. Classes that agree in one of `BANDS` bands of four values meet in a bucket. A pair at the threshold of 0.8 meets with
   probability 1 - (1 - 0.8^4)^32, over 0.99999995. Buckets of one member are left out. A bucket of any size is divided
   into blocks, and every pair of blocks is a unit of work of its own, so no task holds a whole hot bucket.
3. Within a unit, pairs are compared sixteen values at a time. A pair is dropped as soon as the posterior probability
   (uniform prior) that its similarity reaches the threshold falls below `tolerance`. A pair is compared only in the first
   band in which it meets, so it counts once.
4. What is left is verified on the exact shingle sets; the texts are sent only to the units that need them.
   Joins that move texts or bands are merge joins at every size: both sides grow with the table.
5. Links are counted per class inside the units, and linked classes get one id by minimum-label propagation. Verified
   links are never written pair by pair; pairs that survive pruning are, as lists of partner ids (8 bytes an id), so what
   is written grows with the square of a group of near copies. A unit is bounded by rows, not by characters.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventloom.llm.common import complete_groups, small_batches, spread, text_of, written
from eventloom.llm.words import SHINGLE_WORDS, groups, hash_words, shingles, sorted_sets

THRESHOLD = 0.8
BANDS = 32
ROWS = 4
VALUES = BANDS * ROWS
TOLERANCE = 1e-6
STEP = 16
BLOCK = 1000
PAIRS_AT_ONCE = 400_000
UNIT = ["band", "key", "one", "two"]
_SKETCH, _UID, _SET = "__sketch", "__uid", "__set"


@functools.cache
def _multipliers() -> np.ndarray:
    return np.random.default_rng(20_240_229).integers(0, 1 << 63, VALUES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def sketches(texts: list[str], width: int = SHINGLE_WORDS) -> list[tuple[bytes, list[int]] | None]:
    """For each text a 128-bit fingerprint of its shingle set and its MinHash bands; None for a text without words.

    A band holds four values of 16 bits in one 64-bit integer. The 16 bits are a hash of the 32-bit minimum.
    """
    out: list[tuple[bytes, list[int]] | None] = []
    for a, b in groups(texts):
        hashes, offsets = shingles(hash_words(texts[a:b]), width)
        full = np.flatnonzero(np.diff(offsets))
        values = np.zeros((len(full), VALUES), np.uint64)
        for k, by in enumerate(_multipliers() if len(full) else []):
            least = np.minimum.reduceat(((hashes * by) >> np.uint64(32)).astype(np.uint32), offsets[full])
            values[:, k] = (least * np.uint32(2_654_435_769)) >> np.uint32(16)
        packed = values.reshape(-1, BANDS, ROWS)
        bands = packed[..., 0] | packed[..., 1] << np.uint64(16) | packed[..., 2] << np.uint64(32) | packed[..., 3] << np.uint64(48)
        made: list[tuple[bytes, list[int]] | None] = [None] * (b - a)
        for i, row in zip(full.tolist(), bands.view(np.int64), strict=True):
            own = np.unique(hashes[offsets[i] : offsets[i + 1]])
            folded = np.array([own.sum(dtype=np.uint64), (own * (own >> np.uint64(7) | np.uint64(1))).sum(dtype=np.uint64) + np.uint64(len(own))])
            made[i] = (folded.tobytes(), row)
        out += made
    return out


@functools.cache
def least_matches(threshold: float, tolerance: float, compared: int) -> int:
    """The fewest equal values among `compared` for which P(similarity >= threshold) is not below the tolerance.

    With a uniform prior the posterior after m of n matches is Beta(m + 1, n - m + 1).
    """
    total = 0.0
    for m in range(compared + 1):
        total += math.comb(compared + 1, m) * threshold**m * (1 - threshold) ** (compared + 1 - m)
        if total >= tolerance:
            return m
    return compared


def _sketched(docs: DataFrame, text_col: str, width: int) -> DataFrame:
    """`docs` with a row number, the set's fingerprint and the bands, written once."""

    @F.pandas_udf("set binary, bands array<bigint>")
    def sketch(frames: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in frames:
            made = sketches(texts.tolist(), width)
            yield pd.DataFrame({"set": [m and m[0] for m in made], "bands": [None if m is None else m[1] for m in made]}, dtype=object)

    columns = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.select(*columns, sketch(text_of(text_col)).alias(_SKETCH))
    rows = rows.select(*columns, F.col(f"{_SKETCH}.set").alias(_SET), F.col(f"{_SKETCH}.bands").alias(_SKETCH), F.monotonically_increasing_id().alias(_UID))
    return written(rows, "sketches")


def _units(reps: DataFrame, block: int) -> DataFrame:
    """One row for each class and unit of work it belongs to."""
    members = reps.select("id", F.posexplode("bands").alias("band", "key"))
    shared = members.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    found = members.join(shared.hint("merge"), ["band", "key"])
    blocks = F.ceil(F.col("n") / block).cast("int")
    found = found.withColumn("blocks", blocks).withColumn("block", F.pmod(F.hash("id"), F.col("blocks")))
    pair = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda x: F.struct(F.least(x, F.col("block")).alias("one"), F.greatest(x, F.col("block")).alias("two")),
    )
    found = found.withColumn("pair", F.explode(pair)).select("band", "key", "pair.one", "pair.two", "block", "id")
    return found.join(reps.select("id", "bands").hint("merge"), "id")


def _pairs(frame: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of rows of the same unit, in slices of bounded size; rows of one block only meet in that block's own unit."""
    change = np.logical_or.reduce([frame[k].to_numpy()[1:] != frame[k].to_numpy()[:-1] for k in UNIT])
    edges = np.flatnonzero(np.concatenate([[True], change, [True]]))
    ends = np.repeat(edges[1:], np.diff(edges))
    later = ends - np.arange(len(frame)) - 1
    cross, block = (frame["one"] != frame["two"]).to_numpy(), frame["block"].to_numpy()
    total, start = np.cumsum(later), 0
    while start < len(frame):
        stop = max(start + 1, int(np.searchsorted(total, (total[start - 1] if start else 0) + PAIRS_AT_ONCE, "right")))
        counts = later[start:stop]
        first = np.repeat(np.arange(start, stop), counts)
        second = np.arange(len(first)) - np.repeat(np.cumsum(counts) - counts, counts) + first + 1
        keep = ~cross[first] | (block[first] != block[second])
        yield first[keep], second[keep]
        start = stop


def prune(frame: pd.DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> tuple[np.ndarray, np.ndarray]:
    """The index pairs of a frame of whole units that survive the comparison of MinHash values."""
    bands = np.stack(frame["bands"].to_numpy()).astype(np.int64)
    values, here = bands.view(np.uint16), frame["band"].to_numpy()
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for one, two in _pairs(frame):
        for band in np.unique(here[one]) if len(one) else []:
            at = here[one] == band
            a, b = one[at], two[at]
            fresh = ~(bands[a, :band] == bands[b, :band]).any(axis=1) if band else np.ones(len(a), bool)
            a, b = a[fresh], b[fresh]
            matches = np.zeros(len(a), np.int64)
            for done in range(STEP, VALUES + 1, STEP):
                matches += (values[a, done - STEP : done] == values[b, done - STEP : done]).sum(axis=1)
                alive = matches >= least_matches(threshold, tolerance, done)
                a, b, matches = a[alive], b[alive], matches[alive]
                if not len(a):
                    break
            left.append(a)
            right.append(b)
    return np.concatenate(left), np.concatenate(right)


_SURVIVORS = T.StructType(
    [
        T.StructField("band", T.IntegerType()),
        T.StructField("key", T.LongType()),
        T.StructField("one", T.IntegerType()),
        T.StructField("two", T.IntegerType()),
        T.StructField("id", T.LongType()),
        T.StructField("partners", T.ArrayType(T.LongType())),
    ]
)


def _survivors(units: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    """For each unit, the classes that still have a partner in it, with their partners of higher row order."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in complete_groups(frames, UNIT):
            a, b = prune(frame, threshold, tolerance)
            rows = np.unique(np.concatenate([a, b]))
            if not len(rows):
                continue
            ids = frame["id"].to_numpy()
            order = np.argsort(a, kind="stable")
            cuts = np.searchsorted(a[order], rows), np.searchsorted(a[order], rows, "right")
            lists = [ids[b[order[x:y]]] for x, y in zip(*cuts, strict=True)]
            yield frame.iloc[rows][[*UNIT, "id"]].assign(partners=pd.Series(lists, index=rows, dtype=object))

    return spread(units, *UNIT).mapInPandas(run, _SURVIVORS)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets given as sorted arrays."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    common = int((b[np.minimum(at, len(b) - 1)] == a).sum())
    return common / (len(a) + len(b) - common)


def _verified(found: DataFrame, texts: DataFrame, threshold: float, width: int) -> DataFrame:
    """For each unit and class: `links`, the number of verified partners, and `root`, the least class it is linked to there."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in complete_groups(frames, UNIT):
            ids = frame["id"].to_numpy()
            own: dict[int, np.ndarray] = {}
            texts = frame["text"].tolist()
            for x, y in groups(texts):
                new = [i for i in range(x, y) if ids[i] not in own]
                own.update(zip(ids[new].tolist(), sorted_sets(*shingles(hash_words([texts[i] for i in new]), width)), strict=True))
            links = dict.fromkeys(ids.tolist(), 0)
            parent = {i: i for i in links}

            def root(i: int, parent: dict[int, int] = parent) -> int:
                while parent[i] != i:
                    parent[i] = i = parent[parent[i]]
                return i

            for i, partners in zip(ids.tolist(), frame["partners"], strict=True):
                for j in np.asarray(partners).tolist():
                    if similarity(own[i], own[j]) >= threshold:
                        links[i] += 1
                        links[j] += 1
                        one, two = root(i), root(j)
                        parent[max(one, two)] = min(one, two)
            linked = [i for i, n in links.items() if n]
            yield pd.DataFrame({"id": linked, "root": [root(i) for i in linked], "links": [links[i] for i in linked]}, dtype="int64")

    rows = spread(found.join(texts.hint("merge"), "id"), *UNIT)
    return rows.mapInPandas(run, "id bigint, root bigint, links bigint")


def components(edges: DataFrame) -> DataFrame:
    """(id, root) for every node of an undirected graph given as (id, root) edges: the least node that it is connected to.

    Each round takes the least label among the neighbours and then the label of that label; rounds are written to the
    shared folder. Edges of nodes that point to themselves may be given.
    """
    both = edges.select("id", "root").union(edges.select(F.col("root").alias("id"), F.col("id").alias("root"))).filter("id <> root").distinct()
    both = written(both, "edges")
    labels = written(both.groupBy("id").agg(F.least(F.col("id"), F.min("root")).alias("root")), "labels")
    while True:
        near = both.join(labels.select(F.col("id").alias("other"), F.col("root").alias("label")), F.col("root") == F.col("other"))
        least = near.groupBy("id").agg(F.min("label").alias("label"))
        moved = labels.join(least, "id").select("id", F.col("root").alias("old"), F.least("root", "label").alias("root"))
        jump = labels.select(F.col("id").alias("other"), F.col("root").alias("label"))
        moved = moved.join(jump, F.col("root") == F.col("other"), "left").select("id", "old", F.least("root", "label").alias("root"))
        moved = written(moved, "labels")
        if moved.filter("old <> root").isEmpty():
            return moved.select("id", "root")
        labels = moved.select("id", "root")


def link_classes(
    docs: DataFrame,
    text_col: str = "text",
    threshold: float = THRESHOLD,
    tolerance: float = TOLERANCE,
    width: int = SHINGLE_WORDS,
    block: int = BLOCK,
) -> DataFrame:
    """The rows of `docs` with `__uid` (a row number), `__rep` (of the row's class of copies), `__root` (of the linked
    classes), `__links` (classes of other texts at the threshold or above) and `__copies` (rows of the class).

    A text without words (null, empty, punctuation only) is similar to nothing, not even to another such text. A text of
    fewer words than `width` has all its words as its only shingle. Repeated ids and null ids are rows like any other.
    """
    small_batches(docs)
    rows = _sketched(docs, text_col, width)
    classes = rows.filter(F.col(_SET).isNotNull()).groupBy(_SET).agg(F.min(_UID).alias("__rep"), F.count(F.lit(1)).alias("__copies"))
    classes = written(classes, "classes")
    first = rows.join(classes.select(F.col("__rep").alias(_UID)), _UID, "left_semi")
    reps = first.select(F.col(_UID).alias("id"), F.col(_SKETCH).alias("bands"))
    found = written(_survivors(_units(reps, block), threshold, tolerance), "survivors")
    needed = found.select("id").distinct()
    texts = rows.select(F.col(_UID).alias("id"), text_of(text_col).alias("text")).join(needed.hint("merge"), "id", "left_semi")
    links = written(_verified(found, texts, threshold, width), "links")
    counts = links.groupBy("id").agg(F.sum("links").alias("links"))
    linked = components(links).join(counts, "id")
    linked = classes.join(linked, F.col("__rep") == F.col("id"), "left").select(
        _SET, "__rep", "__copies", F.coalesce("root", "__rep").alias("__root"), F.coalesce("links", F.lit(0)).cast("bigint").alias("__links")
    )
    out = rows.drop(_SKETCH).join(linked, _SET, "left").drop(_SET)
    return out.withColumns(
        {
            "__rep": F.coalesce("__rep", _UID),
            "__root": F.coalesce("__root", _UID),
            "__links": F.coalesce("__links", F.lit(0)).cast("bigint"),
            "__copies": F.coalesce("__copies", F.lit(1)).cast("bigint"),
        }
    )


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per row of `docs`: `doc_id`, `class_id`, `n_links`, `n_copies`.

    `class_id` is the least id among the documents connected by links or copies, `n_links` the number of different texts
    (shingle sets) whose similarity with this one reaches the threshold, `n_copies` the rows with this text's shingle set.
    """
    rows = link_classes(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), **options)
    least = rows.groupBy("__root").agg(F.min("doc_id").alias("class_id"))
    return rows.join(least, "__root").select("doc_id", "class_id", F.col("__links").alias("n_links"), F.col("__copies").alias("n_copies"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The row with the least id (nulls last, then an arbitrary row) of every group of linked documents, with its columns.

    Columns may have any names: they go by their numbers in here.
    """
    names = [c.lower() for c in docs.columns]
    own = [f"c{i}" for i in range(len(names))]
    id_at, text_at = own[names.index(id_col.lower())], own[names.index(text_col.lower())]
    rows = link_classes(docs.toDF(*own), text_at, **options)
    best = F.min(F.struct(F.col(id_at).isNull().alias("a"), F.col(id_at).alias("b"), F.col("__uid").alias("uid")))
    kept = rows.groupBy("__root").agg(best.alias("best")).select(F.col("best.uid").alias("__uid"))
    return rows.join(kept, "__uid", "left_semi").select(*own).toDF(*docs.columns)
