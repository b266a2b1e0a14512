"""Near duplicates of texts by HyperMinHash registers.

1. A text is the set of its distinct three-word shingles, known by 64-bit hashes. The first seven bits of a hash are its
   bucket; of the least hash of each of the 128 buckets a register of 16 bits keeps the number of leading zeros and the ten
   bits after the first one. Texts with equal sets are one *class*, and one text of a class goes on.
2. The registers are cut into 32 bands of four. Classes with an equal band that is not empty meet. Sets with a similarity
   of 0.85 miss each other in all bands with a probability under 1e-9; small sets cannot miss, as they differ in fewer
   shingles than they have bands in use. A meeting place of any size is divided into blocks, and pairs of blocks are the units of work.
3. In a unit two classes are *alike* when their sizes allow the similarity and the estimate allows it: the share of equal
   registers among those in use, less what differing minima are expected to share by chance (this depends on the sizes),
   may fall short of the threshold by as much as happens with probability `TOLERANCE`. A unit gives each class that has
   alike ones an edge to the least of those it is connected with, so what is written grows with the classes, not their pairs.
4. The texts of each group of classes that are connected by likeness are brought together once, in blocks of bounded rows and
   characters whose pairs are units again. There the sets are compared exactly. A pair that is connected already is not
   compared, as its link cannot change a component; again only edges to the least connected class leave the unit.
5. The components of those links are the result.

Nulls, ties, repeats: a null or empty text and one of white space only have no shingles and are linked with nothing. A text
with one or two words has them all as its only shingle. Every row counts, also when its id is null or repeated; the id of a
component is its least id that is not null, and null if there is none. `kept` holds for rows whose id equals the id of their
component (null counts as equal to null), so rows with a repeated id may be kept together. An empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import complete_groups, small_batches, spread, text_of, written
from eventloom.llm.graph import components
from eventloom.llm.words import groups, hash_folded_tokens, shingles

WIDTH = 3
PERCENT = 85  # a link needs 100 * intersection >= 85 * union
BUCKET_BITS, MANTISSA_BITS = 7, 10
REGISTERS = 1 << BUCKET_BITS
BANDS, ROWS = 32, 4
TOLERANCE = 1e-7
BLOCK = 1_000  # classes of a block
BLOCK_CHARS = 4_000_000  # of a block of texts; a longer text is more
PAIRS_AT_ONCE = 50_000
_U = np.uint64


def distinct_shingles(texts: list[str], width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of all texts, ascending in each text, and where each text's begin."""
    hashes, offsets = shingles(hash_folded_tokens(texts), width)
    own = np.repeat(np.arange(len(texts)), np.diff(offsets))
    order = np.lexsort((hashes, own))
    hashes, own = hashes[order], own[order]
    fresh = np.ones(len(hashes), bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (own[1:] != own[:-1])
    hashes, own = hashes[fresh], own[fresh]
    return hashes, np.searchsorted(own, np.arange(len(texts) + 1))


def registers(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The registers of each set of ascending hashes; 0 is a bucket without a hash."""
    out = np.zeros((len(offsets) - 1, REGISTERS), np.uint16)
    own = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    bucket = (hashes >> _U(64 - BUCKET_BITS)).astype(np.int64)
    least = np.ones(len(hashes), bool)  # the first of a bucket, as hashes ascend
    least[1:] = (bucket[1:] != bucket[:-1]) | (own[1:] != own[:-1])
    rest = hashes[least] << _U(BUCKET_BITS)
    zeros = 53 - np.frexp((rest >> _U(11)).astype(np.float64))[1].astype(np.int64)  # 53 bits are exact in a double
    mantissa = (rest << (zeros + 1).astype(_U)) >> _U(64 - MANTISSA_BITS)
    out[own[least], bucket[least]] = ((zeros + 1) << MANTISSA_BITS) | mantissa.astype(np.int64)
    return out


def sketch(texts: list[str], width: int = WIDTH) -> Iterator[tuple[int, bytes | None, np.ndarray | None]]:
    """For each text the size of its set, a 128-bit fingerprint of the set, and its registers, four in each of the bands."""
    for a, b in groups(texts):
        hashes, offsets = distinct_shingles(texts[a:b], width)
        values = registers(hashes, offsets)
        for i, (x, y) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
            own = hashes[x:y]
            folded = np.array([own.sum(dtype=_U), (own * (own >> _U(7) | _U(1))).sum(dtype=_U) + _U(len(own))])
            yield (y - x, folded.tobytes(), values[i].view(np.int64)) if y > x else (0, None, None)


def registers_of(bands: pd.Series) -> np.ndarray:
    return np.stack(bands.to_numpy()).astype(np.int64, copy=False).view(np.uint16)


@functools.cache
def _cells(size_class: int) -> np.ndarray:
    """The probability of each register value for a bucket of a set of 2**size_class hashes that holds any."""
    load = 2.0**size_class / REGISTERS
    zeros = np.arange(54)[:, None]
    width = 2.0 ** -(zeros + 1.0) / (1 << MANTISSA_BITS)
    start = 2.0 ** -(zeros + 1.0) + np.arange(1 << MANTISSA_BITS)[None, :] * width
    return (np.exp(-load * start) * -np.expm1(-load * width) / -np.expm1(-load)).ravel()


@functools.cache
def collision(one: int, two: int) -> float:
    """The probability that differing least hashes of two sets of these size classes have equal registers."""
    return float((_cells(one) * _cells(two)).sum())


def size_class(sizes: np.ndarray) -> np.ndarray:
    return np.rint(np.log2(np.maximum(sizes, 1))).astype(np.int64)


@functools.cache
def least_equal(percent: int, tolerance: float = TOLERANCE) -> np.ndarray:
    """For each number of registers in use, the fewest equal ones that a pair at the threshold has but for the tolerance."""
    out, p = np.zeros(REGISTERS + 1), percent / 100
    for n in range(REGISTERS + 1):
        total = 0.0
        for m in range(n + 1):
            total += math.comb(n, m) * p**m * (1 - p) ** (n - m)
            if total >= tolerance:
                out[n] = m
                break
    return out


def alike(one: np.ndarray, two: np.ndarray, sizes_one: np.ndarray, sizes_two: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Whether sizes and registers of each pair allow the similarity."""
    fits = 100 * np.minimum(sizes_one, sizes_two) >= percent * np.maximum(sizes_one, sizes_two)
    used = (one | two) != 0
    n = used.sum(axis=1)
    equal = ((one == two) & used).sum(axis=1)
    classes = np.stack([size_class(sizes_one), size_class(sizes_two)], axis=1)
    known, which = np.unique(classes, axis=0, return_inverse=True)
    chance = np.array([collision(int(min(k)), int(max(k))) for k in known])[which.ravel()]
    corrected = (equal - chance * n) / (1 - chance)
    return fits & (corrected >= least_equal(percent)[n] - 1e-9)


class _Forest:
    """Union-find over the rows of a unit."""

    def __init__(self, n: int) -> None:
        self.root = np.arange(n)

    def find(self, i: int) -> int:
        root = self.root
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    def join(self, pairs: Iterator[tuple[int, int]]) -> None:
        for a, b in pairs:
            one, two = self.find(a), self.find(b)
            if one != two:
                self.root[max(one, two)] = min(one, two)

    def flat(self) -> np.ndarray:
        while True:
            up = self.root[self.root]
            if (up == self.root).all():
                return up
            self.root = up

    def frame(self, ids: np.ndarray) -> pd.DataFrame:
        """An edge from each joined row to the one of least id that it is joined with; units that share rows share edges."""
        root = self.flat()
        least = np.full(len(ids), np.iinfo(np.int64).max)
        np.minimum.at(least, root, ids)
        joined = least[root] != ids
        return pd.DataFrame({"a": least[root][joined], "b": ids[joined]}, dtype="int64")


def blocked(rows: DataFrame, keys: list[str], blocks: Column) -> DataFrame:
    """Deal the rows of each key into `blocks` blocks by their id, and give each row every pair of blocks that holds its own."""
    own = rows.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    pair = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda x: F.struct(F.least(x, F.col("block")).alias("one"), F.greatest(x, F.col("block")).alias("two")),
    )
    rest = [c for c in rows.columns if c not in keys]
    return own.withColumn("pair", F.explode(pair)).select(*keys, "pair.one", "pair.two", "block", *rest)


def likeness(reps: DataFrame, percent: int, block: int) -> DataFrame:
    """Edges (a, b) that connect the classes that are alike; `reps` has id, n, bands."""
    members = reps.select("id", F.posexplode("bands").alias("band", "key")).filter("key <> 0")
    places = members.groupBy("band", "key").agg(F.count(F.lit(1)).alias("held")).filter("held > 1")
    met = members.join(places.hint("merge"), ["band", "key"])
    unit = ["band", "key", "one", "two"]
    met = blocked(met, ["band", "key"], F.ceil(F.col("held") / block)).drop("held")
    met = met.join(reps.select("id", "n", "bands").hint("merge"), "id")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in complete_groups(frames, unit):
            values = registers_of(frame["bands"])
            sizes, blocks = frame["n"].to_numpy(), frame["block"].to_numpy()
            cross, forest = (frame["one"] != frame["two"]).to_numpy(), _Forest(len(frame))
            edge = np.zeros(len(frame) + 1, bool)
            edge[0] = edge[-1] = True
            for k in unit:
                edge[1:-1] |= frame[k].to_numpy()[1:] != frame[k].to_numpy()[:-1]
            edges = np.flatnonzero(edge)
            later = np.repeat(edges[1:], np.diff(edges)) - np.arange(len(frame)) - 1
            total, start = np.cumsum(later), 0
            while start < len(frame):
                stop = max(start + 1, int(np.searchsorted(total, (total[start - 1] if start else 0) + PAIRS_AT_ONCE, "right")))
                a = np.repeat(np.arange(start, stop), later[start:stop])
                b = np.arange(len(a)) - np.repeat(np.cumsum(later[start:stop]) - later[start:stop], later[start:stop]) + a + 1
                root = forest.flat()
                ask = (root[a] != root[b]) & (~cross[a] | (blocks[a] != blocks[b]))
                a, b = a[ask], b[ask]
                good = alike(values[a], values[b], sizes[a], sizes[b], percent) if len(a) else np.zeros(0, bool)
                forest.join(zip(a[good].tolist(), b[good].tolist(), strict=True))
                start = stop
            yield forest.frame(frame["id"].to_numpy())

    return spread(met, *unit).mapInPandas(run, "a bigint, b bigint")


def linked(texts: list[str], values: np.ndarray, cross: np.ndarray | None, percent: int, width: int) -> _Forest:
    """What exact links connect among texts; `cross` gives blocks, of which only different ones are compared."""
    parts = [distinct_shingles(texts[a:b], width) for a, b in groups(texts)]
    sets = [h[x:y] for h, o in parts for x, y in zip(o[:-1], o[1:], strict=True)]
    sizes, forest = np.array([len(s) for s in sets]), _Forest(len(sets))
    for i in range(len(sets) - 1):
        root = forest.flat()
        ask = root[i + 1 :] != root[i]
        if cross is not None:
            ask &= cross[i + 1 :] != cross[i]
        others = np.flatnonzero(ask) + i + 1
        for a in range(0, len(others), 1024):
            some = others[a : a + 1024]
            some = some[alike(values[[i] * len(some)], values[some], np.full(len(some), sizes[i]), sizes[some], percent)]
            if not len(some):
                continue
            asked = np.concatenate([sets[j] for j in some])
            at = np.minimum(np.searchsorted(sets[i], asked), sizes[i] - 1)
            common = np.add.reduceat((sets[i][at] == asked).astype(np.int64), np.cumsum(sizes[some]) - sizes[some])
            true = 100 * common >= percent * (sizes[i] + sizes[some] - common)
            forest.join((i, int(j)) for j in some[true])
    return forest


def links(like: DataFrame, texts: DataFrame, percent: int, width: int, block: int, block_chars: int) -> DataFrame:
    """Edges (a, b) that connect what exact links connect, inside each group of classes; `texts` has id, bands, text."""
    like = like.select("id", F.col("root").alias("likeness"))
    rows = texts.join(like.hint("merge"), "id")
    sizes = rows.groupBy("likeness").agg(F.count(F.lit(1)).alias("held"), F.sum(F.length("text")).alias("chars"))
    needed = F.greatest(F.ceil(F.col("held") / block), F.ceil(F.col("chars") / block_chars), F.lit(1))
    rows = rows.join(sizes.select("likeness", needed.alias("needed")).hint("merge"), "likeness")
    unit = ["likeness", "one", "two"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in complete_groups(frames, unit):
            for _, own in frame.groupby(unit, sort=False):
                values = registers_of(own["bands"])
                cross = own["block"].to_numpy() if own["one"].iloc[0] != own["two"].iloc[0] else None
                ids = own["id"].to_numpy()
                forest = linked(own["text"].tolist(), values, cross, percent, width)
                yield forest.frame(ids)

    dealt = spread(blocked(rows, ["likeness"], F.col("needed")).drop("needed"), *unit)
    return dealt.mapInPandas(run, "a bigint, b bigint")


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    percent: int = PERCENT,
    width: int = WIDTH,
    block: int = BLOCK,
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """One row per row of `docs`: doc_id, n_shingles, component_id, kept."""
    small_batches(docs)

    @F.pandas_udf("n bigint, set binary, bands array<bigint>")
    def sketched(frames: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in frames:
            made = list(sketch(texts.tolist(), width))
            yield pd.DataFrame({"n": [m[0] for m in made], "set": [m[1] for m in made], "bands": [m[2] for m in made]}, dtype=object)

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_of(text_col).alias("text"), F.monotonically_increasing_id().alias("id"))
    rows = rows.withColumn("s", sketched("text")).select("doc_id", "id", "text", "s.n", "s.set", "s.bands")
    rows = written(rows, "sketches")
    classes = rows.filter("n > 0").groupBy("set").agg(F.min("id").alias("id"), F.min("doc_id").alias("least"))
    classes = written(classes, "classes")
    reps = rows.join(classes.select("id").hint("merge"), "id", "left_semi")
    like = components(likeness(reps.select("id", "n", "bands"), percent, block))
    found = links(like, reps.select("id", "bands", "text"), percent, width, block, block_chars)
    roots = components(found)
    joined = classes.join(roots, "id", "left").select("set", F.coalesce("root", "id").alias("root"), "least")
    least = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    of_set = joined.join(least, "root").select("set", "component_id")
    out = rows.select("doc_id", "n", "set").join(of_set, "set", "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
