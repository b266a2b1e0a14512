"""Benchmark items found in documents: SimHash of item-sized windows, exact weighted-shingle similarity of what is near.

Items whose numbers of words differ by a tenth at most form a class. For every class, a window of the middle number of
words moves over each document; its 64-bit SimHash is taken from running sums of its shingles' weighted bits. Windows start
every `size // 10` words (every word for small items) and at the document's end; a document a little shorter is one window.

The 64 bits form four blocks of 16. Two fingerprints within `RADIUS` bits agree to within `RADIUS // 4` bits in one block
at least, so tables that list, for every block value, the items with a block value that near find *all* fingerprints
within the radius. Then the weighted Jaccard similarity of window and item is computed exactly, with windows of
the item's own size at all starts up to the neighbouring windows, and the best is kept.

An edited copy is found when one of its windows lies within the radius; the radius is wide for what the threshold allows,
and windows are dense enough that few are missed (the README has the measured share).

Shingles are five words; the weight of a shingle falls with the number of items that hold it (ln(1 + items / holders),
rounded to sixteenths), so phrases that many items share count less. Items of fewer than five words are one shingle of
all their words.

Items are a query set: they are read in blocks of `ITEMS_AT_ONCE`, and every block passes over all documents.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import absent, small_batches, text_of
from eventloom.llm.words import SHINGLE_WORDS, Words, groups, hash_words, shingles

THRESHOLD = 0.8
BITS = 64
BLOCKS = 4
RADIUS = 15
STEPS = 10
SPREAD = 1.1
UNITS = 16  # weights are multiples of 1 / UNITS
LEVELS = 4  # in fingerprints, weights are rounded to so many levels
ITEMS_AT_ONCE = 20_000
WORDS_AT_ONCE = 150_000
EPSILON = 1e-6
RESULT = "doc_id bigint, item_id bigint, similarity double, first_word bigint, n_words bigint, distance int"


@dataclass
class Size:
    """The items of about the same number of words, with the tables that find near fingerprints."""

    width: int
    counts: list[int] = field(default_factory=list)  # shingles of each item
    items: list[int] = field(default_factory=list)
    shingles: list[dict[int, int]] = field(default_factory=list)  # of each item: hash to number
    prints: list[int] = field(default_factory=list)
    weights: list[dict[int, int]] = field(default_factory=list)  # of each item: shingle to weight
    totals: list[int] = field(default_factory=list)  # weight of each item

    def __post_init__(self) -> None:
        self.tables: list[tuple[np.ndarray, np.ndarray]] | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"tables": None}  # made again in each worker

    @property
    def count(self) -> int:
        return (min(self.counts) + max(self.counts)) // 2

    @property
    def step(self) -> int:
        return max(1, (self.count + self.width - 1) // STEPS)

    def index(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """For every block, where each value's items begin, and the items whose block differs from it in few enough bits."""
        if self.tables is None:
            flips = [sum(1 << b for b in c) for n in range(RADIUS // BLOCKS + 1) for c in itertools.combinations(range(16), n)]
            own, self.tables = np.array(self.prints, np.uint64), []
            for block in range(BLOCKS):
                values = (own >> np.uint64(16 * block)).astype(np.uint16)
                reached = (values[:, None] ^ np.array(flips, np.uint16)[None, :]).ravel()
                starts = np.zeros((1 << 16) + 1, np.int32)
                np.cumsum(np.bincount(reached, minlength=1 << 16), out=starts[1:])
                self.tables.append((starts, (np.argsort(reached, kind="stable") // len(flips)).astype(np.int32)))
        return self.tables


class Items:
    """A block of benchmark items, ready to be found in documents."""

    def __init__(self, rows: list[tuple[int, str]], holders: dict[int, int], total: int):
        self.heaviest = self._round(math.log1p(total))
        shared = sorted((h, self._round(math.log1p(total / n))) for h, n in holders.items() if n > 1)
        self.common = np.array([h for h, _ in shared], np.uint64)
        self.common_weights = np.array([w for _, w in shared], np.int64)
        read = sorted(((len(words.hashes), item, words) for item, text in rows if len((words := hash_words([text])).hashes)), key=lambda x: x[:2])
        self.sizes: list[Size] = []
        least = 0
        for n, item, words in read:
            if not self.sizes or n > least * SPREAD or min(SHINGLE_WORDS, n) != self.sizes[-1].width:
                self.sizes.append(Size(min(SHINGLE_WORDS, n)))
                least = n
            size = self.sizes[-1]
            hashes, _ = shingles(words)
            values, counts = np.unique(hashes, return_counts=True)
            size.items.append(item)
            size.counts.append(len(hashes))
            size.shingles.append(dict(zip(values.tolist(), counts.tolist(), strict=True)))
            weights = self.weigh(values)
            size.weights.append(dict(zip(values.tolist(), weights.tolist(), strict=True)))
            size.totals.append(int((weights * counts).sum()))
            sums = running(hashes, self.levels(hashes), 64)
            size.prints.append(int(fingerprints(sums, np.array([0]), np.array([len(hashes)]))[0]))

    @staticmethod
    def _round(weight: float) -> int:
        return max(1, round(weight * UNITS))

    def weigh(self, hashes: np.ndarray) -> np.ndarray:
        """Weights in units; all shingles that at most one item holds weigh the same."""
        out = np.full(len(hashes), self.heaviest, np.int64)
        if len(self.common) and len(hashes):
            at = np.minimum(np.searchsorted(self.common, hashes), len(self.common) - 1)
            out = np.where(self.common[at] == hashes, self.common_weights[at], out)
        return out

    def levels(self, hashes: np.ndarray) -> np.ndarray:
        return self.rounded(self.weigh(hashes))

    def rounded(self, weights: np.ndarray) -> np.ndarray:
        return np.maximum(1, np.rint(weights * LEVELS / self.heaviest)).astype(np.int64)


def running(hashes: np.ndarray, weights: np.ndarray, digits: int) -> tuple[np.ndarray, np.ndarray]:
    """Running sums, from zero, of the weight under each set bit, and of all weight.

    Every bit's sum has `digits` (8, 16 or 64) binary digits of a 64-bit integer. Sums may run over from one bit into the
    next: the difference of two of them is right as long as a window's own weight fits the digits.
    """
    weights = weights.astype(np.uint64)
    together = 64 // digits
    lanes = np.array([sum(1 << (digits * k) for k in range(together) if n >> k & 1) for n in range(1 << together)], np.uint64)
    pieces = hashes.view(np.uint8).reshape(-1, 8)
    if together < 8:
        pieces = np.stack([pieces >> (together * k) for k in range(8 // together)], axis=2).reshape(len(hashes), -1) & ((1 << together) - 1)
    sums = np.zeros((len(hashes) + 1, BITS // together), np.uint64)
    np.cumsum(lanes[pieces] * weights[:, None], axis=0, out=sums[1:])
    return sums, np.concatenate([np.zeros(1, np.uint64), np.cumsum(weights)])


def fingerprints(sums: tuple[np.ndarray, np.ndarray], starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A bit is set where more than half of the window's weight is under set bits."""
    bits, weight = sums
    total = np.take(bits, ends, axis=0)
    total -= np.take(bits, starts, axis=0)
    own = total.view({8: np.uint8, 16: np.uint16, 64: np.uint64}[64 * bits.shape[1] // BITS])
    half = ((weight[ends] - weight[starts]) >> np.uint64(1)).astype(own.dtype)
    return np.packbits(own > half[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def near(size: Size, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All (window, item, distance) within the radius."""
    own = np.array(size.prints, np.uint64)
    windows, items = [], []
    for block, (starts, listed) in enumerate(size.index()):
        value = prints.view(np.uint16)[block::BLOCKS].astype(np.int32)
        counts = np.take(starts, value + 1) - np.take(starts, value)
        hit = np.flatnonzero(counts)
        counts = counts[hit].astype(np.int64)
        windows.append(np.repeat(hit, counts))
        begin = np.repeat(starts[value[hit]] - (np.cumsum(counts) - counts), counts)
        items.append(listed[begin + np.arange(len(begin))])
    window, item = np.concatenate(windows), np.concatenate(items)
    distance = np.bitwise_count(prints[window] ^ own[item])
    keep = distance <= RADIUS
    pair = np.unique(window[keep] * len(own) + item[keep])
    window, item = pair // len(own), pair % len(own)
    return window, item, np.bitwise_count(prints[window] ^ own[item])


def _window_starts(size: Size, offsets: np.ndarray, weights: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first shingle, end) of every window of this size; shingle numbers are those of the whole group.

    A shorter text is one window, if it weighs enough to reach the threshold with the lightest item (`weights` are running sums).
    """
    have, whole = np.diff(offsets), size.count
    step = size.step
    regular = np.where(have >= whole, (have - whole) // step + 1, 0)
    text = np.repeat(np.arange(len(have)), regular)
    first = (np.arange(len(text)) - np.repeat(np.cumsum(regular) - regular, regular)) * step + offsets[:-1][text]
    tail = np.flatnonzero((have >= whole) & ((have - whole) % step != 0))
    short = np.flatnonzero((have < whole) & (have > 0) & (np.diff(weights[offsets]) >= threshold * min(size.totals) - EPSILON))
    return (
        np.concatenate([text, tail, short]),
        np.concatenate([first, offsets[tail + 1] - whole, offsets[short]]),
        np.concatenate([first + whole, offsets[tail + 1], offsets[short + 1]]),
    )


def weighted_similarity(window: np.ndarray, item: dict[int, int], weigh) -> float:
    """Weighted Jaccard similarity of two multisets of shingles: the weights of the lesser over those of the greater numbers."""
    values, counts = np.unique(window, return_counts=True)
    weights = weigh(values).tolist()
    both = either = 0
    for h, n, w in zip(values.tolist(), counts.tolist(), weights, strict=True):
        m = item.get(h, 0)
        both += w * min(n, m)
        either += w * max(n, m)
    seen = set(values.tolist())
    rest = np.array([h for h in item if h not in seen], np.uint64)
    either += sum(w * item[h] for h, w in zip(rest.tolist(), weigh(rest).tolist(), strict=True))
    return both / either if either else 0.0


def find(items: Items, texts: list[str], threshold: float = THRESHOLD) -> dict[tuple[int, int], tuple[float, int, int, int]]:
    """For every text and item whose best window reaches the threshold: similarity, first word, words, bits of distance."""
    best: dict[tuple[int, int], tuple[float, int, int, int]] = {}
    for a, b in groups(texts):
        words = hash_words(texts[a:b])
        for c, d in _word_groups(words):
            part = Words(words.hashes[words.offsets[c] : words.offsets[d]], words.offsets[c : d + 1] - words.offsets[c], words.starts, words.ends)
            for key, value in _find(items, part, threshold).items():
                best[(a + c + key[0], key[1])] = value
    return best


def _word_groups(words: Words) -> Iterator[tuple[int, int]]:
    start = 0
    for i in range(1, len(words.offsets)):
        if i == len(words.offsets) - 1 or words.offsets[i + 1] - words.offsets[start] > WORDS_AT_ONCE:
            yield start, i
            start = i


def _find(items: Items, words: Words, threshold: float) -> dict[tuple[int, int], tuple[float, int, int, int]]:
    best: dict[tuple[int, int], tuple[float, int, int, int]] = {}
    for width in sorted({s.width for s in items.sizes}):
        hashes, offsets = shingles(words, width)
        own_weights = items.weigh(hashes)
        levels, weights = items.rounded(own_weights), np.concatenate([[0], np.cumsum(own_weights)])
        sums: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        tried: set[tuple[int, int, int]] = set()

        def compare(size: Size, i: int, t: int, low: int, high: int, bits: int, hashes=hashes, offsets=offsets, tried=tried, width=width) -> None:
            """Compare an item with the windows of its size that start from `low` to `high`, as far as the text goes."""
            whole, begin, over = size.counts[i], int(offsets[t]), int(offsets[t + 1])
            low = max(low, begin)
            high = max(min(high, over - whole), low)
            weights, needed = size.weights[i], threshold * size.totals[i] - EPSILON
            shared = np.array([weights.get(h, 0) for h in hashes[low : min(high + whole, over)].tolist()], np.int64)
            if shared.sum() < needed:  # cannot reach the threshold whatever the start
                return
            reached = np.concatenate([[0], np.cumsum(shared)])
            starts = np.arange(low, high + 1)
            most = reached[np.minimum(starts + whole, over) - low] - reached[starts - low]
            for start in starts[most >= needed].tolist():
                if (start, id(size), i) in tried:
                    continue
                tried.add((start, id(size), i))
                stop = min(start + whole, over)
                found = weighted_similarity(hashes[start:stop], size.shingles[i], items.weigh)
                key = (t, size.items[i])
                if found >= threshold and (key not in best or (-found, start - begin) < (-best[key][0], best[key][1])):
                    best[key] = (found, start - begin, stop - start + width - 1, bits)

        for size in items.sizes:
            if size.width != width or not len(hashes):
                continue
            digits = next((d for d in (8, 16) if size.count * LEVELS < 1 << d), 64)
            if digits not in sums:
                sums[digits] = running(hashes, levels, digits)
            text, first, end = _window_starts(size, offsets, weights, threshold)
            window, item, distance = near(size, fingerprints(sums[digits], first, end))
            for w, i, bits in zip(window.tolist(), item.tolist(), distance.tolist(), strict=True):
                slack = size.step - 1 + abs(size.counts[i] - size.count)
                compare(size, i, int(text[w]), int(first[w]) - slack, int(first[w]) + slack, bits)
    return best


def _holders(benchmark: DataFrame) -> dict[int, int]:
    """Shingles that several items hold, with the number of holders; at most as many as the items have shingles."""

    @F.pandas_udf("array<bigint>")
    def own(texts: pd.Series) -> pd.Series:
        return pd.Series([np.unique(shingles(hash_words([t]))[0]).view(np.int64) for t in texts], dtype=object)

    listed = benchmark.select(F.explode(own(text_of())).alias("shingle")).groupBy("shingle").agg(F.count(F.lit(1)).alias("n"))
    return {row.shingle % (1 << 64): row.n for row in listed.filter("n > 1").collect()}


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD
) -> DataFrame:
    """One row per document row and benchmark item whose best window reaches the threshold.

    Null texts are empty and match nothing; so do items without words. Items without id are left out. A window of exactly
    the threshold counts; among equally similar windows the first is told. Repeated documents give repeated rows.
    """
    small_batches(docs)
    benchmark = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), text_of().alias("text")).filter("item_id IS NOT NULL")
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_of(text_col).alias("text"))
    numbered = benchmark.withColumn("block", F.pmod(F.hash("item_id"), F.lit(max(1, -(-benchmark.count() // ITEMS_AT_ONCE)))))
    holders, total = _holders(benchmark), benchmark.count()
    out = None
    for (block,) in numbered.select("block").distinct().orderBy("block").collect() or [(0,)]:
        listed = [(r.item_id, r.text) for r in numbered.filter(F.col("block") == block).orderBy("item_id").collect()]
        shared = docs.sparkSession.sparkContext.broadcast(Items(listed, holders, max(1, total)))

        def run(frames: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            for frame in frames:
                ids = frame["doc_id"].tolist()
                found = find(shared.value, frame["text"].tolist(), threshold)
                made = [(ids[t], item, *value) for (t, item), value in found.items()]
                yield pd.DataFrame(made, columns=["doc_id", "item_id", "similarity", "first_word", "n_words", "distance"])

        part = rows.mapInPandas(run, RESULT)
        out = part if out is None else out.unionByName(part)
    return out


def without_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The documents that hold no benchmark item, with their columns. Every row is judged by its own text, whatever its id."""
    key = absent(docs, "__text")
    keyed = docs.withColumn(key, F.xxhash64(text_of(text_col)))
    bad = contaminated(keyed, benchmark, key, text_col, **options).select(F.col("doc_id").alias(key)).distinct()
    return keyed.join(bad, key, "left_anti").drop(key)
