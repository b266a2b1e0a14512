"""Language-model scores by a weighted backoff automaton.

The model has a state for every word that occurs as a context (and one for the beginning of a text). A state has an arc for
each word that followed it in training; its weight is the word's smoothed probability there. Every state also has a failure
arc to the empty state, weighted by the probability mass that discounting has set aside; the empty state has an arc for
every word. Reading a word follows the state's own arc, or else the failure arc and then the empty state's arc, and leads to
the word's state. A text is read once from left to right and its log probabilities are added up.

Smoothing is interpolated absolute discounting: with c the count of a pair, C of its context, T the number of different
words after it and d the discount n1 / (n1 + 2 n2) of pairs seen once and twice,

    arc      (c - d) / C + (d T / C) p(word)          failure arc   d T / C
    p(word)  (count + 1/2) / (N + (V + 1) / 2)        N tokens, V different ones

so the probabilities of a state add up to one, unknown words taken as one word.

Nothing is pruned and the model is never gathered in one place. Texts are dealt into groups of bounded size. A group
sends the pairs that it needs, with their own training counts, to the tasks that own them (ranges of pairs in the order
of context and follower); each owner adds up the counts and answers every group with the counts of exactly those pairs; the
group builds the part of the automaton that its texts can reach. Requests and answers are arrays, one row for a group and
range. The ranges are cut between pairs, at equal shares of the requests of a few groups, so a context with many followers
is dealt over several owners. Its count and its number of followers are then sums over them; as a cut lies in one context
at most, there are fewer such contexts than ranges. The cuts decide who adds up what, never the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import held_out, small_batches, text_of, written
from eventloom.llm.words import groups, hash_tokens, mix

HELD_OUT = 1
GROUP_SIZE = 8_000_000  # characters of a group of texts
RANGE_SIZE = 24_000_000  # characters of all texts for one range of pairs
SAMPLE_GROUPS = 4  # groups whose requests show where to cut
POINTS = 8  # places of a sampled group for each range
BEGIN, END = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
FOLLOWER_BYTES = 6
RESULT = (
    "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, types bigint"
)


class Pairs:
    """The (context, word) pairs of a group of texts.

    `words` are the different words' hashes in ascending order, `context` and `follower` their numbers at every token, and
    `pairs` the different pairs, ordered by context; `pair` is the pair's number at every token.
    """

    def __init__(self, texts: list[str], training: np.ndarray):
        lower = [t.encode().lower().decode() for t in texts]  # bytes: A-Z only
        hashes, sizes = [], []
        for a, b in groups(lower):
            found = hash_tokens(lower[a:b])
            hashes.append(found.hashes)
            sizes.append(np.diff(found.offsets))
        flat = np.concatenate([np.zeros(0, np.uint64), *hashes])
        self.tokens = np.concatenate([np.zeros(0, np.int64), *sizes]) + 1
        self.begins = np.cumsum(self.tokens) - self.tokens
        follower = np.full(int(self.tokens.sum()), END, np.uint64)
        inner = np.ones(len(follower), bool)
        inner[self.begins + self.tokens - 1] = False
        follower[inner] = flat
        context = np.concatenate([[BEGIN], follower[:-1]])[: len(follower)]
        context[self.begins] = BEGIN
        self.words, numbers = np.unique(np.concatenate([follower, [BEGIN]]), return_inverse=True)
        self.follower = numbers[:-1]
        self.context = np.concatenate([[0], self.follower[:-1]])[: len(follower)]
        self.context[self.begins] = numbers[-1]
        self.training = np.repeat(training, self.tokens)
        self.pairs, self.pair = np.unique(self.context * len(self.words) + self.follower, return_inverse=True)
        self.pair_context = self.pairs // len(self.words)

    def slices(self, cuts: Cuts) -> Iterator[tuple[int, int, int, int, int, int]]:
        """(range, a, b, c, d, first): words a to b are at home in the range and pairs c to d lie in it.

        `first` is a, or a - 1 if the pairs begin with those of a context that is at home in an earlier range.
        """
        size, full = len(self.words), len(self.pairs)
        at = np.searchsorted(self.words, cuts.contexts)
        met = self.words[np.minimum(at, size - 1)] == cuts.contexts
        places = np.searchsorted(self.pairs, at * size + np.where(met, np.searchsorted(self.words, cuts.followers), 0))
        homes = at + (met & (cuts.followers > 0))
        homes, places = np.concatenate([[0], homes, [size]]), np.concatenate([[0], places, [full]])
        for r in range(len(homes) - 1):
            (a, b), (c, d) = homes[r : r + 2].tolist(), places[r : r + 2].tolist()
            first = min(a, int(self.pair_context[c])) if c < d else a
            if first < b:
                yield r, a, b, c, d, first

    def requests(self, cuts: Cuts) -> Iterator[dict]:
        """For each range of pairs: their contexts and training counts, and each one's followers with the pairs' training counts."""
        counts = np.bincount(self.follower, self.training, len(self.words)).astype(np.int64)
        counts[np.searchsorted(self.words, BEGIN)] = 0
        pair_counts = np.bincount(self.pair, self.training, len(self.pairs)).astype(np.int64)
        followers = self.words[self.pairs % len(self.words)]
        for r, a, b, c, d, first in self.slices(cuts):
            own = counts[first:b].copy()
            own[: a - first] = 0  # told at home
            yield {
                "part": r,
                "words": self.words[first:b].tobytes(),
                "counts": packed(own),
                "fans": packed(np.bincount(self.pair_context[c:d] - first, minlength=b - first)),
                "followers": followers[c:d].view(np.uint8).reshape(-1, 8)[:, :FOLLOWER_BYTES].tobytes(),
                "pairs": packed(pair_counts[c:d]),
            }

    def points(self, most: int) -> dict:
        """At most about `most` pairs at equal distances, and the distance."""
        step = max(1, len(self.pairs) // most)
        chosen = self.pairs[step // 2 :: step]
        return {"contexts": self.words[chosen // len(self.words)].tobytes(), "followers": self.words[chosen % len(self.words)].tobytes(), "step": step}


@dataclass(frozen=True)
class Cuts:
    """The first pairs of all ranges but the first, by the hashes of context and follower in ascending order."""

    contexts: np.ndarray
    followers: np.ndarray

    def split(self) -> np.ndarray:
        """The contexts whose pairs may lie in several ranges."""
        return np.unique(self.contexts[self.followers > 0])


def cuts_of(points: list, ranges: int) -> Cuts:
    """Cuts at equal shares of the points of some groups."""
    contexts = np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(p["contexts"], "<u8") for p in points)])
    followers = np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(p["followers"], "<u8") for p in points)])
    weights = np.concatenate([np.zeros(0), *(np.full(len(p["contexts"]) // 8, p["step"], float) for p in points)])
    order = np.lexsort((followers, contexts))
    if not len(order) or ranges < 2:
        return Cuts(np.zeros(0, np.uint64), np.zeros(0, np.uint64))
    reached = np.cumsum(weights[order])
    chosen = order[np.minimum(np.searchsorted(reached, reached[-1] * np.arange(1, ranges) / ranges), len(order) - 1)]
    contexts, followers = contexts[chosen], followers[chosen]
    new = np.concatenate([[True], (contexts[1:] != contexts[:-1]) | (followers[1:] != followers[:-1])])
    return Cuts(contexts[new], followers[new])


POINT = "contexts binary, followers binary, step bigint"
REQUEST = "grp bigint, part int, words binary, counts binary, fans binary, followers binary, pairs binary"
ANSWER = "grp bigint, part int, counts binary, totals binary, fans binary, pairs binary, tokens bigint, types bigint, once bigint, twice bigint, split binary"


def packed(values: np.ndarray) -> bytes:
    """Counts in the fewest bytes that hold the largest of them (1, 2, 4 or 8)."""
    most = int(values.max()) if len(values) else 0
    return values.astype(next(k for k in ("<u1", "<u2", "<u4", "<u8") if most < 1 << 8 * int(k[2]))).tobytes()


def unpacked(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, f"<u{len(data) // n}").astype(np.int64) if n else np.zeros(0, np.int64)


def answer(rows: pd.DataFrame, split: np.ndarray) -> pd.DataFrame:
    """Add up the requests of one range and answer each of them.

    For the contexts of `split`, the count and the number of followers are this range's share; the first row tells them.
    """
    words = [np.frombuffer(w, "<u8") for w in rows["words"]]
    sizes = [len(w) for w in words]
    counts = np.concatenate([unpacked(c, n) for c, n in zip(rows["counts"], sizes, strict=True)])
    fans = np.concatenate([unpacked(f, n) for f, n in zip(rows["fans"], sizes, strict=True)])
    spread = [len(f) // FOLLOWER_BYTES for f in rows["followers"]]
    pair_counts = np.concatenate([unpacked(p, n) for p, n in zip(rows["pairs"], spread, strict=True)])
    short = np.frombuffer(b"".join(rows["followers"]), np.uint8).reshape(-1, FOLLOWER_BYTES)
    followers = np.zeros((len(short), 8), np.uint8)
    followers[:, :FOLLOWER_BYTES] = short
    followers = followers.view(np.uint64).ravel()
    known, word = np.unique(np.concatenate(words), return_inverse=True)
    context = np.repeat(word, fans)
    with np.errstate(over="ignore"):
        keys = mix(known[context] + mix(followers + np.uint64(1)))
    _, first, pair = np.unique(keys, return_index=True, return_inverse=True)
    # two words of one range with one hash, or two pairs with one key, would be taken for one
    pair_totals = np.bincount(pair, pair_counts, len(first)).astype(np.int64)
    totals = np.bincount(word, counts, len(known)).astype(np.int64)
    seen = pair_totals > 0
    as_context = np.bincount(context[first], pair_totals, len(known)).astype(np.int64)
    different = np.bincount(context[first][seen], minlength=len(known))
    word_cuts, pair_cuts = np.cumsum([0, *sizes]), np.cumsum([0, *spread])
    out = []
    for i in range(len(rows)):
        own, of_pairs = word[word_cuts[i] : word_cuts[i + 1]], pair[pair_cuts[i] : pair_cuts[i + 1]]
        out.append((packed(totals[own]), packed(as_context[own]), packed(different[own]), packed(pair_totals[of_pairs])))
    made = pd.DataFrame(out, columns=["counts", "totals", "fans", "pairs"])
    only = np.arange(len(rows)) == 0  # a range's own sums, told once
    sums = {"tokens": totals.sum(), "types": (totals > 0).sum(), "once": (pair_totals == 1).sum(), "twice": (pair_totals == 2).sum()}
    made = made.assign(**{k: np.where(only, int(v), 0) for k, v in sums.items()})
    shares = np.isin(known, split)
    told = np.stack([known[shares], as_context[shares].astype(np.uint64), different[shares].astype(np.uint64)], axis=1)
    made["split"] = [told.tobytes() if i == 0 else b"" for i in range(len(rows))]
    return pd.concat([rows[["grp", "part"]].reset_index(drop=True), made], axis=1)


def whole_contexts(shares: list[bytes]) -> np.ndarray:
    """(context, count, different followers) of the contexts that lie in several ranges, in ascending order."""
    rows = np.frombuffer(b"".join(shares), "<u8").reshape(-1, 3)
    known, place = np.unique(rows[:, 0], return_inverse=True)
    out = np.zeros((len(known), 3), np.uint64)
    out[:, 0] = known
    np.add.at(out[:, 1:], place, rows[:, 1:])
    return out


class Automaton:
    """The states and arcs that a group of texts can reach."""

    def __init__(self, pairs: Pairs, answers: pd.DataFrame, cuts: Cuts, split: np.ndarray, tokens: int, types: int, discount: float):
        slices, found = list(pairs.slices(cuts)), [[], [], [], []]
        for (part, a, b, c, d, first), row in zip(slices, answers.sort_values("part").to_dict("records"), strict=True):
            assert part == row["part"]
            for values, name in zip(found[:3], ("counts", "totals", "fans"), strict=True):
                values.append(unpacked(row[name], b - first)[a - first :])
            found[3].append(unpacked(row["pairs"], d - c))
        self.counts, context, fans, arcs = (np.concatenate(values) for values in found)
        at = np.searchsorted(split[:, 0], pairs.words)
        met = np.flatnonzero(at < len(split))
        met = met[split[at[met], 0] == pairs.words[met]]
        context[met], fans[met] = split[at[met], 1], split[at[met], 2]
        self.word = np.log10((self.counts + 0.5) / (tokens + 0.5 * (types + 1)))
        share = np.where(context > 0, discount * fans / np.maximum(context, 1), 1.0)
        self.failure = np.log10(np.where(share > 0, share, 1.0))
        plain = 10 ** self.word[pairs.pairs % len(pairs.words)]
        own = np.maximum(arcs - discount, 0) / np.maximum(context[pairs.pair_context], 1) + share[pairs.pair_context] * plain
        self.arc = np.where(arcs > 0, np.log10(np.where(own > 0, own, 1.0)), np.nan)

    def read(self, pairs: Pairs) -> np.ndarray:
        """The log10 probability of every token: its state's own arc, or the failure arc and the empty state's arc."""
        own = self.arc[pairs.pair]
        return np.where(np.isnan(own), self.failure[pairs.context] + self.word[pairs.follower], own)


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", training: Column | None = None, group: int = GROUP_SIZE, span: int = RANGE_SIZE) -> DataFrame:
    """Score every row of `docs` by the model of the training rows (by default those outside the held-out fold).

    A null text is empty: it has one token, the end. Rows with equal id and text are scored each; a null id is in fold 0.
    Without training rows all scores are zero.
    """
    small_batches(docs)
    out = held_out(HELD_OUT, id_col) if training is None else ~training
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_of(text_col).alias("text"), out.alias("held_out"))
    chars = rows.agg(F.sum(F.char_length("text"))).first()[0] or 0
    n_groups, ranges = int(max(1, -(-chars // group))), int(max(1, -(-chars // span)))
    rows = rows.withColumn("grp", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_groups)))

    def look(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([Pairs(frame["text"].tolist(), np.zeros(len(frame), bool)).points(POINTS * ranges)])

    points = []
    if ranges > 1:
        some = [r.grp for r in rows.select("grp").distinct().orderBy("grp").limit(SAMPLE_GROUPS).collect()]
        points = rows.filter(F.col("grp").isin(some)).groupBy("grp").applyInPandas(look, POINT).collect()
    cuts = cuts_of(points, ranges)
    inside = cuts.split()

    def ask(frame: pd.DataFrame) -> pd.DataFrame:
        pairs = Pairs(frame["text"].tolist(), ~frame["held_out"].to_numpy(bool))
        return pd.DataFrame(list(pairs.requests(cuts))).assign(grp=frame["grp"].iloc[0])

    requests = rows.groupBy("grp").applyInPandas(ask, REQUEST)
    answers = written(requests.groupBy("part").applyInPandas(lambda frame: answer(frame, inside), ANSWER), "lm-answers")
    split = whole_contexts([bytes(r.split) for r in answers.filter(F.length("split") > 0).select("split").collect()])
    sums = answers.agg(*[F.sum(c).alias(c) for c in ("tokens", "types", "once", "twice")]).first()
    tokens, types = sums.tokens or 0, sums.types or 0
    discount = min(0.95, max(0.1, (sums.once or 0) / max(1, (sums.once or 0) + 2 * (sums.twice or 0))))

    def traverse(frame: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        if not len(frame):
            return pd.DataFrame(columns=[c.split()[0] for c in RESULT.split(", ")])
        training = ~frame["held_out"].to_numpy(bool)
        pairs = Pairs(frame["text"].tolist(), training)
        automaton = Automaton(pairs, answers, cuts, split, tokens, types, discount)
        return pd.DataFrame(
            {
                "doc_id": frame["doc_id"].astype("Int64"),
                "held_out": ~training,
                "n_tokens": pairs.tokens,
                "n_known": np.add.reduceat((automaton.counts[pairs.follower] > 0).astype(np.int64), pairs.begins),
                "train_tokens": tokens,
                "base_score": np.add.reduceat(automaton.word[pairs.follower], pairs.begins),
                "score": np.add.reduceat(automaton.read(pairs), pairs.begins),
                "types": types,
            }
        )

    return rows.groupBy("grp").cogroup(answers.groupBy("grp")).applyInPandas(traverse, RESULT)
