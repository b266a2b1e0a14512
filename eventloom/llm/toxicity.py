"""Toxicity scores of texts: gradient-boosted trees over dense features, with isotonic calibration.

Three disjoint parts of the labelled training rows are used: one for the lexicon, one for the trees, one for calibration.

The lexicon is learned: words, and beginnings of four and five letters of longer words, that toxic texts of the first part
hold more often than chance explains. A term counts by the number of different words it follows, so a word that only
copies of one passage repeat is not taken for an insult.

Features of a text: densities of lexicon words and beginnings, the same after undoing obfuscation (digits and signs for
letters, stretched letters, letters set apart), hits near a second-person word, capitals, punctuation, obfuscation rates,
and length. Language, source and id are not used.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.llm import trees
from eventloom.llm.common import held_out, small_batches, text_of, written

TRAIN_ROWS = 24_000  # labelled rows to learn from, at most (chosen by a hash of the id)
HELD_OUT = 0
LEAST_TOXIC = 25
NEAR = 4  # words on either side of a second-person word
LEAST = 3  # different preceding words that a term needs
LEAST_SHARE = 0.5  # of a term's texts that must be toxic
EVIDENCE = 1.3  # log likelihood ratio that a term needs, for each unit of the logarithm of the number of texts
CALIBRATED_SHARE = 0.98  # of the score; the rest keeps the order of equal calibrated scores

WORD = re.compile(r"[^\W_]+(?:[@$!*#.\-_0-9]+[^\W_]+)*[@$*#0-9]*", re.UNICODE)
APART = re.compile(r"\b(?:[^\W\d_][ .\-*_]){3,}[^\W\d_]\b")
STRETCHED = re.compile(r"(.)\1{2,}")
INNER = re.compile(r"[^\W\d_][@$!*#0-9._\-]+[^\W\d_]")
# fixed values: signs written for letters
LETTERS = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i"})
# fixed values: second-person words of English, German, French and Spanish
SECOND = frozenset(
    "you your yours yourself u ur du dich dir dein deine deiner deinem deinen ihr euch euer tu te toi ton ta tes vous votre vos "
    "tú ti tuyo tuya usted ustedes vosotros vosotras vuestro vuestra".split()
)
FEATURES = 18


def plain(word: str) -> str:
    """The word without obfuscation; itself if there is none."""
    if word.isalpha() and not STRETCHED.search(word):
        return word
    word = word.translate(LETTERS) if not word.isdigit() else word
    return STRETCHED.sub(r"\1", re.sub(r"[^\w]|_", "", word))


def terms(word: str) -> tuple[str, ...]:
    """What the lexicon may hold of a word: itself, and the beginnings of a longer one, marked by a star."""
    return (word, f"{word[:4]}*", f"{word[:5]}*") if len(word) > 5 else (word,)


@dataclass(frozen=True)
class Lexicon:
    words: frozenset[str]
    beginnings: frozenset[str]

    def hit(self, word: str) -> int:
        """2 for a word of the lexicon, 1 for a word with a beginning of the lexicon, else 0."""
        if word in self.words:
            return 2
        return int(len(word) > 5 and (word[:4] in self.beginnings or word[:5] in self.beginnings))


def split_words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def features(text: str, lexicon: Lexicon) -> list[float]:
    raw = WORD.findall(text)
    words = [w.lower() for w in raw]
    n, chars = len(words), max(1, len(text))
    hits = {w: lexicon.hit(w) for w in set(words)}
    odd = {w: lexicon.hit(plain(w)) for w, h in hits.items() if not h and not w.isdigit() and (not w.isalpha() or STRETCHED.search(w))}
    strong = [i for i, w in enumerate(words) if hits[w] == 2]
    weak = [i for i, w in enumerate(words) if hits[w] == 1]
    hidden = [i for i, w in enumerate(words) if odd.get(w)]
    apart = sum(1 for m in APART.findall(text) if lexicon.hit(re.sub(r"[^\w]|_", "", m).lower()))
    second = np.array([i for i, w in enumerate(words) if w in SECOND])
    at = np.array(sorted(strong + weak + hidden))
    close = 0
    if len(second) and len(at):
        where = np.searchsorted(second, at)
        before = at - second[np.maximum(where - 1, 0)]
        after = second[np.minimum(where, len(second) - 1)] - at
        close = int(((np.abs(before) <= NEAR) | (np.abs(after) <= NEAR)).sum())
    per = 1 / max(1, n)
    letters = max(1, sum(map(str.isalpha, text)))
    return [
        float(len(strong)),
        len(strong) * per,
        float(len({words[i] for i in strong})),
        float(len(weak)),
        len(weak) * per,
        float(len({words[i] for i in weak})),
        float(len(hidden) + apart),
        (len(hidden) + apart) * per,
        float(close),
        close * per,
        len(second) * per,
        sum(map(str.isupper, text)) / letters,
        sum(1 for w in raw if len(w) > 2 and w.isupper()) * per,
        text.count("!") / chars,
        (chars - letters - text.count(" ")) / chars,
        len(INNER.findall(text)) * per,
        len(STRETCHED.findall(text)) / chars,
        float(np.log1p(n)),
    ]


@dataclass(frozen=True)
class Model:
    lexicon: Lexicon
    ensemble: trees.Ensemble
    scores: np.ndarray
    levels: np.ndarray

    def score(self, texts: list[str]) -> np.ndarray:
        rows = np.array([features(t, self.lexicon) for t in texts]).reshape(-1, FEATURES)
        raw = self.ensemble.probability(rows)
        return CALIBRATED_SHARE * np.interp(raw, self.scores, self.levels) + (1 - CALIBRATED_SHARE) * raw


def _lexicon(rows: DataFrame) -> Lexicon:
    """Terms whose contexts (different preceding words) lie in toxic texts far more often than in clean ones."""

    def contexts(frames: Iterator[pd.DataFrame], wanted: frozenset[str] | None = None) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts: Counter = Counter()
            pairs: set[tuple[str, str]] = set()
            for text, label in zip(frame["text"], frame["label"], strict=True):
                words = [plain(w) for w in split_words(text)]
                if wanted is None:
                    texts.update((t, int(label)) for w in set(words) for t in terms(w))
                else:
                    before = ["", *words]
                    pairs.update((t, b) for b, w in zip(before, words, strict=False) for t in terms(w) if t in wanted)
            if wanted is None:
                made = [(t, n if label else 0, 0 if label else n) for (t, label), n in texts.items()]
                yield pd.DataFrame(made, columns=["term", "toxic", "clean"])
            else:
                yield pd.DataFrame(list(pairs), columns=["term", "before"])

    totals = {int(r["label"]): r["count"] for r in rows.groupBy("label").count().collect()}
    counted = rows.mapInPandas(contexts, "term string, toxic bigint, clean bigint").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    toxic, clean = F.col("toxic"), F.col("clean")
    rate = totals.get(1, 0) / max(1, sum(totals.values()))
    expected = (toxic + clean) * rate
    # log likelihood ratio of the term's own share of toxic texts against the share of all texts
    ratio = toxic * F.log(toxic / expected) + F.when(clean > 0, clean * F.log(clean / (toxic + clean - expected))).otherwise(0.0)
    likely = frozenset(r.term for r in counted.filter((toxic >= LEAST) & (toxic > expected) & (ratio >= EVIDENCE * math.log(1 + sum(totals.values()))) & (toxic >= LEAST_SHARE * (toxic + clean))).select("term").collect())
    pairs = rows.filter("label = 1").mapInPandas(lambda frames: contexts(frames, likely), "term string, before string").distinct()
    contexts_of = pairs.groupBy("term").count().filter(F.col("count") >= LEAST).join(counted, "term")
    found = [r.term for r in contexts_of.filter(F.col("count") >= 0.5 * F.col("toxic")).select("term").collect()]
    return Lexicon(frozenset(t for t in found if t[-1] != "*"), frozenset(t[:-1] for t in found if t[-1] == "*"))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = TRAIN_ROWS, training: Column | None = None) -> Model:
    """Learn from labelled rows outside the held-out fold; `rows` of them at most.

    Labels other than 0 and 1, null labels and null ids are left out. If a part would have fewer than 25 toxic rows,
    all parts use all training rows. With one label only, every score is that label.
    """
    small_batches(docs)
    labels = labels.filter("toxic IN (0, 1)").select(F.col("doc_id").alias("__id"), F.col("toxic").cast("double").alias("label"))
    labels = labels.filter(~held_out(HELD_OUT, "__id") if training is None else training)
    labels = labels.groupBy("__id").agg(F.max("label").alias("label"))
    total = max(1, labels.count())
    part = F.pmod(F.xxhash64("__id"), F.lit(1_000_000))
    labels = labels.filter(part < 1_000_000 * rows // total) if total > rows else labels
    found = docs.select(F.col(id_col).alias("__doc"), text_of(text_col).alias("text")).join(labels, F.col("__doc") == F.col("__id"))
    found = written(found.select("text", "label", F.pmod(F.xxhash64("__id", F.lit(1)), F.lit(10)).alias("part")), "toxicity-rows")
    parts = [F.col("part") < 4, (F.col("part") >= 4) & (F.col("part") < 8), F.col("part") >= 8]
    fewest = found.filter("label = 1").agg(*[F.count_if(p) for p in parts]).first()
    if min(fewest) < LEAST_TOXIC:
        parts = [F.lit(True)] * 3
    lexicon = _lexicon(found.filter(parts[0]).select("text", "label"))

    def described(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"features": [features(t, lexicon) for t in frame["text"]], "label": frame["label"], "part": frame["part"]})

    table = written(found.repartition(8).mapInPandas(described, "features array<double>, label double, part bigint"), "toxicity-features")
    ensemble = trees.fit(table.filter(parts[1]).select("features", "label"))

    def scored(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"score": ensemble.probability(np.stack(frame["features"].to_numpy())), "label": frame["label"]})

    scores, levels = trees.calibrate(table.filter(parts[2]).select("features", "label").mapInPandas(scored, "score double, label double"))
    return Model(lexicon, ensemble, scores, levels)


def score_column(model: Model, docs: DataFrame, text: Column) -> Column:
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(frames: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in frames:
            yield pd.Series(shared.value.score(texts.tolist()))

    return score(text)


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of `docs`; a null text is scored as an empty one."""
    model = train(docs, labels, id_col, text_col, **options)
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(HELD_OUT, id_col).alias("held_out"), score_column(model, docs, text_of(text_col)).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def without_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of `docs` that score below one half, with their columns."""
    model = train(docs, labels, id_col, text_col, **options)
    return docs.filter(score_column(model, docs, text_of(text_col)) < 0.5)
