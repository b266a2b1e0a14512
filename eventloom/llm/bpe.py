"""Byte-level BPE over documents of any length, by overlapping chunks; and decoding.

A pre-token is a match of the tokenizer's pattern. Matching looks only forward, so two scans of the same text that both
begin a pre-token at the same place agree from there on. Documents longer than `CHUNK` characters are cut into chunks that
overlap, the chunks are dealt over the cluster and scanned side by side, and each document's scans are stitched where a
boundary of one chunk is also a boundary of the next. Where the overlap has no common boundary (a pre-token longer than the
overlap), the text is scanned on from the last agreed boundary until it meets a boundary of the next chunk. Then the pieces
are encoded; equal pieces are encoded once per worker. Decoding concatenates the tokens' bytes.

A document of one chunk is cut at simpler boundaries: a space before a character that is no white space always begins a
pre-token, so the text between such spaces is a piece, whose pre-tokens the tokenizer finds by itself.

The vocabulary is a rank file; its content (bounded by the vocabulary, not by the data) is sent to the executors.
"""

from __future__ import annotations

import base64
import functools
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.llm.common import small_batches, text_of
from eventloom.llm.pieces import PieceCache
from eventloom.llm.words import groups

CHUNK = 16_384
OVERLAP = 512
CACHED = 300_000  # pieces a worker remembers; some 60 MB
TOGETHER = 256


class Codec:
    """Encodes and decodes pieces by a rank file."""

    def __init__(self, ranks: bytes, pattern: str):
        import regex
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
        self.pattern = regex.compile(pattern)
        self.bytes_of = {rank: token for token, rank in table.items()}
        self.sizes = np.zeros(max(self.bytes_of) + 1, np.int64)
        self.sizes[list(self.bytes_of)] = [len(token) for token in self.bytes_of.values()]
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.cache = PieceCache(self.encode_new)

    def encode_new(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Pieces that begin with a space and a word are encoded many to a call; the tokens' bytes tell where each one ends."""
        joint = np.array([len(p) > 1 and p[0] == " " and not p[1].isspace() for p in pieces], bool)
        alone = [np.array(self.encoding.encode_ordinary(p), np.uint32) for p, j in zip(pieces, joint.tolist(), strict=True) if not j]
        some = list(itertools.compress(pieces, joint.tolist()))
        together = [self.encoding.encode_ordinary("".join(some[i : i + TOGETHER])) for i in range(0, len(some), TOGETHER)]
        flat = np.fromiter(itertools.chain.from_iterable(together), np.uint32)
        token_ends = np.cumsum(self.sizes[flat])
        piece_ends = np.cumsum(np.fromiter((len(p.encode()) for p in some), np.int64, len(some)))
        ends = np.searchsorted(token_ends, piece_ends, "left") + 1
        lengths = np.zeros(len(pieces), np.int64)
        lengths[joint], lengths[~joint] = np.diff(ends, prepend=0), [len(a) for a in alone]
        which = np.repeat(joint, lengths)
        out = np.zeros(int(lengths.sum()), np.uint32)
        out[which], out[~which] = flat, np.concatenate([np.zeros(0, np.uint32), *alone])
        return out, lengths

    def encode(self, texts: list[list[str]]) -> Iterator[np.ndarray]:
        """The ids of texts given as pieces that begin and end at boundaries of pre-tokens."""
        if len(self.cache) > CACHED:
            self.cache = PieceCache(self.encode_new)
        yield from self.cache.encode(texts)

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@functools.lru_cache(2)
def _codec(ranks: bytes, pattern: str) -> Codec:
    return Codec(ranks, pattern)


INSIDE = re.compile(r" (?!\S)")
BEFORE_WORD = re.compile(r" (?=\S)")


def spaced(text: str) -> list[str]:
    """The pieces of a text between spaces that begin a pre-token; each but the first keeps its space."""
    parts = BEFORE_WORD.split(text) if INSIDE.search(text) else text.split(" ")
    return [parts[0], *[" " + p for p in parts[1:]]]


class Vocabulary:
    """A rank file and its pattern, as the executors see them."""

    def __init__(self, spark: SparkSession, path: str, pattern: str):
        with open(path, "rb") as f:
            self.shared = spark.sparkContext.broadcast((f.read(), pattern))

    def codec(self) -> Codec:
        return _codec(*self.shared.value)

    def __getstate__(self) -> dict:
        return self.__dict__


def boundaries(codec: Codec, text: str, start: int, last: bool) -> np.ndarray:
    """The ends of the pre-tokens of a chunk that begins at `start`; an end that the cut may have made is left out."""
    ends = np.cumsum([len(p) for p in codec.pattern.findall(text)], dtype=np.int64)
    if not last:  # the last match touches the cut, and the one before may have looked past it
        ends = ends[:-2]
    return ends + start


def stitch(codec: Codec, text: str, scans: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """The pre-token ends of a whole text, from the scans (start, ends) of its chunks in order."""
    kept = [scans[0][1]]
    at = int(kept[0][-1]) if len(kept[0]) else 0
    for start, ends in scans[1:]:
        own = np.concatenate([[start], ends]) if start else ends  # the chunk's start is a boundary only if the scan before has it
        own = own[1:] if start and not np.isin(start, kept[-1]) else own
        both = np.intersect1d(kept[-1], own, assume_unique=True)
        both = both[both >= start]
        if len(both):
            meet = int(both[0])
            kept[-1] = kept[-1][kept[-1] <= meet]
        else:
            meet, more, places = at, [], set(own.tolist())
            for match in codec.pattern.finditer(text, at):
                meet = match.end()
                more.append(meet)
                if meet in places:
                    break
            kept.append(np.array(more, np.int64))
        kept.append(ends[ends > meet])
        if len(kept[-1]):
            at = int(kept[-1][-1])
        else:
            kept.pop()
            at = meet
    return np.concatenate(kept)


def _long(docs: DataFrame, vocabulary: Vocabulary, chunk: int, overlap: int, raw: bool) -> DataFrame:
    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                starts = list(range(0, max(1, len(row.text) - overlap), chunk))
                yield pd.DataFrame(
                    {
                        "doc_id": pd.array([None if pd.isna(row.doc_id) else int(row.doc_id)] * len(starts), "Int64"),
                        "content": row.content,
                        "start": starts,
                        "last": [s == starts[-1] for s in starts],
                        "piece": [row.text[s : (None if s == starts[-1] else s + chunk + overlap)] for s in starts],
                    }
                )

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = vocabulary.codec()
        for frame in frames:
            ends = [boundaries(codec, *row) for row in zip(frame["piece"], frame["start"], frame["last"], strict=True)]
            yield frame.assign(ends=pd.Series(ends, dtype=object))

    def join(frame: pd.DataFrame) -> pd.DataFrame:
        codec = vocabulary.codec()
        frame = frame.sort_values("start", kind="stable")
        copies = int((frame["start"] == 0).sum())
        frame = frame.iloc[::copies]
        text, scans = "", []
        for row in frame.itertuples(index=False):
            text = text[: row.start] + row.piece
            scans.append((row.start, np.asarray(row.ends, np.int64)))
        ends = stitch(codec, text, scans)
        begin = np.concatenate([[0], ends[:-1]]).tolist()
        (ids,) = codec.encode([[text[a:b] for a, b in zip(begin, ends.tolist(), strict=True)]])
        own = frame["doc_id"].iloc[0]
        made = {"doc_id": pd.array([None if pd.isna(own) else int(own)] * copies, "Int64"), "ids": [ids.astype(np.int32)] * copies}
        return pd.DataFrame(made | ({"raw": [codec.decode(ids.tolist())] * copies} if raw else {}))

    shape = "doc_id bigint, content string, start int, last boolean, piece string"
    chunks = docs.withColumn("content", F.md5("text")).mapInPandas(cut, shape).repartition("doc_id", "content", "start")
    scanned = chunks.mapInPandas(scan, f"{shape}, ends array<bigint>")
    return scanned.groupBy("doc_id", "content").applyInPandas(join, "doc_id bigint, ids array<int>" + ", raw binary" * raw)


def encode(
    docs: DataFrame,
    vocabulary: Vocabulary,
    id_col: str = "doc_id",
    text_col: str = "text",
    chunk: int = CHUNK,
    overlap: int = OVERLAP,
    raw: bool = False,
) -> DataFrame:
    """(doc_id, ids) for every row of `docs`. A null text is empty and has no ids; rows repeated in every way stay.

    With `raw`, a further column has the bytes that the ids decode to, from the same pass over them; `decoded` in a step of
    its own would start a second Python worker for every task.
    """
    small_batches(docs)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_of(text_col).alias("text"))

    @F.pandas_udf("ids array<int>" + ", raw binary" * raw)
    def whole(frames: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        codec = vocabulary.codec()
        for texts in frames:
            rows, made = texts.tolist(), []
            for a, b in groups(rows):
                made += [ids.astype(np.int32) for ids in codec.encode([spaced(t) for t in rows[a:b]])]
            out = {"ids": pd.Series(made, dtype=object)}
            yield pd.DataFrame(out | ({"raw": pd.Series([codec.decode(ids.tolist()) for ids in made], dtype=object)} if raw else {}))

    short = rows.filter(F.char_length("text") <= chunk).select("doc_id", whole("text").alias("made")).select("doc_id", "made.*")
    return short.unionByName(_long(rows.filter(F.char_length("text") > chunk), vocabulary, chunk, overlap, raw))


def decoded(vocabulary: Vocabulary, ids: Column) -> Column:
    """The bytes of an array of ids; null for null."""

    @F.pandas_udf("binary")
    def run(frames: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = vocabulary.codec()
        for lists in frames:
            yield pd.Series([None if x is None else codec.decode(np.asarray(x).tolist()) for x in lists], dtype=object)

    return run(ids)


def digests(encoded: DataFrame, *kept: str) -> DataFrame:
    """Per document of `encode(..., raw=True)` the number of ids, and the SHA-256 of the ids as text and of the decoded bytes.

    The columns named by `kept` come after them.
    """
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return encoded.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(ids, 256).alias("ids_sha256"),
        F.sha2("raw", 256).alias("decoded_sha256"),
        *kept,
    )
