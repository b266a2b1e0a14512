"""Token ids as length-delimited binary records with masked checksums, and a separate offset index.

A data file is a sequence of records, each

    length  unsigned 64-bit   bytes of the payload
    check   unsigned 32-bit   masked CRC-32 of the eight length bytes
    payload
    check   unsigned 32-bit   masked CRC-32 of the payload

all little-endian; masking rotates the CRC right by 15 bits and adds 0xA282EAD8, so that a CRC stored next to its data is
not mistaken for data. A payload is a byte of flags (1: has an id, 2: ids of 16 bits), the document id (signed 64-bit) and
the token ids. The index file of a data file holds an unsigned 64-bit offset for each record, and then the file's length; a
reader may take records in any order.

Rows are range-partitioned on the document id and sorted, so file n holds smaller ids than file n + 1. A task writes under
a name of its own attempt and renames at the end, so a repeated task leaves one whole file.
"""

from __future__ import annotations

import functools
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eventloom.llm.common import small_batches, text_of, written
from eventloom.llm.pieces import PieceCache
from eventloom.llm.words import groups
from eventloom.plans.timeline import scratch_dir

MASK = 0xA282EAD8
HEAD = struct.Struct("<QI")
TAIL = struct.Struct("<I")
OWN = struct.Struct("<Bq")
CACHED = 700_000  # words a worker remembers; some 150 MB
MARK = "\u2e3b"  # any symbol; words that hold it are encoded one by one
TOGETHER = 64
RECORDS_AT_ONCE = 2_000
FILE_CHARS = 64_000_000


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return length + TAIL.pack(masked(length)) + payload + TAIL.pack(masked(payload))


def unframe(data: bytes) -> bytes:
    """The payload of one record; an error if a checksum or the length is wrong."""
    length, check = HEAD.unpack_from(data)
    if masked(data[:8]) != check or len(data) != HEAD.size + length + TAIL.size:
        raise ValueError("damaged record length")
    payload = data[HEAD.size : HEAD.size + length]
    if masked(payload) != TAIL.unpack_from(data, HEAD.size + length)[0]:
        raise ValueError("damaged record")
    return payload


def pack(doc_id: int | None, ids: np.ndarray) -> bytes:
    small = not len(ids) or int(ids.max()) < 1 << 16
    return OWN.pack((doc_id is not None) | small << 1, doc_id or 0) + ids.astype("<u2" if small else "<u4").tobytes()


def unpack(payload: bytes) -> tuple[int | None, np.ndarray]:
    flags, doc_id = OWN.unpack_from(payload)
    return doc_id if flags & 1 else None, np.frombuffer(payload, "<u2" if flags & 2 else "<u4", offset=OWN.size).astype("<u4")


class Words:
    """Encodes lists of white-space separated words, many new words to a call of the tokenizer.

    The tokenizer drops white space between its pre-tokens, and none of its steps looks across white space, so a text's ids
    are the ids of its words one after another. The words of a call are told apart by the ids of a mark between them.
    """

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer
        self.mark = self._ids([MARK])[0]
        self.cache = PieceCache(self.encode_new)

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode_new(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        plain = [w for w in words if MARK not in w]
        marked = {w: self._ids([w])[0] for w in words if MARK in w}
        calls = [f" {MARK} ".join([*plain[i : i + TOGETHER], ""]) for i in range(0, len(plain), TOGETHER)]
        flat, lengths = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        if calls:
            flat, mark = np.concatenate(self._ids(calls)), self.mark
            at = np.flatnonzero(np.logical_and.reduce([np.roll(flat, -k) == m for k, m in enumerate(mark)]))
            lengths = np.diff(np.concatenate([[-len(mark)], at])) - len(mark)
            keep = np.ones(len(flat), bool)
            for k in range(len(mark)):
                keep[at + k] = False
            flat = flat[keep]
        if marked:
            numbers = np.array([i for i, w in enumerate(words) if w in marked])
            own = [marked[w] for w in marked]
            lengths = np.insert(lengths, numbers - np.arange(len(numbers)), [len(x) for x in own])
            pieces = np.split(flat, np.cumsum(np.delete(lengths, numbers))[:-1]) if len(plain) else []
            for i, ids in zip(numbers.tolist(), own, strict=True):
                pieces.insert(i, ids)
            flat = np.concatenate(pieces)
        return flat, lengths

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        if len(self.cache) > CACHED:
            self.cache = PieceCache(self.encode_new)
        for a, b in groups(texts):
            yield from self.cache.encode([t.split() for t in texts[a:b]])


# characters that Python takes for white space and the tokenizer for symbols
_SYMBOLS = ("\x1c", "\x1d", "\x1e", "\x1f")


class Encoder:
    def __init__(self, definition: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.tokenizer.encode_special_tokens = True  # their names in a text are ordinary text
        self.words = Words(self.tokenizer)

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        odd = [any(c in t for c in _SYMBOLS) for t in texts]
        made = self.words.encode(["" if o else t for t, o in zip(texts, odd, strict=True)])
        for text, whole, ids in zip(texts, odd, made, strict=True):
            yield np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32) if whole else ids


@functools.lru_cache(2)
def _encoder(definition: str) -> Encoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the cores of a task are Spark's to give
    return Encoder(definition)


def _opened(uri: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


def _write_part(frames: Iterator[pd.DataFrame], folder: str, definition: str, end: int) -> Iterator[pd.DataFrame]:
    part, encoder = TaskContext.get().partitionId(), _encoder(definition)
    store, path = _opened(folder)
    name, attempt = f"{path}/part-{part:06d}", f"{path}/_{uuid.uuid4().hex}"
    offsets, at, tokens = [], 0, 0
    with store.open_output_stream(f"{attempt}.rec") as out:
        for rows in frames:
            for doc_id, ids in zip(rows["doc_id"], encoder.encode(rows["text"].tolist()), strict=True):
                record = frame(pack(None if pd.isna(doc_id) else int(doc_id), np.append(ids, np.uint32(end))))
                out.write(record)
                offsets.append(at)
                at += len(record)
                tokens += len(ids) + 1
    with store.open_output_stream(f"{attempt}.idx") as out:
        out.write(np.array([*offsets, at], "<u8").tobytes())
    for kind in ("rec", "idx"):
        store.move(f"{attempt}.{kind}", f"{name}.{kind}")
    yield pd.DataFrame({"part": [part], "n_docs": [len(offsets)], "n_tokens": [tokens]})


def write_records(
    docs: DataFrame, tokenizer_path: str, folder: str, end: int, id_col: str = "doc_id", text_col: str = "text", files: int | None = None
) -> DataFrame:
    """Encode, append the `end` id to each document and write data and index files; one row per file: part, n_docs, n_tokens.

    Documents are in ascending order of id, null ids first; those of equal ids in the order of a hash of their text. A null
    text is empty. `files` defaults to one for 64 million characters, and to the session's number of shuffle partitions at
    least. The tokenizer's definition is read on the driver and sent to the executors.
    """
    small_batches(docs)
    with open(tokenizer_path, encoding="utf-8") as f:
        definition = f.read()
    spark = docs.sparkSession
    store, path = _opened(folder)
    store.create_dir(path)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_of(text_col).alias("text"))
    if files is None:
        chars = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        files = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-chars // FILE_CHARS))
    rows = rows.withColumn("content", F.xxhash64("text"))
    keys = [F.col("doc_id").asc_nulls_first(), F.col("content")]
    rows = rows.repartitionByRange(files, *keys).sortWithinPartitions(*keys).select("doc_id", "text")
    shared = spark.sparkContext.broadcast(definition)
    made = rows.mapInPandas(lambda frames: _write_part(frames, folder, shared.value, end), "part int, n_docs bigint, n_tokens bigint")
    return written(made, "record-parts")


def index_of(parts: DataFrame, folder: str) -> DataFrame:
    """One row per record of the files in `parts`: part, record (from 0), offset and length of the framed record."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in frames:
            for part in rows["part"]:
                store, path = _opened(folder)
                with store.open_input_stream(f"{path}/part-{part:06d}.idx") as f:
                    offsets = np.frombuffer(f.read(), "<u8").astype(np.int64)
                yield pd.DataFrame({"part": part, "record": np.arange(len(offsets) - 1), "offset": offsets[:-1], "length": np.diff(offsets)})

    few = parts.filter("n_docs > 0")
    return few.repartition(max(1, few.count()), "part").mapInPandas(run, "part int, record bigint, offset bigint, length bigint")


def _fetch(file, rows: pd.DataFrame) -> Iterator[memoryview]:
    """The framed records of one file; records that follow one another are read together."""
    offsets, lengths = rows["offset"].to_numpy(), rows["length"].to_numpy()
    breaks = np.flatnonzero(offsets[1:] != offsets[:-1] + lengths[:-1]) + 1
    for few in np.split(np.arange(len(rows)), breaks):
        file.seek(int(offsets[few[0]]))
        data = memoryview(file.read(int(lengths[few].sum())))
        at = 0
        for n in lengths[few].tolist():
            yield data[at : at + n]
            at += n


def read_records(index: DataFrame, folder: str, take: Callable[[np.ndarray], tuple] = lambda ids: (ids.astype(np.int32),), shape: str = "ids array<int>") -> DataFrame:
    """Fetch the records that `index` names, in any order, and check them: part, record, doc_id, and what `take` makes of the ids.

    By default that is the ids themselves; `shape` names and types the values of `take`.
    """
    names = [field.split()[0] for field in shape.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, path = _opened(folder)
        for rows in frames:
            for part, own in rows.groupby("part", sort=False):
                with store.open_input_file(f"{path}/part-{part:06d}.rec") as f:
                    for a in range(0, len(own), RECORDS_AT_ONCE):
                        few = own.iloc[a : a + RECORDS_AT_ONCE]
                        made, ids = [], []
                        for record in _fetch(f, few):
                            doc_id, tokens = unpack(unframe(record))
                            ids.append(doc_id)
                            made.append(take(tokens))
                        values = {name: pd.Series([m[i] for m in made], index=few.index) for i, name in enumerate(names)}
                        yield few[["part", "record"]].assign(doc_id=pd.array(ids, "Int64"), **values)

    return index.mapInPandas(run, f"part int, record bigint, doc_id bigint, {shape}")


def read_back(spark: SparkSession, parts: DataFrame, folder: str) -> DataFrame:
    """Per document of the files, in the order of their ids: doc_id, start, n_tokens, ids_crc32."""

    files = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per file
    before = parts.select("part", F.coalesce(F.sum("n_tokens").over(files), F.lit(0)).alias("before"))
    few = read_records(index_of(parts, folder), folder, lambda ids: (len(ids), zlib.crc32(ids.tobytes())), "n_tokens bigint, ids_crc32 bigint")
    earlier = Window.partitionBy("part").orderBy("record").rowsBetween(Window.unboundedPreceding, -1)
    few = few.withColumn("start", F.coalesce(F.sum("n_tokens").over(earlier), F.lit(0)))
    return few.join(F.broadcast(before), "part").select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def new_folder(spark: SparkSession) -> str:
    return f"{scratch_dir(spark)}/records-{uuid.uuid4().hex}"
