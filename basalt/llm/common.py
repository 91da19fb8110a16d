"""What the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one Arrow batch may hold; long texts make batches of few rows.
BATCH_BYTES = 6 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches by bytes, so that a batch of very long texts fits a task."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. One of our own only where none is set and all runs on this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="basalt-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def written(df: DataFrame) -> DataFrame:
    """Writes ``df`` as Parquet to the shared folder and reads it again: lineage ends there,
    and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/basalt-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, after which the worker, which lives on, gives its free memory back."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
            if trim:
                trim(0)

    return tidied


def text_hash(text="text"):
    """Tells apart rows that share a doc_id; a null text counts as empty."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (rows + 1) and UTF-8 bytes of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return offsets - offsets[0], data[offsets[0] : offsets[-1]]


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads each 64-bit value over all bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_R = np.uint64(0x5851F42D4C957F2D)  # odd
_R_INVERSE = np.uint64(pow(0x5851F42D4C957F2D, -1, 1 << 64))


def words(offsets: np.ndarray, data: np.ndarray, lower: bool = False):
    """Words ``[^\\x20\\x09-\\x0D]+`` of every row: their 64-bit hashes, first and last byte + 1,
    and per row the number of its first word (rows + 1)."""
    if lower:
        data = _LOWER[data]
    gap = _SPACE[data]
    inner = ~gap
    first = inner.copy()
    first[1:] &= gap[:-1]
    starts_row = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[starts_row] = inner[starts_row]
    last = inner.copy()
    last[:-1] &= gap[1:]
    ends_row = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    last[ends_row] = inner[ends_row]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    hashes = np.empty(len(begin), np.uint64)
    step = 1 << 17  # words at a time, to bound memory
    for i in range(0, len(begin), step):
        b, e = begin[i : i + step], end[i : i + step]
        lo, hi = b[0], e[-1]
        powers = np.full(hi - lo, _R, np.uint64)
        powers[0] = 1
        powers = np.multiply.accumulate(powers)
        sums = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(_BYTE[data[lo:hi]] * powers, out=sums[1:])
        back = np.full(hi - lo, _R_INVERSE, np.uint64)
        back[0] = 1
        back = np.multiply.accumulate(back)
        hashes[i : i + step] = mix((sums[e - lo] - sums[b - lo]) * back[b - lo] + (e - b).astype(np.uint64))
    return hashes, begin, end, np.searchsorted(begin, offsets)


def shingles(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` words from each word on; the caller leaves out those that cross rows."""
    count = max(0, len(hashes) - n + 1)
    out = np.zeros(count, np.uint64)
    for k in range(n):
        out = out * _R + hashes[k : k + count]
    return mix(out)


class ChunkMemo(dict):
    """Ids of a text as little-endian unsigned 32-bit integers, by the ids of its spaced chunks.

    A single space between two other characters always starts a match of the pattern that splits
    text before the merges, so a text without runs of white space is the sum of its spaced chunks.
    As a dict it keeps the chunks' ids in two generations of ``entries`` at most.
    """

    #: Longest chunk that is kept.
    chars = 48
    _blank_run = re.compile(r"\s\s|\A\s|\s\Z")

    def __init__(self, entries: int):
        super().__init__()
        self.entries, self.older = entries, {}

    def whole(self, text: str) -> bytes:
        raise NotImplementedError

    def spaced(self, chunk: str) -> bytes:
        """Ids of a chunk and the space before it."""
        return self.whole(f" {chunk}")

    def __missing__(self, chunk: str) -> bytes:
        found = self.older.get(chunk)
        if found is None:
            found = self.spaced(chunk)
        if len(chunk) <= self.chars:
            if len(self) >= self.entries:
                self.older = dict(self)
                self.clear()
            self[chunk] = found
        return found

    def encode(self, text: str) -> bytes:
        if self._blank_run.search(text):
            return self.whole(text)
        head, *rest = text.split(" ")
        return self.whole(head) + b"".join(map(self.__getitem__, rest))


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def no_batches(*_: object) -> Iterator[pa.RecordBatch]:
    return iter(())
