"""Packing of tokenized documents into sequences of one window length.

A document's ids are cut into whole windows and a rest. The histogram of the rests' lengths, which has
as many bins as the window whatever the input, is what the packing is planned on: shallow combinations
(two or three lengths) that fill a window exactly are enumerated, non-negative least squares gives each
a repeat count against the histogram, the counts are rounded, and what is left is packed greedily,
largest first with the best fit. Each plan entry is a run of equal sequences; pieces take their places
in it by their rank among the pieces of their length.

Null texts count as empty: their document is the closing id alone. Empty texts do likewise. Repeated
rows are packed as often as they occur. Documents without a doc_id are packed with a null doc_id. Long
texts are cut into as many windows as they need. An empty table gives no pieces. Other columns are left
out of the result.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ChunkMemo, bound_batches, column, tidy, written

#: Pieces of one length that one task ranks.
RANKED = 200_000
#: Rounds of the least-squares solver.
ROUNDS = 300


def byte_alphabet() -> dict[str, int]:
    """Printable stand-ins of the 256 bytes in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Vocabulary(ChunkMemo):
    """A byte-level BPE vocabulary file of the ``tokenizers`` library, whose ids are its merge ranks.
    The strings of its added tokens in a text are those tokens, as in the library; what is between is merged."""

    def __init__(self, spec: str, pattern: str):
        super().__init__(150_000)
        spec = json.loads(spec)
        self.added = {t["content"]: np.array([t["id"]], "<u4").tobytes() for t in spec.get("added_tokens", []) if t["content"]}
        special = {t["content"] for t in spec.get("added_tokens", []) if t.get("special")}
        # At one place the longest.
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        byte = byte_alphabet()
        ranks = {bytes(byte[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        self.core = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> bytes:
        if self.cut is None or not self.cut.search(text):
            return super().encode(text)
        parts = self.cut.split(text)  # text, token, text, ...
        return b"".join(self.added[x] if k % 2 else super(Vocabulary, self).encode(x) for k, x in enumerate(parts) if x)

    def whole(self, text: str) -> bytes:
        return np.array(self.core.encode_ordinary(text), "<u4").tobytes()


_vocabularies: dict[str, Vocabulary] = {}

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def pieces(docs: DataFrame, vocabulary_path: str, pattern: str, window: int, end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """Every document's ids with ``end_id`` behind, cut into whole windows and a rest; one row a piece.
    With ``keep_ids`` the ids themselves follow, as little-endian unsigned 32-bit integers."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(Path(vocabulary_path).read_text())  # 1.6 MB, whatever the input
    end = np.array([end_id], "<u4").tobytes()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *["ids"] * keep_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if vocabulary_path not in _vocabularies:
            _vocabularies[vocabulary_path] = Vocabulary(shared.value, pattern)
        encode, step = _vocabularies[vocabulary_path].encode, 4 * window
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(column(batch, "doc_id").to_pylist(), column(batch, "text").to_pylist()):
                ids = encode(text or "") + end
                for at in range(0, len(ids), step):
                    part = ids[at : at + step]
                    rows.append((doc_id, at // 4, len(part) // 4, zlib.crc32(part), len(ids) // 4, part))
            if rows:
                columns = [*zip(*rows)]
                arrays = [pa.array(x, pa.int64()) for x in columns[:5]] + [pa.array(columns[5], pa.binary())] * keep_ids
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(run), PIECES + ", ids binary" * keep_ids)


def combinations(present: np.ndarray, window: int) -> np.ndarray:
    """Rows of two or three of the lengths ``present`` that fill the window, padded with 0."""
    have = np.zeros(window + 1, bool)
    have[present] = True
    out = []
    for a in present:
        b = present[(present >= a) & (present <= (window - a) // 2)]
        c = window - a - b
        third = np.column_stack([np.full(len(b), a), b, c])[have[c]]
        out.append(third)
        if 2 * a <= window and have[window - a]:
            out.append(np.array([[a, window - a, 0]]))
    return np.concatenate(out) if out else np.zeros((0, 3), np.int64)


def repeats(patterns: np.ndarray, histogram: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Non-negative least squares: repeat counts whose summed lengths come close to the histogram,
    by multiplicative updates, which keep every count non-negative."""
    x = np.ones(len(patterns))
    used = patterns > 0
    target = np.where(used, histogram[patterns], 0).sum(1)
    for _ in range(rounds):
        filled = np.bincount(patterns.ravel(), (used * x[:, None]).ravel(), len(histogram))
        filled[0] = 0
        x *= target / np.maximum(np.where(used, filled[patterns], 0).sum(1), 1e-12)
    return x


def plan(histogram: np.ndarray, window: int) -> list[tuple[tuple[int, ...], int]]:
    """Lengths of a sequence's pieces and how many such sequences there are; together they use every
    piece of the histogram exactly once. ``histogram[n]`` counts pieces of length n."""
    left = histogram.astype(np.int64).copy()
    out: list[tuple[tuple[int, ...], int]] = []
    if left[window]:
        out.append(((window,), int(left[window])))
        left[window] = 0
    patterns = combinations(np.flatnonzero(left), window)
    if len(patterns):
        x = repeats(patterns, left)
        for k in np.lexsort((-x, -patterns.max(1))):  # the longest pieces first, which find a partner hardest
            lengths = patterns[k][patterns[k] > 0]
            kinds, need = np.unique(lengths, return_counts=True)
            times = min(int((left[kinds] // need).min()), round(x[k]))
            if times > 0:
                left[kinds] -= need * times
                out.append((tuple(int(n) for n in lengths), times))
    while left.any():
        lengths: list[int] = []
        taken = np.zeros_like(left)
        room = window
        while room and len(fit := np.flatnonzero((left - taken)[: room + 1])):
            lengths.append(int(fit[-1]))
            taken[fit[-1]] += 1
            room -= lengths[-1]
        kinds = np.flatnonzero(taken)
        times = int((left[kinds] // taken[kinds]).min())
        left -= taken * times
        out.append((tuple(lengths), times))
    return out


@dataclass
class Places:
    """Of one length: the first rank of each run of places, its first sequence and its offset."""

    rank: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray


def places(planned: list[tuple[tuple[int, ...], int]]) -> dict[int, Places]:
    runs: dict[int, list[tuple[int, int, int]]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for lengths, times in planned:
        offset = 0
        for n in lengths:
            runs.setdefault(n, []).append((used.get(n, 0), sequence, offset))
            used[n] = used.get(n, 0) + times
            offset += n
        sequence += times
    return {n: Places(*(np.array(x, np.int64) for x in zip(*found))) for n, found in runs.items()}


def pack(cut: DataFrame, window: int) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces. ``cut`` is read twice: hand in a written table.
    The plan on the driver has a size that depends on the window alone."""
    spark = cut.sparkSession
    histogram = np.zeros(window + 1, np.int64)
    for length, count in cut.groupBy("length").count().collect():  # at most ``window`` rows
        histogram[length] = count
    shared = spark.sparkContext.broadcast(places(plan(histogram, window)))
    # A length may be very frequent: its pieces are ranked in buckets, behind the buckets before.
    buckets = max(1, -(-int(histogram.max()) // RANKED))
    order = ["doc_id", "start", "ids_crc32"]
    salted = cut.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = salted.groupBy("length", "_bucket").count().withColumn("_before", F.coalesce(F.sum("count").over(before), F.lit(0)))
    within = F.row_number().over(Window.partitionBy("length", "_bucket").orderBy(*order)) - 1
    ranked = (
        salted.withColumn("_rank", within)
        .join(sizes.drop("count"), ["length", "_bucket"])
        .select(*cut.columns, (F.col("_rank") + F.col("_before")).alias("_rank"))
    )
    kept = cut.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (column(batch, c).to_numpy() for c in ("length", "_rank"))
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for n in np.unique(length):
                at, of = np.flatnonzero(length == n), shared.value[int(n)]
                k = np.searchsorted(of.rank, rank[at], "right") - 1
                sequence[at] = of.sequence[k] + rank[at] - of.rank[k]
                offset[at] = of.offset[k]
            yield pa.RecordBatch.from_arrays([*(column(batch, c) for c in kept), pa.array(sequence), pa.array(offset)], names=[*kept, "sequence_id", "offset"])

    schema = ", ".join(f"`{c}` {t}" for c, t in cut.dtypes)
    return ranked.mapInArrow(tidy(run), f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, vocabulary_path: str, pattern: str, window: int = 1024, keep_ids: bool = False) -> DataFrame:
    """One row a piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``."""
    return pack(written(pieces(docs, vocabulary_path, pattern, window, keep_ids=keep_ids)), window)
