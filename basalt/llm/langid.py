"""Language identification by bitmask n-gram filters.

Every letter n-gram that a language's training texts hold is in that language; it is typical of the languages
where its share comes near its largest share in any. The n-grams go into bit-sliced Bloom filters: each position
holds a mask of languages, and the AND of an n-gram's positions is the set of all languages that may contain it
(or that it may be typical of). A text's n-grams are looked up, hits are counted for each language, both counts
are corrected by the language's false-positive rate, and the highest sum of the corrected rates decides: where much has
been learned, every language holds nearly every n-gram once, and what is typical tells them apart. The
filters are sized by the number of n-grams, up to ``MOST`` bytes; beyond, they take in all the same n-grams and get
denser, which the correction accounts for. They are filled where the n-grams are; the driver gets their blocks.

Null texts and texts without a letter are ``und`` with score 0, as is every text when nothing was
learned (an empty training table, or one without labels). Ties go to the first language by name.
Rows with a null language teach nothing. Repeated rows each count and each get a row. Texts of any
length are read whole. Other columns pass through; a column with the name of an output column is
replaced. At most 63 languages can be told apart; more raise an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, column, mix, tidy, written

UNKNOWN = "und"
SIZES = (3, 4)
#: Characters that are worked on at a time.
BLOCK = 1 << 19
#: An n-gram is typical of the languages where its share is at least this part of its largest share.
TYPICAL = 0.5
#: Positions of a filter for each n-gram, and probes of each; bytes of a filter at most; positions of a block.
POSITIONS, PROBES, MOST, PART = 16, 3, 64 << 20, 1 << 14
_MIX = np.uint64(0x9E3779B97F4A7C15)


def blocks(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """About ``BLOCK`` characters at a time: code points in lower case, everything but letters as 0,
    with a 0 around each text; and the row of each. A text longer than a block is cut at a space, which
    cuts no n-gram, as what is no letter is an edge anyway."""
    parts: list[str] = []
    rows: list[int] = []
    size = 0
    for row, text in enumerate(texts.to_pylist()):
        text, at = (text or "").lower(), 0
        while at < len(text):
            to = len(text) if len(text) - at <= BLOCK else text.find(" ", at + BLOCK)
            to = len(text) if to < 0 else to
            parts.append(text[at:to])
            rows.append(row)
            size, at = size + to - at, to
            if size >= BLOCK:
                yield _points(parts, rows)
                parts, rows, size = [], [], 0
    if parts:
        yield _points(parts, rows)


def _points(parts: list[str], rows: list[int]) -> tuple[np.ndarray, np.ndarray]:
    points = np.frombuffer(("\0" + "\0".join(parts) + "\0").encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.array([*rows, rows[-1]]), [*(len(p) + 1 for p in parts), 1])
    return np.where(_letter(points), points, 0).astype(np.uint64), owner


_table: np.ndarray | None = None


def _letter(points: np.ndarray) -> np.ndarray:
    global _table
    if _table is None:
        _table = np.array([chr(c).isalpha() for c in range(0x110000)])
    return _table[points]


def grams(points: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each size the first positions and hashes of the n-grams: letters, with an edge of the word on
    either side at most."""
    for n in SIZES:
        if len(points) < n:
            continue
        count = len(points) - n + 1
        whole = points[1 : 1 + count] > 0
        for k in range(2, n - 1):
            whole &= points[k : k + count] > 0
        at = np.flatnonzero(whole)
        h = np.full(len(at), n, np.uint64)
        for k in range(n):
            h = h * np.uint64(0x100000001B3) + points[at + k]
        yield at, mix(h)


def gram_counts(docs: DataFrame) -> DataFrame:
    """``lang, gram, n`` over all rows with a language; each batch adds up its own before the shuffle."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.array(column(batch, "lang").to_pylist(), object)
            for lang in sorted(set(langs)):
                texts = column(batch, "text").filter(pa.array(langs == lang))
                keys, sums = np.zeros(0, np.uint64), np.zeros(0, np.int64)
                for points, _ in blocks(texts):
                    gram, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *(h for _, h in grams(points))]), return_counts=True)
                    keys, back = np.unique(np.concatenate([keys, gram]), return_inverse=True)
                    sums = np.bincount(back, np.concatenate([sums, n]), len(keys)).astype(np.int64)
                if len(keys):
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(sums)], names=["lang", "gram", "n"])

    part = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    return part.mapInArrow(tidy(run), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def masks(counts: DataFrame, totals: dict[str, int]) -> DataFrame:
    """``gram, has, typical``: of every n-gram the languages that have it, and those it is typical of, as bits."""
    langs = sorted(totals)
    bit = F.create_map(*(F.lit(x) for k, lang in enumerate(langs) for x in (lang, 1 << k)))
    all_ = F.create_map(*(F.lit(x) for lang in langs for x in (lang, totals[lang])))
    each = counts.select("gram", bit[F.col("lang")].cast("long").alias("bit"), (F.col("n") / all_[F.col("lang")]).alias("share"))
    by_gram = each.groupBy("gram").agg(F.bit_or("bit").alias("has"), F.max("share").alias("top"), F.collect_list(F.struct("bit", "share")).alias("by"))  # a language each
    typical = F.expr(f"aggregate(filter(by, x -> x.share >= top * {TYPICAL}), 0L, (m, x) -> m | x.bit)")
    return by_gram.select("gram", "has", typical.alias("typical"))


def positions(h: np.ndarray, size: int) -> Iterator[np.ndarray]:
    step = mix(h ^ _MIX) | np.uint64(1)
    for k in range(PROBES):
        yield ((h + np.uint64(k) * step) & np.uint64(size - 1)).astype(np.int64)


class Filter:
    """Bit-sliced Bloom filters: bit k of a position is set if language k has an n-gram there, or if one there
    is typical of it."""

    def __init__(self, langs: list[str], n: int):
        if len(langs) > 63:
            raise ValueError(f"{len(langs)} languages; at most 63 fit the mask")
        self.langs = langs
        self.kind = next(np.dtype(f"u{w}") for w in (1, 2, 4, 8) if len(langs) <= 8 * w)
        self.size = min(MOST // self.kind.itemsize, 1 << max(PART.bit_length() - 1, int(n * POSITIONS - 1).bit_length()))
        self.slices = np.zeros((2, self.size), self.kind)
        self.false = np.zeros((2, len(langs)))

    def filled(self, found: list[tuple[int, bytes, bytes]]) -> Filter:
        for part, *levels in found:
            for level, block in zip(self.slices, levels):
                level[part * PART : (part + 1) * PART] = np.frombuffer(block, self.kind)
        bits = [[self.bit(level, k).mean() for k in range(len(self.langs))] for level in self.slices]
        self.false = np.array(bits) ** PROBES
        return self

    def bit(self, masks: np.ndarray, k: int) -> np.ndarray:
        return masks >> self.kind.type(k) & self.kind.type(1)

    def lookup(self, h: np.ndarray) -> np.ndarray:
        """Two masks for each n-gram: all languages that may contain it, and that it may be typical of."""
        out = None
        for at in positions(h, self.size):
            out = self.slices[:, at] if out is None else out & self.slices[:, at]
        return out

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        """Language and score: the mean of the best language's two corrected rates."""
        rows = len(texts)
        seen, hits = np.zeros(rows), np.zeros((2, len(self.langs), rows))
        for points, owner in blocks(texts):
            for at, h in grams(points):
                found, row = self.lookup(h), owner[at]
                seen += np.bincount(row, minlength=rows)
                for level, masks_ in enumerate(found):
                    for k in range(len(self.langs)):
                        hits[level, k] += np.bincount(row[self.bit(masks_, k) > 0], minlength=rows)
        found = [UNKNOWN] * rows
        score = np.zeros(rows)
        if self.langs:
            rates = (hits / np.maximum(seen, 1) - self.false[:, :, None]) / np.maximum(1 - self.false[:, :, None], 1e-9)
            rates = np.clip(rates, 0, 1).mean(0)
            best = rates.argmax(0)
            some = seen > 0
            score = np.where(some, np.take_along_axis(rates, best[None], 0)[0], 0.0)
            found = [self.langs[b] if s else UNKNOWN for b, s in zip(best, some)]
        return found, score


def train(docs: DataFrame) -> Filter:
    """Learns from ``lang`` and ``text``. The driver gets the languages and the filters, ``MOST`` bytes of each."""
    counts = written(gram_counts(docs))
    totals = {r.lang: r.n for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).limit(64).collect()}
    if not totals:
        return Filter([], 0)
    table = written(masks(counts, totals))
    empty = Filter(sorted(totals), table.count())
    size, kind = empty.size, empty.kind

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            levels = [column(batch, c) for c in ("has", "typical")]
            for at in positions(column(batch, "gram").to_numpy().view(np.uint64), size):
                arrays = [pa.array((at // PART).astype(np.int32)), pa.array((at % PART).astype(np.int32)), *levels]
                yield pa.RecordBatch.from_arrays(arrays, names=["part", "at", "has", "typical"])

    def block(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        out = {"part": [key[0]]}
        for c in ("has", "typical"):
            level = np.zeros(PART, kind)
            np.bitwise_or.at(level, rows["at"].to_numpy(), rows[c].to_numpy().astype(kind))
            out[c] = [level.tobytes()]
        return pd.DataFrame(out)

    dealt = table.mapInArrow(tidy(places), "part int, at int, has long, typical long")
    found = dealt.groupBy("part").applyInPandas(block, "part int, has binary, typical binary")
    return empty.filled([(r.part, bytes(r.has), bytes(r.typical)) for r in found.collect()])  # the filters' size


def predict(docs: DataFrame, learned: Filter, text: str = "text") -> DataFrame:
    """Adds ``lang_pred`` and ``score``."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(learned)  # twice MOST bytes
    rest = [c for c in docs.columns if c not in ("lang_pred", "score")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, score = shared.value.predict(column(batch, text))
            yield pa.RecordBatch.from_arrays([*(column(batch, c) for c in rest), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*rest, "lang_pred", "score"])

    schema = T.StructType([docs.schema[c] for c in rest] + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.mapInArrow(tidy(run), schema)


def held_out(doc_id: str = "doc_id"):
    """Rows that training leaves out: a fifth, by the checksum of the id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))
