"""Removal of repeated word windows by a compacted de Bruijn graph.

The windows of ``window`` words are the edges of a de Bruijn graph. Runs of consecutive windows that share
their least ``ANCHOR``-word gram are paths without a branch inside; each is one row, by its anchor and the
hash of all its words, so that an edge costs a fraction of a row. Equal paths compact into one node, with
the smallest doc_id that has it, in each batch before the shuffle and over all batches after it. Where an
anchor's paths are all equal, nothing branches, and every later document's windows on the path are
repeats. Where they differ, the first source of each path is looked up by its coordinates, its windows
are compared one by one, and those that start in a document with a smaller id are repeats too.

Windows are told apart by 64-bit hashes. Null texts count as empty. Rows without an id neither lose words
nor cost others any. Rows that repeat an id are not smaller than each other, so equal ones are left alone; those that
differ are told apart by a 64-bit hash of the text; each row gives a row. Texts of any length are read whole; texts shorter than a window are left as they are
(but for white space). Other columns play no part. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import _R, _R_INVERSE, bound_batches, buffers, column, mix, shingles, text_hash, tidy, words, written

#: Words of the gram that windows are gathered under.
ANCHOR = 4
#: Words of the longest window: the number of windows under one anchor has 16 bits.
LONGEST = 1 << 16
#: ``th`` is the text's hash, which tells rows with one id apart; ``at`` holds the first window and the number
#: of windows (0: a found repeat, its number in ``path``).
ROWS = "anchor long, path long, doc_id long, th long, at long"
_NAMES = ["anchor", "path", "doc_id", "th", "at"]


def span_hashes(hashes: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the words from ``begin`` up to ``end``."""
    powers, back = np.full(len(hashes), _R, np.uint64), np.full(len(hashes), _R_INVERSE, np.uint64)
    powers[:1] = back[:1] = 1
    powers, back = np.multiply.accumulate(powers), np.multiply.accumulate(back)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * powers)])
    return mix((sums[end] - sums[begin]) * back[begin] + mix((end - begin).astype(np.uint64)))


def paths(hashes: np.ndarray, first: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """Of each row's windows the runs under one anchor: row, first window, number of windows, anchor, path."""
    grams = shingles(hashes, ANCHOR)
    count = max(0, len(hashes) - window + 1)
    best, where = grams[:count].copy(), np.arange(count)
    for k in range(1, window - ANCHOR + 1):
        other = grams[k : k + count]
        less = other < best
        best[less] = other[less]
        where[less] = np.flatnonzero(less) + k
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))[:count]
    inside = np.arange(count) + window <= first[1:][row]
    at = np.flatnonzero(inside)
    new = np.ones(len(at), bool)
    new[1:] = (where[at[1:]] != where[at[:-1]]) | (row[at[1:]] != row[at[:-1]])
    start = np.flatnonzero(new)
    n = np.diff(np.append(start, len(at)))
    begin = at[start]
    path = span_hashes(hashes, begin, begin + n + window - 1) if len(begin) else np.zeros(0, np.uint64)
    path = mix(path + (where[begin] - begin).astype(np.uint64))
    return row[begin], begin - first[row[begin]], n, best[begin], path


def place(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    return first.astype(np.int64) << 16 | n.astype(np.int64)


def merged(doc: np.ndarray, th: np.ndarray, first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """Adjoining runs of one document as one."""
    order = np.lexsort((first, th, doc))
    doc, th, first, n = (x[order] for x in (doc, th, first, n))
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (th[1:] != th[:-1]) | (first[1:] != first[:-1] + n[:-1])
    at = np.flatnonzero(new)
    return doc[at], th[at], first[at], np.add.reduceat(n, at) if len(at) else n[:0]


def batch_of(arrays: list[np.ndarray], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x).view(np.int64)) for x in arrays], names=names)


def leaders(*keys: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by the keys and doc; which rows begin a key there; each row's smallest doc of its key."""
    order = np.lexsort((doc, *reversed(keys)))
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.any([k[order[1:]] != k[order[:-1]] for k in keys], axis=0)
    least = doc[order][np.flatnonzero(new)][np.cumsum(new) - 1] if len(order) else doc
    return order, new, least


def found_rows(doc: np.ndarray, th: np.ndarray, first: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    doc, th, first, n = merged(doc, th, first, n)
    return batch_of([mix(doc.view(np.uint64)), n, doc, th, place(first, np.zeros_like(n))], _NAMES)


def path_rows(docs: DataFrame, window: int) -> DataFrame:
    """The paths of all documents. What a smaller document of the same batch repeats is found at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ths = (column(batch, c).to_numpy() for c in ("doc_id", "th"))
            offsets, data = buffers(column(batch, "text"))
            hashes, _, _, first = words(offsets, data)
            row, begin, n, anchor, path = paths(hashes, first, window)
            doc, th = ids[row], ths[row]
            order, _, least = leaders(anchor, path, doc=doc)
            later = doc[order] > least
            late, lead = order[later], order[~later]
            yield found_rows(doc[late], th[late], begin[late], n[late])
            yield batch_of([anchor[lead], path[lead], doc[lead], th[lead], place(begin[lead], n[lead])], _NAMES)

    return docs.mapInArrow(tidy(run), ROWS)


def by_key(rows: DataFrame, key: str, names: list[str], of_runs, schema: str) -> DataFrame:
    """``of_runs`` of the rows in order of ``key``, whole keys at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            new = [column(batch, c).to_numpy() for c in names]
            held = [np.concatenate(x) for x in zip(held, new)] if held else new
            last = int(np.searchsorted(held[0], held[0][-1])) if len(held[0]) else 0
            if last:
                yield from of_runs(*(x[:last] for x in held))
                held = [x[last:] for x in held]
        if held and len(held[0]):
            yield from of_runs(*held)

    return rows.repartition(key).sortWithinPartitions(key).select(key, *(c for c in names if c != key)).mapInArrow(tidy(run), schema)


FOUND = "doc_id long, th long, first long, n long, open boolean"


def resolved(rows: DataFrame) -> DataFrame:
    """``doc_id, th, first, n, open``: runs of windows that are repeats, or, where ``open``, that have to be
    looked at one by one."""

    def of_runs(anchor: np.ndarray, path: np.ndarray, doc: np.ndarray, th: np.ndarray, at: np.ndarray) -> Iterator[pa.RecordBatch]:
        n, first = at & 0xFFFF, at >> 16
        done = n == 0
        known = [doc[done], th[done], first[done], path[done]]
        anchor, path, doc, th, n, first = (x[~done] for x in (anchor, path, doc, th, n, first))
        order, new, least = leaders(anchor, path, doc=doc)
        anchor, doc, th, n, first = (x[order] for x in (anchor, doc, th, n, first))
        later = doc > least
        key = np.ones(len(anchor), bool)
        key[1:] = anchor[1:] != anchor[:-1]
        start = np.flatnonzero(key)
        branched = np.zeros(len(anchor), bool)
        if len(start):
            several = (np.add.reduceat(new.astype(np.int64), start) > 1) & (np.minimum.reduceat(doc, start) < np.maximum.reduceat(doc, start))
            branched = several[np.cumsum(key) - 1]
        open_ = branched & ~later
        parts = [np.concatenate([k, x[later], x[open_]]) for k, x in zip(known, (doc, th, first, n))]
        flag = np.zeros(len(parts[0]), bool)
        flag[len(flag) - int(open_.sum()) :] = True
        yield pa.RecordBatch.from_arrays([*(pa.array(x) for x in parts), pa.array(flag)], names=["doc_id", "th", "first", "n", "open"])

    return by_key(rows, "anchor", _NAMES, of_runs, FOUND)


def packed(docs: DataFrame) -> DataFrame:
    """``doc_id, th, z``: the texts compressed, for the shuffles that bring them to their runs; ``rest``, if
    there is such a column, goes along."""
    names = ["doc_id", "th", *(["rest"] if "rest" in docs.columns else [])]
    schema = T.StructType([*(docs.schema[c] for c in names), T.StructField("z", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            z = pa.array([press((x or "").encode()) for x in column(batch, "text").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*(column(batch, c) for c in names), z], names=[*names, "z"])

    return docs.mapInArrow(tidy(run), schema)


def texts_of(z: pa.Array) -> list[bytes]:
    expand = zstandard.ZstdDecompressor().decompress
    return [expand(x) for x in z.to_pylist()]


def with_runs(docs: DataFrame, runs: DataFrame, how: str) -> DataFrame:
    """``doc_id, th, z`` and the lists of a document's runs."""
    lists = runs.groupBy("doc_id", "th").agg(F.collect_list("first").alias("first"), F.collect_list("n").alias("n"))  # within a text's length
    lists = lists.select(F.col("doc_id").alias("_id"), F.col("th").alias("_th"), "first", "n")
    return packed(docs).join(lists, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th")), how).select("doc_id", "z", "th", "first", "n")


def single_windows(docs: DataFrame, runs: DataFrame, window: int) -> DataFrame:
    """``w, doc_id, th, at``: the windows of the runs, by their hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array(texts_of(column(batch, "z")), pa.binary()).cast(pa.large_binary()).cast(pa.large_string())
            hashes, _, _, first = words(*buffers(texts))
            lists = [(np.array(f), np.array(n)) for f, n in zip(column(batch, "first").to_pylist(), column(batch, "n").to_pylist())]
            row = np.repeat(np.arange(len(lists)), [int(n.sum()) for _, n in lists])
            begin = np.concatenate([np.repeat(f - (np.cumsum(n) - n), n) + np.arange(n.sum()) for f, n in lists])
            at = begin + first[row]
            w = span_hashes(hashes, at, at + window)
            doc, th = column(batch, "doc_id").to_numpy()[row], column(batch, "th").to_numpy()[row]
            yield batch_of([w, doc, th, begin], ["w", "doc_id", "th", "at"])

    return with_runs(docs, runs, "inner").mapInArrow(tidy(run), "w long, doc_id long, th long, at long")


def repeated_singles(singles: DataFrame) -> DataFrame:
    def of_runs(w: np.ndarray, doc: np.ndarray, th: np.ndarray, at: np.ndarray) -> Iterator[pa.RecordBatch]:
        order, _, least = leaders(w, doc=doc)
        late = order[doc[order] > least]
        parts = [*merged(doc[late], th[late], at[late], np.ones(len(late), np.int64))]
        yield pa.RecordBatch.from_arrays([*(pa.array(x) for x in parts), pa.array(np.zeros(len(parts[0]), bool))], names=["doc_id", "th", "first", "n", "open"])

    return by_key(singles, "w", ["w", "doc_id", "th", "at"], of_runs, FOUND)


def dedup(docs: DataFrame, window: int = 13) -> DataFrame:
    """``doc_id, n_words, n_removed, kept`` for every row: words in a window that also starts in a document
    with a smaller id are removed, the others are joined by single spaces. ``window`` is ``ANCHOR`` to ``LONGEST``."""
    if not ANCHOR <= window <= LONGEST:
        raise ValueError(f"a window has {ANCHOR} to {LONGEST} words, not {window}")
    bound_batches(docs.sparkSession)
    keyed = docs.select(F.col("doc_id").cast("long"), "text", text_hash().alias("th"))
    found = written(resolved(path_rows(keyed.filter(F.col("doc_id").isNotNull()), window)))
    singles = repeated_singles(single_windows(keyed, found.filter("open"), window))
    runs = found.filter("not open").unionByName(singles)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            totals, removed, kept = [], [], []
            for raw, firsts, ns in zip(texts_of(column(batch, "z")), column(batch, "first").to_pylist(), column(batch, "n").to_pylist()):
                each = raw.split()
                keep = each
                if firsts:
                    edge = np.zeros(len(each) + 1, np.int64)
                    np.add.at(edge, firsts, 1)
                    np.add.at(edge, np.array(firsts) + np.array(ns) + window - 1, -1)
                    keep = [each[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]
                totals.append(len(each))
                removed.append(len(each) - len(keep))
                kept.append(b" ".join(keep).decode())
            arrays = [column(batch, "doc_id"), pa.array(totals, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_words", "n_removed", "kept"])

    return with_runs(keyed, runs, "left").mapInArrow(tidy(run), "doc_id long, n_words long, n_removed long, kept string")
