"""Importance resampling towards a target distribution.

Features are runs of one to ``n`` consecutive words, hashed to buckets. The bucket counts of the documents and of the
target texts are summed over all rows; a bucket's gain is the scaled logarithm of its two smoothed shares, and a
document's weight is the mean gain of its features. A weight with a Gumbel number of the document's id is its score, and
the highest scores are a draw without replacement by weight.

The cutoff among the scores is found by selection, without a sort of all: every partition gives the median of its keys
that remain, the medians are weighted by how many remain, and their weighted median is a pivot that at least a quarter
of the keys lies on either side of. What lies beyond is counted and discarded until the pivot is the exact cutoff. Only
winners are sorted.

Nulls: null texts have no features; a null id takes part with the empty string for its decimal digits, before the
others at equal scores. Empty texts have no features and weight 0; texts of any length are taken whole. Rows that repeat
each take part (of equal rows at the cutoff as many are drawn as are due). Without target texts, or without documents, the
smoothed shares are equal in every bucket or the result is empty. Other columns pass through, whatever their names: the
input's row is kept as a whole in ``row``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import sha256
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, column, buffers, shared_dir, tidy, written

BUCKETS = 10_000
#: Words of more bytes have their checksum computed one by one.
SHORT = 32
#: Bytes of text that are split at once within a batch.
STEP = 1 << 20
#: Keys that remain when the rest is sorted in one task instead of further rounds.
FEW = 10_000

# Letters and digits of ASCII and all bytes of other characters make words, A-Z become a-z.
_INNER = np.zeros(256, bool)
_INNER[0x30:0x3A] = _INNER[0x61:0x7B] = _INNER[0x80:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def _crc_table() -> np.ndarray:
    """The reflected CRC-32 table of one byte, by its polynomial."""
    x = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        x = np.where(x & 1, x >> 1 ^ np.uint32(0xEDB88320), x >> 1)
    return x


_CRC = _crc_table()


def _crc_words(state: np.ndarray, data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """``state`` (one for each word, inverted) after the bytes of its word."""
    out = state.copy()
    for i in np.flatnonzero(size > SHORT).tolist():
        out[i] = ~np.uint32(crc32(data[begin[i] : begin[i] + size[i]].tobytes(), int(~out[i])))
    live = np.flatnonzero(size <= SHORT)
    live = live[np.argsort(-size[live], kind="stable")]
    counts = np.searchsorted(-size[live], -np.arange(1, SHORT + 1), side="right")
    for k, n in enumerate(counts.tolist()):
        some = live[:n]
        if not n:
            break
        out[some] = _CRC[(out[some] ^ data[begin[some] + k]) & 0xFF] ^ out[some] >> 8
    return out


def features(texts: pa.Array, n: int = 1, buckets: int = BUCKETS) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For some rows at a time: the first row, the buckets of their features, the rows' numbers from there on, and the words of each row."""
    offsets, data = buffers(texts)
    a = 0
    while a < len(offsets) - 1:
        z = max(a + 1, int(np.searchsorted(offsets, offsets[a] + STEP, side="right")) - 1)
        part, bounds = _LOWER[data[offsets[a] : offsets[z]]], offsets[a : z + 1] - offsets[a]
        inner = _INNER[part]
        first, last = inner.copy(), inner.copy()
        first[1:] &= ~inner[:-1]
        last[:-1] &= ~inner[1:]
        full = bounds[:-1] < bounds[1:]
        first[bounds[:-1][full]] = inner[bounds[:-1][full]]
        last[bounds[1:][full] - 1] = inner[bounds[1:][full] - 1]
        begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
        row = np.searchsorted(bounds, begin, side="right") - 1
        count = np.bincount(row, minlength=z - a)
        state, size = np.full(len(begin), 0xFFFFFFFF, np.uint32), end - begin
        found, rows = [], []
        live = np.arange(len(begin))
        for k in range(n):
            if k:
                live = live[live + k < len(begin)]
                live = live[row[live] == row[live + k]]
                state[live] = _CRC[(state[live] ^ 0x20) & 0xFF] ^ state[live] >> 8
            state[live] = _crc_words(state[live], part, begin[live + k], size[live + k])
            found.append((~state[live]).astype(np.int64) % buckets)
            rows.append(row[live])
        yield a, np.concatenate(found), np.concatenate(rows), count
        a = z


def bucket_counts(texts: DataFrame, text: str = "text", n: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """``bucket, n``: features of all texts in each bucket. A task sends one row a bucket at most."""
    bound_batches(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, found, _, _ in features(batch.column(0), n, buckets):
                total += np.bincount(found, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], names=["bucket", "n"])

    return texts.select(F.col(text).alias("text")).mapInArrow(tidy(run), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Every bucket's gain, by the counts of both sides. ``buckets`` rows come to the driver from each."""
    s, t = ({r.bucket: r.n for r in side.collect()} for side in (source, target))
    all_s, all_t = sum(s.values()), sum(t.values())
    share = (((t.get(b, 0) + 1) * float(all_s + buckets)) / ((s.get(b, 0) + 1) * float(all_t + buckets)) for b in range(buckets))
    return np.array([math.floor(1000 * math.log(x)) for x in share], np.int64)


def gumbel(doc_id: int | None, seed: int) -> int:
    h = int(sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray, n: int = 1, seed: int = 2024, doc_id: str = "doc_id", text: str = "text", keep: bool = True) -> DataFrame:
    """``_id, n_words, n_features, weight, score`` of every document, and with ``keep`` its input ``row``."""
    bound_batches(docs.sparkSession)
    buckets = len(gain)
    shared = docs.sparkSession.sparkContext.broadcast(gain)  # 8 bytes a bucket
    given = docs.select(F.col(doc_id).cast("long").alias("_id"), F.col(text).alias("_text"), *([F.struct("*").alias("row")] if keep else []))
    kinds = given.drop("_text").schema.add("n_words", "long").add("n_features", "long").add("weight", "long").add("score", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value
        for batch in batches:
            size = batch.num_rows
            words, count, total = (np.zeros(size, np.int64) for _ in range(3))
            for a, found, row, each in features(column(batch, "_text"), n, buckets):
                z = a + len(each)
                words[a:z] = each
                count[a:z] = np.bincount(row, minlength=z - a)
                np.add.at(total[a:z], row, gain[found])
            weight = total // np.maximum(count, 1)
            luck = np.array([gumbel(x, seed) for x in column(batch, "_id").to_pylist()], np.int64)
            kept = [batch.column(i) for i, f in enumerate(batch.schema) if f.name != "_text"]
            names = [f.name for f in batch.schema if f.name != "_text"]
            yield pa.RecordBatch.from_arrays([*kept, *map(pa.array, (words, count, weight, weight + luck))], names=[*names, "n_words", "n_features", "weight", "score"])

    return given.mapInArrow(tidy(run), kinds)


#: What orders the documents: the score from above, then the id (a null first), then which row it is.
_KEY = ("_neg", "_known", "_order", "_uid")


def _keys(batch: pa.RecordBatch) -> np.ndarray:
    return np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)], 1)


def _beyond(pivot: tuple[int, ...]):
    """As a column: the key is larger than the pivot."""
    out = F.lit(False)
    for name, value in reversed(list(zip(_KEY, pivot))):
        out = (F.col(name) > value) | ((F.col(name) == value) & out)
    return out


def _middle(keys: np.ndarray) -> tuple[int, ...]:
    """The lower median of rows that are ordered by their columns, found column by column."""
    k = (len(keys) - 1) // 2
    out = []
    for c in range(keys.shape[1]):
        values = keys[:, c]
        v = np.partition(values, k)[k]
        out.append(int(v))
        k -= int((values < v).sum())
        keys = keys[values == v]
    return tuple(out)


def _medians(keys: DataFrame) -> list[tuple[tuple[int, ...], int]]:
    """The median of every partition's keys and how many it has: one small row a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [_keys(b) for b in batches if b.num_rows]
        if parts:
            all_ = np.concatenate(parts)
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (*_middle(all_), len(all_))], names=[*_KEY, "n"])

    rows = keys.mapInArrow(run, ", ".join(f"{c} long" for c in (*_KEY, "n"))).collect()
    return [(tuple(r[:4]), r[4]) for r in rows]


def cutoff(keys: DataFrame, k: int) -> tuple[int, ...] | None:
    """The ``k``-th least of unique keys (``_KEY``); None if ``k`` is 0. Exact, by a weighted median of medians.

    A round reads what remains and leaves three quarters of it at most, mostly a half; what remains is written anew
    when it is a quarter of what was written last."""
    if k <= 0:
        return None
    low: tuple[int, ...] | None = None
    high: tuple[int, ...] | None = None
    held, held_n = keys, None
    while True:
        rest = held if low is None else held.filter(_beyond(low))
        rest = rest if high is None else rest.filter(~_beyond(high))
        medians = sorted(_medians(rest))
        remain = sum(n for _, n in medians)
        held_n = remain if held_n is None else held_n
        if remain <= FEW:
            rows = sorted(tuple(r) for r in rest.select(*_KEY).collect())
            return rows[k - 1]
        if remain * 4 <= held_n:
            held, held_n = written(rest), remain
        at = 0
        for pivot, n in medians:
            at += n
            if 2 * at >= remain:
                break
        inside = (held if low is None else held.filter(_beyond(low))).filter(~_beyond(pivot)).count()
        if inside == k:
            return pivot
        if inside > k:
            high = pivot
        else:
            low, k = pivot, k - inside


def draw(docs: DataFrame, target: DataFrame, percent: int = 10, n: int = 1, least_words: int = 20, buckets: int = BUCKETS, seed: int = 2024, doc_id: str = "doc_id", text: str = "text", keep: bool = True) -> DataFrame:
    """Every document with ``doc_id, n_features, weight, score, rank`` (and with ``keep`` its input ``row``). Of the documents
    with ``least_words`` words, ``percent`` in a hundred are drawn and ranked from 1; ``rank`` is null for all others."""
    gain = gains(bucket_counts(docs, text, n, buckets), bucket_counts(target, text, n, buckets), buckets)
    shared_dir(docs.sparkSession)
    all_ = written(scored(docs, gain, n, seed, doc_id, text, keep).withColumn("_uid", F.monotonically_increasing_id()))
    all_ = all_.withColumns({"_neg": -F.col("score"), "_known": F.col("_id").isNotNull().cast("long"), "_order": F.coalesce("_id", F.lit(0).cast("long"))})
    able = F.col("n_words") >= least_words
    last = cutoff(all_.filter(able).select(*_KEY), percent * all_.filter(able).count() // 100)
    wins = F.lit(False) if last is None else able & ~_beyond(last)
    columns = [F.col("_id").alias("doc_id"), "n_features", "weight", "score", "rank", *(["row"] if keep else [])]
    losers = all_.filter(~wins).withColumn("rank", F.lit(None).cast("long"))
    # The winners' ranks: their number within a sorted partition, behind the sizes of the partitions before.
    ordered = all_.filter(wins).repartitionByRange(*_KEY).sortWithinPartitions(*_KEY)
    ordered = written(ordered.withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    before, offsets = 0, []
    for p, size in sorted(tuple(r) for r in ordered.groupBy(part.alias("p")).count().collect()):  # one row a partition
        offsets.append((p, before))
        before += size
    spark = docs.sparkSession
    offset = spark.createDataFrame(offsets, "_part long, _before long")
    ranked = ordered.withColumn("_part", part).join(F.broadcast(offset), "_part")
    ranked = ranked.withColumn("rank", F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1)
    return ranked.select(*columns).unionByName(losers.select(*columns))


def sql_crc(name: str, strings: str) -> str:
    """Two tables of a WITH clause: ``<name>(s, crc)``, the CRC-32 of the strings ``s`` that the query ``strings`` gives,
    as DuckDB has none of its own."""
    return f"""{name}_t AS (SELECT list(x ORDER BY i) AS t FROM (
            SELECT i, list_reduce(list_prepend(i, range(8)), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) AS x FROM range(256) r(i))),
        {name} AS (SELECT s, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, octet_length(encode(s))),
                lambda i: CAST(('0x' || substr(hex(encode(s)), CAST(2 * i + 1 AS BIGINT), 2)) AS BIGINT))),
                lambda c, b: xor(c >> 8, t[CAST(xor(c, b) & 255 AS BIGINT) + 1])), 4294967295) AS crc
            FROM ({strings}), {name}_t)"""


def sql(percent: int = 10, least_words: int = 20, buckets: int = BUCKETS, seed: int = 2024) -> str:
    split = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
        WITH d AS (SELECT row_number() OVER () AS u, doc_id, {split} AS ws FROM documents),
        dw AS (SELECT u, unnest(ws) AS s FROM d),
        bw AS (SELECT unnest({split}) AS s FROM benchmark),
        {sql_crc("crc", "SELECT s FROM dw UNION SELECT s FROM bw")},
        ds AS (SELECT crc % {buckets} AS b, count(*) AS n FROM dw JOIN crc USING (s) GROUP BY 1),
        bs AS (SELECT crc % {buckets} AS b, count(*) AS n FROM bw JOIN crc USING (s) GROUP BY 1),
        g AS (SELECT b, CAST(floor(1000 * ln(((coalesce(bs.n, 0) + 1) * CAST((SELECT coalesce(sum(n), 0) FROM ds) + {buckets} AS DOUBLE))
                / ((coalesce(ds.n, 0) + 1) * CAST((SELECT coalesce(sum(n), 0) FROM bs) + {buckets} AS DOUBLE)))) AS BIGINT) AS gain
            FROM (SELECT unnest(range({buckets})) AS b) LEFT JOIN ds USING (b) LEFT JOIN bs USING (b)),
        w AS (SELECT u, CAST(sum(gain) AS BIGINT) AS total FROM dw JOIN crc USING (s) JOIN g ON b = crc % {buckets} GROUP BY u),
        x AS (SELECT u, doc_id, len(ws) AS n, CASE WHEN len(ws) = 0 THEN 0 ELSE CAST(floor(total / len(ws)) AS BIGINT) END AS weight,
                CAST('0x' || substr(sha256('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h
            FROM d LEFT JOIN w USING (u)),
        y AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5) / 4294967296))) AS BIGINT) AS score FROM x),
        z AS (SELECT u, row_number() OVER (ORDER BY score DESC, doc_id NULLS FIRST, u) AS r, count(*) OVER () AS able FROM y WHERE n >= {least_words})
        SELECT doc_id, n AS n_features, weight, score, CASE WHEN r <= {percent} * able // 100 THEN r END AS rank FROM y LEFT JOIN z USING (u)"""
