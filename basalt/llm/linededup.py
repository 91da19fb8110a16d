"""Removal of lines that repeat an earlier line, exactly or within a few edits.

Lines are compared by a segment-partition edit join. A line is cut into ``edits + 1`` segments; two lines
within ``edits`` edits share a segment of the shorter one, at a place that the lengths confine. Segments
are keyed by their line's length, their number and their text; each line probes the keys of every length
that may match, only with the substrings at places that may match. Only lines that meet another one under a key
go there with their texts; under each key they come in order of their first places, and each is compared with
those before it, the earliest first, until one is near: by a bit-parallel edit distance over a band of
``2 edits + 1`` diagonals. So a line has one match a key at most, however many lines are alike.

A line is removed if the same line, or one within ``edits`` edits, stands earlier: in a document with a
smaller id, or above it in its own. Lines are judged on the input, not on what is left. Lines of fewer than
``min_chars`` code points stay. Null texts count as empty; an empty text has one line, which is empty. Rows
without an id neither lose lines nor cost others any; rows that repeat an id and a text are not earlier than
each other; of rows that share an id and differ in text, the one with the smaller hash of its text is earlier.
Texts and lines of any length are read whole; ``min_chars`` below ``2 edits + 1`` is an error, as such a line may be near one
too short to be cut. Lines are told apart by 61-bit hashes, rows of one id by 64-bit
hashes. Other columns pass through in ``rest``. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import _R, _R_INVERSE, bound_batches, column, mix, text_hash, tidy, written
from .substring import batch_of, by_key, packed, texts_of

EDITS, MIN_CHARS = 2, 20
#: Lines that are broadcast at most, by their hash; beyond, the join is a shuffle.
BROADCAST_ROWS = 1_000_000
#: Characters that are hashed at a time.
BLOCK = 1 << 20
#: Lines of a block that go to a key one by one; where there are more, one goes there for all of them.
KEPT = 16
#: Lines of a key whose parities are held against each other (of more, all go on), and that are compared in one task.
TESTED, SPLIT = 2048, 20_000
#: The lowest bits of a line's hash are left for what a row stands for: a probe instead of an own segment; all
#: of a block's lines; a line that is known to meet others, whose key stands in ``parity``.
PROBE, MANY, MET = 1, 2, 4
_BINS = 1 << 18
_LINE = 0xFFFFFFFFFFFFFFF8


def edit_distance(a: str, b: str, most: int) -> int:
    """Levenshtein distance in code points, or ``most + 1`` if it is more. A column's vertical differences in
    the band are bits; the band moves down one row a column."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    k, end = 0, min(len(a), len(b))
    while k < end and a[k] == b[k]:
        k += 1
    a, b = a[k:], b[k:]
    k, end = 0, min(len(a), len(b))
    while k < end and a[-1 - k] == b[-1 - k]:
        k += 1
    a, b = a[: len(a) - k], b[: len(b) - k]
    m, n = len(a), len(b)
    if not m or not n:
        return min(max(m, n), most + 1)
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    mask = (1 << 2 * most + 1) - 1
    low, up, down = 1 << 2 * most, mask ^ (1 << most) - 1, 0
    distance, limit = min(m, most), most + n - m + most
    for j, c in enumerate(b, 1):
        shift, equal = j - most - 1, where.get(c, 0)
        equal = (equal >> shift if shift >= 0 else equal << -shift) & mask
        diagonal = ((((equal & up) + up) ^ up) | equal | down) & mask
        right_up = down | mask & ~(diagonal | up)
        right_down = diagonal & up
        if j <= m - most:
            distance += not diagonal & low
            if distance > limit:
                return most + 1
        else:
            row = 1 << m - j + most
            distance += bool(right_up & row) - bool(right_down & row)
        up = (right_down | ~(diagonal >> 1 | right_up)) & mask
        down = diagonal >> 1 & right_up
    return min(distance, most + 1)


def probes(length: np.ndarray, edits: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int, bool]]:
    """For lines of the given lengths: ``which`` of them, and of those ``first`` and ``size`` of a substring
    that may equal segment ``number`` of a line ``gap`` shorter; and whether it is the line's own segment.

    The parts before a segment and behind it hold so few edits that the substring's place is confined."""
    parts = edits + 1
    for gap in range(parts):
        short = length - gap
        base, more = short // parts, short % parts
        for i in range(parts):
            size = base + (i >= parts - more)
            begin = i * base + np.maximum(0, i - (parts - more))
            for move in range(max(-i, gap - (edits - i)), min(i, gap + edits - i) + 1):
                at = begin + move
                which = np.flatnonzero((base > 0) & (at >= 0) & (at + size <= length))
                yield which, at[which], size[which], gap * parts + i, not gap and not move


_powers: tuple[np.ndarray, np.ndarray] | None = None


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if _powers is None or len(_powers[0]) < n:
        p, b = np.full(n + 1, _R, np.uint64), np.full(n + 1, _R_INVERSE, np.uint64)
        p[0] = b[0] = 1
        _powers = np.multiply.accumulate(p), np.multiply.accumulate(b)
    return _powers


class Lines:
    """Lines that aren't empty: their places, hashes and parities."""

    def __init__(self, lines: list[str]):
        points = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.length = np.array([len(x) for x in lines], np.int64)
        self.begin = np.cumsum(self.length) - self.length
        self.sums = np.zeros(len(points) + 1, np.uint64)
        np.cumsum(mix(points) * powers(len(points))[0][: len(points)], out=self.sums[1:])
        #: Parity of the number of characters in each of 64 classes: an edit changes two bits at most.
        bits = np.uint64(1) << (mix(points) >> np.uint64(58))
        self.parity = np.bitwise_xor.reduceat(bits, self.begin) if len(lines) else np.zeros(0, np.uint64)
        self.id = self.hash(self.begin, self.length, 0) & np.uint64(_LINE)

    def hash(self, begin: np.ndarray, length: np.ndarray | int, kind: np.ndarray | int) -> np.ndarray:
        back = powers(len(self.sums))[1]
        whole = (self.sums[begin + length] - self.sums[begin]) * back[begin]
        return mix(whole + mix(np.atleast_1d(length).astype(np.uint64) * np.uint64(1 << 20) + np.atleast_1d(kind).astype(np.uint64)))


def long_lines(texts: list[str | None], min_chars: int) -> Iterator[tuple[list[int], list[int], list[str]]]:
    """Row, number and text of the lines that take part, about ``BLOCK`` characters at a time."""
    rows, numbers, lines, size = [], [], [], 0
    for row, text in enumerate(texts):
        for number, line in enumerate((text or "").split("\n")):
            if len(line) >= min_chars:
                rows.append(row)
                numbers.append(number)
                lines.append(line)
                size += len(line)
                if size >= BLOCK:
                    yield rows, numbers, lines
                    rows, numbers, lines, size = [], [], [], 0
    if lines:
        yield rows, numbers, lines


def occurrences(docs: DataFrame, min_chars: int) -> DataFrame:
    """``line, doc_id, th, at`` of every line; ``at`` is its number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ths = (column(batch, c).to_numpy() for c in ("doc_id", "th"))
            for rows, numbers, lines in long_lines(column(batch, "text").to_pylist(), min_chars):
                yield batch_of([Lines(lines).id, ids[rows], ths[rows], np.array(numbers)], ["line", "doc_id", "th", "at"])

    return docs.mapInArrow(tidy(run), "line long, doc_id long, th long, at long")


def gathered(key: np.ndarray, line: np.ndarray, parity: np.ndarray) -> tuple[np.ndarray, ...]:
    """The rows of a block. Of a key with more than ``KEPT``, one row stands for all; they are known to meet
    each other, and are dealt out by their own hash."""
    bins = (key & np.uint64(_BINS - 1)).astype(np.int64)
    full = np.bincount(bins, minlength=_BINS) > KEPT
    if not full.any():
        return key, line, parity
    apart = full[bins]  # few rows, of the keys that may be hot
    left, rest = np.flatnonzero(~apart), np.flatnonzero(apart)
    rest = rest[np.argsort(key[rest], kind="stable")]
    start = np.flatnonzero(np.concatenate([[True], key[rest[1:]] != key[rest[:-1]]]))
    length = np.diff(np.append(start, len(rest)))
    hot = length > KEPT
    lead = np.array([rest[a + int((line[rest[a : a + n]] & np.uint64(PROBE)).argmin())] for a, n in zip(start[hot], length[hot])], np.int64)
    many = np.repeat(hot, length)
    one, rest = np.concatenate([left, rest[~many]]), rest[many]
    keys_ = [key[one], key[lead], mix(key[rest] ^ line[rest])]
    lines = [line[one], line[lead] | np.uint64(MANY), line[rest] | np.uint64(MET)]
    return np.concatenate(keys_), np.concatenate(lines), np.concatenate([parity[one], parity[lead], key[rest]])


def keys(docs: DataFrame, edits: int, min_chars: int) -> DataFrame:
    """``key, line, parity``: a row for each segment and further probe of each line; a line once a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = np.zeros(0, np.uint64)
            for _, _, lines in long_lines(column(batch, "text").to_pylist(), min_chars):
                block = Lines(list(dict.fromkeys(lines)))
                fresh = np.flatnonzero(~np.isin(block.id, done))
                done = np.concatenate([done, block.id[fresh]])
                found: list[tuple[np.ndarray, ...]] = []
                length, begin, ids, parity = block.length[fresh], block.begin[fresh], block.id[fresh], block.parity[fresh]
                for which, at, size, number, own in probes(length, edits):
                    gap, i = divmod(number, edits + 1)
                    kind = (length[which] - gap) * 16 + i + 1
                    found.append((block.hash(begin[which] + at, size, kind), ids[which] | np.uint64(PROBE * (not own)), parity[which]))
                if found and len(fresh):
                    yield batch_of(gathered(*(np.concatenate(x) for x in zip(*found))), ["key", "line", "parity"])

    return docs.mapInArrow(tidy(run), "key long, line long, parity long")


def meetings(rows: DataFrame, edits: int) -> DataFrame:
    """``key, line``: lines that meet another one under a key, where one has it as a segment of its own, unless
    the parities of all those differ by more than the edits can."""

    def of_runs(key: np.ndarray, line: np.ndarray, parity: np.ndarray) -> Iterator[pa.RecordBatch]:
        met = line & MET > 0
        out = [(parity[met], line[met] & ~np.int64(MET))]
        key, line, parity = key[~met], line[~met], parity[~met]
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        length = np.diff(np.append(start, len(key)))
        if len(key):
            # Most keys have one line alone, from several batches, or probes alone.
            other = np.concatenate([[False], (key[1:] == key[:-1]) & ((line[1:] ^ line[:-1]) & np.int64(~7) != 0)])
            useful = np.logical_or.reduceat(other, start) & np.logical_or.reduceat((line & PROBE == 0) | (line & MANY > 0), start)
            start, length = start[useful], length[useful]
        for at, n in zip(start, length):
            many = bool((line[at : at + n] & MANY).any())
            run, where = np.unique(line[at : at + n] & ~np.int64(MANY), return_index=True)
            of, sign = run & ~np.int64(PROBE), parity[at : at + n][where]
            own = run & PROBE == 0
            if of[0] == of[-1] or not many and not own.any():
                continue
            if not many and len(run) <= TESTED:
                near = np.bitwise_count(sign[own, None] ^ sign[None]) <= 2 * edits
                near &= of[own, None] != of[None]
                hit = near.any(0)
                hit[own] |= near.any(1)
                run = run[hit]
            if len(run):
                out.append((np.full(len(run), key[at]), run))
        yield batch_of([np.concatenate(x) for x in zip(*out)], ["key", "line"])

    return by_key(rows, "key", ["key", "line", "parity"], of_runs, "key long, line long")


def texts_of_lines(docs: DataFrame, wanted: DataFrame, min_chars: int) -> DataFrame:
    """``line, text`` of the wanted lines. Few are picked where they are read, by a broadcast; else by a join."""
    few = wanted.count() <= BROADCAST_ROWS
    picked = np.sort(wanted.toPandas()["line"].to_numpy(np.int64)) if few else None
    shared = docs.sparkSession.sparkContext.broadcast(picked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, lines in long_lines(column(batch, "text").to_pylist(), min_chars):
                lines = list(dict.fromkeys(lines))
                ids = Lines(lines).id.view(np.int64)
                at = np.flatnonzero(np.isin(ids, shared.value)) if shared.value is not None else np.arange(len(ids))
                yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array([lines[i] for i in at], pa.string())], names=["line", "text"])

    found = docs.mapInArrow(tidy(run), "line long, text string")
    found = found if few else found.join(wanted, "line", "left_semi")
    return found.groupBy("line").agg(F.first("text").alias("text"))


def earliest(met: DataFrame, lines: DataFrame, edits: int) -> DataFrame:
    """``line, near``: of each line that has one, the place of the first line before it within ``edits`` edits.
    ``lines`` has ``line, text`` and the ``first`` place of each. A key of very many lines is split by ranges of
    the earlier side; the least match counts."""
    counts = met.groupBy("key").agg(F.ceil(F.count("*") / SPLIT).alias("parts"))
    known = lines.select(F.col("line").alias("of"), "text", "first.*")
    each = met.withColumn("of", F.col("line").bitwiseAND(~7)).join(known, "of").join(counts, "key")
    each = each.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    early = (F.pmod(F.xxhash64("of"), "parts") == F.col("part")).alias("early")
    place = ("doc_id", "th", "at")
    dealt = each.select("key", "part", "of", (F.col("line").bitwiseAND(PROBE) == 0).alias("own"), early, *place, "text")
    dealt = dealt.repartition("key", "part").sortWithinPartitions("key", "part", *place)

    def compared(group: pa.Table) -> Iterator[tuple[int, int, int, int]]:
        texts = group.column("text").to_pylist()
        parity = Lines(texts).parity
        of, ids, ths, at = (group.column(c).to_numpy() for c in ("of", *place))
        own, first = (group.column(c).to_numpy() for c in ("own", "early"))
        for i in range(1, len(texts)):
            near = np.bitwise_count(parity[:i] ^ parity[i]) <= 2 * edits
            near &= first[:i] & (of[:i] != of[i])
            if not own[i]:
                near &= own[:i]
            for j in np.flatnonzero(near):
                if edit_distance(texts[i], texts[j], edits) <= edits:
                    yield of[i], ids[j], ths[j], at[j]
                    break

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            key, part = (rows.column(c).to_numpy() for c in ("key", "part"))
            cut = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (part[1:] != part[:-1]), [True]]))
            found = [x for a, z in zip(cut, cut[1:]) if z - a > 1 for x in compared(rows.slice(a, z - a))]
            if found:
                yield batch_of([np.array(x, np.int64) for x in zip(*found)], ["line", *place])

        for batch in batches:
            if not batch.num_rows:
                continue
            key, part = (column(batch, c).to_numpy() for c in ("key", "part"))
            last = int(np.flatnonzero((key == key[-1]) & (part == part[-1]))[0])
            if held and (last or (column(held[-1], "key")[-1].as_py(), column(held[-1], "part")[-1].as_py()) != (key[-1], part[-1])):
                yield from flush(pa.Table.from_batches([*held, *[batch.slice(0, last)] * bool(last)]))
                held = []
            elif last:
                yield from flush(pa.Table.from_batches([batch.slice(0, last)]))
            held.append(batch.slice(last))
        if held:
            yield from flush(pa.Table.from_batches(held))

    found = dealt.mapInArrow(tidy(run), "line long, doc_id long, th long, at long")
    return found.groupBy("line").agg(F.min(F.struct(*place)).alias("near"))


def dedup(docs: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """``rest, n_lines, n_removed, source_doc_id, kept`` for every row: all its columns but the text as a
    struct, the lines that are left, and the least document that has an earlier line for a removed one (null
    where nothing is removed)."""
    bound_batches(docs.sparkSession)
    rest = F.struct(*(docs[c] for c in docs.columns if c != "text"))
    keyed = docs.select(F.col("doc_id").cast("long"), "text", text_hash().alias("th"), rest.alias("rest"))
    known = keyed.filter(F.col("doc_id").isNotNull()).drop("rest")
    if min_chars < 2 * edits + 1:
        raise ValueError("lines need 2 * edits + 1 characters at least: shorter ones have partners without a segment of their own")
    seen = written(occurrences(known, min_chars))
    place = F.struct("doc_id", "th", "at")
    firsts = seen.groupBy("line").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    met = written(meetings(keys(known, edits, min_chars), edits))
    wanted = written(met.select(F.col("line").bitwiseAND(~7).alias("line")).distinct())
    some = seen.join(wanted, "line", "left_semi").groupBy("line").agg(F.min(place).alias("first"))
    near = written(earliest(met, texts_of_lines(known, wanted, min_chars).join(some, "line"), edits))
    judged = firsts.join(near, "line", "left").select("line", F.least("first", F.coalesce("near", "first")).alias("source"), "last")
    judged = written(judged.filter(F.col("source") < F.col("last")).select("line", "source"))
    small = judged.count() <= BROADCAST_ROWS
    late = seen.join(F.broadcast(judged) if small else judged, "line").filter(F.col("source") < place)
    per_doc = late.groupBy("doc_id", "th").agg(F.collect_list("at").alias("gone"), F.min("source.doc_id").alias("source_doc_id"))
    per_doc = per_doc.select(F.col("doc_id").alias("_id"), F.col("th").alias("_th"), "gone", "source_doc_id")
    joined = packed(keyed).join(per_doc, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th")), "left").select("rest", "z", "gone", "source_doc_id")
    schema = T.StructType([keyed.schema["rest"], *(T.StructField(c, T.LongType()) for c in ("n_lines", "n_removed", "source_doc_id")), T.StructField("kept", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            totals, removed, kept = [], [], []
            for raw, gone in zip(texts_of(column(batch, "z")), column(batch, "gone").to_pylist()):
                lines = raw.decode().split("\n")
                out = set(gone or ())
                left = [x for i, x in enumerate(lines) if i not in out]
                totals.append(len(lines))
                removed.append(len(out))
                kept.append("\n".join(left))
            arrays = [column(batch, "rest"), pa.array(totals, pa.int64()), pa.array(removed, pa.int64()), column(batch, "source_doc_id"), pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=["rest", "n_lines", "n_removed", "source_doc_id", "kept"])

    return joined.mapInArrow(tidy(run), schema)
