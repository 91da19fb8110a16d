"""SentencePiece encoding and decoding (BPE models with byte fallback).

A text is cut at its spaces, and each word with the space before it at places that no piece spans. The distinct
words of a block of texts then lie in flat arrays of symbols, and all are merged together in rounds: the least rank
among each word's pairs (a segmented minimum), its leftmost pair (where the merge cannot give a lesser rank, all its
pairs from the left that do not overlap), then compaction, until no pair has a rank. What is left of a word after
``ROUNDS`` rounds, as of an adversarial run of characters, takes a heap to its end, so that time stays n log n.
Pieces of spaces alone rank last in the models that are taken, so runs of spaces are merged after all else.

Null texts count as empty; empty texts give no ids but the end's; repeated rows each give a row; an empty table gives
an empty result; other columns pass through, whatever their names, but a column with the name of an output column is
replaced. Texts are encoded whole, of whatever length. The sign U+2581 is a space, as in the library.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, column, tidy

#: Characters of text that are encoded together; words of each generation of a worker's memo, the longest that is kept.
BLOCK, MEMO_ENTRIES, MEMO_CHARS = 1 << 20, 200_000, 48
#: Rounds of merges after which what is left of a word takes a heap.
ROUNDS = 256
SPACE = "▁"
_NONE = 1 << 40
_NORMAL, _UNKNOWN, _CONTROL, _BYTE = 1, 2, 3, 6


class Pieces:
    """A model: its symbols (pieces by id, then characters that only longer pieces hold) and the ranks of their pairs."""

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        kinds = [p.type for p in proto.pieces]
        norm = proto.normalizer_spec
        plain = not norm.precompiled_charsmap and norm.add_dummy_prefix and not norm.remove_extra_whitespaces and norm.escape_whitespaces
        if proto.trainer_spec.model_type != 2 or not plain or proto.trainer_spec.treat_whitespace_as_suffix or not set(kinds) <= {_NORMAL, _UNKNOWN, _CONTROL, _BYTE}:
            raise ValueError("only BPE models with byte fallback, plain text and a leading space are taken")
        self.end = next(i for i, p in enumerate(proto.pieces) if p.type == _CONTROL and p.piece == proto.trainer_spec.eos_piece)
        score = {p.piece: p.score for p in proto.pieces if p.type == _NORMAL}
        number = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == _NORMAL}
        bytes_ = {int(p.piece[1:-1], 16): i for i, p in enumerate(proto.pieces) if p.type == _BYTE}
        if len(bytes_) != 256:
            raise ValueError("only models with byte fallback are taken")
        self.byte = np.array([bytes_[b] for b in range(256)], np.int32)
        runs = {p for p in score if p == SPACE * len(p)}
        if any(SPACE in p[1:] and p not in runs for p in score) or max((score[p] for p in runs if len(p) > 1), default=-np.inf) >= min(s for p, s in score.items() if len(p) > 1 and p not in runs):
            raise ValueError("only models whose spaces begin a piece, and whose pieces of spaces rank last, are taken")
        self.runs = {len(p): number[p] for p in runs}
        self.space = number.get(SPACE, -1)
        if self.space < 0:
            raise ValueError("only models with a piece for one space are taken")
        self.n = len(proto.pieces)
        symbols = dict(number)
        for p in score:
            for c in p:
                symbols.setdefault(c, self.n + len(symbols) - len(number))
        self.char = np.full(0x110000, -1, np.int32)
        for s, i in symbols.items():
            if len(s) == 1:
                self.char[ord(s)] = i
        rank_of = {s: k for k, s in enumerate(sorted(set(score.values()), reverse=True))}
        pairs, results, bigrams, least = [], [], set(), {}
        for p, s in score.items():
            if p in runs:
                continue
            bigrams.update(ord(a) << 21 | ord(b) for a, b in zip(p, p[1:]))
            for k in range(1, len(p)):
                left, right = symbols.get(p[:k]), symbols.get(p[k:])
                if left is not None and right is not None:
                    pairs.append(left << 20 | right)
                    results.append(number[p])
                    for x in (left, right):
                        least[x] = min(least.get(x, _NONE), rank_of[s])
        order = np.argsort(np.array(pairs, np.int64))
        self.pairs, self.results = np.array(pairs, np.int64)[order], np.array(results, np.int64)[order]
        self.rank = np.zeros(self.n, np.int64)
        for p, i in number.items():
            self.rank[i] = rank_of[score[p]]
        #: Merges into these give no pair of a lesser or equal rank.
        self.calm = np.array([least.get(i, _NONE) > self.rank[i] for i in range(self.n)])
        self.bigrams = np.array(sorted(bigrams), np.int64)
        shown = [p.piece.replace(SPACE, " ").encode() if k == _NORMAL else b"" for p, k in zip(proto.pieces, kinds)]
        for b, i in bytes_.items():
            shown[i] = bytes([b])
        for i, k in enumerate(kinds):
            if k == _UNKNOWN:
                shown[i] = proto.trainer_spec.unk_surface.encode()
        self.shown, self.kinds = shown, np.array(kinds)
        self.sizes = np.array([len(x) for x in shown], np.int64)
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(shown), np.uint8)
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.run_ids: dict[int, bytes] = {}

    def joined(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that two adjacent symbols give, or -1."""
        key = left.astype(np.int64) << 20 | right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where((self.pairs[at] == key) & (left >= 0) & (right >= 0), self.results[at], -1)

    def merge_all(self, words: list[str]) -> list[bytes]:
        """Ids (little-endian, 32 bits) of each word with a space before it; no word holds a space."""
        cp = np.frombuffer((SPACE + SPACE.join(words)).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        heads = np.flatnonzero(cp == ord(SPACE))
        key = cp[:-1] << 21 | cp[1:]
        at = np.minimum(np.searchsorted(self.bigrams, key), max(0, len(self.bigrams) - 1))
        cut = np.concatenate(([True], (self.bigrams[at] != key) if len(self.bigrams) else np.ones(len(key), bool)))
        cut[heads] = True
        first = self.char[cp]  # the final symbol at each place where one begins; -2 where none does
        final = np.full(len(cp), -2, np.int64)
        place, sym, segment = np.arange(len(cp)), first.astype(np.int64), np.cumsum(cut) - 1
        got = self._pairs(sym, segment)
        for _ in range(ROUNDS):
            if not len(sym):
                break
            starts = np.flatnonzero(np.diff(segment, prepend=-1))
            rank = np.where(got >= 0, self.rank[got], _NONE)
            low = np.minimum.reduceat(rank, starts)
            per = np.repeat(low, np.diff(np.append(starts, len(sym))))
            done = per == _NONE
            final[place[done]] = sym[done]
            hit = np.flatnonzero((rank == per) & ~done)
            # Within a run of overlapping pairs every other one; of a piece that is not calm the word's first alone.
            fresh = np.diff(hit, prepend=-2) != 1
            lead = np.maximum.accumulate(np.where(fresh, np.arange(len(hit)), 0))
            of = segment[hit]
            once = np.diff(of, prepend=-1) != 0
            hit = hit[((np.arange(len(hit)) - lead) % 2 == 0) & (self.calm[got[hit]] | once)]
            sym[hit] = got[hit]
            keep = ~done
            keep[hit + 1] = False
            changed = np.zeros(len(sym), bool)
            changed[hit] = True
            changed[np.maximum(hit - 1, 0)] = True
            changed[np.maximum(hit - 2, 0)] = True  # the symbol before may itself have been the later half of a merge
            sym, segment, place, got, changed = sym[keep], segment[keep], place[keep], got[keep], changed[keep]
            todo = np.flatnonzero(changed)
            if len(todo):
                got[todo] = self._pairs(sym, segment, todo)
        for a, z in self._bounds(segment):
            for i, s in self._heap(sym[a:z].tolist()):
                final[place[a + i]] = s
        kept = np.flatnonzero(final != -2)
        out, chars = final[kept], cp[kept]
        raw = (out < 0) | (out >= self.n)
        size = np.ones(len(out), np.int64)
        c = chars[raw]
        size[raw] = 1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF)
        ends = np.cumsum(size)
        ids = np.repeat(out, size)
        begin = (ends - size)[raw]
        for k in range(4):  # the k-th byte of each character that has no piece
            some = size[raw] > k
            n, x = size[raw][some], c[some]
            lead = np.where(n == 1, x, np.where(n == 2, 0xC0, np.where(n == 3, 0xE0, 0xF0)) | x >> 6 * (n - 1))
            ids[begin[some] + k] = self.byte[(lead if k == 0 else 0x80 | x >> 6 * (n - 1 - k) & 0x3F).astype(np.int64)]
        data = ids.astype("<i4").tobytes()
        bounds = (np.append(ends - size, ends[-1:])[np.searchsorted(kept, np.append(heads, len(cp)))] * 4).tolist()
        return [data[a:z] for a, z in zip(bounds, bounds[1:])]

    def _pairs(self, sym: np.ndarray, segment: np.ndarray, todo: np.ndarray | None = None) -> np.ndarray:
        """What each symbol (of the places ``todo``) gives with the next one of its segment, or -1."""
        todo = np.arange(len(sym)) if todo is None else todo
        after = np.minimum(todo + 1, len(sym) - 1)
        same = (segment[todo] == segment[after]) & (after > todo)
        return np.where(same, self.joined(sym[todo], sym[after]), -1)

    @staticmethod
    def _bounds(segment: np.ndarray) -> list[tuple[int, int]]:
        starts = np.flatnonzero(np.diff(segment, prepend=-1)).tolist() if len(segment) else []
        return list(zip(starts, [*starts[1:], len(segment)]))

    def _heap(self, ids: list[int]) -> list[tuple[int, int]]:
        """The rest of one word's merges: the place and symbol of each part that stays."""
        n = len(ids)
        table: dict[int, tuple[int, int] | None] = {}

        def join(a: int, b: int) -> tuple[int, int] | None:
            if a < 0 or b < 0:
                return None
            key = a << 20 | b
            if key not in table:
                at = int(np.searchsorted(self.pairs, key))
                hit = at < len(self.pairs) and self.pairs[at] == key
                table[key] = (int(self.rank[self.results[at]]), int(self.results[at])) if hit else None
            return table[key]

        pair = [join(a, b) for a, b in zip(ids, ids[1:])] + [None]
        heap = [(p[0], i) for i, p in enumerate(pair) if p]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        gone = [False] * n
        heapify(heap)
        while heap:
            rank, i = heappop(heap)
            if gone[i] or not pair[i] or pair[i][0] != rank:
                continue
            j = after[i]
            ids[i], gone[j] = pair[i][1], True
            k = after[i] = after[j]
            if k < n:
                before[k] = i
            pair[i] = join(ids[i], ids[k]) if k < n else None
            if pair[i]:
                heappush(heap, (pair[i][0], i))
            h = before[i]
            if h >= 0:
                pair[h] = join(ids[h], ids[i])
                if pair[h]:
                    heappush(heap, (pair[h][0], h))
        return [(i, x) for i, x in enumerate(ids) if not gone[i]]

    def run(self, k: int) -> bytes:
        """Ids of ``k`` spaces: the leftmost pair that has a piece first, one after the other."""
        if k not in self.run_ids:
            sizes: list[int] = []
            left = k
            while left or len(sizes) > 1:
                # All but the last two parts are settled; what comes is single spaces.
                if len(sizes) > 1 and sizes[-2] + sizes[-1] in self.runs:
                    sizes[-2:] = [sizes[-2] + sizes[-1]]
                elif sizes and left and sizes[-1] + 1 in self.runs:
                    sizes[-1] += 1
                    left -= 1
                elif left:
                    sizes.append(1)
                    left -= 1
                else:
                    break
            found = np.array([self.runs[s] for s in sizes], "<i4").tobytes()
            if k > 4096:
                return found
            self.run_ids[k] = found
        return self.run_ids[k]

    def encode_block(self, texts: list[str]) -> list[bytes]:
        if len(self.young) > MEMO_ENTRIES:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        split = [t.replace(SPACE, " ").split(" ") if t else [] for t in texts]
        missing = []
        for w in set().union(*split).difference(young):
            known = old.get(w)
            if known is not None:
                young[w] = known
            elif w:
                missing.append(w)
        long: dict[str, bytes] = {}
        if missing:
            for w, ids in zip(missing, self.merge_all(missing)):
                (young if len(w) <= MEMO_CHARS else long)[w] = ids
        of = young.__getitem__ if not long else lambda w: young[w] if w in young else long[w]
        space = int(self.space).to_bytes(4, "little")
        out = []
        for words in split:
            if "" not in words:
                out.append(b"".join(map(of, words)))
                continue
            parts, blanks = [], 0
            for w in words:
                if not w:
                    blanks += 1
                    continue
                ids = of(w)
                if blanks and ids.startswith(space):  # the word's own space has stayed single and joins the run
                    parts += self.run(blanks + 1), ids[4:]
                else:
                    parts += self.run(blanks), ids
                blanks = 0
            out.append(b"".join([*parts, self.run(blanks)]))
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids without the end's, as little-endian 32-bit integers."""
        out: list[bytes] = []
        at, size = 0, 0
        for k, text in enumerate(texts):
            size += len(text)
            if size >= BLOCK or k == len(texts) - 1:
                out += self.encode_block(texts[at : k + 1])
                at, size = k + 1, 0
        return out

    def decode(self, ids: np.ndarray) -> str:
        """What the ids show: control ids nothing, one space at the start is dropped, bytes that are no UTF-8 become U+FFFD."""
        if len(ids) and (ids.min() < 0 or ids.max() >= self.n):
            raise ValueError("an id that the model lacks")
        kinds = self.kinds[ids]
        if (kinds[:-1] == _CONTROL).any():  # a control id parts the bytes around it
            return self._slowly(ids.tolist())
        size = self.sizes[ids]
        begin = np.cumsum(size) - size
        raw = self.bytes[np.arange(size.sum()) + np.repeat(self.begins[ids] - begin, size)].tobytes()
        try:
            text = raw.decode()
        except UnicodeDecodeError:
            return self._slowly(ids.tolist())
        return text[1:] if len(ids) and kinds[0] == _NORMAL and text.startswith(" ") else text

    def _slowly(self, ids: list[int]) -> str:
        parts, held, first = [], bytearray(), True

        def flush() -> None:
            at = 0
            while at < len(held):
                for n in (1, 2, 3, 4):
                    try:
                        parts.append(bytes(held[at : at + n]).decode())
                        at += n
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    parts.append("�")
                    at += 1
            held.clear()

        for i in ids:
            if self.kinds[i] == _BYTE:
                held += self.shown[i]
                first = False
                continue
            flush()
            text = self.shown[i].decode()
            if first and self.kinds[i] == _NORMAL:
                text = text[1:] if text.startswith(" ") else text
                first = False
            elif self.kinds[i] != _CONTROL:
                first = False
            parts.append(text)
        flush()
        return "".join(parts)


_models: dict[str, Pieces] = {}  # one for each model, kept by the worker


def _mapped(df: DataFrame, model_path: str, source: str, ids: str | None, decoded: str | None) -> DataFrame:
    spark = df.sparkSession
    bound_batches(spark)
    shared = spark.sparkContext.broadcast(Path(model_path).read_bytes())  # 0.5 MB, whatever the input
    kinds = {ids: T.ArrayType(T.IntegerType()), decoded: T.StringType()}
    new = [c for c in (ids, decoded) if c]
    rest = [c for c in df.columns if c not in new]
    schema = T.StructType([df.schema[c] for c in rest] + [T.StructField(c, kinds[c]) for c in new])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model_path not in _models:
            _models[model_path] = Pieces(shared.value)
        model = _models[model_path]
        end = model.end.to_bytes(4, "little")
        for batch in batches:
            added = []
            if ids:
                found = [x + end for x in model.encode([x or "" for x in column(batch, source).to_pylist()])]
                flat = np.frombuffer(b"".join(found), "<i4")
                bounds = np.cumsum([0, *(len(x) // 4 for x in found)])
                added.append(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat, pa.int32())))
            else:
                given = column(batch, source).cast(pa.list_(pa.int32()))
                lengths = given.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                flat, bounds = given.flatten().to_numpy(zero_copy_only=False), np.cumsum([0, *lengths])
            if decoded:
                added.append(pa.array([model.decode(flat[a:z]) for a, z in zip(bounds, bounds[1:])], pa.string()))
            yield pa.RecordBatch.from_arrays([*(column(batch, c) for c in rest), *added], names=[*rest, *new])

    return df.mapInArrow(tidy(run), schema)


def encode(df: DataFrame, model_path: str, text: str = "text", into: str = "ids") -> DataFrame:
    """Adds the ids of ``text``, the end's id last."""
    return _mapped(df, model_path, text, into, None)


def decode(df: DataFrame, model_path: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """Adds the text that ``ids`` stand for; null ids give an empty text, unknown ids fail."""
    return _mapped(df, model_path, ids, None, into)


def round_trip(df: DataFrame, model_path: str, text: str = "text") -> DataFrame:
    """``encode`` and ``decode`` of what it gives, in one pass: adds ``ids`` and ``decoded``."""
    return _mapped(df, model_path, text, "ids", "decoded")


def digest(encoded: DataFrame) -> DataFrame:
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
