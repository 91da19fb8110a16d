"""Byte-level BPE encoding and decoding.

A whole pre-token that is itself in the vocabulary is resolved by a minimal perfect hash (one probe
and one comparison). What the hash misses is merged with a heap over linked bytes: the heap holds the
adjacent pairs by rank, the links tell each part's neighbours. The distinct misses of some texts are merged
together: each has a heap of its own as a row of a matrix (node k is the lesser of nodes 2k and 2k + 1, the
pairs are the leaves), and a round takes the top of every heap. Long misses have a heap to themselves.

Null texts count as empty (no ids); empty texts give no ids; repeated rows each give a row; an empty
table gives an empty result; other columns pass through, whatever their names, but a column with the
name of an output column is replaced. Texts of any length are encoded whole, in n log n time.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, column, tidy

#: Entries of each generation of the memo of spaced chunks in a Python worker; longest chunk that is kept.
MEMO_ENTRIES, MEMO_CHARS = 200_000, 48
#: Characters of text that are encoded together; leaves of the heaps of the misses that are merged together.
BLOCK, LEAVES = 1 << 20, (8, 16, 32)
_NONE = 1 << 62
_BLANK_RUN = re.compile(r"\s\s|\A\s|\s\Z")


class PerfectHash:
    """Minimal perfect hash of byte strings by hash and displace: ``n`` keys in ``n`` slots."""

    def __init__(self, keys: list[bytes]):
        n = len(keys)
        self.n, self.buckets = n, max(1, n // 3)
        hashes = [xxhash.xxh3_64_intdigest(k) for k in keys]
        groups: dict[int, list[int]] = {}
        for i, h in enumerate(hashes):
            groups.setdefault(h % self.buckets, []).append(i)
        self.displace = array("q", bytes(8 * self.buckets))
        slots: list[int | None] = [None] * n
        todo = sorted(groups.items(), key=lambda g: -len(g[1]))
        for at, (bucket, group) in enumerate(todo):
            if len(group) == 1:
                break
            d = 1
            while True:
                take = [self._slot(hashes[i], d) for i in group]
                if len(set(take)) == len(take) and all(slots[s] is None for s in take):
                    break
                d += 1
            self.displace[bucket] = d
            for s, i in zip(take, group):
                slots[s] = i
        else:
            at = len(todo)
        free = (s for s in range(n) if slots[s] is None)
        for bucket, group in todo[at:]:  # buckets of one key go straight to what is left
            s = next(free)
            self.displace[bucket] = -s - 1
            slots[s] = group[0]
        self.keys = [keys[i] for i in slots]
        self.values = array("l", slots)
        self._places = np.array(self.displace, np.int64)
        self._hashes = np.array([hashes[i] for i in slots], np.uint64)

    def _slot(self, h: int, d: int) -> int:
        return (((h >> 20) ^ (d * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) * 0xD6E8FEB86659FD93 >> 13 & 0xFFFFFFFFFFFF) % self.n

    def get(self, key: bytes) -> int:
        """The key's number, or -1."""
        h = xxhash.xxh3_64_intdigest(key)
        d = self.displace[h % self.buckets]
        s = -d - 1 if d < 0 else self._slot(h, d)
        return self.values[s] if self.keys[s] == key else -1

    def get_all(self, keys: list[bytes]) -> np.ndarray:
        """``get`` of each key; a key itself is compared where the hash agrees."""
        h = np.array(list(map(xxhash.xxh3_64_intdigest, keys)), np.uint64)
        d = self._places[(h % np.uint64(self.buckets)).astype(np.int64)]
        mixed = ((h >> np.uint64(20)) ^ d.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xD6E8FEB86659FD93)
        far = (mixed >> np.uint64(13) & np.uint64(0xFFFFFFFFFFFF)) % np.uint64(self.n)
        slot = np.where(d < 0, -d - 1, far.astype(np.int64))
        out = np.full(len(keys), -1, np.int64)
        for i in np.flatnonzero(self._hashes[slot] == h).tolist():
            if self.keys[slot[i]] == keys[i]:
                out[i] = self.values[slot[i]]
        return out


class Encoder:
    """The vocabulary: its hash, the ranks of its joins, and each id's bytes.

    A single space between two other characters always starts a match of the pattern, so a text without runs
    of white space is the sum of its spaced chunks, whose ids are kept in two generations."""

    def __init__(self, ranks: bytes, pattern: str):
        pairs = [line.split() for line in ranks.splitlines() if line]
        self.tokens = [base64.b64decode(a) for a, _ in pairs]
        self.ids = [int(b) for _, b in pairs]
        self.hash = PerfectHash(self.tokens)
        self.find = regex.compile(pattern).findall
        number = dict(zip(self.tokens, self.ids))
        self.byte = [number[bytes([b])] for b in range(256)]
        self.sizes = np.zeros(max(self.ids) + 1, np.int64)
        self.begins = np.zeros_like(self.sizes)
        self.sizes[self.ids] = [len(t) for t in self.tokens]
        self.begins[self.ids] = np.cumsum([0, *(len(t) for t in self.tokens[:-1])])
        self.bytes = np.frombuffer(b"".join(self.tokens), np.uint8)
        #: Rank of joining two adjacent parts, for every split of every token; the same as sorted arrays.
        self.join: dict[int, int] = {}
        for token, rank in number.items():
            for k in range(1, len(token)):
                left, right = number.get(token[:k]), number.get(token[k:])
                if left is not None and right is not None:
                    self.join[left << 20 | right] = rank
        self.pairs = np.array(sorted(self.join), np.int64)
        self.ranks = np.array([self.join[k] for k in self.pairs.tolist()], np.int64)
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def pair_keys(self, left: np.ndarray, right: np.ndarray, slot: np.ndarray) -> np.ndarray:
        """What stands in a heap for a pair: its rank, and at equal ranks its place."""
        key = left << 20 | right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where((self.pairs[at] == key) & (left >= 0) & (right >= 0), self.ranks[at] << 6, _NONE) | slot

    def merge_all(self, words: list[bytes], leaves: int) -> list[bytes]:
        """Ids of words of ``leaves - 2`` bytes at most. Slots before the first part and behind the last hold
        no part; slot s of word w is number w * leaves + s."""
        n, size = len(words), np.array([len(w) for w in words])
        slots = np.arange(leaves)
        ids = np.full((n, leaves), -1, np.int64)
        ids[(slots >= 1) & (slots <= size[:, None])] = np.array(self.byte)[np.frombuffer(b"".join(words), np.uint8)]
        heap = np.full((n, 2 * leaves), _NONE, np.int64)
        heap[:, leaves:-1] = self.pair_keys(ids[:, :-1], ids[:, 1:], slots[:-1])
        a = leaves // 2
        while a:
            heap[:, a : 2 * a] = np.minimum(heap[:, 2 * a : 4 * a : 2], heap[:, 2 * a + 1 : 4 * a : 2])
            a //= 2
        ids, heap = ids.ravel(), heap.ravel()
        after, before = np.arange(1, n * leaves + 1), np.arange(-1, n * leaves - 1)
        word = np.arange(n)
        while True:
            top = heap[word * (2 * leaves) + 1]
            live = top < _NONE
            word, top = word[live], top[live]
            if not len(word):
                break
            base, root = word * leaves, word * (2 * leaves)
            slot = top & 63
            i = base + slot
            j = after[i]
            k, h = after[j], before[i]
            ids[i], ids[j] = top >> 6, -1
            after[i], before[k] = k, i
            left = h - base
            nodes = [leaves + slot, leaves + (j - base), leaves + left]
            heap[root + nodes[0]] = self.pair_keys(ids[i], ids[k], slot)
            heap[root + nodes[1]] = _NONE
            heap[root + nodes[2]] = self.pair_keys(ids[h], ids[i], left)
            a = leaves // 2
            while a:
                nodes = [x >> 1 for x in nodes]
                for x in nodes:
                    at = root + 2 * x
                    heap[root + x] = np.minimum(heap[at], heap[at + 1])
                a //= 2
        ids = ids.reshape(n, leaves)
        kept = ids >= 0
        ends = (np.cumsum(kept.sum(1)) * 4).tolist()
        data = ids[kept].astype("<u4").tobytes()
        return [data[a:z] for a, z in zip([0, *ends], ends)]

    def merge(self, word: bytes) -> list[int]:
        """The lowest rank first, at equal ranks the leftmost pair. ``rank[i]`` is that of joining part i
        with the part after it."""
        ids = [self.byte[b] for b in word]
        n, join = len(ids), self.join.get
        rank = [join(a << 20 | b) for a, b in zip(ids, ids[1:])]
        heap = [r << 32 | i for i, r in enumerate(rank) if r is not None]
        if not heap:
            return ids
        rank.append(None)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heapify(heap)
        while heap:
            top = heappop(heap)
            i, now = top & 0xFFFFFFFF, top >> 32
            if rank[i] != now:
                continue  # one of its parts has changed since
            j = after[i]
            ids[i], ids[j], rank[j] = now, -1, None
            k = after[i] = after[j]
            r = None
            if k < n:
                before[k] = i
                r = join(now << 20 | ids[k])
                if r is not None:
                    heappush(heap, r << 32 | i)
            rank[i] = r
            h = before[i]
            if h >= 0:
                r = rank[h] = join(ids[h] << 20 | now)
                if r is not None:
                    heappush(heap, r << 32 | h)
        return [x for x in ids if x >= 0]

    def resolve(self, words: list[str]) -> list[bytes]:
        """Ids of each match of the pattern, by either tier."""
        raw = [w.encode() for w in words]
        found = self.hash.get_all(raw) if raw else np.zeros(0, np.int64)
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        out: list[bytes] = [b""] * len(raw)
        for i in np.flatnonzero(found >= 0).tolist():
            out[i] = self.ids[found[i]].to_bytes(4, "little")
        least = 0
        for leaves in LEAVES:
            some = np.flatnonzero((found < 0) & (size > least) & (size <= leaves - 2)).tolist()
            for a in range(0, len(some), 1 << 14):
                part = some[a : a + (1 << 14)]
                for i, ids in zip(part, self.merge_all([raw[i] for i in part], leaves)):
                    out[i] = ids
            least = leaves - 2
        for i in np.flatnonzero((found < 0) & (size > least)).tolist():
            out[i] = array("I", self.merge(raw[i])).tobytes()
        return out

    def encode_block(self, texts: list[str]) -> list[bytes]:
        if len(self.young) > MEMO_ENTRIES:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        split = [text.split(" ") for text in texts]
        heads = [self.find(chunks.pop(0)) for chunks in split]
        single, several, brief = [], {}, {}
        for c in set().union(*split).difference(young):
            known = old.get(c)
            if known is not None:
                young[c] = known
            elif c.isalpha():
                single.append(c)
            elif not c or _BLANK_RUN.search(c):
                brief[c] = None  # a run of white space: its text is split as a whole
            else:
                several[c] = self.find(f" {c}")
        # Split whole: texts with white space at an end or in runs.
        whole = {k for k, text in enumerate(texts) if text[:1].isspace() or text[-1:].isspace() or split[k] and not split[k][-1]}
        if brief:
            whole |= {k for k, chunks in enumerate(split) if not brief.keys().isdisjoint(chunks)}
        whole |= {k for k, text in enumerate(texts) if split[k] and _BLANK_RUN.search(text[: text.index(" ")])}
        for k in whole:
            heads[k], split[k] = self.find(texts[k]), []
        table: dict[str, bytes] = {}
        todo = {f" {c}" for c in single}
        for word in set().union(*heads, *several.values()):
            known = young.get(word[1:]) if word[0] == " " else None
            if known is None:
                todo.add(word)
            else:
                table[word] = known
        words = list(todo)
        table.update(zip(words, self.resolve(words)))
        for c in single:
            (young if len(c) <= MEMO_CHARS else brief)[c] = table[f" {c}"]
        of_word = table.__getitem__
        for c, words in several.items():
            (young if len(c) <= MEMO_CHARS else brief)[c] = b"".join(map(of_word, words))
        of = young.__getitem__ if not brief else lambda c: young[c] if c in young else brief[c]
        return [b"".join([*map(of_word, head), *map(of, chunks)]) for head, chunks in zip(heads, split)]

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        at, size = 0, 0
        for k, text in enumerate(texts):
            size += len(text)
            if size >= BLOCK or k == len(texts) - 1:
                out += self.encode_block(texts[at : k + 1])
                at, size = k + 1, 0
        return out

    def decode(self, ids: bytes) -> bytes:
        """The ids' bytes stand one behind the other in a table; all are gathered at once."""
        found = np.frombuffer(ids, "<u4")
        if len(found) and (found.max() >= len(self.sizes) or not self.sizes[found].all()):
            raise ValueError("an id that the vocabulary lacks")
        size = self.sizes[found]
        begin = np.cumsum(size) - size
        return self.bytes[np.arange(size.sum()) + np.repeat(self.begins[found] - begin, size)].tobytes()


_encoders: dict[tuple[str, str], Encoder] = {}  # one for each vocabulary, kept by the worker


def _mapped(df: DataFrame, ranks_path: str, pattern: str, source: str, ids: str | None, decoded: str | None) -> DataFrame:
    """Adds ``ids`` of the texts in ``source`` (without ``ids``: which holds ids) and the bytes ``decoded`` from them."""
    spark = df.sparkSession
    bound_batches(spark)
    shared = spark.sparkContext.broadcast(Path(ranks_path).read_bytes())  # under 1 MB, whatever the input
    new = [c for c in (ids, decoded) if c]
    rest = [c for c in df.columns if c not in new]
    schema = T.StructType([df.schema[c] for c in rest] + [T.StructField(c, T.BinaryType()) for c in new])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (ranks_path, pattern) not in _encoders:
            _encoders[ranks_path, pattern] = Encoder(shared.value, pattern)
        encoder = _encoders[ranks_path, pattern]
        for batch in batches:
            given = column(batch, source).to_pylist()
            found = encoder.encode([x or "" for x in given]) if ids else [x or b"" for x in given]
            added = [found] * bool(ids) + [[encoder.decode(x) for x in found]] * bool(decoded)
            yield pa.RecordBatch.from_arrays([*(column(batch, c) for c in rest), *(pa.array(x, pa.binary()) for x in added)], names=[*rest, *new])

    return df.mapInArrow(tidy(run), schema)


def encode(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", into: str = "ids") -> DataFrame:
    """Adds the ids of ``text`` as little-endian unsigned 32-bit integers, without special tokens."""
    return _mapped(df, ranks_path, pattern, text, into, None)


def decode(df: DataFrame, ranks_path: str, pattern: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """Adds the bytes that ``ids`` stand for; null ids give no bytes, unknown ids fail."""
    return _mapped(df, ranks_path, pattern, ids, None, into)


def round_trip(df: DataFrame, ranks_path: str, pattern: str, text: str = "text") -> DataFrame:
    """``encode`` and ``decode`` of what it gives, in one pass: adds ``ids`` and ``decoded``."""
    return _mapped(df, ranks_path, pattern, text, "ids", "decoded")


def digest(encoded: DataFrame) -> DataFrame:
    return encoded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
