"""N-gram Jaccard join by a token-group matrix.

Tokens are hashes of word n-grams. They have one order: common tokens last, by hash within. Two sets whose
Jaccard similarity reaches the threshold share a token among their first ones (as many as could be missing
from a match, and one). Documents with equal sets are one class. Classes are partitioned into groups of
similar ones: those that share their least common token (least token, where common ones are few) and are
nearly as large, in parts of some ``GROUP`` members. First the members of each group are compared with each other, and
those of a token's further groups with its first one; what is linked so counts as one group, whatever its size. The
matrix has a row for each first token and such group that has it. A class looks its first tokens up, the hits bound
its overlap with anything in a group, and only groups that can still reach the threshold are opened: there the
bound is checked again against the union of all the group's tokens, and what passes is compared with the members
exactly. Of several links that join the same parts, one is kept; what links have joined is not compared again.

Null and empty texts, and texts without words, have an empty set and are linked with nothing. Texts with
fewer words than n have one token, the whole sequence. Repeated rows, and rows without an id, are rows like
others; a component's id is its smallest doc_id that isn't null. Sets are told apart by 64-bit hashes. Texts of any
length are read whole. Other columns play no part. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, buffers, column, mix, shingles, text_hash, tidy, words, written
from .components import components

#: Members of a group, queries that visit a group at a time.
GROUP, VISITORS = 128, 1024
#: Sizes in a group differ by this factor at most, so that the least size bounds the overlap well.
BAND = 1.04
#: A token is common if at least one of so many documents has it; so their number has a bound.
COMMON = 20_000
#: Ids that are broadcast at most; beyond, the join is a shuffle.
BROADCAST_ROWS = 1_000_000


def token_sets(texts: pa.Array, n: int) -> list[np.ndarray]:
    """Sorted distinct tokens of each text; words are ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case."""
    offsets, data = buffers(texts)
    hashes, _, _, first = words(offsets, data, lower=True)
    grams = shingles(hashes, n)
    out = []
    for a, z in zip(first[:-1], first[1:]):
        if z - a >= n:
            out.append(np.unique(grams[a : z - n + 1]))
        else:
            out.append(shingles(hashes[a:z], z - a) if z > a else np.zeros(0, np.uint64))
    return out


def node_of(tokens: np.ndarray) -> int:
    """One number for a set."""
    spread = mix(tokens + np.uint64(len(tokens)))
    both = mix(spread.sum(keepdims=True)) + np.bitwise_xor.reduce(spread, keepdims=True)
    return int(mix(both).view(np.int64)[0])


def needed(n: np.ndarray | int, percent: int):
    """Tokens of a set of n that any match shares with it, at least."""
    return -(-percent * n // 100)


def overlap_needed(a, b, percent: int):
    return -(-percent * (a + b) // (100 + percent))


def common_tokens(docs: DataFrame, n: int) -> np.ndarray:
    """Tokens that at least one in ``COMMON`` documents has, by the counts of batches where they repeat.
    The order needs no exact counts; any set of common tokens gives the same result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = {node_of(s): s for s in token_sets(column(batch, "text"), n)}
            found = np.sort(np.concatenate(list(sets.values()) or [np.zeros(0, np.uint64)]))
            change = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1], [True]])) if len(found) else np.zeros(1, np.int64)
            counts = np.diff(change)
            at = np.flatnonzero(counts > 1)
            yield pa.RecordBatch.from_arrays([pa.array(found[change[at]].view(np.int64)), pa.array(counts[at])], names=["token", "df"])

    rows = docs.count()
    counts = docs.select("text").mapInArrow(tidy(run), "token long, df long").groupBy("token").agg(F.sum("df").alias("df"))
    common = counts.filter(F.col("df") >= max(8, rows // COMMON)).select("token").toPandas()["token"]
    return np.sort(common.to_numpy(np.int64).view(np.uint64))


def sketched(docs: DataFrame, n: int, percent: int, common: np.ndarray) -> DataFrame:
    """``doc_id, text_hash, size, node, theme, tokens``: of each document its set's size and number, what its group goes
    by, and its first tokens in order, as 64-bit integers."""
    shared = docs.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = shared.value
        for batch in batches:
            sizes, nodes, themes, tokens = [], [], [], []
            for s in token_sets(column(batch, "text"), n):
                frequent = np.zeros(len(s), bool)
                if len(common) and len(s):
                    frequent = common[np.minimum(np.searchsorted(common, s), len(common) - 1)] == s
                first = len(s) - needed(len(s), percent) + 1
                order = np.concatenate([s[~frequent], s[frequent]])
                sizes.append(len(s))
                nodes.append(node_of(s) if len(s) else None)
                lead = s[frequent] if 2 * frequent.sum() >= len(s) else s
                themes.append(int(lead[:1].view(np.int64)[0]) if len(s) else None)
                tokens.append(order[:first].tobytes() if len(s) else b"")
            arrays = [column(batch, "doc_id"), column(batch, "text_hash"), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), pa.array(themes, pa.int64()), pa.array(tokens, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "text_hash", "size", "node", "theme", "tokens"])

    keyed = docs.select(F.col("doc_id").cast("long"), "text", text_hash().alias("text_hash"))
    return keyed.mapInArrow(tidy(run), "doc_id long, text_hash long, size long, node long, theme long, tokens binary")


def matrix_rows(classes: DataFrame) -> DataFrame:
    """``token, group, node, size``: a row for each first token of each class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [np.frombuffer(x, np.int64) for x in column(batch, "tokens").to_pylist()]
            counts = [len(p) for p in parts]
            own = [np.repeat(column(batch, c).to_numpy(zero_copy_only=False), counts) for c in ("group", "node", "size")]
            whole = [np.concatenate(parts) if parts else np.zeros(0, np.int64), *own]
            for i in range(0, len(whole[0]), 1 << 18):
                yield pa.RecordBatch.from_arrays([pa.array(x[i : i + (1 << 18)], pa.int64()) for x in whole], names=["token", "group", "node", "size"])

    return classes.mapInArrow(tidy(run), "token long, group long, node long, size long")


def hits(rows: DataFrame, percent: int) -> DataFrame:
    """``node, size, group, c, low, high``: the groups that share first tokens with a class, how many, and the
    least and largest size met there. Reads the matrix in token order; a token of one row is passed over.
    Each pair of groups is met from the lower one's members; groups with more members have higher numbers."""

    def fits(size: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return (percent * low <= 100 * size) & (100 * high >= percent * size)

    def of_pairs(i: np.ndarray, j: np.ndarray, group: np.ndarray, node: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
        i, j = np.where(group[i] <= group[j], i, j), np.where(group[i] <= group[j], j, i)
        ok = fits(size[i], size[j], size[j]) & (group[i] != group[j])
        i, j = i[ok], j[ok]
        return [node[i], size[i], group[j], size[j], size[j]]

    def of_run(group: np.ndarray, node: np.ndarray, size: np.ndarray) -> Iterator[list[np.ndarray]]:
        kinds, back = np.unique(group, return_inverse=True)
        if len(kinds) == 1:
            return
        low, high = np.full(len(kinds), 1 << 62), np.zeros(len(kinds), np.int64)
        np.minimum.at(low, back, size)
        np.maximum.at(high, back, size)
        asks = np.flatnonzero(back < len(kinds) - 1)  # the largest group need not ask
        for a in range(0, len(asks), 1024):  # the queries of a long run, some at a time
            own = asks[a : a + 1024]
            q, k = np.nonzero(np.arange(len(kinds))[None] > back[own, None])
            q = own[q]
            ok = fits(size[q], low[k], high[k])
            q, k = q[ok], k[ok]
            yield [node[q], size[q], kinds[k], low[k], high[k]]

    def of_all(token: np.ndarray, rest: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        start = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        length = np.diff(np.append(start, len(token)))
        two = start[length == 2]
        found = [of_pairs(two, two + 1, *rest)]
        pending = len(two)
        for a, n in zip(start[length > 2], length[length > 2]):
            for part in of_run(*(x[a : a + n] for x in rest)):
                found.append(part)
                pending += len(part[0])
            if pending > 1 << 20:
                yield from summed(found)
                found, pending = [], 0
        yield from summed(found)

    def summed(found: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        if not found or not sum(len(x[0]) for x in found):
            return
        node, size, group, low, high = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((group, node))
        node, size, group, low, high = (x[order] for x in (node, size, group, low, high))
        at = np.flatnonzero(np.concatenate([[True], (node[1:] != node[:-1]) | (group[1:] != group[:-1])]))
        c = np.diff(np.append(at, len(node)))
        arrays = [node[at], size[at], group[at], c, np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)]
        yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in arrays], names=["node", "size", "group", "c", "low", "high"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            new = [column(batch, c).to_numpy() for c in ("token", "group", "node", "size")]
            held = [np.concatenate(x) for x in zip(held, new)] if held else new
            last = int(np.searchsorted(held[0], held[0][-1])) if len(held[0]) else 0
            if last:
                yield from of_all(held[0][:last], [x[:last] for x in held[1:]])
                held = [x[last:] for x in held]
        if held and len(held[0]):
            yield from of_all(held[0], held[1:])

    dealt = rows.repartition("token").sortWithinPartitions("token")
    return dealt.mapInArrow(tidy(run), "node long, size long, group long, c long, low long, high long")


def with_sets(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """``node, tokens`` of the wanted ``at, node``: their texts are read again. ``at`` names a row by its id and its text's
    hash, so that rows that share an id or have none meet only themselves. Few are broadcast."""
    wanted = wanted.select(F.col("at.doc_id").alias("_of"), F.col("at.text_hash").alias("_hash"), F.col("node").alias("_node"))
    if wanted.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    keyed = docs.select(F.col("doc_id").cast("long"), "text", text_hash().alias("text_hash"))
    found = keyed.join(wanted, (F.col("text_hash") == F.col("_hash")) & F.col("doc_id").eqNullSafe(F.col("_of"))).select("text", "_node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [(node, s) for node, s in zip(column(batch, "_node").to_pylist(), token_sets(column(batch, "text"), n)) if len(s) and node_of(s) == node]
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1].tobytes() for p in pairs], pa.binary())], names=["node", "tokens"])

    sets = found.mapInArrow(tidy(run), "node long, tokens binary")
    return sets.groupBy("node").agg(F.first("tokens").alias("tokens"))  # an id may stand for several rows


def links_in(members: pd.DataFrame, visitors: pd.DataFrame, percent: int, inside: bool) -> list[tuple[int, int]]:
    """Links that join what the group's visitors (and, if ``inside``, its members) reach in it: of several
    links that would join the same parts of the group, one. Members of one component are a part from the start."""
    sets = [np.frombuffer(x, np.uint64) for x in members["tokens"]]
    nodes, sizes = members["node"].tolist(), np.array([len(s) for s in sets])
    union, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(union, kind="stable")
    union, owner = union[order], owner[order]
    least = needed(sizes.min(), percent)
    first: dict[int, int] = {}
    part = [first.setdefault(c, i) for i, c in enumerate(members["component"].tolist())]

    def root(i: int) -> int:
        while part[i] != i:
            part[i] = i = part[part[i]]
        return i

    def linked(s: np.ndarray) -> np.ndarray:
        """Members that a set is linked with; none if not even the union of all has enough of it."""
        begin, end = np.searchsorted(union, s, "left"), np.searchsorted(union, s, "right")
        n = end - begin
        if (n > 0).sum() < max(least, needed(len(s), percent)):
            return np.zeros(0, np.int64)
        at = np.arange(n.sum()) + np.repeat(begin - (np.cumsum(n) - n), n)
        shared = np.bincount(owner[at], minlength=len(sets))
        return np.flatnonzero(100 * shared >= percent * (len(s) + sizes - shared))

    out = []
    for i, s in enumerate(sets if inside else ()):
        for j in linked(s):
            if j > i and (a := root(i)) != (b := root(j)):
                part[max(a, b)] = min(a, b)
                out.append((nodes[i], nodes[j]))
    for node, raw in zip(visitors["node"], visitors["tokens"]):
        found = {root(j): j for j in linked(np.frombuffer(raw, np.uint64)).tolist()}
        out += [(node, nodes[j]) for j in found.values()]
        for r in found:  # the visitor joins them
            part[r] = min(found)
    return out


def links(docs: DataFrame, classes: DataFrame, n: int, percent: int) -> DataFrame:
    """``a, b``: links between classes, enough to join all that are connected."""
    banded = classes.withColumn("_band", F.floor(F.log("size") / math.log(BAND)))
    counts = banded.groupBy("theme", "_band").agg(F.count("*").alias("_n"))
    counts = counts.join(counts.groupBy("theme").agg(F.sum("_n").alias("_all")), "theme")
    part = F.pmod(F.xxhash64("node"), F.ceil(F.col("_n") / GROUP))

    def group_of(band, part):
        return F.xxhash64("theme", band.cast("long"), part.cast("long"))

    placed = banded.join(counts, ["theme", "_band"]).withColumn("_part", part).withColumn("group", group_of(F.col("_band"), F.col("_part")))
    grouped = written(placed)

    # Inside the groups, and from a theme's further groups to its first ones.
    shared = grouped.filter("_all > 1")
    members = shared.select("node", "group", F.col("node").alias("component"))
    sideways = shared.filter("_part > 0").select("node", group_of(F.col("_band"), F.lit(0)).alias("group"))
    downwards = shared.filter("_part = 0 AND _all > _n").withColumn("_down", F.explode(F.array(F.lit(1), F.lit(2))))
    downwards = downwards.select("node", group_of(F.col("_band") - F.col("_down"), F.lit(0)).alias("group"))
    visits = sideways.unionByName(downwards).join(members.select("group").distinct(), "group", "left_semi")
    sets = written(with_sets(docs, shared.select("at", "node"), n))
    early = written(compared(members, visits.select("node", "group"), sets, percent, inside=True))

    # What links have joined is one row of the matrix, whatever its groups; what stands alone goes by its group.
    known = grouped.join(components(early), "node", "left").withColumn("_row", F.coalesce("component", "group"))
    known = known.select("node", "at", "size", "tokens", "group", F.coalesce("component", "node").alias("component"), "_row")
    many = known.groupBy("_row").agg(F.floor(F.log2(F.count("*"))).cast("long").alias("_log"))
    number = F.shiftleft("_log", 56).bitwiseOR(F.xxhash64("_row").bitwiseAND((1 << 56) - 1))
    known = written(known.join(many, "_row").withColumn("row", number).drop("_row", "_log"))
    met = hits(matrix_rows(known.select(F.col("row").alias("group"), "node", "size", "tokens")), percent)
    total = met.groupBy("node", "size", "group").agg(F.sum("c").alias("c"), F.min("low").alias("low"), F.max("high").alias("high"))
    n_q, low = F.col("size"), F.greatest("low", F.ceil(F.col("size") * percent / 100))
    rest = F.greatest(F.ceil(n_q * percent / 100), F.ceil(F.least("high", F.floor(n_q * 100 / percent)) * percent / 100)) - 1
    open_ = written(total.filter(F.col("c") + rest >= F.ceil((n_q + low) * percent / (100 + percent))).select("node", "size", F.col("group").alias("row")))
    groups = known.groupBy("row", "group").agg(F.min("size").alias("_low"), F.max("size").alias("_high"))
    fits = (percent * F.col("_low") <= 100 * F.col("size")) & (100 * F.col("_high") >= percent * F.col("size"))
    opened = known.join(open_.select("row").distinct(), "row", "left_semi").select("at", "node")
    asking = known.join(open_.select("node").distinct(), "node", "left_semi").select("at", "node")
    more = opened.unionByName(asking).distinct().join(sets.select("node"), "node", "left_anti")
    sets = sets.unionByName(written(with_sets(docs, written(more.select("at", "node")), n)))

    # One of the nodes that are joined already asks first; where that joins it with the whole row, the others needn't.
    homes = known.select("node", F.col("row").alias("home"), "component")
    lead = open_.join(homes, "node").groupBy("home", "component", "row").agg(F.min(F.struct("node", "size")).alias("x")).select("x.*", "row")
    first = lead.join(groups, "row").filter(fits).groupBy("node", "row").agg(F.min("group").alias("group")).select("node", "group")
    first = written(first)
    second = written(compared(known, first, sets, percent, inside=False))
    joined = components(early.unionByName(second))
    now = known.drop("component").join(joined, "node", "left").select("node", "row", "group", F.coalesce("component", "node").alias("component"))
    now = written(now)
    ends = now.groupBy("row").agg(F.min("component").alias("_least"), F.max("component").alias("_most"))
    late = open_.join(now.select("node", "component"), "node").join(ends, "row")
    late = late.filter((F.col("component") != F.col("_least")) | (F.col("component") != F.col("_most")))
    late = written(late.join(groups, "row").filter(fits).select("node", "group").join(first, ["node", "group"], "left_anti"))
    return early.unionByName(second).unionByName(compared(now, late, sets, percent, inside=False))


def compared(known: DataFrame, visits: DataFrame, sets: DataFrame, percent: int, inside: bool) -> DataFrame:
    """``a, b``: links of visitors with a group's members, some visitors of a group at a time; and, if
    ``inside``, of the members with each other. ``known`` has ``node, group, component``."""
    members = known.select("node", "group", "component")
    if not inside:
        members = members.join(visits.select("group").distinct(), "group", "left_semi")
    chunks = visits.groupBy("group").agg(F.ceil(F.count("*") / VISITORS).alias("chunks"))
    spread = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("chunks", F.lit(1)).cast("long") - 1))
    left = members.join(chunks, "group", "left").select("node", "group", "component", spread.alias("chunk")).join(sets, "node")
    right = visits.join(chunks, "group").select("node", "group", F.pmod(F.xxhash64("node"), "chunks").alias("chunk")).join(sets, "node")
    right = right.select(*(F.col(c).alias(c) for c in right.columns))  # columns of their own

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(links_in(left, right, percent, inside) if len(left) else [], columns=["a", "b"], dtype=np.int64)

    return left.groupBy("group", "chunk").cogroup(right.groupBy("group", "chunk")).applyInPandas(compare, "a long, b long")


def join(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id, text_hash, component`` for every row of ``docs``: two documents are
    linked when 100 * shared tokens >= percent * tokens of both, and a component is what links reach. ``component``
    names it for rows without an id too, and is null for empty sets."""
    bound_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    rows = written(sketched(docs, n, percent, common_tokens(docs, n)))
    some = rows.filter(F.col("node").isNotNull())
    classes = some.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.min(F.struct("doc_id", "text_hash")).alias("at"), F.first("size").alias("size"), F.first("theme").alias("theme"), F.first("tokens").alias("tokens"))
    classes = written(classes)
    found = components(links(docs, classes, n, percent))
    firsts = classes.select("node", F.col("doc_id").alias("first")).join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = firsts.groupBy("component").agg(F.min("first").alias("component_id"))
    named = firsts.join(least, "component").select("node", "component_id", "component")
    return rows.join(named, "node", "left").select("doc_id", F.col("size").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), "text_hash", "component")
