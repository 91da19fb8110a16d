"""The prefix trie of conversations, by truncation peeling.

A conversation is the chain of its prefixes' hashes (128 bits of SHA-256 over the hash before, the role and the
text's SHA-256), so that a node is a hash and texts move nowhere. The trie is peeled from the deepest turns on: the
surviving nodes of one depth lose their last turn and are grouped anew, together with the conversations that end there,
and what is asked for is added up as the nodes are found.

Equal conversations are one path with a count before that. Below a bound of turns all paths under a node are peeled in
one task in one pass; nodes with more under them (hot prefixes, such as a first turn that a third of all conversations
share) are peeled by Spark, one grouped round for each depth, with sums within tasks first.

Rows without a conversation's id take no part. Null roles and texts are empty; a null turn comes first; turns with equal
numbers are ordered by role and then by the text's SHA-256, and repeated rows are turns of their own. An empty table gives
no nodes. Columns besides those named are not read. Texts of any length are hashed whole. The turns of one conversation
(hashes and sizes, about 60 bytes each) must fit a task, as a conversation's digest needs them in order.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, tidy, written
from .resample import sql_crc

#: Turns (and ends) under a node from which on Spark peels it; those that a task peels in one go.
LIMIT, GO = 10_000, 50_000
#: Ids of one list of ends that are joined to a string at once, as a power of two.
CHUNK_BITS = 16
#: Hot nodes that are broadcast at most; beyond, the join is a shuffle.
BROADCAST_ROWS = 1_000_000
NO_ENDS = sha256(b"").hexdigest()
_TURNS = "array<struct<role:string,digest:binary,size:bigint>>"


def sequences(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id, turns``: each conversation's turns in order as ``role``, the text's ``digest`` and ``size`` in UTF-8 bytes."""
    said = F.coalesce(F.col(text), F.lit(""))
    one = F.struct(
        F.col(turn).isNotNull().alias("known"),
        F.coalesce(F.col(turn).cast("long"), F.lit(0).cast("long")).alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.unhex(F.sha2(said.cast("binary"), 256)).alias("digest"),
        F.octet_length(said).cast("long").alias("size"),
    )
    rows = turns.select(F.col(conv_id).cast("long").alias("conv_id"), one.alias("one")).filter(F.col("conv_id").isNotNull())
    listed = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("one")).alias("turns"))
    return listed.withColumn("turns", F.transform("turns", lambda x: F.struct(x.role.alias("role"), x.digest.alias("digest"), x.size.alias("size"))))


def rebuilt(sequences: DataFrame, family: int = 5, heads: int = 9) -> DataFrame:
    """Every conversation c begins with the first h turns of c - c % ``family`` and goes on with its own after its first h,
    h = crc32(decimal c) % ``heads``."""
    both = written(sequences)
    first = both.filter(F.col("conv_id") % family == 0).select(F.col("conv_id").alias("_first"), F.slice("turns", 1, heads - 1).alias("_head"))
    own = both.withColumns({"_first": F.col("conv_id") - F.col("conv_id") % family, "_h": (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")})
    head = F.coalesce(F.slice("_head", F.lit(1), F.col("_h")), F.array().cast(_TURNS))
    rest = F.slice("turns", F.col("_h") + 1, F.greatest(F.lit(0), F.size("turns") - F.col("_h")))
    return own.join(first, "_first", "left").select("conv_id", F.concat(head, rest).alias("turns"))


def _chained(sequences: DataFrame) -> DataFrame:
    """``conv_id, keys, sizes``: the hash of each prefix from one turn on, and the size of its last text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sizes = [], []
            for turns in batch.column(1).to_pylist():
                at, chain = b"", []
                for t in turns:
                    role = t["role"].encode()
                    at = sha256(b"%b%d:%b%b" % (at, len(role), role, t["digest"])).digest()[:16]
                    chain.append(at)
                keys.append(chain)
                sizes.append([t["size"] for t in turns])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.list_(pa.binary())), pa.array(sizes, pa.list_(pa.int64()))], names=["conv_id", "keys", "sizes"])

    return sequences.select("conv_id", "turns").mapInArrow(tidy(run), "conv_id long, keys array<binary>, sizes array<bigint>")


def _paths(chained: DataFrame) -> DataFrame:
    """Equal conversations as one: ``key, keys, sizes, n, least, ends``. The ids that end at a node are joined in chunks of
    bounded size; a task then reads a node's chunks in order and keeps nothing of them but the state of their digest."""
    key = F.coalesce(F.try_element_at("keys", F.lit(-1)), F.lit(b""))
    rows = chained.withColumns({"key": key, "chunk": F.shiftright("conv_id", CHUNK_BITS)})
    chunks = rows.groupBy("key", "chunk").agg(F.sort_array(F.collect_list("conv_id")).alias("ids"), F.first("keys").alias("keys"), F.first("sizes").alias("sizes"))
    chunks = chunks.select("key", "chunk", "keys", "sizes", F.size("ids").cast("long").alias("n"), F.element_at("ids", 1).alias("least"), F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, digest, held = None, sha256(), []
        for batch in batches:
            out = []
            for key, keys, sizes, n, least, ids in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4, 5, 6))):
                if key == at:
                    held[3] += n
                    digest.update(b"," + ids.encode())
                    continue
                if at is not None:
                    out.append((*held, digest.hexdigest()))
                at, digest, held = key, sha256(ids.encode()), [key, keys, sizes, n, least]
            yield _batch(out, _PATHS)
        if at is not None:
            yield _batch([(*held, digest.hexdigest())], _PATHS)

    ordered = chunks.repartition("key").sortWithinPartitions("key", "chunk")
    return ordered.mapInArrow(tidy(run), "key binary, keys array<binary>, sizes array<bigint>, n long, least long, ends string")


_PATHS = pa.schema([("key", pa.binary()), ("keys", pa.list_(pa.binary())), ("sizes", pa.list_(pa.int64())), ("n", pa.int64()), ("least", pa.int64()), ("ends", pa.string())])
_NODES = pa.schema(
    [("depth", pa.int64()), ("conv_id", pa.int64()), ("parent_conv_id", pa.int64()), *((c, pa.int64()) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")), ("ends_sha256", pa.string())]
    + [("top", pa.bool_()), ("keys", pa.list_(pa.binary())), ("sizes", pa.list_(pa.int64()))]
)
_NODES_DDL = "depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, top boolean, keys array<binary>, sizes array<bigint>"
#: What a node has besides its place.
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


class _Node:
    __slots__ = ("path", "n", "least", "kids", "leaves", "saved", "ends")

    def __init__(self, path: tuple):
        self.path, self.n, self.least, self.kids, self.leaves, self.saved, self.ends = path, 0, None, [], 0, 0, NO_ENDS

    def add(self, n: int, least: int) -> None:
        self.n += n
        self.least = least if self.least is None else min(self.least, least)


def peel(paths: list[tuple]) -> Iterator[tuple]:
    """All nodes of the paths ``(keys, sizes, n, least, ends, anchor)`` down from the deepest: rows of ``_NODES``. A path is
    peeled to the depth of its ``anchor``, whose node is a ``top`` with the keys and sizes of its ancestors."""
    ended = defaultdict(list)
    for p in paths:
        ended[len(p[0])].append(p)
    survivors: dict[bytes, _Node] = {}

    def row(node: _Node, depth: int, parent: int | None, top: bool) -> tuple:
        above = max(0, depth - 1) if top else 0
        return depth, node.least, parent, node.n, len(node.kids) if node.kids else 0, node.leaves, node.saved, node.ends, top, node.path[0][:above], node.path[1][:above]

    depth = max(ended, default=-1)
    while depth >= 0 and (survivors or ended):
        here: dict[bytes, _Node] = {}

        def at(path: tuple) -> _Node:
            key = path[0][depth - 1] if depth else b""
            if key not in here:
                here[key] = _Node(path)
            return here[key]

        for node in survivors.values():
            if node.path[5] > depth:
                yield row(node, depth + 1, None, True)
                continue
            up = at(node.path)
            up.add(node.n, node.least)
            up.kids.append(node)
            up.leaves += node.leaves
            up.saved += node.saved
        for path in ended.pop(depth, ()):
            node = at(path)
            node.add(path[2], path[3])
            node.ends = path[4]
        for node in here.values():
            node.leaves = node.leaves or 1
            node.saved += (node.n - 1) * (node.path[1][depth - 1] if depth else 0)
            for kid in node.kids:
                yield row(kid, depth + 1, node.least, False)
                kid.kids = ()
        survivors = here
        depth = depth - 1 if here else max(ended, default=-1)
    for node in survivors.values():
        yield row(node, 0, None, True)


def _peeled(paths: DataFrame) -> DataFrame:
    """``peel`` of the paths under each anchor. A task reads anchor by anchor and peels some together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, at = [], 0, None
        for batch in batches:
            for anchor, *path in zip(*(c.to_pylist() for c in batch.columns)):
                if size >= GO and anchor != at:
                    yield from _batches(peel(held))
                    held, size = [], 0
                at = anchor
                held.append(tuple(path))
                size += len(path[0]) + 1
        if held:
            yield from _batches(peel(held))

    ordered = paths.repartition("_anchor").sortWithinPartitions("_anchor").select("_anchor", "keys", "sizes", "n", "least", "ends", "_depth")
    return ordered.mapInArrow(tidy(run), _NODES_DDL)


def _batches(rows: Iterator[tuple], most: int = 1 << 14) -> Iterator[pa.RecordBatch]:
    some: list[tuple] = []
    for r in rows:
        some.append(r)
        if len(some) == most:
            yield _batch(some, _NODES)
            some = []
    if some:
        yield _batch(some, _NODES)


def _last(name: str, default: Column) -> Column:
    return F.coalesce(F.try_element_at(name, F.lit(-1)), default)


def _but_last(name: str) -> Column:
    return F.slice(name, F.lit(1), F.greatest(F.lit(0), F.size(name) - 1))


def trie(sequences: DataFrame, limit: int = LIMIT) -> DataFrame:
    """The nodes of the trie of ``sequences`` (``conv_id, turns``): ``COLUMNS``, all of them long but the digest."""
    bound_batches(sequences.sparkSession)
    paths = written(_paths(_chained(sequences)))
    weight = F.size("keys") + 1
    total = paths.agg(F.coalesce(F.sum(weight), F.lit(0)).alias("turns"), F.count("*").alias("paths")).first()
    deep = 0  # hot nodes have depths from 0 to deep - 1
    if total.turns > limit and total.paths > 1:
        each = paths.select("key", weight.alias("w"), F.posexplode("keys").alias("at", "node"))
        hot = each.groupBy("at", "node").agg(F.sum(F.col("w") - 1 - F.col("at")).alias("turns"), F.count("*").alias("paths")).filter((F.col("turns") > limit) & (F.col("paths") > 1))
        hot = written(hot.select("at", "node"))
        n_hot, deepest = hot.agg(F.count("*"), F.max("at")).first()
        deep = 1 if deepest is None else deepest + 2
        if n_hot:
            known = hot.select("node")
            on = each.join(F.broadcast(known) if n_hot <= BROADCAST_ROWS else known, "node", "left_semi").groupBy("key").agg((F.count("*") + 1).alias("_depth"))
            paths = paths.join(on, "key", "left").withColumn("_depth", F.coalesce("_depth", F.lit(1).cast("long")))
        else:
            paths = paths.withColumn("_depth", F.lit(1).cast("long"))
    else:
        paths = paths.withColumn("_depth", F.lit(0).cast("long"))
    under = paths.filter(F.size("keys") >= F.col("_depth"))
    under = under.withColumn("_anchor", F.when(F.col("_depth") > 0, F.try_element_at("keys", F.col("_depth").cast("int"))).otherwise(F.lit(b"")))
    nodes = written(_peeled(under))
    found = [nodes.filter(~F.col("top") | (F.col("depth") == 0)).select(*COLUMNS)]
    tops = nodes.filter("top")
    at_hot = paths.filter(F.size("keys") < F.col("_depth"))
    above: DataFrame | None = None
    for depth in range(deep - 1, -1, -1):
        kids = tops.filter(F.col("depth") == depth + 1).drop("top")
        if above is not None:
            kids = kids.unionByName(above)
        up = {"up": _last("keys", F.lit(b"")), "up_size": _last("sizes", F.lit(0).cast("long")), "keys": _but_last("keys"), "sizes": _but_last("sizes")}
        kids = kids.select("*", up["up"].alias("up"), up["up_size"].alias("up_size"))
        zero = F.lit(0).cast("long")
        from_kids = kids.select(
            "up", "up_size", up["keys"].alias("keys"), up["sizes"].alias("sizes"), "conv_id", "n_convs", F.lit(1).cast("long").alias("n_children"), "n_leaves", "saved_tokens", F.lit(None).cast("string").alias("ends")
        )
        from_ends = at_hot.filter(F.size("keys") == depth).select(
            up["up"].alias("up"), up["up_size"].alias("up_size"), up["keys"].alias("keys"), up["sizes"].alias("sizes"), F.col("least").alias("conv_id"), F.col("n").alias("n_convs"), zero.alias("n_children"),
            zero.alias("n_leaves"), zero.alias("saved_tokens"), "ends",
        )
        grouped = from_kids.unionByName(from_ends).groupBy("up").agg(
            F.first("up_size").alias("size"), F.first("keys").alias("keys"), F.first("sizes").alias("sizes"), F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"),
            F.sum("n_children").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved"), F.max("ends").alias("ends"),
        )
        merged = written(
            grouped.select(
                "up",
                F.lit(depth).cast("long").alias("depth"),
                "conv_id",
                F.lit(None).cast("long").alias("parent_conv_id"),
                "n_convs",
                "n_children",
                F.greatest("n_leaves", (F.col("n_children") == 0).cast("long")).alias("n_leaves"),
                (F.col("saved") + (F.col("n_convs") - 1) * F.col("size")).alias("saved_tokens"),
                F.coalesce("ends", F.lit(NO_ENDS)).alias("ends_sha256"),
                "keys",
                "sizes",
            )
        )
        parents = merged.select("up", F.col("conv_id").alias("_parent"))
        small = merged.count() <= BROADCAST_ROWS
        placed = kids.join(F.broadcast(parents) if small else parents, "up").withColumn("parent_conv_id", F.col("_parent"))
        found.append(placed.select(*COLUMNS))
        above = merged.drop("up")
    if above is not None:
        found.append(above.select(*COLUMNS))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def sql(family: int = 5, heads: int = 9) -> str:
    return f"""
        WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(coalesce(text, ''))) AS i
            FROM conversations WHERE conv_id IS NOT NULL),
        {sql_crc("crc", "SELECT DISTINCT CAST(conv_id AS VARCHAR) AS s FROM t")},
        c AS (SELECT CAST(s AS BIGINT) AS conv_id, crc % {heads} AS h FROM crc),
        r AS (SELECT c.conv_id, 0 AS own, i, role, text FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % {family} WHERE i <= h
            UNION ALL SELECT c.conv_id, 1, i, role, text FROM c JOIN t USING (conv_id) WHERE i > h),
        p AS (SELECT c.conv_id, coalesce(q.path, []) AS path FROM c LEFT JOIN
            (SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY own, i) AS path FROM r GROUP BY 1) q USING (conv_id)),
        n AS (SELECT path[1:d] AS k, d, min(conv_id) AS conv_id, count(*) AS n_convs,
                coalesce(string_agg(CASE WHEN len(path) = d THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id), '') AS ends
            FROM p, unnest(range(0, len(path) + 1)) AS x(d) GROUP BY 1, 2),
        kid AS (SELECT k[1:d - 1] AS k, d - 1 AS d, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1, 2),
        one AS (SELECT n.*, coalesce(n_children, 0) AS n_children, CASE WHEN n.d = 0 THEN 0 ELSE (n_convs - 1) * octet_length(encode(n.k[n.d].text)) END AS saved FROM n LEFT JOIN kid USING (k, d)),
        sub AS (SELECT k[1:j] AS k, j AS d, count(*) FILTER (WHERE n_children = 0) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved_tokens FROM one, unnest(range(0, d + 1)) AS x(j) GROUP BY 1, 2)
        SELECT one.conv_id, one.d AS depth, up.conv_id AS parent_conv_id, one.n_convs, one.n_children, sub.n_leaves, sub.saved_tokens, sha256(one.ends) AS ends_sha256
        FROM one JOIN sub ON sub.k = one.k AND sub.d = one.d LEFT JOIN n up ON up.k = one.k[1:one.d - 1] AND up.d = one.d - 1"""
