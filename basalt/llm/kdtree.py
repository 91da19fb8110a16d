"""Exact top-k inner-product search with a KD-tree in each shard.

Vectors are dealt to shards by KD splits, so that a shard's box is tight: cells split at the median of the widest
axis of about ``SAMPLE`` vectors, every vector goes to its cell, and a cell of many vectors (equal ones too) is
dealt to several shards by the hash of the id. A shard is one row with its tight bounding box, as is a block of
queries. A shard's tree splits at the median of the widest axis down to leaves, each node with its box. The highest
inner product that a box can give with a query bounds what the box holds; the tree is walked best bound first, and a
box is opened only if its bound can still beat the query's k-th score. That k-th score is propagated: every query
first visits the shard of the highest bound, and what it finds there is the floor with which it goes on to those
other shards whose bounds reach it. Boxes and queries grow in number of rows and not in the size of one.

Vectors that are null, empty, or hold a null or non-finite component take no part, nor do rows without
an id, nor vectors of another length than most (of equally many, the shorter). Repeated ids count once, with their
smallest vector. Ties go to the smaller id. Scores that leave a signed 64-bit integer raise an error. With fewer
than k other vectors a query gets them all; empty tables give no rows. Other columns play no part.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, column, tidy, written

#: Components of a shard (8192 vectors of 64) and of a block of queries, vectors of a leaf.
SHARD, BLOCK, LEAF = 1 << 19, 1 << 17, 256
#: Vectors that the shards' splits are fitted on, about; those that a cell has of them, at least.
SAMPLE, CELL = 10_000, 16
#: Shards whose boxes stand in one row, and the rows that repeat it, so that many tasks share the bounds.
BOXES, LANES = 4096, 256
HITS = "block long, at long, query_id long, vec_id long, score long"


def scaled(vectors: DataFrame, vec_id: str, vector: str, scale: int) -> DataFrame:
    """``vec_id, v``: floor(scale * x) of each component; one row an id."""
    x = F.col(vector)
    good = x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    whole = F.transform(x, lambda e: F.floor(F.lit(float(scale)) * e.cast("double")).cast("long"))
    kept = vectors.filter(good & F.col(vec_id).isNotNull())
    return kept.select(F.col(vec_id).cast("long").alias("vec_id"), whole.alias("v")).groupBy("vec_id").agg(F.min("v").alias("v"))


class Tree:
    """Nodes in heap order of a median-split tree over the rows of a matrix, leaves of ``leaf`` rows."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, leaf: int):
        order = np.arange(len(ids))
        self.low, self.high, self.span, self.child = [], [], [], []
        todo = [(0, len(ids), -1)]
        while todo:
            a, b, parent = todo.pop()
            part = rows[order[a:b]]
            node = len(self.span)
            low, high = part.min(0), part.max(0)
            self.low.append(low)
            self.high.append(high)
            self.span.append((a, b))
            self.child.append([])
            if parent >= 0:
                self.child[parent].append(node)
            if b - a > leaf and (high > low).any():
                axis, mid = int((high - low).argmax()), (b - a) // 2
                order[a:b] = order[a:b][np.argpartition(part[:, axis], mid)]
                todo += [(a, a + mid, node), (a + mid, b, node)]
        self.ids, self.rows = ids[order], rows[order]
        self.low, self.high = np.array(self.low), np.array(self.high)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Highest inner product of each query with any point of each node's box."""
        return np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, floors: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """The k best of each query that reach its floor."""
        bounds = self.bounds(queries)
        for own, q, bound, floor in zip(query_ids, queries, bounds, floors):
            best: list[tuple] = []  # a heap, worst first: (score, -id)
            line = [(-bound[0], 0)]
            while line:
                least = best[0][0] if len(best) == k else None
                top, node = heapq.heappop(line)
                if -top < floor or least is not None and -top < least:
                    break
                if self.child[node]:
                    for c in self.child[node]:
                        heapq.heappush(line, (-bound[c], c))
                    continue
                a, b = self.span[node]
                score = self.rows[a:b] @ q
                least = floor if least is None else max(floor, least)
                at = np.flatnonzero((score >= least) & (self.ids[a:b] != own))
                if len(at) > k:  # no more than k of one leaf can count
                    at = at[np.lexsort((self.ids[a:b][at], -score[at]))[:k]]
                for i in at:
                    x = (int(score[i]), -int(self.ids[a + i]))
                    if len(best) < k:
                        heapq.heappush(best, x)
                    elif x > best[0]:
                        heapq.heapreplace(best, x)
            yield from ((int(own), -i, s) for s, i in best)


def exact(*parts: np.ndarray) -> list[np.ndarray]:
    """Integer vectors as doubles while every sum of products stays exact in them, else as integers."""
    reach = max(float(np.abs(m.astype(float)).max(initial=0)) for m in parts) ** 2 * parts[0].shape[1]
    if reach < 2.0**53:
        return [m.astype(float) for m in parts]
    if reach >= 2.0**63:
        raise OverflowError("a score may leave a signed 64-bit integer")
    return list(parts)


def matrix(vectors: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    flat = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def of_bytes(value: bytes, width: int = 0) -> np.ndarray:
    found = np.frombuffer(value, np.int64)
    return found.reshape(-1, width) if width else found


class Cells:
    """Splits of the space at medians of the widest axis of a sample; a cell is the number of a node without a split."""

    def __init__(self, sample: np.ndarray, cells: int):
        self.axis, self.cut, self.low, self.high = [], [], [], []
        todo = [(sample, max(1, min(cells, len(sample) // CELL)), None)]
        while todo:
            rows, n, parent = todo.pop()
            node = len(self.axis)
            if parent:
                parent[0][parent[1]] = node
            for x, empty in ((self.axis, -1), (self.cut, 0), (self.low, 0), (self.high, 0)):
                x.append(empty)
            spread = rows.max(0) - rows.min(0) if len(rows) else np.zeros(1, np.int64)
            if n < 2 or not spread.any():
                continue
            axis = int(spread.argmax())
            x = rows[:, axis]
            cut = np.partition(x, len(x) // 2)[len(x) // 2]
            if cut == x.min():
                cut = x[x > cut].min()
            self.axis[node], self.cut[node] = axis, int(cut)
            todo += [(rows[x < cut], n // 2, (self.low, node)), (rows[x >= cut], n - n // 2, (self.high, node))]
        self.axis, self.cut, self.low, self.high = (np.array(x, np.int64) for x in (self.axis, self.cut, self.low, self.high))

    def of(self, rows: np.ndarray) -> np.ndarray:
        node = np.zeros(len(rows), np.int64)
        at = np.flatnonzero(self.axis[node] >= 0)
        while len(at):
            own = node[at]
            node[at] = np.where(rows[at, self.axis[own]] < self.cut[own], self.low[own], self.high[own])
            at = at[self.axis[node[at]] >= 0]
        return node


def shard_rows(vectors: DataFrame, n: int, width: int) -> tuple[DataFrame, int]:
    """``shard, ids, v, low, high``: a row for each shard, its numbers as bytes; and how many there are."""
    spark, each = vectors.sparkSession, max(1, SHARD // width)
    sampled = vectors.filter(F.pmod(F.xxhash64("vec_id"), F.lit(max(1, -(-n // SAMPLE)))) == 0).select("v")
    cells = Cells(np.array([r.v for r in sampled.toLocalIterator()], np.int64).reshape(-1, width), -(-n // each))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = column(batch, "v")
            yield pa.RecordBatch.from_arrays([column(batch, "vec_id"), v, pa.array(cells.of(matrix(v, width)))], names=["vec_id", "v", "cell"])

    dealt = vectors.mapInArrow(tidy(deal), "vec_id long, v array<long>, cell long")
    parts, shards = [], 0
    for cell, count in dealt.groupBy("cell").count().orderBy("cell").collect():  # SAMPLE / CELL at most
        parts.append((cell, shards, -(-count // each)))
        shards += -(-count // each)
    placed = dealt.join(F.broadcast(spark.createDataFrame(parts, "cell long, base long, parts long")), "cell")
    placed = placed.select((F.col("base") + F.pmod(F.xxhash64("vec_id", F.lit(1)), "parts")).alias("shard"), "vec_id", "v")

    def build(shard: pa.Table) -> pa.Table:
        v = matrix(shard.column("v"), width)
        parts = [shard.column("vec_id").to_numpy(), v, v.min(0), v.max(0)]
        return pa.table({"shard": shard.column("shard").slice(0, 1), **{c: pa.array([x.tobytes()], pa.binary()) for c, x in zip(("ids", "v", "low", "high"), parts)}})

    return written(placed.groupBy("shard").applyInArrow(build, "shard long, ids binary, v binary, low binary, high binary")), shards


def query_blocks(queries: DataFrame, n: int, width: int) -> tuple[DataFrame, int]:
    """``block, query_ids, q``: a row for each block of queries; and how many there are at most."""
    blocks = max(1, -(-n * width // BLOCK))

    def build(block: pa.Table) -> pa.Table:
        parts = {"query_ids": block.column("vec_id").to_numpy(), "q": matrix(block.column("v"), width)}
        return pa.table({"block": block.column("block").slice(0, 1), **{c: pa.array([x.tobytes()], pa.binary()) for c, x in parts.items()}})

    dealt = queries.select(F.pmod(F.xxhash64("vec_id", F.lit(2)), F.lit(blocks)).alias("block"), "vec_id", "v")
    return written(dealt.groupBy("block").applyInArrow(build, "block long, query_ids binary, q binary")), blocks


def with_boxes(asked: DataFrame, shards: DataFrame, n_shards: int, blocks: int) -> DataFrame:
    """Every block of queries beside every row of ``BOXES`` boxes."""
    lanes, parts = min(blocks, LANES), -(-n_shards // BOXES)

    def build(boxes: pa.Table) -> pa.Table:
        joined = {c: b"".join(boxes.column(c).to_pylist()) for c in ("low", "high")}
        joined["shards"] = boxes.column("shard").to_numpy().astype(np.int64).tobytes()
        return pa.table({"part": boxes.column("part").slice(0, 1), **{c: pa.array([joined[c]], pa.binary()) for c in ("shards", "low", "high")}})

    boxes = shards.select(F.floor(F.col("shard") / BOXES).alias("part"), "shard", "low", "high")
    boxes = boxes.groupBy("part").applyInArrow(build, "part long, shards binary, low binary, high binary")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<long>"))
    boxes = boxes.withColumn("lane", spread(lanes))
    return asked.withColumn("lane", F.pmod("block", F.lit(lanes))).withColumn("part", spread(parts)).join(boxes, ["part", "lane"])


def box_bounds(row: dict, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Shards, and the bound of each query of a block with each of them."""
    q, low, high = exact(*(of_bytes(row[c], width) for c in ("q", "low", "high")))
    return of_bytes(row["shards"]), np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T


def walked(routes: DataFrame, blocks: DataFrame, shards: DataFrame, k: int, width: int) -> DataFrame:
    """The k best vectors that reach the floor, for each query of each route ``block, shard, picks, floors``."""

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            cut = [(r["picks"], of_bytes(r["query_ids"])[r["picks"]].tobytes(), of_bytes(r["q"], width)[r["picks"]].tobytes()) for r in rows]
            arrays = [pa.array([x[0] for x in cut], pa.list_(pa.int64())), *(pa.array([x[i] for x in cut], pa.binary()) for i in (1, 2))]
            names = ["block", "shard", "floors"]
            yield pa.RecordBatch.from_arrays([*(column(batch, c) for c in names), *arrays], names=[*names, "picks", "query_ids", "q"])

    picked = routes.join(blocks, "block").mapInArrow(tidy(pick), "block long, shard long, floors array<long>, picks array<long>, query_ids binary, q binary")

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[int, bool, Tree] | None = None
        for batch in batches:
            for r in batch.to_pylist():
                q, v = exact(of_bytes(r["q"], width), of_bytes(r["v"], width))
                if held is None or held[:2] != (r["shard"], v.dtype == float):
                    held = (r["shard"], v.dtype == float, Tree(of_bytes(r["ids"]), v, LEAF))
                lowest = -float("inf") if q.dtype == float else np.iinfo(np.int64).min
                floors = [lowest if f is None else f for f in r["floors"]]
                ids = of_bytes(r["query_ids"])
                at = dict(zip(ids.tolist(), r["picks"]))
                found = [(r["block"], at[x[0]], *x) for x in held[2].search(ids, q, k, floors)]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], names=["block", "at", "query_id", "vec_id", "score"])

    return picked.join(shards.select("shard", "ids", "v"), "shard").mapInArrow(tidy(visit), HITS)


def search(vectors: DataFrame, is_query: Column, k: int, vec_id: str = "vec_id", vector: str = "embedding", scale: int = 1024) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the k vectors with the highest inner product for every row
    of which ``is_query``, a condition on ``vec_id``, holds."""
    spark = vectors.sparkSession
    bound_batches(spark)
    every = written(scaled(vectors, vec_id, vector, scale))
    counts = every.groupBy(F.size("v").alias("width")).agg(F.count("*").alias("n"), F.count_if(is_query).alias("queries"))
    most = counts.orderBy(F.desc("n"), "width").first()
    if most is None or not most.queries:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    width = most.width
    every = every.filter(F.size("v") == width)
    shards, n_shards = shard_rows(every, most.n, width)
    blocks, n_blocks = query_blocks(every.filter(is_query), most.queries, width)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                of, bounds = box_bounds(row, width)
                best = bounds.argmax(1)
                n = len(best)
                arrays = [np.full(n, row["block"]), np.arange(n), of[best], bounds[np.arange(n), best].astype(float)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], names=["block", "at", "shard", "bound"])

    near = with_boxes(blocks, shards, n_shards, n_blocks).mapInArrow(tidy(nearest), "block long, at long, shard long, bound double")
    homes = written(near.groupBy("block", "at").agg(F.max_by("shard", F.struct("bound", -F.col("shard"))).alias("home")))
    picks = F.collect_list("at").alias("picks")  # within a block
    routes = homes.groupBy("block", F.col("home").alias("shard")).agg(picks).withColumn("floors", F.transform("picks", lambda _: F.lit(None).cast("long")))
    hits = written(walked(routes, blocks, shards, k, width))
    if n_shards > 1:
        kth = hits.groupBy("block", "at").agg(F.when(F.count("*") >= k, F.min("score")).alias("floor"))
        state = homes.join(kth, ["block", "at"], "left").groupBy("block").agg(F.sort_array(F.collect_list(F.struct("at", "home", "floor"))).alias("state"))

        def onward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    of, bounds = box_bounds(row, width)
                    home = np.array([x["home"] for x in row["state"]], np.int64)
                    lowest = -float("inf") if bounds.dtype == float else np.iinfo(np.int64).min
                    floor = np.array([lowest if x["floor"] is None else x["floor"] for x in row["state"]], bounds.dtype)
                    open_ = (bounds >= floor[:, None]) & (of[None] != home[:, None])
                    some = [(int(of[j]), np.flatnonzero(open_[:, j]).tolist()) for j in np.flatnonzero(open_.any(0))]
                    for a in range(0, len(some), 64):
                        part = some[a : a + 64]
                        arrays = [pa.array([row["block"]] * len(part), pa.int64()), pa.array([x for x, _ in part], pa.int64())]
                        floors = [[row["state"][i]["floor"] for i in at] for _, at in part]
                        arrays += [pa.array([x for _, x in part], pa.list_(pa.int64())), pa.array(floors, pa.list_(pa.int64()))]
                        yield pa.RecordBatch.from_arrays(arrays, names=["block", "shard", "picks", "floors"])

        beside = with_boxes(blocks.drop("query_ids").join(state, "block"), shards, n_shards, n_blocks)
        further = beside.mapInArrow(tidy(onward), "block long, shard long, picks array<long>, floors array<long>")
        hits = hits.unionByName(walked(further, blocks, shards, k, width))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return hits.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
