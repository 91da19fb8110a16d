"""Ingest of records one by one, as a batch: keys, then scores against representatives, else a new canonical record.

A record's keys are looked up among those that earlier records have left (the last writer of a key wins). One canonical
record: it is ``merged``; several: ``review``, attached to that of the first key; none: ``merged`` with the representative
that it scores highest with, from ``MERGE`` on (the first of equals), else ``new``. Then all its keys point there.

What a decision depends on are records that share keys or reach the score, over and over: a component of that graph. The
components are found by Spark in few rounds, however long their chains are; each is then read in order by one
task that keeps its keys and representatives and nothing of its records. Components are many and small, but a key that a
third of all records have makes one task read these, as the rule is one of order.

Records without any key, or with null keys among them, are decided by scores alone (by the others); repeated records are
records like others. Without records there are no decisions.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basalt.operators.graph import components
from basalt.operators.resolution import MERGE
from basalt.sources.shared import settled

_OUT = pa.schema([("seq", pa.int64()), ("canonical", pa.int64()), ("action", pa.string()), ("content_updated", pa.bool_())])


class _Component:
    """The keys and representatives of a component so far."""

    def __init__(self) -> None:
        self.of: dict[str, int] = {}
        self.prints: dict[int, str | None] = {}

    def decide(self, seq: int, keys: list[str], fingerprint: str | None, near: list[dict]) -> tuple:
        hits = list(dict.fromkeys(self.of[k] for k in keys if k in self.of))
        if hits:
            to, action = hits[0], "merged" if len(hits) == 1 else "review"
        else:
            best = max((x for x in near if x["l"] in self.prints), key=lambda x: (x["score"], -x["l"]), default=None)
            to, action = (best["l"], "merged") if best else (seq, "new")
        updated = None
        if action == "new":
            self.prints[seq] = fingerprint
        else:
            old = self.prints.get(to)
            updated = bool(old and fingerprint and old != fingerprint)
        self.of.update(dict.fromkeys(keys, to))
        return seq, to, action, updated


def decided(records: DataFrame, pairs: DataFrame | None = None, mappings: DataFrame | None = None, canonicals: DataFrame | None = None) -> DataFrame:
    """``seq, canonical, action, content_updated`` of records ``seq, keys, fingerprint`` (keys in the order of lookup). ``pairs``:
    ``l, r, score``, the earlier record left. What earlier batches have left: ``mappings`` (``key, canonical``) and
    ``canonicals`` (``canonical, fingerprint``, a representative's). ``content_updated``: a merged record's fingerprint isn't
    its representative's; null for new ones, false where either has none."""
    spark = records.sparkSession
    rows = settled(records.select("seq", F.array_distinct(F.array_compact(F.coalesce("keys", F.array().cast("array<string>")))).alias("keys"), "fingerprint"))
    long = rows.select("seq", F.explode("keys").alias("key"))
    stars = long.join(long.groupBy("key").agg(F.min("seq").alias("first")), "key").select(F.col("first").alias("a"), F.col("seq").alias("b"))
    close = (pairs if pairs is not None else spark.createDataFrame([], "l long, r long, score double")).filter(F.col("score") >= MERGE).select("l", "r", "score")
    close = settled(close.join(rows.select(F.col("seq").alias("r")), "r", "left_semi"))
    edges = stars.unionByName(close.select(F.col("l").alias("a"), F.col("r").alias("b")))
    old = None
    if mappings is not None:
        old = settled(mappings.join(long.select("key").distinct(), "key", "left_semi").select("key", "canonical"))
        edges = edges.unionByName(old.join(long, "key").select(F.col("canonical").alias("a"), F.col("seq").alias("b")))
    found = components(edges)
    kind = "component long, turn int, seq long, keys array<string>, fingerprint string, near array<struct<l:long,score:double>>"
    near = close.groupBy(F.col("r").alias("seq")).agg(F.array_sort(F.collect_list(F.struct("l", "score"))).alias("near"))
    none = F.array().cast("array<struct<l:long,score:double>>")
    events = rows.join(found.withColumnRenamed("node", "seq"), "seq", "left").join(near, "seq", "left").select(
        F.coalesce("component", "seq").alias("component"), F.lit(2).alias("turn"), "seq", "keys", "fingerprint", F.coalesce("near", none).alias("near")
    )
    if old is not None:  # what is known comes before a component's records
        of = old.join(found.withColumnRenamed("node", "canonical"), "canonical")
        events = events.unionByName(of.select("component", F.lit(1).alias("turn"), F.col("canonical").alias("seq"), F.array("key").alias("keys"), F.lit(None).cast("string").alias("fingerprint"), none.alias("near")))
    if canonicals is not None:
        of = canonicals.join(found.withColumnRenamed("node", "canonical"), "canonical")
        events = events.unionByName(of.select("component", F.lit(0).alias("turn"), F.col("canonical").alias("seq"), F.array().cast("array<string>").alias("keys"), "fingerprint", none.alias("near")))
    ordered = events.repartition("component").sortWithinPartitions("component", "turn", "seq")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, _Component()
        for batch in batches:
            out = []
            for component, turn, seq, keys, fingerprint, close_ in zip(*(c.to_pylist() for c in batch.columns)):
                if component != at:
                    at, state = component, _Component()
                if turn == 0:
                    state.prints[seq] = fingerprint
                elif turn == 1:
                    state.of[keys[0]] = seq
                else:
                    out.append(state.decide(seq, keys, fingerprint, close_))
            columns = zip(*out) if out else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _OUT)], schema=_OUT)

    assert [f.split()[0] for f in kind.split(", ")] == ordered.columns
    return ordered.mapInArrow(run, "seq long, canonical long, action string, content_updated boolean")


def new_mappings(records: DataFrame, decisions: DataFrame) -> DataFrame:
    """``key, canonical``: where a batch's keys point after it."""
    long = records.select("seq", F.explode("keys").alias("key")).filter(F.col("key").isNotNull()).join(decisions.select("seq", "canonical"), "seq")
    return long.groupBy("key").agg(F.max_by("canonical", "seq").alias("canonical"))


def rewritten(mappings: DataFrame, new: DataFrame) -> DataFrame:
    """All mappings, the new ones over the old."""
    return mappings.select("key", "canonical").join(new.select("key"), "key", "left_anti").unionByName(new.select("key", "canonical"))


def members(records: DataFrame, decisions: DataFrame, source: str = "id") -> DataFrame:
    """``canonical, source, seq``: a canonical record's sources, each once, at its first place."""
    return records.join(decisions.select("seq", "canonical"), "seq").groupBy("canonical", F.col(source).alias("source")).agg(F.min("seq").alias("seq"))
