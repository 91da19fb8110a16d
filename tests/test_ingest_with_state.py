"""Ingest one by one against the plain rule, in one batch, in many, and after a restart; indexes that follow records; components."""

import random

import pytest
from pyspark.sql import functions as F

from basalt.operators import fulltext, graph, records
from basalt.operators.resolution import MERGE
from basalt.streaming import records as streaming

SCHEMA = "seq long, id string, keys array<string>, fingerprint string, title string"


def plain(rows, scores):
    """Records in order, with a dictionary of keys."""
    of, prints, out = {}, {}, []
    for seq, _, keys, print_, _ in rows:
        keys = [k for k in keys or [] if k is not None]
        hits = list(dict.fromkeys(of[k] for k in keys if k in of))
        near = [(s, -x) for (x, y), s in scores.items() if y == seq and s >= MERGE and x in prints]
        if hits:
            to, action = hits[0], "merged" if len(hits) == 1 else "review"
        elif near:
            to, action = -max(near)[1], "merged"
        else:
            to, action = seq, "new"
        updated = None if action == "new" else bool(prints[to] and print_ and prints[to] != print_)
        if action == "new":
            prints[seq] = print_
        of.update((k, to) for k in keys)
        out.append((seq, to, action, updated))
    return out, of


def made(seed, n, key_space, titles):
    r = random.Random(seed)
    keys = [f"k{i}" for i in range(key_space)]
    rows = [(i * 3, f"s{r.randint(0, n // 2)}", r.sample(keys, min(key_space, r.randint(0, 2))) + ([None] if r.random() < 0.1 else []), r.choice(["a", "b", None, ""]), r.choice(titles)) for i in range(n)]
    scores = {(a[0], b[0]): 0.9 if a[4] == b[4] else 0.86 for a in rows for b in rows if a[0] < b[0] and a[4][0] == b[4][0] and a[4] != "none"}
    return rows, scores


@pytest.mark.parametrize(("seed", "n", "space", "titles"), [(1, 120, 60, ["t1", "t2", "none", "none"]), (2, 120, 15, ["none"]), (3, 80, 200, ["t1", "t2", "u1", "u2"]), (4, 60, 1, ["none"])])
def test_one_batch(spark, seed, n, space, titles):
    """Many keys and few, chains of scores, one key that nearly all records have."""
    rows, scores = made(seed, n, space, titles)
    pairs = spark.createDataFrame([(a, b, s) for (a, b), s in scores.items()] or [(0, 0, 0.0)], "l long, r long, score double")
    given = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = records.decided(given, pairs).cache()
    want, of = plain(rows, scores)
    assert sorted(tuple(r) for r in found.collect()) == want
    assert {r.key: r.canonical for r in records.new_mappings(given, found).collect()} == of
    firsts = {}
    for (seq, ident, *_), (_, to, *_) in zip(rows, want):
        firsts.setdefault((to, ident), seq)
    assert {(r.canonical, r.source): r.seq for r in records.members(given, found).collect()} == firsts


def test_listing_number_merges_across_addresses(spark):
    """One listing number at two addresses, the third time with another body; another source's equal number stays apart."""
    rows = [(1, "src-1", ["a/1234567", "url 1"], "A", ""), (2, "src-2", ["a/1234567", "url 2"], "A", ""), (3, "src-3", ["a/1234567", "url 2"], "B", ""), (4, "src-4", ["b/1234567", "url 4"], "A", "")]
    found = records.decided(spark.createDataFrame(rows, SCHEMA))
    assert sorted(tuple(r) for r in found.collect()) == [(1, 1, "new", None), (2, 1, "merged", False), (3, 1, "merged", True), (4, 4, "new", None)]


def test_no_records(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert records.decided(none).count() == 0 and records.new_mappings(none, records.decided(none)).count() == 0
    old = spark.createDataFrame([("x", 1), ("y", 2)], "key string, canonical long")
    assert sorted(tuple(r) for r in records.rewritten(old, spark.createDataFrame([("y", 3), ("z", 4)], "key string, canonical long")).collect()) == [("x", 1), ("y", 3), ("z", 4)]


def test_long_chains_take_few_rounds(spark):
    """Each record like the one before: decided in one pass over a component."""
    rows = spark.range(3000).select(F.col("id").alias("seq"), F.array().cast("array<string>").alias("keys"), F.lit(None).cast("string").alias("fingerprint"))
    pairs = spark.range(1, 3000).select((F.col("id") - 1).alias("l"), F.col("id").alias("r"), F.lit(0.9).alias("score"))
    found = records.decided(rows, pairs).groupBy("action").count().collect()
    assert {r.action: r["count"] for r in found} == {"new": 1500, "merged": 1500}  # every other one founds a record


def test_stream_equals_batch_after_a_restart(spark, tmp_path):
    rows, scores = made(9, 90, 40, ["t1", "t2", "none"])
    table = spark.createDataFrame([(a, b, s) for (a, b), s in scores.items()], "l long, r long, score double").cache()

    def scored(earlier, new):
        return table.join(earlier.select(F.col("seq").alias("l")), "l", "left_semi").join(new.select(F.col("seq").alias("r")), "r", "left_semi")

    each = streaming.ingest_batch(f"{tmp_path}/state", scored)
    failed = []

    def interrupted(batch, number):
        each(batch, number)
        if number == 1 and not failed:
            failed.append(number)
            raise RuntimeError("stopped after a batch was written, before it was committed")

    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/empty")
    for k in range(3):
        spark.createDataFrame(rows[k * 30 : k * 30 + 30], SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    with pytest.raises(Exception, match="stopped after"):
        streaming.run_batches(stream, interrupted, f"{tmp_path}/checkpoint")
    streaming.run_batches(stream, interrupted, f"{tmp_path}/checkpoint")
    want, of = plain(rows, scores)
    assert sorted(tuple(r) for r in streaming.decisions(spark, f"{tmp_path}/state").collect()) == want
    assert {r.key: r.canonical for r in streaming.mappings(spark, f"{tmp_path}/state").collect()} == of


def test_index_equals_a_rebuild(spark, tmp_path):
    fields, schema = [("title", "A", True), ("body", "C", True)], "id long, title string, body string, deleted boolean, version int"
    batches = [
        [(1, "red pool", "the pools", False, 1), (2, "blue", None, None, 1), (2, "green", "x", False, 2), (3, "gone", "y", False, 1)],
        [(3, "gone", "y", True, 2), (1, "red", "pool of reds", False, 2), (4, None, None, False, 1)],
        [(2, "", "", False, 3)],
    ]
    each = streaming.index_batch(f"{tmp_path}/index", "id", fields)
    for i, rows in enumerate(batches):
        for _ in range(2):  # a batch that runs again changes nothing
            each(spark.createDataFrame(rows, schema), i)
    now = spark.createDataFrame([(1, "red", "pool of reds"), (2, "", ""), (4, None, None)], "id long, title string, body string")
    want = sorted(map(str, fulltext.postings(now, "id", fields).collect()))
    assert sorted(map(str, streaming.index(spark, f"{tmp_path}/index", "id").collect())) == want
    assert [r.id for r in fulltext.ranked(streaming.index(spark, f"{tmp_path}/index", "id"), "id", fulltext.web_query("pool")).collect()] == [1]


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(180)] + [(k, k + 1) for k in range(1000, 1200)] + [(5000, k) for k in range(4000, 4400)] + [(7, 7), (None, 1), (1, None), (1, 1000)]
    part = {}

    def root(x):
        while part.setdefault(x, x) != x:
            x = part[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = root(a), root(b)
            part[max(x, y)] = min(x, y)
    assert {n.node: n.component for n in graph.components(spark.createDataFrame([*edges, *edges[:9]], "a long, b long")).collect()} == {x: root(x) for x in part}
    assert graph.components(spark.createDataFrame([(None, None), (1, 1)], "a long, b long")).count() == 0
