"""Walks against a loop over pages, whole and resumed, and in batches with a restart."""

import random

import pytest
from pyspark.sql import functions as F

from basalt.operators import walks
from basalt.streaming import records as streaming

SCHEMA = "walk string, page string, next string, refs array<struct<key:string,url:string>>, blocked string"


def plain(pages, start, known=(), fetched=0, stale=0, most_pages=0, most_refs=0):
    table = {p[1]: p for p in pages}
    found, seen, at, url, run, out, position = {}, set(known), set(), start, 0, [], fetched
    while url in table and url not in at:
        at.add(url)
        _, _, following, refs, blocked = table[url]
        keys = {k for k, _ in refs or []}
        new = keys - seen
        for k, u in refs or []:
            if k not in seen:
                seen.add(k)
                found[k] = (u, position)
            if most_refs and len(seen) >= most_refs:
                break
        run = run + 1 if keys and not new else 0
        reason = "stale" if stale and run >= stale else "listings" if most_refs and len(seen) >= most_refs else "blocked" if not keys and blocked else "empty" if not keys else "pages" if most_pages and position + 1 >= most_pages else None
        if reason is None and (following not in table or following in at or following == url):
            reason = "end"
        out.append((url, position, len(keys), len(new), reason))
        position += 1
        if reason:
            break
        url = following
    return out, found


def made(seed, n):
    r = random.Random(seed)
    pages = []
    for i in range(n):
        refs = [(f"k{x}", f"u{i}-{j}") for j, x in enumerate(r.choices(range(max(1, i * 2 - 12), i * 3 + 3), k=r.randint(1, 5)))] if r.random() > 0.02 else r.choice([[], None])
        pages.append(("w", f"p{i}", f"p{i + 1}" if i + 1 < n else r.choice([None, "p3", f"p{i}", "lost"]), refs, "denied" if r.random() < 0.5 else None))
    return pages


@pytest.mark.parametrize("limits", [{}, {"stale": 2}, {"most_pages": 7}, {"most_refs": 20}, {"stale": 1, "most_pages": 40, "most_refs": 55}])
def test_walks(spark, limits):
    sets = {f"w{s}": [(f"w{s}", *p[1:]) for p in made(s, n)] for s, n in ((1, 45), (2, 70), (3, 1), (4, 33))}
    pages = spark.createDataFrame([p for ps in sets.values() for p in ps] + [(None, "x", None, None, None), ("w1", None, "p0", None, None)], SCHEMA).repartition(3)
    starts = spark.createDataFrame([*((w, "p0") for w in sets), ("w1", "p0"), ("gone", "p0")], "walk string, page string")
    kept, refs = walks.walked(pages, starts, **limits)
    got, found = {}, {}
    for r in kept.orderBy("walk", "position").collect():
        got.setdefault(r.walk, []).append((r.page, r.position, r.n_refs, r.n_new, r.reason))
        assert r.n_seen == r.n_refs - r.n_new
    for r in refs.collect():
        found.setdefault(r.walk, {})[r.key] = (r.url, r.position)
    for w, ps in sets.items():
        steps, keys = plain(ps, "p0", **limits)
        assert (got[w], found.get(w, {})) == (steps, keys), w
    assert set(got) == set(sets)


def test_resumed_walk_finds_the_same(spark):
    ps = made(8, 60)
    pages = spark.createDataFrame(ps, SCHEMA)
    start = spark.createDataFrame([("w", "p0")], "walk string, page string")
    whole, all_refs = walks.walked(pages, start)
    kept, refs = walks.walked(pages, start, most_pages=11)
    fetched, resume = walks.left_by(kept, pages)
    more, rest = walks.walked(pages, resume, refs, fetched)
    assert sorted(map(tuple, refs.unionByName(rest).collect())) == sorted(map(tuple, all_refs.collect()))
    places = lambda df: sorted((r.page, r.position) for r in df.collect())
    assert places(kept.unionByName(more)) == places(whole)


def test_walk_in_batches_with_a_restart(spark, tmp_path):
    ps = [(w, p, n, r or [("kx", "x")], b) for w in ("a", "b") for _, p, n, r, b in made(9 if w == "a" else 10, 40)]
    starts = spark.createDataFrame([("a", "p0"), ("b", "p0")], "walk string, page string").cache()
    each, failed = streaming.walk_batch(f"{tmp_path}/walks", starts), []

    def interrupted(batch, number):
        each(batch, number)
        if number == 1 and not failed:
            failed.append(number)
            raise RuntimeError("stopped after a batch was written, before it was committed")

    for k in range(4):
        part = [p for p in ps if int(p[1][1:]) // 10 == k]
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    with pytest.raises(Exception, match="stopped after"):
        streaming.run_batches(stream, interrupted, f"{tmp_path}/checkpoint")
    streaming.run_batches(stream, interrupted, f"{tmp_path}/checkpoint")
    _, refs = walks.walked(spark.createDataFrame(ps, SCHEMA), starts)
    assert sorted(map(tuple, streaming.walk_refs(spark, f"{tmp_path}/walks").collect())) == sorted(map(tuple, refs.collect()))


def test_no_pages(spark):
    none = spark.createDataFrame([], SCHEMA)
    kept, refs = walks.walked(none, spark.createDataFrame([("w", "p")], "walk string, page string"), stale=1, most_refs=2)
    assert kept.count() == 0 and refs.count() == 0 and walks.visited(none, none.select("walk", F.col("page"))).count() == 0


@pytest.fixture
def written(monkeypatch):
    """The plans and numbers of rows of the tables that a walk writes."""
    found, write = [], walks.settled

    def noted(df):
        out = write(df)
        found.append((df._jdf.queryExecution().executedPlan().toString(), out.count()))
        return out

    monkeypatch.setattr(walks, "settled", noted)
    return found


def test_rounds_send_no_pages_through_the_driver(spark, written):
    pages = spark.createDataFrame([(w, f"p{i}", f"p{i + 1}", None, None) for w in ("a", "b") for i in range(40)], SCHEMA)
    starts = spark.createDataFrame([("a", "p0"), ("b", "p7")], "walk string, page string")
    got = sorted((r.walk, r.position, r.page) for r in walks.visited(pages, starts).collect())
    assert got == [("a", i, f"p{i}") for i in range(40)] + [("b", i, f"p{i + 7}") for i in range(33)]
    assert len(written) > 10 and not any("Broadcast" in plan for plan, _ in written)


def test_a_limit_of_pages_bounds_the_rounds(spark, written):
    pages = spark.createDataFrame([("a", f"p{i}", f"p{i + 1}", [("k", "u")], None) for i in range(200)], SCHEMA)
    kept, refs = walks.walked(pages, spark.createDataFrame([("a", "p0")], "walk string, page string"), most_pages=5)
    assert sorted((r.position, r.n_new, r.reason) for r in kept.collect()) == [(i, int(i == 0), "pages" if i == 4 else None) for i in range(5)]
    assert refs.count() == 1 and len(written) <= 3 + 2 * 3 + 3 and written[-3][1] == 5  # of 200 pages, the content of five
