"""Walks over catalogues whose pages have been fetched: which pages a walk from a start visits, in which order, where and why
it stops, and what it has found; from the start, or resumed from what an earlier walk has left.

A page names its next one. The order of a walk's pages is found by doubling: after k rounds the first 2^k pages of every
walk are known, so long walks take few rounds. A page that a walk has visited already ends it. Everything after that
are windows over a walk's pages.

Pages: ``walk, page`` (its address in one form), ``next`` (null for none), ``refs`` (``key, url`` in order; null for none),
and ``blocked`` (why it is no catalogue page; null if it is one). Null walks and pages take no part; of pages with
one address the first by ``next`` counts. Walks whose start was not fetched have no pages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basalt.sources.shared import settled

_REFS = "array<struct<key:string,url:string>>"


def visited(pages: DataFrame, starts: DataFrame, most: int = 0) -> DataFrame:
    """``walk, page, position``: the pages of the walks from ``starts`` (``walk, page``), counted from 0; with ``most``, each walk's
    first pages alone, and only as many rounds as these take.

    Tables of a round have as many rows as there are pages, so their joins are shuffled: broadcast, each would pass through
    the driver in every round."""
    own = pages.filter("walk IS NOT NULL AND page IS NOT NULL").groupBy("walk", "page").agg(F.min("next").alias("next"))
    known = settled(own)
    real = known.select("walk", F.col("page").alias("next"))
    jump = settled(known.filter("next IS NOT NULL AND next <> page").join(real.hint("merge"), ["walk", "next"], "left_semi").select("walk", "page", "next"))
    found = settled(starts.select("walk", "page").distinct().join(known.select("walk", "page").hint("merge"), ["walk", "page"], "left_semi").withColumn("position", F.lit(0).cast("long")))
    step = 1
    while True:
        if 0 < most <= step:
            return found.filter(F.col("position") < most)
        ahead = found.join(jump.hint("merge"), ["walk", "page"]).select("walk", F.col("next").alias("page"), (F.col("position") + step).alias("position"))
        both = settled(found.unionByName(ahead).groupBy("walk", "page").agg(F.min("position").alias("position")))
        if both.count() == found.count():
            return both
        found = both
        far = jump.select("walk", F.col("page").alias("next"), F.col("next").alias("_far"))
        jump = settled(jump.join(far.hint("merge"), ["walk", "next"]).select("walk", "page", F.col("_far").alias("next")))
        step *= 2


def walked(pages: DataFrame, starts: DataFrame, known: DataFrame | None = None, fetched: DataFrame | None = None, stale: int = 0, most_pages: int = 0, most_refs: int = 0) -> tuple[DataFrame, DataFrame]:
    """The walks' pages and what they have found.

    Pages: ``walk, page, position, n_refs, n_new, n_seen, reason``; a walk's last page has the ``reason`` why it ends there:
    ``stale`` (that many pages in a row with references that were all known; 0 never), ``listings`` or ``pages`` (as many as
    asked for; 0 for any number), ``blocked``, ``empty``, or ``end``. References: ``walk, key, url, position``, each key once,
    at its first place. ``known`` (``walk, key``) and ``fetched`` (``walk, pages``) are what a walk had before it was
    resumed: known keys are not new, and pages are counted on."""
    where = visited(pages, starts, most_pages)  # pages beyond the most that are asked for are none of the walk's
    before = where.join(fetched, "walk", "left").withColumn("position", F.col("position") + F.coalesce("pages", F.lit(0))).drop("pages") if fetched is not None else where
    content = pages.join(where.select("walk", "page"), ["walk", "page"], "left_semi").groupBy("walk", "page").agg(F.min_by(F.struct("refs", "blocked"), F.struct(F.col("next").isNotNull(), "next")).alias("c"))
    rows = settled(before.join(content, ["walk", "page"]).select("walk", "page", "position", F.coalesce("c.refs", F.array().cast(_REFS)).alias("refs"), "c.blocked"))
    each = rows.select("walk", "position", F.posexplode("refs").alias("at", "r")).select("walk", "position", "at", "r.key", "r.url").filter(F.col("key").isNotNull())
    first = each.groupBy("walk", "key").agg(F.min(F.struct("position", "at", "url")).alias("f"))
    if known is not None:
        first = first.join(known.select("walk", "key"), ["walk", "key"], "left_anti")
    first = settled(first.select("walk", "key", "f.position", "f.at", "f.url"))
    counts = each.select("walk", "position", "key").distinct().groupBy("walk", "position").agg(F.count("*").alias("n_refs"))
    fresh = first.groupBy("walk", "position").agg(F.count("*").alias("n_new"))
    zero = F.lit(0).cast("long")
    table = rows.select("walk", "page", "position", "blocked").join(counts, ["walk", "position"], "left").join(fresh, ["walk", "position"], "left")
    table = table.select("walk", "page", "position", "blocked", F.coalesce("n_refs", zero).alias("n_refs"), F.coalesce("n_new", zero).alias("n_new"))
    order = Window.partitionBy("walk").orderBy("position")
    had = zero
    if known is not None:
        table = table.join(known.select("walk", "key").distinct().groupBy("walk").agg(F.count("*").alias("_had")), "walk", "left")
        had = F.coalesce("_had", zero)
    fruitless = (F.col("n_refs") > 0) & (F.col("n_new") == 0)
    table = table.withColumn("_run", F.sum((~fruitless).cast("long")).over(order)).withColumn("_all", F.sum("n_new").over(order) + had)
    table = table.withColumn("_stale", F.sum(fruitless.cast("long")).over(Window.partitionBy("walk", "_run").orderBy("position")))
    last = F.col("position") == F.max("position").over(Window.partitionBy("walk"))
    reason = (
        F.when((F.col("_stale") >= stale) & fruitless & F.lit(stale > 0), "stale")
        .when((F.col("_all") >= most_refs) & F.lit(most_refs > 0), "listings")
        .when((F.col("n_refs") == 0) & F.col("blocked").isNotNull(), "blocked")
        .when(F.col("n_refs") == 0, "empty")
        .when((F.col("position") + 1 >= most_pages) & F.lit(most_pages > 0), "pages")
        .when(last, "end")
    )
    table = table.withColumn("reason", reason)
    stops = table.filter("reason IS NOT NULL").groupBy("walk").agg(F.min("position").alias("_stop"))
    kept = settled(table.join(stops, "walk").filter(F.col("position") <= F.col("_stop")).select("walk", "page", "position", "n_refs", "n_new", (F.col("n_refs") - F.col("n_new")).alias("n_seen"), "reason", "_all"))
    until = kept.groupBy("walk").agg(F.max("position").alias("_stop"), (F.max("_all") - F.sum("n_new")).alias("_had"))
    refs = first.join(until, "walk").filter(F.col("position") <= F.col("_stop"))
    if most_refs > 0:  # the last page gives what is still asked for
        rank = F.row_number().over(Window.partitionBy("walk").orderBy("position", "at"))
        refs = refs.withColumn("_n", rank).filter(F.col("_n") + F.col("_had") <= most_refs)
    return kept.drop("_all"), refs.select("walk", "key", "url", "position")


def left_by(kept: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What a walk leaves for the next run: how many pages it has (``walk, pages``) and where to go on (``walk, page``), if its
    last page names a next one."""
    last = kept.groupBy("walk").agg((F.max("position") + 1).alias("pages"), F.max_by("page", "position").alias("page"))
    following = pages.groupBy("walk", "page").agg(F.min("next").alias("next"))
    resume = last.join(following, ["walk", "page"]).filter("next IS NOT NULL AND next <> page").select("walk", F.col("next").alias("page"))
    return last.select("walk", "pages"), resume
