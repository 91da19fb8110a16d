"""Discovery: links of pages, which are new, when to stop, what changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basalt.functions import urls


def page_links(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``page_id, seq, link``: every anchor of every page, absolute."""
    each = pages.select(page_id, url, F.posexplode(urls.links(F.col(html))).alias("seq", "href"))
    return each.select(page_id, "seq", urls.resolved(F.col("href"), F.col(url)).alias("link"))


def first_wins(refs: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """One row a key: the value of its first reference, and how many there are."""
    return refs.groupBy(key).agg(F.min_by(value, F.struct(*order)).alias(value), F.count("*").alias("n"))


def last_wins(refs: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    return refs.groupBy(key).agg(F.max_by(value, F.struct(*order)).alias(value), F.count("*").alias("n"))


def new_and_seen(refs: DataFrame, page: str, key: str) -> DataFrame:
    """For each page how many of its distinct keys no page before it had."""
    distinct = refs.select(page, key).distinct()
    first = distinct.groupBy(key).agg(F.min(page).alias("_first"))
    fresh = (F.col("_first") == F.col(page)).cast("long")
    return distinct.join(first, key).groupBy(page).agg(F.count("*").alias("n_refs"), F.sum(fresh).alias("n_new"), F.sum(1 - fresh).alias("n_seen"))


def stale_stop(counts: DataFrame, walk: str, page: str, n_refs: str, n_new: str, most: int = 2) -> DataFrame:
    """The page of each walk at which ``most`` pages in a row with references brought nothing new; null if
    none. Pages without references neither count nor break the row; 0 never stops."""
    some = counts.filter(F.col(n_refs) > 0)
    order = Window.partitionBy(walk).orderBy(page)
    run = some.withColumn("_run", F.sum(F.when(F.col(n_new) > 0, 1).otherwise(0)).over(order))
    in_run = Window.partitionBy(walk, "_run").orderBy(page)
    stale = run.withColumn("_stale", F.sum(F.when(F.col(n_new) == 0, 1).otherwise(0)).over(in_run))
    hit = F.when((F.col("_stale") >= most) & F.lit(most > 0), F.col(page))
    return stale.groupBy(walk).agg(F.min(hit).alias("stop_page"), F.count("*").alias("n_pages"))


def catalog_diff(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """``key`` with ``added``, ``removed`` or ``unchanged``."""
    b = before.select(*key).distinct().withColumn("_b", F.lit(True))
    a = after.select(*key).distinct().withColumn("_a", F.lit(True))
    change = F.when(F.col("_b").isNull(), "added").when(F.col("_a").isNull(), "removed").otherwise("unchanged")
    return b.join(a, key, "full_outer").select(*key, change.alias("change"))


def supplemented(refs: DataFrame, extra: DataFrame, key: str, order: str, limit: int) -> DataFrame:
    """The references, and of the others those not among them, the first ones up to ``limit`` in all. The
    limit is the feature: a run's budget."""
    own = refs.groupBy(key).agg(F.min(order).alias("_at")).withColumn("extra", F.lit(False))
    more = extra.join(own.select(key), key, "left_anti").groupBy(key).agg(F.min(order).alias("_at")).withColumn("extra", F.lit(True))
    return own.unionByName(more).orderBy("extra", "_at", key).limit(limit).select(key, "extra")


def next_page(html: Column, url: Column) -> Column:
    """The page behind: a link marked as next, else the page after this one if a link leads to a higher one;
    null at the end."""
    marked = F.regexp_extract(html, r'<a\s[^>]*rel="next"[^>]*href="([^"]+)"', 1)
    numbers = F.transform(F.regexp_extract_all(html, F.lit(r"[?&]page=([0-9]+)"), F.lit(1)), lambda x: x.try_cast("long"))
    current = urls.page_number(url)
    return F.when(marked != "", urls.resolved(marked, url)).when(F.array_max(numbers) > current, urls.with_page(url, current + 1))
