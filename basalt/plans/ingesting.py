"""Queries of ingest with state and of tables that streams keep, each with its SQL; they join those of the catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from basalt.functions import text, urls
from basalt.operators import records
from basalt.plans.catalogue import BARE_SQL, BODY_SQL, ID_SQL, NORM_SQL, parts, query
from basalt.sources.shared import scratch, settled
from basalt.sources.tables import spread, table
from basalt.streaming import records as streaming

#: Page by page: the keys so far, where they point, and the representatives' fingerprints.
_ONE_BY_ONE = f"""WITH RECURSIVE p AS (SELECT row_number() OVER (ORDER BY page_id) AS i, page_id AS seq, sha256({BODY_SQL}) AS f,
        list_filter([{BARE_SQL} || '/' || {ID_SQL}, 'url ' || {NORM_SQL}, 'title ' || regexp_extract(html, '<title>(.*?)</title>', 1)], lambda k: k IS NOT NULL) AS ks FROM pages),
    s AS (SELECT CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS BIGINT) AS canonical, CAST(NULL AS VARCHAR) AS action, CAST(NULL AS BOOLEAN) AS content_updated,
            map([]::VARCHAR[], []::BIGINT[]) AS m, map([]::BIGINT[], []::VARCHAR[]) AS fs
        UNION ALL
        SELECT i, seq, canonical, CASE WHEN n = 0 THEN 'new' WHEN n = 1 THEN 'merged' ELSE 'review' END, CASE WHEN n > 0 THEN fs[canonical] <> f END,
            map_concat(m, map(ks, list_transform(ks, lambda k: canonical))), CASE WHEN n = 0 THEN map_concat(fs, map([seq], [f])) ELSE fs END
        FROM (SELECT *, len(list_distinct(hits)) AS n, coalesce(hits[1], seq) AS canonical FROM
            (SELECT p.i, p.seq, p.f, p.ks, s.m, s.fs, list_filter(list_transform(p.ks, lambda k: s.m[k]), lambda h: h IS NOT NULL) AS hits FROM s JOIN p ON p.i = s.i + 1)))"""


def page_records(spark, sf_dir):
    """A page's keys in the order of lookup: its number at its host, its address, its title."""
    rows = spread(table(spark, sf_dir, "pages"))
    number = F.concat(urls.bare_host("url"), F.lit("/"), urls.external_id("url"))
    keys = F.array_compact(F.array(number, F.concat(F.lit("url "), urls.normalized("url")), F.concat(F.lit("title "), F.regexp_extract("html", "<title>(.*?)</title>", 1))))
    return rows.select(F.col("page_id").alias("seq"), F.col("page_id").cast("string").alias("id"), keys.alias("keys"), text.body_fingerprint("html").alias("fingerprint"))


@query(f"{_ONE_BY_ONE} SELECT seq, canonical, action, content_updated FROM s WHERE i > 0")
def ingest_by_keys(spark, sf_dir):
    """Pages one by one: merged, new, or in review where their keys point to several; keys are rewritten by the last one."""
    return records.decided(page_records(spark, sf_dir))


@query(f"{_ONE_BY_ONE} SELECT key, m[key] AS canonical FROM (SELECT m, unnest(map_keys(m)) AS key FROM s WHERE i = (SELECT max(i) FROM s))")
def ingest_mappings(spark, sf_dir):
    """Where each key points at the end."""
    rows = page_records(spark, sf_dir)
    return records.new_mappings(rows, records.decided(rows))


@query(f"{_ONE_BY_ONE} SELECT canonical, count(*) AS n_sources, min(seq) AS first_source, max(seq) AS last_source FROM s WHERE i > 0 GROUP BY 1")
def ingest_members(spark, sf_dir):
    """The sources of each canonical page."""
    rows = page_records(spark, sf_dir)
    found = records.members(rows, records.decided(rows))
    return found.groupBy("canonical").agg(F.count("*").alias("n_sources"), F.min("seq").alias("first_source"), F.max("seq").alias("last_source"))


@query(f"{_ONE_BY_ONE} SELECT seq, canonical, action, content_updated FROM s WHERE i > 0")
def ingest_stream(spark, sf_dir):
    """The same pages through a stream of three batches, whose state is what the batches before have written."""
    path = scratch(spark, "ingest")
    rows = settled(page_records(spark, sf_dir).withColumn("title", F.lit("")))  # pages are parsed once, by all tasks
    cuts = rows.agg(F.max("seq")).first()[0] or 0
    loads = (rows.filter(F.floor(F.col("seq") * 3 / (cuts + 1)) == k) for k in range(3))
    streaming.run_loads(loads, streaming.ingest_batch(f"{path}/state"), path)
    return streaming.decisions(spark, f"{path}/state")


_NAMES = "CASE WHEN p_size > 25 THEN 'bright ' || p_name ELSE p_name END"


@query(f"""WITH t AS (SELECT p_partkey, unnest(string_split({_NAMES}, ' ')) AS term FROM part WHERE p_size % 10 <> 0)
    SELECT CASE term WHEN 'large' THEN 'larg' ELSE term END AS term, count(*) AS n_records, CAST(sum(p_partkey) AS BIGINT) AS keys FROM t GROUP BY 1""")
def index_follows_records(spark, sf_dir):
    """A search index after a first load and two batches of changes, one of which deletes: as if built anew."""
    path, rows = scratch(spark, "index"), parts(spark, sf_dir).select("p_partkey", F.col("p_name").alias("title"), "p_size")
    loads = [
        rows.select("p_partkey", "title", F.lit(False).alias("deleted"), F.lit(0).alias("version")),
        rows.filter("p_size > 25").select("p_partkey", F.concat(F.lit("bright "), "title").alias("title"), F.lit(False).alias("deleted"), F.lit(1).alias("version")),
        rows.filter("p_size % 10 = 0").select("p_partkey", "title", F.lit(True).alias("deleted"), F.lit(2).alias("version")),
    ]
    streaming.run_loads(loads, streaming.index_batch(f"{path}/index", "p_partkey", [("title", "A", True)]), path)
    found = streaming.index(spark, f"{path}/index", "p_partkey")
    return found.groupBy("term").agg(F.count("*").alias("n_records"), F.sum("p_partkey").alias("keys"))
