"""Queries over crawl policies, whole searches and stores, each with its SQL; they join those of the catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from basalt.functions import contact, urls
from basalt.operators import ingest, robots, search, workspace
from basalt.plans.catalogue import _DIFF, _FIELDS, _HAY_SQL, _INDEX_SQL, _QUERY, BARE_SQL, HOST_SQL, ID_SQL, parts, query
from basalt.sources.tables import table

_FILE = "# x\nUser-agent: *\nDisallow: /en/\nAllow: /en/1\r\nCrawl-delay: 1.5\n"
_MORE = "User-Agent: *\nDisallow: /\nuser-agent: Basalt\nDisallow: /de/ # y\nAllow: /de/1\nDisallow:\nCrawl-delay: 2\nsitemap: z\n"


@query(f"""WITH p AS (SELECT page_id, {HOST_SQL} AS site, coalesce(nullif(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), ''), '/') AS path FROM pages)
    SELECT page_id, CASE WHEN starts_with(site, 'blog.') THEN true WHEN starts_with(site, 'm.') THEN NOT starts_with(path, '/en/') OR starts_with(path, '/en/1') ELSE starts_with(path, '/de/1') END AS allowed,
        CASE WHEN starts_with(site, 'blog.') THEN NULL WHEN starts_with(site, 'm.') THEN 1500 ELSE 2000 END AS delay_ms FROM p""")
def robots_by_site(spark, sf_dir):
    """Every host has a file: hosts ``m.`` one group, ``blog.`` none at all, others a second group, which the agent's own name joins."""
    path = F.regexp_extract("url", r"^[a-z]+://[^/?#]*([^?#]*)", 1)
    rows = table(spark, sf_dir, "pages").select("page_id", urls.host("url").alias("site"), F.when(path == "", "/").otherwise(path).alias("path"))
    body = F.when(F.col("site").startswith("m."), _FILE).when(~F.col("site").startswith("blog."), _FILE + _MORE)
    rules, delays = robots.policies(rows.select("site").distinct().withColumn("body", body), "site", "body", "basalt/1.0")
    return robots.allowed(rows, rules, "site", "path").join(delays, "site", "left").select("page_id", "allowed", "delay_ms")


@query(f"""SELECT page_id, CASE WHEN page_id % 4 = 0 THEN false WHEN regexp_matches({HOST_SQL}, '(^|\\.)example\\.net$') THEN true
    WHEN regexp_matches({HOST_SQL}, '(^|\\.)example\\.(org|com)$') THEN page_id % 4 <> 3 AND NOT regexp_matches({HOST_SQL}, '(^|\\.)example\\.org$') ELSE true END AS blocked FROM pages""")
def resource_blocks(spark, sf_dir):
    host = urls.host("url")
    kind = F.element_at(F.array(*(F.lit(x) for x in ("Document", "image", "font", "script"))), (F.col("page_id") % 4 + 1).cast("int"))
    of = lambda *hosts: ingest.of_hosts(host, list(hosts))
    return table(spark, sf_dir, "pages").select("page_id", robots.resource_blocked(host, kind, of("example.net"), of("example.org", "example.com"), of("example.org")).alias("blocked"))


# Whole searches

_HITS_SQL = f"""{_INDEX_SQL}, a AS (SELECT p_partkey, count(*) AS n, sum(weight) AS rank FROM i WHERE term IN ('red', 'economy', '17') GROUP BY 1),
    h AS (SELECT p_partkey, CASE WHEN n = 3 THEN 'strict' ELSE 'related' END AS kind, round(CASE WHEN n = 3 THEN rank ELSE rank * 0.9 END, 6)::DOUBLE AS rank FROM a)"""


def _page(spark, sf_dir, words, **more):
    return search.search_page(parts(spark, sf_dir), "p_partkey", _FIELDS, words, **more).withColumn("rank", F.round("rank", 6))


@query(f"SELECT p_partkey, 'related' AS kind, 0.0::DOUBLE AS rank FROM part WHERE contains({_HAY_SQL}, 'idge') AND p_brand = 'Brand#13'")
def search_page_any(spark, sf_dir):
    return _page(spark, sf_dir, ("idge", "zzz"), adapter="p_brand", source="Brand#13")


@query(f"{_HITS_SQL} SELECT p_partkey, kind, rank FROM h WHERE p_partkey % 100 <> 0 UNION ALL SELECT p_partkey, 'corpus', 1.0 FROM part WHERE p_partkey % 100 = 0")
def search_page_fetched(spark, sf_dir):
    return _page(spark, sf_dir, _QUERY, adapter="p_brand", source="all", fetched=parts(spark, sf_dir).filter("p_partkey % 100 = 0"))


@query("SELECT p_partkey, 'corpus' AS kind, 0.0::DOUBLE AS rank FROM part WHERE p_brand = 'Brand#5'")
def search_page_blank(spark, sf_dir):
    return _page(spark, sf_dir, (), adapter="p_brand", source="Brand#5")


@query(f"{_HITS_SQL} SELECT count(*) FILTER (kind = 'strict') AS n_strict, count(*) FILTER (kind = 'related') AS n_related, 0 AS n_corpus, count(*) AS n_total FROM h")
def search_diagnostics(spark, sf_dir):
    return search.diagnostics(_page(spark, sf_dir, _QUERY))


@query(f"""SELECT p_partkey, array_to_string(list_filter(['red', 'economy', '17'], lambda w: NOT contains({_HAY_SQL}, w)), ',') AS missed,
    'https://a.example/search?q=' || replace(p_name, ' ', '+') AS url FROM part""")
def token_missed_summary(spark, sf_dir):
    hay = search.haystack(F.col("p_name"), F.col("p_brand"), F.col("p_type"))
    return parts(spark, sf_dir).select("p_partkey", F.array_join(search.missed_words(hay, _QUERY), ",").alias("missed"), search.search_url("https://a.example/search", F.col("p_name")).alias("url"))


# Stores


@query("""WITH a AS (SELECT DISTINCT p_brand, p_type FROM part WHERE p_size % 2 = 0), b AS (SELECT DISTINCT p_brand, p_type FROM part WHERE p_size % 2 = 1)
    SELECT p_brand, string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS sources FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY 1""")
def attach_sources(spark, sf_dir):
    of = lambda odd: parts(spark, sf_dir).filter(F.col("p_size") % 2 == odd).groupBy("p_brand").agg(F.array_sort(F.collect_set("p_type")).alias("sources"))
    return workspace.attached(of(0), of(1), "p_brand", "sources").select("p_brand", F.array_join(F.array_sort("sources"), ",").alias("sources"))


@query("""SELECT 'project' AS kind, CAST(o_custkey AS VARCHAR) AS workspace, o_orderkey AS canonical, 'researching' AS value FROM orders WHERE o_orderstatus = 'P'
    UNION ALL SELECT 'bucket', CAST(o_custkey AS VARCHAR), o_orderkey, o_orderpriority FROM orders WHERE o_orderstatus = 'P' AND o_orderkey % 2 = 0""")
def promote_canonicals(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").withColumn("canonical", F.col("o_orderkey"))
    bucket = F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority")).when(F.col("o_orderkey") % 3 == 0, " ")
    projects, buckets = workspace.promoted(rows, F.col("o_custkey").cast("string"), bucket)
    one = lambda df, kind, value: df.select(F.lit(kind).alias("kind"), "workspace", "canonical", F.col(value).alias("value"))
    return one(projects, "project", "status").unionByName(one(buckets, "bucket", "bucket"))


@query("""SELECT 'positive_price' AS rule, count(*) FILTER (NOT p_retailprice > 0) AS n FROM part UNION ALL SELECT 'small', count(*) FILTER (NOT p_size < 25) FROM part
    UNION ALL SELECT 'known_type', count(*) FILTER (NOT coalesce(CASE WHEN p_size % 2 = 0 THEN p_type <> 'ECONOMY' END, false)) FROM part""")
def quality_violations(spark, sf_dir):
    rules = {"positive_price": F.col("p_retailprice") > 0, "small": F.col("p_size") < 25, "known_type": F.when(F.col("p_size") % 2 == 0, F.col("p_type") != "ECONOMY")}
    return workspace.violations(parts(spark, sf_dir), rules)


@query(f"""WITH p AS (SELECT page_id, CASE WHEN page_id % 10 = 0 THEN '_snapshots/' WHEN page_id % 10 = 1 THEN '../' ELSE 'wiki/' END || {HOST_SQL} AS path FROM pages)
    SELECT page_id, path FROM p WHERE starts_with(path, 'wiki/m.')""")
def pages_under_prefix(spark, sf_dir):
    k = F.col("page_id") % 10
    path = F.concat(F.when(k == 0, "_snapshots/").when(k == 1, "../").otherwise("wiki/"), urls.host("url"))
    rows = table(spark, sf_dir, "pages").select("page_id", path.alias("path"))
    return workspace.under(rows, "path", "wiki/m.")


@query(f"SELECT page_id, {ID_SQL} AS parsed FROM pages WHERE page_id % 10 = 0 AND {ID_SQL} IS NOT NULL")
def replay_mismatches(spark, sf_dir):
    """Of the stored ids, those of every tenth page are broken."""
    stored = F.when(F.col("page_id") % 10 != 0, urls.external_id("url"))
    rows = table(spark, sf_dir, "pages").select("page_id", "url", stored.alias("stored"))
    return workspace.replay_mismatches(rows, urls.external_id("url"), "stored").select("page_id", "parsed")


@query("""SELECT p_partkey, '{"adapter":"' || p_brand || '","category":"' || p_type || '","method":"' || CASE WHEN p_size % 3 = 0 THEN 'adapter+llm-enrich' ELSE 'adapter-heuristic' END || '"}' AS classification FROM part""")
def classification_json(spark, sf_dir):
    enriched = F.when(F.col("p_size") % 3 == 0, F.array(F.lit("page"), F.lit("llm"))).when(F.col("p_size") % 3 == 1, F.array(F.lit("page")))
    return parts(spark, sf_dir).select("p_partkey", workspace.classification(F.col("p_brand"), F.col("p_type"), enriched).alias("classification"))


@query("""WITH m AS (SELECT p_brand, p_name, CASE WHEN p_size % 4 = 0 THEN 0.0 ELSE p_retailprice END AS price FROM part)
    SELECT p_brand, first(p_name ORDER BY CASE p_name WHEN 'cold ring' THEN 1 WHEN 'red widget' THEN 2 ELSE 3 END, price > 0, CASE WHEN price <= 0 THEN length(p_name) ELSE 0 END, price, p_name) AS p_name FROM m GROUP BY 1""")
def model_choice(spark, sf_dir):
    rows = parts(spark, sf_dir).select("p_brand", "p_name", F.when(F.col("p_size") % 4 == 0, 0.0).otherwise(F.col("p_retailprice")).alias("price"))
    return workspace.chosen(rows, "p_brand", "p_name", "price", ["cold ring", "red widget"])


@query("SELECT sha256(text) AS fingerprint, count(*) AS n FROM documents GROUP BY 1 HAVING bool_or(source = 'src1')")
def deals_by_source(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("fingerprint")).agg(F.count("*").alias("n"), F.collect_set("source").alias("adapters"))
    return workspace.by_sources(docs, "adapters", "src1").select("fingerprint", "n")


@query(f"SELECT {ID_SQL} AS id, arg_min(url, CASE WHEN starts_with({HOST_SQL}, 'www.') THEN 0 ELSE 1000000000 END + page_id) AS url FROM pages WHERE {ID_SQL} IS NOT NULL GROUP BY 1")
def refs_prefer_www(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select("page_id", "url", urls.external_id("url").alias("id")).filter("id IS NOT NULL")
    return rows.groupBy("id").agg(urls.preferred("url", "page_id").alias("url"))


@query("""SELECT c_custkey, ['US', 'CA', NULL][c_custkey % 3 + 1] AS country FROM customer WHERE c_custkey % 3 = 0 AND c_mktsegment = 'FURNITURE'""")
def contacts_in_place(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").withColumn("country", contact.country_code(F.element_at(F.array(F.lit("usa"), F.lit("can"), F.lit(" ")), (F.col("c_custkey") % 3 + 1).cast("int"))))
    return contact.in_place(rows, "country", "c_mktsegment", "United States", "furniture").select("c_custkey", "country")


@query("""SELECT user_id, epoch_us(max(ts) FILTER (event_id % 3 > 0)) AS seen_us FROM events GROUP BY 1""")
def latest_valid_fetch(spark, sf_dir):
    said = F.when(F.col("event_id") % 3 > 0, F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH:mm:ss.SSSSSS")).otherwise("not a date")
    rows = table(spark, sf_dir, "events").select("user_id", said.alias("said"))
    return rows.groupBy("user_id").agg(F.unix_micros(F.max(F.try_to_timestamp("said"))).alias("seen_us"))
