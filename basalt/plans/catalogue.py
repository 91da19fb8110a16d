"""The queries of the library over the given tables, each with its SQL.

The tables stand in for the entities of a listing pipeline: ``pages`` are responses; ``part`` is canonical
records (name, brand as adapter, price); ``events`` is the log of ingest states, where a user is a listing;
``orders``, ``customer``, ``nation`` are projects, workspaces and places; ``lineitem`` is observations.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basalt.functions import parse, text, urls
from basalt.operators import discovery, pages, resolution, search, state, workspace
from basalt.sources.shared import scratch
from basalt.sources.tables import evidence, table
from basalt.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

STATUS = {"purchase": "ingested", "error": "failed", "view": "skipped_known", "click": "skipped_fresh", "signup": "discovered"}
STATUS_SQL = "CASE event_type WHEN 'purchase' THEN 'ingested' WHEN 'error' THEN 'failed' WHEN 'view' THEN 'skipped_known' WHEN 'click' THEN 'skipped_fresh' ELSE 'discovered' END"
BODY_SQL = (
    "lower(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, "
    "'(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g'), '(?is)<noscript[^>]*>.*?</noscript>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')))"
)
HOST_SQL = "lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1))"
BARE_SQL = f"regexp_replace({HOST_SQL}, '^(www|m)\\.', '')"
ID_SQL = "nullif(regexp_extract(url, '^[^?#]*/([0-9]+)(\\.html)?/?([?#].*)?$', 1), '')"
NORM_SQL = (
    "lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1)) || coalesce(nullif(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), ''), '/') || "
    "CASE WHEN regexp_extract(url, '\\?([^#]*)', 1) = '' THEN '' ELSE '?' || array_to_string(list_sort(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&')), '&') END"
)
LINKS_SQL = """
    SELECT page_id, seq - 1 AS seq, CASE WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN href
        WHEN starts_with(href, '/') THEN regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) || href ELSE 'relative' END AS link
    FROM (SELECT page_id, url, unnest(regexp_extract_all(html, '<a\\s[^>]*href="([^"]*)"', 1)) AS href,
                 generate_subscripts(regexp_extract_all(html, '<a\\s[^>]*href="([^"]*)"', 1), 1) AS seq FROM pages)"""


def query(sql: str | None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.lit("discovered")
    for kind, name in STATUS.items():
        status = F.when(F.col("event_type") == kind, name).otherwise(status)
    return table(spark, sf_dir, "events").withColumn("status", status)


# Evidence and keys


@query(f"SELECT sha256({BODY_SQL}) AS fingerprint, min(page_id) AS canonical, count(*) AS n_pages, count(DISTINCT {BARE_SQL}) AS n_hosts FROM pages GROUP BY 1")
def body_fingerprint_groups(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select("page_id", text.body_fingerprint("html").alias("fingerprint"), urls.bare_host("url").alias("host"))
    return rows.groupBy("fingerprint").agg(F.min("page_id").alias("canonical"), F.count("*").alias("n_pages"), F.count_distinct("host").alias("n_hosts"))


@query(f"SELECT page_id, {NORM_SQL} AS url FROM pages")
def url_normalize(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.normalized("url").alias("url"))


@query(f"SELECT {BARE_SQL} AS adapter, count(*) AS n, count(DISTINCT regexp_extract({HOST_SQL}, '([^.]+\\.[^.]+)$', 1)) AS n_domains FROM pages GROUP BY 1")
def adapter_from_host(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select(urls.adapter("url").alias("adapter"), urls.registrable("url").alias("d"))
    return rows.groupBy("adapter").agg(F.count("*").alias("n"), F.count_distinct("d").alias("n_domains"))


@query(f"""SELECT page_id, sha256('{{"kind":"url","value":"' || {NORM_SQL} || '"}}') AS url_key,
    sha256('{{"kind":"external","adapter":"' || {BARE_SQL} || '","externalId":"' || {ID_SQL} || '"}}') AS external_key FROM pages""")
def dedup_key_hash(spark, sf_dir):
    return keyed_pages(spark, sf_dir).select("page_id", "url_key", "external_key")


def keyed_pages(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select("page_id", urls.normalized("url").alias("u"), urls.adapter("url").alias("a"), urls.external_id("url").alias("i"))
    return rows.select("page_id", resolution.url_key(F.col("u")).alias("url_key"), resolution.external_key(F.col("a"), F.col("i")).alias("external_key"))


_KEYS_SQL = f"""WITH k AS (SELECT page_id, {NORM_SQL} AS u, {BARE_SQL} || '/' || {ID_SQL} AS e FROM pages),
    h AS (SELECT page_id, min(page_id) OVER (PARTITION BY u) AS cu, CASE WHEN e IS NOT NULL THEN min(page_id) OVER (PARTITION BY e) END AS ce FROM k)"""


@query(f"{_KEYS_SQL} SELECT page_id, coalesce(ce, cu) AS canonical, CASE WHEN coalesce(ce, cu) = page_id THEN 'new' ELSE 'merged' END AS action FROM h")
def key_lookup_first_canonical(spark, sf_dir):
    hits = resolution.by_keys(keyed_pages(spark, sf_dir), ["external_key", "url_key"], "page_id")
    return hits.select("page_id", F.col("first_hit").alias("canonical"), F.when(F.col("first_hit") == F.col("page_id"), "new").otherwise("merged").alias("action"))


@query(f"{_KEYS_SQL} SELECT page_id, CASE WHEN ce IS NOT NULL AND ce <> cu THEN 2 ELSE 1 END AS n_canonicals FROM h")
def key_conflicts_review(spark, sf_dir):
    return resolution.by_keys(keyed_pages(spark, sf_dir), ["external_key", "url_key"], "page_id").select("page_id", "n_canonicals")


@query(f"SELECT {BARE_SQL} AS adapter, sha256(html) AS sha256, count(*) AS n_puts, strlen(html) AS size_bytes FROM pages GROUP BY 1, 2, html")
def evidence_store(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").withColumn("adapter", urls.adapter("url"))
    return evidence(rows, "adapter", "html").select("adapter", "sha256", "n_puts", F.col("size_bytes").cast("long").alias("size_bytes"))


# Pair scores. Records with one name in a brand are one; what is compared are the first of each.


def named(spark, sf_dir):
    rows = table(spark, sf_dir, "part").groupBy("p_brand", "p_name").agg(F.min("p_partkey").alias("seq"))
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("seq"), "p_type", "p_size", "p_retailprice")
    return rows.join(part, "seq")


_PAIRS_SQL = """WITH f AS (SELECT p_brand, p_name, min(p_partkey) AS seq FROM part GROUP BY 1, 2),
    r AS (SELECT f.*, p_type, p_size, p_retailprice, list_distinct(string_split(f.p_name, ' ')) AS t FROM f JOIN part ON seq = p_partkey),
    p AS (SELECT a.p_brand, a.seq AS l, b.seq AS r, len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t)))::DOUBLE AS lexical,
          (least(a.p_retailprice, b.p_retailprice) / greatest(a.p_retailprice, b.p_retailprice) + least(a.p_size, b.p_size) / greatest(a.p_size, b.p_size)::DOUBLE) / 2 AS numeric,
          CASE WHEN a.p_type = b.p_type THEN 1.0 ELSE 0.0 END::DOUBLE AS geo
          FROM r a JOIN r b ON a.p_brand = b.p_brand AND a.seq < b.seq WHERE len(list_intersect(a.t, b.t)) > 0)"""


def scored(spark, sf_dir):
    """Pairs of a title Jaccard of 0.3 or more, as in the SQL. That loses no merge (0.85), but pairs below it that could
    reach the review band (0.55) or a chain's link (0.6) by type, size and price are not scored."""
    pairs = resolution.candidate_pairs(named(spark, sf_dir), "p_brand", "p_name", "seq", 0.3)
    numeric = resolution.numeric_score([(F.col(f"l_{c}").cast("double"), F.col(f"r_{c}").cast("double")) for c in ("p_retailprice", "p_size")])
    rows = pairs.withColumn("numeric", numeric).withColumn("geo", resolution.geo_score(F.col("l_p_type"), F.col("r_p_type")))
    return rows.withColumn("score", resolution.composite(F.col("lexical"), F.col("numeric"), F.col("geo")))


@query(f"{_PAIRS_SQL} SELECT l, r, round(lexical, 6) AS lexical FROM p WHERE lexical >= 0.3")
def title_jaccard_pairs(spark, sf_dir):
    return scored(spark, sf_dir).filter("lexical >= 0.3").select(F.col("l_seq").alias("l"), F.col("r_seq").alias("r"), F.round("lexical", 6).alias("lexical"))


@query(f"{_PAIRS_SQL} SELECT l, r, round(numeric, 6) AS numeric FROM p WHERE lexical >= 0.3")
def numeric_ratio_pairs(spark, sf_dir):
    return scored(spark, sf_dir).filter("lexical >= 0.3").select(F.col("l_seq").alias("l"), F.col("r_seq").alias("r"), F.round("numeric", 6).alias("numeric"))


@query(f"""{_PAIRS_SQL}, s AS (SELECT round(0.45 * lexical + 0.25 * numeric + 0.3 * geo, 6) AS score, p_brand FROM p WHERE lexical >= 0.3)
    SELECT p_brand, CASE WHEN score >= 0.85 THEN 'auto_merge' WHEN score >= 0.55 THEN 'review' ELSE 'new' END AS decision, count(*) AS n, round(avg(score), 4) AS mean FROM s GROUP BY 1, 2""")
def composite_score_decision(spark, sf_dir):
    rows = scored(spark, sf_dir).filter("lexical >= 0.3").select(F.col("l_p_brand").alias("p_brand"), F.round("score", 6).alias("score"))
    return rows.groupBy("p_brand", resolution.decision(F.col("score")).alias("decision")).agg(F.count("*").alias("n"), F.round(F.avg("score"), 4).alias("mean"))


@query(f"""{_PAIRS_SQL}, s AS (SELECT r, l, round(0.45 * lexical + 0.25 * numeric + 0.3 * geo, 6) AS score FROM p WHERE lexical >= 0.3)
    SELECT r AS record, l AS candidate, score FROM s QUALIFY row_number() OVER (PARTITION BY r ORDER BY score DESC, l) = 1""")
def best_candidate(spark, sf_dir):
    rows = scored(spark, sf_dir).filter("lexical >= 0.3").select(F.col("r_seq").alias("record"), F.col("l_seq").alias("candidate"), F.round("score", 6).alias("score"))
    return resolution.best_candidate(rows, "record", "candidate")


@query(f"""WITH RECURSIVE {_PAIRS_SQL[5:]}, s AS (SELECT r, l, round(0.45 * lexical + 0.25 * numeric + 0.3 * geo, 6) AS score FROM p WHERE lexical >= 0.3),
    b AS (SELECT r AS seq, l AS parent FROM s WHERE score >= 0.6 QUALIFY row_number() OVER (PARTITION BY r ORDER BY score DESC, l) = 1),
    c(seq, canonical) AS (SELECT f.seq, f.seq FROM f WHERE seq NOT IN (SELECT seq FROM b) UNION ALL SELECT b.seq, c.canonical FROM b JOIN c ON b.parent = c.seq)
    SELECT seq, canonical FROM c""")
def cluster_chains(spark, sf_dir):
    pairs = scored(spark, sf_dir).filter("lexical >= 0.3").select(F.col("l_seq").alias("l"), F.col("r_seq").alias("r"), F.round("score", 6).alias("score")).filter("score >= 0.6")
    return resolution.clusters(named(spark, sf_dir), pairs)


@query("""SELECT c.c_nationkey, count(*) AS n, round(avg(CASE WHEN c.c_nationkey = s.s_nationkey THEN 1.0 ELSE 0.0 END), 6) AS geo
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer c ON o_custkey = c_custkey JOIN supplier s ON l_suppkey = s_suppkey GROUP BY 1""")
def geo_agreement(spark, sf_dir):
    li, o = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey"), table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    c, s = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    rows = li.join(o, li.l_orderkey == o.o_orderkey).join(c, F.col("o_custkey") == c.c_custkey).join(s, F.col("l_suppkey") == s.s_suppkey)
    score = resolution.geo_score(F.col("c_nationkey"), F.col("s_nationkey"))
    return rows.groupBy("c_nationkey").agg(F.count("*").alias("n"), F.round(F.avg(score), 6).alias("geo"))


@query("""WITH r AS (SELECT label, min(vec_id) AS rep FROM embeddings GROUP BY 1)
    SELECT e.vec_id, rep, round((list_cosine_similarity(e.embedding::DOUBLE[], f.embedding::DOUBLE[]) + 1) / 2, 6) AS score
    FROM embeddings e JOIN r ON e.label = r.label JOIN embeddings f ON f.vec_id = rep""")
def embedding_to_representative(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    reps = rows.groupBy("label").agg(F.min(F.struct("vec_id", "embedding")).alias("r")).select("label", F.col("r.vec_id").alias("rep"), F.col("r.embedding").alias("of"))
    return rows.join(reps, "label").select("vec_id", "rep", F.round(resolution.embedding_score(F.col("embedding"), F.col("of")), 6).alias("score"))


@query("""SELECT sha256(text) AS fingerprint, min(doc_id) AS canonical, count(*) AS n_sources, array_to_string(list_sort(list(DISTINCT source)), ',') AS sources
    FROM documents GROUP BY 1 HAVING count(*) > 1""")
def multi_source_deals(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("fingerprint"), "source")
    return resolution.merged_sources(rows, ["fingerprint"], "doc_id", "source").withColumn("sources", F.array_join("sources", ","))


@query("""WITH d AS (SELECT doc_id, count(*) OVER (PARTITION BY sha256(text)) > 1 AS dup FROM documents)
    SELECT dup, quality, count(*) AS n FROM d JOIN labels USING (doc_id) GROUP BY 1, 2""")
def dedup_against_labels(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("fp"))
    twice = docs.groupBy("fp").agg((F.count("*") > 1).alias("dup"))
    return docs.join(twice, "fp").join(table(spark, sf_dir, "labels"), "doc_id").groupBy("dup", "quality").agg(F.count("*").alias("n"))


# Discovery


@query(LINKS_SQL)
def anchor_links(spark, sf_dir):
    return discovery.page_links(table(spark, sf_dir, "pages"))


@query(f"WITH l AS ({LINKS_SQL}) SELECT link, min(page_id) AS page_id, count(*) AS n FROM l GROUP BY 1")
def link_first_wins(spark, sf_dir):
    return discovery.first_wins(discovery.page_links(table(spark, sf_dir, "pages")), "link", ["page_id", "seq"], "page_id")


@query(f"WITH l AS ({LINKS_SQL}) SELECT link, max(page_id) AS page_id, count(*) AS n FROM l GROUP BY 1")
def link_last_wins(spark, sf_dir):
    return discovery.last_wins(discovery.page_links(table(spark, sf_dir, "pages")), "link", ["page_id", "seq"], "page_id")


_NEW_SQL = """WITH d AS (SELECT DISTINCT CAST(ts AS DATE) AS page, user_id FROM events), f AS (SELECT *, min(page) OVER (PARTITION BY user_id) AS first FROM d),
    c AS (SELECT page, count(*) AS n_refs, count(*) FILTER (page = first) AS n_new, count(*) FILTER (page <> first) AS n_seen FROM f GROUP BY 1)"""


def daily(spark, sf_dir):
    return discovery.new_and_seen(table(spark, sf_dir, "events").select(F.to_date("ts").alias("page"), "user_id"), "page", "user_id")


@query(f"{_NEW_SQL} SELECT CAST(page AS VARCHAR) AS page, n_refs, n_new, n_seen FROM c")
def new_vs_seen_per_page(spark, sf_dir):
    return daily(spark, sf_dir).withColumn("page", F.col("page").cast("string"))


@query(f"""{_NEW_SQL}, r AS (SELECT *, sum(CASE WHEN n_new > 0 THEN 1 ELSE 0 END) OVER (ORDER BY page) AS run FROM c),
    s AS (SELECT *, sum(CASE WHEN n_new = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY run ORDER BY page) AS stale FROM r)
    SELECT 'all' AS walk, CAST(min(CASE WHEN stale >= 2 THEN page END) AS VARCHAR) AS stop_page, count(*) AS n_pages FROM s""")
def stale_page_stop(spark, sf_dir):
    walk = daily(spark, sf_dir).withColumn("walk", F.lit("all"))  # a row a day
    return discovery.stale_stop(walk, "walk", "page", "n_refs", "n_new").withColumn("stop_page", F.col("stop_page").cast("string"))


_DIFF = "2024-01-15"


@query(f"""WITH b AS (SELECT DISTINCT user_id, event_type FROM events WHERE ts < DATE '{_DIFF}'), a AS (SELECT DISTINCT user_id, event_type FROM events WHERE ts >= DATE '{_DIFF}')
    SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.event_type, b.event_type) AS event_type,
           CASE WHEN b.user_id IS NULL THEN 'added' WHEN a.user_id IS NULL THEN 'removed' ELSE 'unchanged' END AS change
    FROM b FULL JOIN a ON a.user_id = b.user_id AND a.event_type = b.event_type""")
def catalog_diff(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", "ts")
    cut = F.lit(_DIFF).cast("date")
    return discovery.catalog_diff(rows.filter(F.col("ts") < cut), rows.filter(F.col("ts") >= cut), ["user_id", "event_type"])


@query(f"""WITH l AS ({LINKS_SQL}), own AS (SELECT url AS link, min(page_id) AS pos FROM pages GROUP BY 1),
    more AS (SELECT link, min(page_id) AS pos FROM l WHERE link NOT IN (SELECT link FROM own) GROUP BY 1),
    u AS (SELECT link, pos, false AS extra FROM own UNION ALL SELECT link, pos, true FROM more)
    SELECT link, extra FROM u ORDER BY extra, pos, link LIMIT 500""")
def supplement_limit(spark, sf_dir):
    rows = table(spark, sf_dir, "pages")
    links = discovery.page_links(rows).select("link", "page_id")
    return discovery.supplemented(rows.select(F.col("url").alias("link"), "page_id"), links, "link", "page_id", 500)


@query("""WITH p AS (SELECT page_id, regexp_replace(url, '#.*$', '') AS url, list_max(list_transform(regexp_extract_all(html, '[?&]page=([0-9]+)', 1), lambda x: x::BIGINT)) AS most,
        coalesce(TRY_CAST(nullif(regexp_extract(url, '[?&]page=([0-9]+)', 1), '') AS BIGINT), 1) AS cur FROM pages)
    SELECT page_id, cur AS page, CASE WHEN most > cur THEN CASE WHEN regexp_matches(url, '[?&]page=[0-9]+') THEN regexp_replace(url, '([?&]page=)[0-9]+', '\\1' || (cur + 1))
        ELSE url || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || 'page=' || (cur + 1) END END AS next_page FROM p""")
def next_page(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.page_number("url").alias("page"), discovery.next_page(F.col("html"), F.col("url")).alias("next_page"))


# States


@query(f"SELECT user_id, arg_max({STATUS_SQL}, ts) AS status, arg_max(value, ts) AS value, max(event_id) FILTER (true) AS n FROM events GROUP BY 1".replace("max(event_id) FILTER (true) AS n", "arg_max(event_id, ts) AS event_id"))
def latest_state(spark, sf_dir):
    return state.latest(events(spark, sf_dir), ["user_id"], ["ts", "event_id"], "status", "value", "event_id")


@query(f"""WITH e AS (SELECT user_id, ts, event_id, {STATUS_SQL} AS status FROM events), b AS (SELECT *, lag(status) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM e)
    SELECT user_id, arg_max(status, ts) AS status, count(*) AS n_kept FROM b
    WHERE NOT (status IN ('skipped_known', 'skipped_fresh') AND coalesce(before IN ('ingested', 'skipped_known', 'skipped_fresh'), false)) GROUP BY 1""")
def state_no_downgrade(spark, sf_dir):
    return state.without_downgrades(events(spark, sf_dir), "user_id", ["ts", "event_id"])


@query(f"""SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS last_success FROM events""")
def last_success(spark, sf_dir):
    return state.last_success(events(spark, sf_dir), "user_id", ["ts", "event_id"], "event_id").select("event_id", "last_success")


@query("""SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) FILTER (event_type = 'purchase') AS n_ingested, count(*) FILTER (event_type = 'error') AS n_failed,
    count(*) FILTER (event_type = 'view') AS n_skipped_known, count(*) FILTER (event_type = 'click') AS n_skipped_fresh, count(*) AS n_total FROM events GROUP BY 1""")
def status_counts(spark, sf_dir):
    rows = events(spark, sf_dir).withColumn("day", F.to_date("ts").cast("string"))
    return state.status_counts(rows, "day", ("ingested", "failed", "skipped_known", "skipped_fresh"))


@query(f"""WITH l AS (SELECT user_id, arg_max({STATUS_SQL}, ts) AS status FROM events GROUP BY 1)
    SELECT count(*) FILTER (status IN ('ingested', 'skipped_known', 'skipped_fresh')) AS satisfied, count(*) FILTER (status = 'failed') AS failed, count(*) AS total,
    CASE WHEN count(*) FILTER (status = 'failed') = count(*) THEN 'failed' WHEN count(*) FILTER (status = 'failed') > 0 THEN 'partial' ELSE 'completed' END AS run FROM l""")
def cumulative(spark, sf_dir):
    rows = state.latest(events(spark, sf_dir), ["user_id"], ["ts", "event_id"], "status")
    counts = rows.agg(F.count_if(F.col("status").isin(*state.SATISFIED)).alias("satisfied"), F.count_if(F.col("status") == "failed").alias("failed"), F.count("*").alias("total"))
    return counts.withColumn("run", F.when(F.col("failed") == F.col("total"), "failed").when(F.col("failed") > 0, "partial").otherwise("completed"))


_NOW = "2024-01-31 00:00:00"


@query(f"""WITH l AS (SELECT user_id, max(ts) FILTER (event_type = 'purchase') AS seen FROM events GROUP BY 1)
    SELECT user_id, CASE WHEN seen IS NOT NULL AND epoch_us(TIMESTAMP '{_NOW}') - epoch_us(seen) < 259200000000 THEN 'fresh' ELSE 'none' END AS skip FROM l""")
def cooldown_skip(spark, sf_dir):
    seen = events(spark, sf_dir).groupBy("user_id").agg(F.max(F.when(F.col("status") == "ingested", F.col("ts").cast("timestamp"))).alias("seen"))
    skip = state.cooldown(F.col("seen"), F.col("seen").isNotNull(), F.lit(_NOW).cast("timestamp"), 72)
    return seen.select("user_id", skip.alias("skip"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS m FROM documents),
    b AS (SELECT doc_id, m, substr(regexp_replace(regexp_replace(m, 'https?://[^\\s]+', '<url>', 'g'), '\\b[0-9]{6,}\\b', '<id>', 'g'), 1, 200) AS bucket FROM l WHERE m <> '')
    SELECT bucket, count(*) AS n, min(doc_id) AS first_doc FROM b GROUP BY 1 ORDER BY n DESC, bucket LIMIT 8""")
def failure_buckets_top8(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("m")).filter("m <> ''")
    rows = lines.select("doc_id", text.error_bucket("m").alias("bucket"))
    return state.failure_buckets(rows, "bucket", "doc_id", "doc_id").select("bucket", "n", F.col("sample").alias("first_doc"))


@query("""WITH o AS (SELECT user_id, max(ts) FILTER (event_type = 'purchase') AS ok FROM events GROUP BY 1)
    SELECT user_id, count(*) AS attempts FROM events JOIN o USING (user_id) WHERE event_type = 'error' AND (ok IS NULL OR ts > ok) GROUP BY 1""")
def failure_attempts(spark, sf_dir):
    return state.attempts(events(spark, sf_dir), "user_id", ["ts", "event_id"])


@query(f"""WITH l AS (SELECT user_id, arg_max({STATUS_SQL}, ts) AS status, arg_max(value, ts) AS value FROM events GROUP BY 1), f AS (SELECT user_id, value > 50 AS hard FROM l WHERE status = 'failed'),
    r AS (SELECT user_id, min(event_id) AS seq FROM events WHERE event_type = 'signup' GROUP BY 1)
    SELECT user_id, seq, 0 AS bucket FROM r LEFT JOIN f USING (user_id) WHERE NOT coalesce(hard, false)
    UNION ALL SELECT user_id, NULL, 1 FROM f WHERE NOT hard AND user_id NOT IN (SELECT user_id FROM r)""")
def ingest_order(spark, sf_dir):
    rows = events(spark, sf_dir)
    failed = state.latest(rows, ["user_id"], ["ts", "event_id"], "status", "value").filter("status = 'failed'").select("user_id", (F.col("value") > 50).alias("hard"))
    refs = rows.filter("status = 'discovered'").groupBy("user_id").agg(F.min("event_id").alias("seq"))
    return state.ingest_order(refs, failed, "user_id", "seq")


@query("""WITH g AS (SELECT user_id, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) AS gap FROM events)
    SELECT user_id, count(*) FILTER (gap < 3600000000) AS n_short, min(gap) AS shortest_us FROM g GROUP BY 1""")
def throttle_gaps(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    return state.throttle_gaps(rows, "user_id", "ts", 3_600_000)


@query("SELECT user_id, event_type, min(event_id) AS event_id, count(*) AS n_enqueued FROM events GROUP BY 1, 2")
def idempotent_enqueue(spark, sf_dir):
    return state.first_of_key(table(spark, sf_dir, "events"), ["user_id", "event_type"], "event_id")


@query("""SELECT event_id, coalesce(props <> first_value(props) OVER (PARTITION BY user_id ORDER BY ts, event_id), false) AS updated FROM events""")
def content_updated(spark, sf_dir):
    return state.content_updated(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "props").select("event_id", "updated")


@query("SELECT user_id, event_type, count(*) AS n FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY 1, 2")
def stream_dedup(spark, sf_dir):
    """Batches of the stream run now, and what they have written is read again."""
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string"
    source = ingest.stream(spark, f"{sf_dir}/{{events}}.parquet", schema)  # a pattern: one file or a folder
    shared = scratch(spark, "stream")
    once = ingest.deduplicated(source, ["user_id", "event_type"], "ts", "60 days").select("user_id", "event_type")
    return ingest.drain(once, f"{shared}/out", f"{shared}/checkpoint").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


# Search

_WORDS = ("red", "widget")
_HAY_SQL = "lower(concat_ws(' ', p_name, p_brand, p_type))"


def parts(spark, sf_dir):
    return table(spark, sf_dir, "part")


@query(f"SELECT p_partkey FROM part WHERE contains({_HAY_SQL}, 'red') AND contains({_HAY_SQL}, 'widget')")
def haystack_and(spark, sf_dir):
    return parts(spark, sf_dir).filter(search.matches_all(search.haystack(F.col("p_name"), F.col("p_brand"), F.col("p_type")), _WORDS)).select("p_partkey")


@query(f"SELECT p_partkey FROM part WHERE contains({_HAY_SQL}, 'red') OR contains({_HAY_SQL}, 'widget')")
def haystack_or(spark, sf_dir):
    return parts(spark, sf_dir).filter(search.matches_any(search.haystack(F.col("p_name"), F.col("p_brand"), F.col("p_type")), _WORDS)).select("p_partkey")


@query("""WITH q AS (SELECT unnest(['  w', ' wi', 'wid', 'idg', 'dge', 'get', 'ett', 'tt ']) AS g),
    w AS (SELECT p_partkey, '  ' || unnest(string_split(p_name, ' ')) || ' ' AS w FROM part),
    t AS (SELECT DISTINCT p_partkey, substr(w, i::BIGINT, 3) AS g FROM w, unnest(range(1, 40)) r(i) WHERE i <= length(w) - 2),
    s AS (SELECT p_partkey, count(q.g) AS shared, count(*) AS n FROM t LEFT JOIN q ON q.g = t.g GROUP BY 1)
    SELECT p_partkey, round(shared / (n + 8 - shared)::DOUBLE, 6) AS score FROM s WHERE shared / (n + 8 - shared)::DOUBLE >= 0.25""")
def trigram_search(spark, sf_dir):
    return search.trigram_search(parts(spark, sf_dir), ["p_name"], "widgett").select("p_partkey", F.round("score", 6).alias("score"))


_INDEX_SQL = """WITH t AS (SELECT p_partkey, unnest(list_distinct(string_split(lower(p_name), ' '))) AS term, 1.0::DOUBLE AS w FROM part
    UNION ALL SELECT p_partkey, unnest(list_distinct(list_filter(string_split(regexp_replace(lower(p_brand), '[^a-z0-9]', ' ', 'g'), ' '), lambda x: x <> ''))), 0.4::DOUBLE FROM part
    UNION ALL SELECT p_partkey, unnest(list_distinct(string_split(lower(p_type), ' '))), 0.2 FROM part),
    i AS (SELECT term, p_partkey, sum(w) AS weight FROM t GROUP BY 1, 2)"""
_FIELDS = {"p_name": 1.0, "p_brand": 0.4, "p_type": 0.2}
_QUERY = ("red", "economy", "17")


@query(f"{_INDEX_SQL} SELECT p_partkey, count(*) AS n_terms, round(sum(weight), 6)::DOUBLE AS rank FROM i WHERE term IN ('red', 'economy', '17') GROUP BY 1")
def or_terms_ranked(spark, sf_dir):
    found = search.ranked_any(search.postings(parts(spark, sf_dir), "p_partkey", _FIELDS), "p_partkey", _QUERY)
    return found.withColumn("rank", F.round("rank", 6))


@query(f"{_INDEX_SQL} SELECT p_partkey, count(*) AS n_terms, round(sum(weight), 6)::DOUBLE AS rank FROM i WHERE term IN ('red', 'economy') GROUP BY 1 HAVING count(*) = 2")
def all_terms_ranked(spark, sf_dir):
    found = search.ranked_all(search.postings(parts(spark, sf_dir), "p_partkey", _FIELDS), "p_partkey", _QUERY[:2])
    return found.withColumn("rank", F.round("rank", 6))


@query(f"""{_INDEX_SQL}, a AS (SELECT p_partkey, count(*) AS n, sum(weight) AS rank FROM i WHERE term IN ('red', 'economy', '17') GROUP BY 1)
    SELECT p_partkey, CASE WHEN n = 3 THEN 'strict' ELSE 'related' END AS kind, round(CASE WHEN n = 3 THEN rank ELSE rank * 0.9 END, 6)::DOUBLE AS rank FROM a""")
def search_cascade(spark, sf_dir):
    return search.cascade(parts(spark, sf_dir), "p_partkey", _FIELDS, _QUERY).withColumn("rank", F.round("rank", 6))


@query(f"SELECT p_partkey, 'corpus' AS kind, 0.0::DOUBLE AS rank FROM part WHERE contains({_HAY_SQL}, 'idge') AND contains({_HAY_SQL}, 'conom')")
def search_cascade_corpus(spark, sf_dir):
    return search.cascade(parts(spark, sf_dir), "p_partkey", _FIELDS, ("idge", "conom"))


@query(f"SELECT p_partkey, array_to_string(list_filter(['red', 'economy', '17'], lambda w: contains({_HAY_SQL}, w)), ',') AS matched FROM part")
def token_match_summary(spark, sf_dir):
    hay = search.haystack(F.col("p_name"), F.col("p_brand"), F.col("p_type"))
    return parts(spark, sf_dir).select("p_partkey", F.array_join(search.matched_words(hay, _QUERY), ",").alias("matched"))


@query("""SELECT p_partkey, array_to_string(list_transform(string_split(lower(p_name), ' '), lambda w: CASE w WHEN 'widget' THEN 'gadget' WHEN 'rod' THEN 'bar' ELSE w END), ' ') AS prepared FROM part""")
def query_prepare_batch(spark, sf_dir):
    return parts(spark, sf_dir).select("p_partkey", F.array_join(search.prepared_column(F.col("p_name"), {"widget": "gadget", "rod": "bar"}), " ").alias("prepared"))


@query("SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2")
def adapter_facets(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))


@query("""SELECT o_orderkey, string_agg(concat_ws(' ', p_name, p_brand), ' ' ORDER BY l_linenumber, p_name, p_brand) AS document,
    arg_min(p_name, l_linenumber * 1000000 + 0) AS title, count(*) AS n_items FROM orders JOIN (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey FROM lineitem) ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey GROUP BY 1""".replace("arg_min(p_name, l_linenumber * 1000000 + 0) AS title", "first(p_name ORDER BY l_linenumber, p_name, p_brand) AS title"))
def search_document(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey").distinct()
    items = li.join(parts(spark, sf_dir), F.col("l_partkey") == F.col("p_partkey"))
    found = search.search_documents(table(spark, sf_dir, "orders").select("o_orderkey"), items, "o_orderkey", "l_linenumber", "p_name", "p_brand")
    return found.select("o_orderkey", "document", "title", F.col("n_items").cast("long").alias("n_items"))


# Scalars


@query("""SELECT o_orderkey, round(o_totalprice, 2)::DOUBLE AS money, floor(o_totalprice + 0.5)::DOUBLE AS rounded, year(o_orderdate)::INTEGER AS year FROM orders""")
def parse_money_year(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    shown = F.concat(F.lit("Asking $"), F.format_number("o_totalprice", 2), F.lit(" since "), F.year("o_orderdate").cast("string"))
    rows = o.select("o_orderkey", shown.alias("t"), F.format_number("o_totalprice", 2).alias("p"))
    return rows.select("o_orderkey", parse.money("t").alias("money"), parse.money_rounded("p").alias("rounded"), parse.year("t").alias("year"))


@query("SELECT c_custkey, floor(c_acctbal / 1000 * 1000 + 0.5)::DOUBLE AS scaled FROM customer WHERE c_acctbal >= 0".replace("c_acctbal / 1000 * 1000", "round(c_acctbal / 1000, 2) * 1000"))
def parse_money_scaled(spark, sf_dir):
    c = table(spark, sf_dir, "customer").filter("c_acctbal >= 0")
    # Rounded as the SQL does: the product's halves, not those of the shortest decimal.
    thousands = F.round(F.col("c_acctbal") / 1000 * 100, 0) / 100
    return c.select("c_custkey", parse.money_scaled(F.concat(F.lit("$"), thousands.cast("string"), F.lit("k"))).alias("scaled"))


@query("SELECT s_suppkey, n_name AS city, 'ST' AS state, n_name || ', ST' AS location FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def city_state(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    rows = s.select("s_suppkey", parse.city_state(F.concat("n_name", F.lit(", ST"))).alias("p"))
    return rows.select("s_suppkey", "p.city", "p.state", parse.location(F.col("p.city"), F.col("p.state")).alias("location"))


@query("""WITH u AS (SELECT s_suppkey, list_reduce(list_prepend(0::BIGINT, list_transform(string_split(lower(s_name), ''), lambda c: ascii(c)::BIGINT)), lambda a, c: (a * 31 + c) % 4294967296) AS u FROM supplier),
    h AS (SELECT s_suppkey, u, abs(CASE WHEN u >= 2147483648 THEN u - 4294967296 ELSE u END) AS h FROM u)
    SELECT s_suppkey, u AS hash, round((h % 100 - 50) / 50.0, 6)::DOUBLE AS lat, round((h // 256 % 100 - 50) / 50.0, 6)::DOUBLE AS lng FROM h""")
def geo_jitter(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", parse.name_hash(F.lower("s_name")).alias("hash"), parse.jitter("s_name").alias("j"))
    return rows.select("s_suppkey", "hash", F.round(F.col("j.lat").cast("double"), 6).alias("lat"), F.round(F.col("j.lng").cast("double"), 6).alias("lng"))


_STATUSES = (200, 403, 429, 503, 401)
_RESPONSES_SQL = """r AS (SELECT page_id, [200, 403, 429, 503, 401][page_id % 5 + 1] AS status, page_id % 3 AS attempt,
        CASE WHEN page_id % 7 = 0 THEN '<title>Access Denied</title> Reference #18.' || page_id WHEN page_id % 7 = 1 THEN 'please verify you are human' WHEN page_id % 7 = 2 THEN 'datadome ' || html ELSE html END AS body FROM pages),
    s AS (SELECT *, lower(substr(body, 1, 8000)) AS a, lower(substr(body, 1, 20000)) AS b, lower(substr(body, 1, 24000)) AS c FROM r),
    d AS (SELECT *, contains(b, 'access denied') AND (contains(b, 'edgesuite.net') OR contains(b, 'you don''t have permission to access') OR contains(b, 'you dont have permission to access')
        OR regexp_matches(substr(body, 1, 4000), '(?i)reference\\s*#\\s*[\\d.a-f]+')) AS hard,
        CASE WHEN status = 429 THEN 'rate_limited' WHEN status IN (401, 403) THEN 'challenge' WHEN regexp_matches(a, 'akamai|access denied|captcha|cf-browser-verification') THEN CASE WHEN status >= 400 THEN 'challenge' ELSE 'ok' END
        WHEN status >= 500 THEN 'block' ELSE 'ok' END AS waf FROM s)"""


def responses(spark, sf_dir):
    """Pages with statuses, and some bodies that are denials or challenges."""
    k = F.col("page_id")
    body = F.when(k % 7 == 0, F.concat(F.lit("<title>Access Denied</title> Reference #18."), k.cast("string"))).when(k % 7 == 1, "please verify you are human")
    body = body.when(k % 7 == 2, F.concat(F.lit("datadome "), "html")).otherwise(F.col("html"))
    status = F.element_at(F.array(*(F.lit(s) for s in _STATUSES)), (k % 5 + 1).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", status.alias("status"), (k % 3).alias("attempt"), body.alias("body"))


@query(f"""WITH {_RESPONSES_SQL} SELECT page_id, waf, CASE WHEN hard THEN 'akamai_hard_denial'
    WHEN regexp_matches(c, 'access is temporarily restricted|unusual activity from your device|captcha-delivery.com|datadome') OR contains(c, 'automated') AND contains(c, 'bot') AND contains(c, 'activity on your network')
        OR contains(c, 'please enable js') AND contains(c, 'ad blocker') THEN 'datadome_challenge'
    WHEN status IN (401, 403) AND (contains(regexp_extract(c, '<title[^>]*>([^<]{{0,120}})', 1), 'access denied') OR contains(c, 'cf-browser-verification') OR contains(c, 'just a moment')) THEN 'http_forbidden'
    WHEN length(body) < 2000 AND (status IN (401, 403) OR regexp_matches(c, 'captcha|challenge|verify you are human')) THEN 'thin_challenge_page' END AS block FROM d""")
def block_detection(spark, sf_dir):
    r = responses(spark, sf_dir)
    return r.select("page_id", pages.waf_class(F.col("status"), F.col("body")).alias("waf"), pages.page_block(F.col("status"), F.col("body")).alias("block"))


@query(f"""WITH {_RESPONSES_SQL} SELECT page_id, CASE WHEN hard THEN 'fail_hard' WHEN waf = 'ok' THEN 'ok' WHEN waf = 'rate_limited' AND attempt < 2 THEN 'retry_http' ELSE 'persist_needs_browser' END AS plan FROM d""")
def http_plan(spark, sf_dir):
    r = responses(spark, sf_dir)
    return r.select("page_id", pages.http_plan(F.col("status"), F.col("body"), F.col("attempt"), F.lit(3)).alias("plan"))


@query("""SELECT event_id, regexp_matches(message, '(?i)fetch failed|ECONNRESET|ECONNREFUSED|ETIMEDOUT|socket hang up|EPIPE|ENOTFOUND|Request was cancelled')
        OR coalesce(code IN ('UND_ERR_CONNECT_TIMEOUT', 'UND_ERR_HEADERS_TIMEOUT', 'UND_ERR_BODY_TIMEOUT', 'UND_ERR_SOCKET'), false) AS transient
    FROM (SELECT event_id, ['Fetch Failed at ', 'econnreset by ', 'no such page ', 'parse error '][event_id % 4 + 1] || event_type AS message,
                 CASE WHEN event_id % 3 = 0 THEN 'UND_ERR_SOCKET' WHEN event_id % 3 = 1 THEN 'OTHER' END AS code FROM events WHERE event_type = 'error')""")
def transient_errors(spark, sf_dir):
    said = F.array(*(F.lit(x) for x in ("Fetch Failed at ", "econnreset by ", "no such page ", "parse error ")))
    rows = table(spark, sf_dir, "events").filter("event_type = 'error'")
    message = F.concat(F.element_at(said, (F.col("event_id") % 4 + 1).cast("int")), "event_type")
    code = F.when(F.col("event_id") % 3 == 0, "UND_ERR_SOCKET").when(F.col("event_id") % 3 == 1, "OTHER")
    return rows.select("event_id", pages.transient_error(message, code).alias("transient"))


@query("""WITH p AS (SELECT page_id, coalesce(nullif(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), ''), '/') AS path FROM pages)
    SELECT page_id, path, NOT (starts_with(path, '/de/') AND NOT starts_with(path, '/de/1')) AS allowed FROM p""")
def robots_eval(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", r"^[a-z]+://[^/?#]*([^?#]*)", 1).alias("path")).withColumn("path", F.when(F.col("path") == "", "/").otherwise(F.col("path")))
    rules = spark.createDataFrame([("/", True), ("/de/", False), ("/de/1", True)], "prefix string, allow boolean")
    return pages.robots_allowed(rows, rules, "path", "page_id")


@query("""SELECT page_id, nullif(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), '') AS title,
    nullif(trim(regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '<[^>]+>', '', 'g')), '') AS heading FROM pages""")
def page_title_parse(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", pages.title(F.col("html")).alias("title"), pages.heading(F.col("html")).alias("heading"))


@query("""SELECT page_id, sha256(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style|noscript|template)[^>]*>.*?</(script|style|noscript|template)>', '', 'g'),
    '(?is)<link[^>]*rel="(preload|prefetch)"[^>]*>', '', 'g'), '(?is)<div class="ad"[^>]*>.*?</div>', '', 'g')) AS masked FROM pages""")
def mask_html(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.sha2(text.masked("html"), 256).alias("masked"))


@query(f"SELECT page_id, sha256('# ' || coalesce(nullif(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), ''), 'Listing') || chr(10) || chr(10) || 'Source: ' || url || chr(10) || chr(10) || {BODY_SQL} || chr(10)) AS markdown FROM pages")
def listing_markdown(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.sha2(pages.markdown(F.col("html"), F.col("url")), 256).alias("markdown"))


# Workspace tables


@query("""SELECT user_id, arg_max(value, ts) FILTER (value > 20) AS value, arg_max(props, ts) FILTER (event_type = 'view') AS props, count(*) AS n_rows FROM events GROUP BY 1""")
def merge_latest_non_null(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumns({"value": F.when(F.col("value") > 20, F.col("value")), "props": F.when(F.col("event_type") == "view", F.col("props"))})
    return workspace.latest_non_null(rows, "user_id", ["ts", "event_id"], "value", "props")


@query("""SELECT o_orderkey, o_custkey, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'MACHINERY' AND o_orderstatus = 'P'""")
def workspace_projects(spark, sf_dir):
    o = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select("o_orderkey", "o_custkey")
    c = table(spark, sf_dir, "customer").filter("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return o.join(c, "o_custkey").select("o_orderkey", "o_custkey", "c_mktsegment")


@query("""SELECT o_orderpriority AS bucket, o_custkey, count(*) AS n, max(o_orderdate)::VARCHAR AS last FROM orders GROUP BY 1, 2""".replace("max(o_orderdate)::VARCHAR", "CAST(CAST(max(o_orderdate) AS DATE) AS VARCHAR)"))
def dispositions_scoped(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("bucket"), "o_custkey")
    return rows.agg(F.count("*").alias("n"), F.max("o_orderdate").cast("date").cast("string").alias("last"))


@query("SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F') GROUP BY 1")
def fk_orphans(spark, sf_dir):
    parent = table(spark, sf_dir, "orders").filter("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return workspace.orphans(table(spark, sf_dir, "lineitem").select("l_orderkey"), parent, "l_orderkey").groupBy("l_orderkey").agg(F.count("*").alias("n"))


@query(f"""WITH b AS (SELECT user_id, min(ts) AS c, arg_max(value, ts) AS v FROM events WHERE ts < DATE '{_DIFF}' GROUP BY 1), n AS (SELECT user_id, min(ts) AS c, arg_max(value, ts) AS v FROM events WHERE ts >= DATE '{_DIFF}' GROUP BY 1)
    SELECT coalesce(b.user_id, n.user_id) AS user_id, epoch_us(coalesce(b.c, n.c)) AS created_us, coalesce(n.v, b.v) AS value FROM b FULL JOIN n ON b.user_id = n.user_id""")
def upsert_latest(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    cut = F.lit(_DIFF).cast("date")
    of = lambda part: part.groupBy("user_id").agg(F.min("us").alias("created_us"), F.max_by("value", F.struct("ts", "event_id")).alias("value"))
    return workspace.upserted(of(rows.filter(F.col("ts") < cut)), of(rows.filter(F.col("ts") >= cut)), ["user_id"], ["created_us"], ["value"])


@query("""SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_name ELSE p_type END AS filled, p_type AS overwritten FROM part""")
def llm_patch_fill_blanks(spark, sf_dir):
    current = F.when(F.col("p_size") % 2 == 0, F.col("p_name")).otherwise(F.lit("  "))
    return parts(spark, sf_dir).select("p_partkey", workspace.filled(current, F.col("p_type")).alias("filled"), workspace.filled(current, F.col("p_type"), overwrite=True).alias("overwritten"))


# More of the pipeline's reports and lookups


@query("SELECT p_partkey, '{\"title\":\"' || p_name || '\",\"adapter\":\"' || p_brand || '\",\"category\":\"' || p_type || '\",\"size\":' || p_size || '}' AS structured FROM part")
def structured_json(spark, sf_dir):
    fields = F.struct(F.col("p_name").alias("title"), F.col("p_brand").alias("adapter"), F.col("p_type").alias("category"), F.col("p_size").alias("size"))
    return parts(spark, sf_dir).select("p_partkey", F.to_json(fields).alias("structured"))


@query(f"""SELECT page_id, {HOST_SQL} AS host, max(CASE WHEN starts_with({HOST_SQL}, 'm.') THEN 1 ELSE 0 END) OVER (PARTITION BY {BARE_SQL}) = 1 AS needs_browser FROM pages""")
def domain_profile_lookup(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select("page_id", urls.host("url").alias("host"), urls.bare_host("url").alias("bare"))
    profiles = rows.groupBy("bare").agg(F.bool_or(F.col("host").startswith("m.")).alias("needs_browser"))
    return rows.join(profiles, "bare", "left").select("page_id", "host", "needs_browser")


@query("SELECT page_id, regexp_replace(url, '^(https?://)m\\.', '\\1www.') AS url FROM pages")
def mobile_to_desktop(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.desktop("url").alias("url"))


@query(f"""SELECT {BARE_SQL} AS host, max(coalesce(TRY_CAST(nullif(regexp_extract(url, '[?&]page=([0-9]+)', 1), '') AS BIGINT), 1)) AS max_page, count(*) AS n FROM pages GROUP BY 1""")
def max_page_per_host(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select(urls.bare_host("url").alias("host"), urls.page_number("url").alias("page"))
    return rows.groupBy("host").agg(F.max("page").alias("max_page"), F.count("*").alias("n"))


@query("SELECT c_custkey, regexp_replace(regexp_replace(lower(c_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM customer")
def name_slugs(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", text.slug("c_name").alias("slug"))


@query(f"""WITH l AS (SELECT user_id, arg_max({STATUS_SQL}, ts) AS status, arg_max(value, ts) AS value FROM events GROUP BY 1), f AS (SELECT user_id, value > 50 AS hard FROM l WHERE status = 'failed'),
    r AS (SELECT user_id, min(event_id) AS seq FROM events WHERE event_type = 'signup' GROUP BY 1)
    SELECT user_id, seq, CASE WHEN hard IS NULL THEN 1 WHEN hard THEN 2 ELSE 0 END AS bucket FROM r LEFT JOIN f USING (user_id)""")
def ingest_order_retries_first(spark, sf_dir):
    rows = events(spark, sf_dir)
    failed = state.latest(rows, ["user_id"], ["ts", "event_id"], "status", "value").filter("status = 'failed'").select("user_id", (F.col("value") > 50).alias("hard"))
    refs = rows.filter("status = 'discovered'").groupBy("user_id").agg(F.min("event_id").alias("seq"))
    return state.ingest_order(refs, failed, "user_id", "seq", retry_first=True)


@query(f"""{_INDEX_SQL}, a AS (SELECT p_partkey, count(*) AS n, round(sum(weight) * 0.9, 6) AS rank FROM i WHERE term IN ('red', 'economy', '17') GROUP BY 1),
    top AS (SELECT * FROM a ORDER BY rank DESC, p_partkey LIMIT 100) SELECT p_partkey, rank::DOUBLE AS rank FROM top WHERE n < 3""")
def related_after_limit(spark, sf_dir):
    """The strict hits are taken out of the related ones after the limit, which is the report's length."""
    index = search.postings(parts(spark, sf_dir), "p_partkey", _FIELDS)
    ranked = search.ranked_any(index, "p_partkey", _QUERY).withColumn("rank", F.round(F.col("rank") * search.RELATED_WEIGHT, 6))
    top = ranked.orderBy(F.desc("rank"), "p_partkey").limit(100)
    return top.join(search.ranked_all(index, "p_partkey", _QUERY).select("p_partkey"), "p_partkey", "left_anti").select("p_partkey", "rank")


@query("""SELECT event_type, sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS k, count(*) AS n, count(*) FILTER (CAST(json_extract(props, '$.k') AS BIGINT) >= 50) AS n_high FROM events GROUP BY 1""")
def lenient_json_fields(spark, sf_dir):
    k = F.coalesce(F.get_json_object("props", "$.k"), F.regexp_extract("props", r'"k"\s*:\s*([0-9]+)', 1)).try_cast("long")
    rows = table(spark, sf_dir, "events").select("event_type", k.alias("k"))
    return rows.groupBy("event_type").agg(F.sum("k").alias("k"), F.count("*").alias("n"), F.count_if(F.col("k") >= 50).alias("n_high"))


@query("""SELECT o_orderkey, o_custkey, n_name AS place, coalesce(nullif(c_mktsegment, 'MACHINERY'), n_name) AS contact, c_acctbal < 0 AS sold
    FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey""")
def profile_enrichment(spark, sf_dir):
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    rows = o.select("o_orderkey", "o_custkey").join(c, F.col("o_custkey") == c.c_custkey, "left").join(n, F.col("c_nationkey") == n.n_nationkey, "left")
    contact = workspace.filled(F.when(F.col("c_mktsegment") != "MACHINERY", F.col("c_mktsegment")), F.col("n_name"))
    return rows.select("o_orderkey", "o_custkey", F.col("n_name").alias("place"), contact.alias("contact"), (F.col("c_acctbal") < 0).alias("sold"))


@query("""SELECT p_type, p_brand, count(*) AS n, grouping(p_brand) AS all_brands FROM part GROUP BY ROLLUP (p_type, p_brand)""")
def facet_rollup(spark, sf_dir):
    return parts(spark, sf_dir).rollup("p_type", "p_brand").agg(F.count("*").alias("n"), F.grouping("p_brand").cast("long").alias("all_brands"))


@query(f"""WITH e AS (SELECT user_id, ts, {STATUS_SQL} AS status FROM events)
    SELECT count(*) FILTER (status = 'failed') AS failures, count(DISTINCT user_id) FILTER (status = 'failed') AS listings,
           count(DISTINCT user_id) FILTER (status IN ('ingested', 'skipped_known', 'skipped_fresh')) AS satisfied FROM e""")
def run_totals(spark, sf_dir):
    e = events(spark, sf_dir)
    per = e.groupBy("user_id").agg(F.count_if(F.col("status") == "failed").alias("f"), F.bool_or(F.col("status").isin(*state.SATISFIED)).alias("s"))
    return per.agg(F.sum("f").alias("failures"), F.count_if(F.col("f") > 0).alias("listings"), F.count_if("s").alias("satisfied"))


@query("""SELECT doc_id, source FROM documents WHERE source IN ('src1', 'src2') AND lang = 'en' AND contains(lower(text), 'tion')""")
def filter_by_source(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").filter(F.col("source").isin("src1", "src2") & (F.col("lang") == "en"))
    return rows.filter(search.matches_all(F.lower("text"), ("tion",))).select("doc_id", "source")
