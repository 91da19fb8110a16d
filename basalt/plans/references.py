"""Queries over references, ingest states and contacts, each with its SQL; they join those of the catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from basalt.functions import contact, urls
from basalt.operators import discovery, ingest, references, resolution, state
from basalt.plans.catalogue import _DIFF, _NOW, _PAIRS_SQL, BARE_SQL, HOST_SQL, ID_SQL, LINKS_SQL, STATUS_SQL, events, named, parts, query, scored
from basalt.sources.tables import table

_DONE = "('ingested', 'skipped_known', 'skipped_fresh')"


def text(x):
    return F.col(x).cast("string") if isinstance(x, str) else x.cast("string")


# References


@query("""SELECT p_partkey, 0 AS seq, 'https://a.example/l/' || (p_partkey + 1000000) AS url, CAST(p_size AS VARCHAR) AS external_id FROM part
    UNION ALL SELECT p_partkey, 1, 'https://a.example/m/' || (p_partkey + 2000000) || '/x', CAST(p_partkey + 2000000 AS VARCHAR) FROM part""")
def linked_data_refs(spark, sf_dir):
    """Each record is shown as a page with a list of three items: one with a product id, one by its address, one with neither."""
    k = F.col("p_partkey")
    first = F.to_json(F.struct(F.struct(F.concat(F.lit("https://a.example/l/"), text(k + 1_000_000)).alias("url"), F.col("p_size").alias("productId")).alias("item")))
    second = F.to_json(F.struct(F.concat(F.lit("https://a.example/m/"), text(k + 2_000_000), F.lit("/x")).alias("@id"), F.lit("Product").alias("@type")))
    third = F.lit('{"url":"https://a.example/about"}')
    html = F.concat(F.lit('<html><script type="application/ld+json">{"@type":"ItemList","itemListElement":['), F.concat_ws(",", first, second, third, second), F.lit("]}</script><script type='application/ld+json'>{broken</script>"))
    return parts(spark, sf_dir).select("p_partkey", F.posexplode(references.linked_data_refs(html)).alias("seq", "r")).select("p_partkey", "seq", "r.url", "r.external_id")


@query("""SELECT page_id, generate_subscripts(a, 1) AS position, unnest(a) AS link FROM (SELECT page_id, regexp_extract_all(html, '<a\\s[^>]*href="([^"]*)"', 1) AS a FROM pages)""")
def search_result_refs(spark, sf_dir):
    results = F.transform(urls.links("html"), lambda x: F.struct(x.alias("link"), F.lit("t").alias("title")))
    rows = table(spark, sf_dir, "pages").select("page_id", F.to_json(F.struct(results.alias("organic"), F.lit(1).alias("credits"))).alias("body"))
    found = rows.select("page_id", F.posexplode(references.search_results(F.col("body"))).alias("at", "r"))
    return found.select("page_id", (F.col("at") + 1).alias("position"), "r.link")


@query("""SELECT DISTINCT page_id, upper(regexp_extract(url, '^https?://[^/]+/([a-z]+)/([0-9]+)', 1)) AS state, regexp_extract(url, '^https?://[^/]+/([a-z]+)/([0-9]+)', 2) AS city
    FROM pages WHERE regexp_matches(url, '^https?://[^/]+/[a-z]+/[0-9]+')""")
def sitemap_offices(spark, sf_dir):
    xml = F.concat(F.lit("<urlset><url><loc> "), "url", F.lit(" </loc></url><url><LOC>"), "url", F.lit("</LOC></url></urlset>"))
    rows = table(spark, sf_dir, "pages").select("page_id", F.explode(references.sitemap(xml)).alias("u"))
    office = r"^https?://[^/]+/([a-z]+)/([0-9]+)"
    return rows.filter(F.col("u").rlike(office)).select("page_id", F.upper(F.regexp_extract("u", office, 1)).alias("state"), F.regexp_extract("u", office, 2).alias("city")).distinct()


@query(f"""WITH l AS ({LINKS_SQL}), u AS (SELECT url, page_id * 1000000 AS place FROM pages UNION ALL SELECT link, 1000000000000000 + page_id * 1000000 + seq FROM l)
    SELECT coalesce('id:' || {ID_SQL}, 'url:' || url) AS key, arg_min(url, place) AS url FROM u GROUP BY 1""")
def merged_refs(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    own = pages.select("url", F.lit(None).cast("string").alias("external_id"), "page_id", F.lit(0).alias("seq"))
    walked = discovery.page_links(pages).select(F.col("link").alias("url"), F.lit("").alias("external_id"), "page_id", F.col("seq").cast("int").alias("seq"))
    return references.merged([own, walked], ["page_id", "seq"])


@query(f"""SELECT page_id, {BARE_SQL.replace("(www|m)", "(www)")} AS host, regexp_matches({HOST_SQL}, '(^|\\.)example\\.com$') AS marketplace,
    coalesce(regexp_extract({HOST_SQL}, '([^.]+\\.[^.]+)$', 1) = 'example.org' OR regexp_replace({HOST_SQL}, '^www\\.', '') = 'm.tionsh.example.net', false) AS allowed FROM pages""")
def crawl_hosts(spark, sf_dir):
    host = urls.host("url")
    allowed = ingest.crawl_allowed(host, ["example.org", "m.tionsh.example.net"])
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_replace(host, r"^www\.", "").alias("host"), ingest.of_hosts(host, ["example.com"]).alias("marketplace"), allowed.alias("allowed"))


# Ingest and its states


@query(f"""WITH RECURSIVE {_PAIRS_SQL[5:]}, m AS (SELECT r, l, round(0.45 * lexical + 0.25 * numeric + 0.3 * geo, 6) AS score FROM p),
    n AS (SELECT f.p_brand, f.seq, row_number() OVER (PARTITION BY f.p_brand ORDER BY f.seq) AS i, coalesce(list(m.l ORDER BY m.score DESC, m.l) FILTER (m.l IS NOT NULL), []) AS earlier
          FROM f LEFT JOIN m ON m.r = f.seq AND m.score >= 0.85 GROUP BY f.p_brand, f.seq),
    g(p_brand, i, reps, seq, canonical) AS (
        SELECT DISTINCT p_brand, 0::BIGINT, []::BIGINT[], NULL::BIGINT, NULL::BIGINT FROM f
        UNION ALL SELECT p_brand, i, CASE WHEN hit IS NULL THEN list_append(reps, seq) ELSE reps END, seq, coalesce(hit, seq)
        FROM (SELECT g.p_brand, n.i, g.reps, n.seq, list_filter(n.earlier, lambda x: list_contains(g.reps, x))[1] AS hit FROM g JOIN n ON n.p_brand = g.p_brand AND n.i = g.i + 1))
    SELECT seq, canonical, CASE WHEN seq = canonical THEN 'new' ELSE 'merged' END AS action FROM g WHERE seq IS NOT NULL""")
def record_ingest(spark, sf_dir):
    """Records against representatives of their brand. A merge needs a title Jaccard of two thirds, which the blocking at 0.3 keeps."""
    pairs = scored(spark, sf_dir).select(F.col("l_seq").alias("l"), F.col("r_seq").alias("r"), F.round("score", 6).alias("score"))
    return ingest.ingested(named(spark, sf_dir), pairs)


def _latest(spark, sf_dir):
    return state.latest(events(spark, sf_dir), ["user_id"], ["ts", "event_id"], "status", "ts", "event_id")


@query(f"""WITH l AS (SELECT user_id, arg_max({STATUS_SQL}, ts) AS status, max(ts) AS seen FROM events GROUP BY 1)
    SELECT user_id, CASE WHEN status IN {_DONE} AND epoch_us(TIMESTAMP '{_NOW}') - epoch_us(seen) < 259200000000 THEN 'skipped_fresh' END AS skip, CASE WHEN status IN {_DONE} THEN 'skipped_known' END AS skip_known FROM l""")
def skip_by_state(spark, sf_dir):
    now, at = F.lit(_NOW).cast("timestamp"), F.col("ts").cast("timestamp")
    fresh, known = ingest.skip(F.col("status"), at, now, 72), ingest.skip(F.col("status"), at, now, 72, skip_known=True, retry_failures=True)
    return _latest(spark, sf_dir).select("user_id", fresh.alias("skip"), known.alias("skip_known"))


@query(f"SELECT user_id, arg_max(event_id, ts) AS event_id, 1::BIGINT AS attempts FROM events GROUP BY 1 HAVING arg_max({STATUS_SQL}, ts) = 'failed'")
def failures_from_states(spark, sf_dir):
    return ingest.failures(_latest(spark, sf_dir), "user_id", "event_id")


@query(f"""WITH a AS (SELECT user_id, arg_max({STATUS_SQL}, ts) AS status FROM events WHERE ts < DATE '{_DIFF}' GROUP BY 1), b AS (SELECT user_id, arg_max({STATUS_SQL}, ts) AS status FROM events WHERE ts >= DATE '{_DIFF}' GROUP BY 1)
    SELECT coalesce(a.user_id, b.user_id) AS user_id, CASE WHEN a.user_id IS NULL THEN 1 ELSE 0 END AS store, coalesce(a.status, b.status) AS status FROM a FULL JOIN b ON a.user_id = b.user_id""")
def composite_states(spark, sf_dir):
    rows, cut = events(spark, sf_dir), F.lit(_DIFF).cast("date")
    stores = [state.latest(rows.filter(x), ["user_id"], ["ts", "event_id"], "status") for x in (F.col("ts") < cut, F.col("ts") >= cut)]
    return ingest.composite(stores, "user_id", "status")


@query("""SELECT event_id, 'a' || user_id AS key, event_type AS adapter, event_id % 5 AS attempts FROM events WHERE event_type = 'error'
    UNION ALL SELECT event_id, 'b' || user_id, event_type, 1 FROM events WHERE event_type = 'error'""")
def failure_collection(spark, sf_dir):
    def value(adapter, n):
        return F.struct(adapter.alias("adapter"), n.cast("long").alias("attempts"))

    kind = F.col("event_type")
    both = F.create_map(F.concat(F.lit("a"), text("user_id")), value(kind, F.col("event_id") % 5), F.concat(F.lit("b"), text("user_id")), value(kind, F.lit(1)))
    rows = table(spark, sf_dir, "events").select("event_id", F.to_json(both).alias("body"))
    found = rows.select("event_id", F.explode(ingest.failure_entries(F.col("body"))).alias("x")).select("event_id", "x.key", "x.value.adapter", "x.value.attempts")
    return found.filter("adapter = 'error'")


@query("SELECT o_custkey, max(o_orderkey) + 1 AS next_run FROM orders GROUP BY 1")
def next_run_id(spark, sf_dir):
    return ingest.next_run(table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey")


@query(f"""WITH l AS (SELECT user_id, arg_max({STATUS_SQL}, ts) AS status FROM events GROUP BY 1), r AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'signup')
    SELECT count(*) AS n_refs, count(*) FILTER (status IN {_DONE}) AS n_satisfied FROM r LEFT JOIN l USING (user_id)""")
def satisfied_refs(spark, sf_dir):
    refs = events(spark, sf_dir).filter("status = 'discovered'").select("user_id").distinct()
    return ingest.satisfied_refs(refs, _latest(spark, sf_dir).select("user_id", "status"), "user_id")


# Records


@query("""SELECT p_partkey, (p_size % 2 = 1 AND p_size % 3 <> 0) OR p_size >= 40 OR (p_retailprice > 950 AND p_size % 5 <> 0) AS gaps FROM part""")
def enrich_gaps(spark, sf_dir):
    size = F.col("p_size")
    gaps = ingest.enrich_gaps(
        F.when(size % 2 == 0, F.col("p_type")).otherwise("  "), F.when(size % 3 == 0, F.array("p_brand")), F.when(size < 40, text("p_size")), F.col("p_name"),
        [(F.when(F.col("p_retailprice") > 950, "stock"), F.when(size % 5 == 0, F.lit(True))), (F.lit(None).cast("string"), F.lit(None).cast("boolean"))],
    )
    return parts(spark, sf_dir).select("p_partkey", gaps.alias("gaps"))


@query("""WITH s AS (SELECT o_orderkey, l_linenumber::BIGINT * 1000000000 + l_partkey AS place, CASE WHEN p_size % 2 = 0 THEN p_name END AS title, CASE WHEN p_size % 3 > 0 THEN p_retailprice END AS price
        FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey FROM lineitem) ON l_orderkey = o_orderkey LEFT JOIN part ON p_partkey = l_partkey),
    r AS (SELECT *, place = max(place) OVER (PARTITION BY o_orderkey) AS rep FROM s)
    SELECT o_orderkey, coalesce(max(title) FILTER (rep), arg_min(title, place)) AS title, arg_min(price, place) AS price, count(place) AS n_sources FROM r GROUP BY 1""")
def deal_view(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey").distinct()
    items = items.join(parts(spark, sf_dir), F.col("l_partkey") == F.col("p_partkey"), "left")
    at = (F.col("l_linenumber").cast("long") * 1_000_000_000 + F.col("l_partkey")).alias("at")
    items = items.select("o_orderkey", at, F.when(F.col("p_size") % 2 == 0, F.col("p_name")).otherwise("").alias("title"), F.when(F.col("p_size") % 3 > 0, F.col("p_retailprice")).alias("price"))
    reps = items.groupBy("o_orderkey").agg(F.max("at").alias("_rep"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey").join(items.join(reps, "o_orderkey"), "o_orderkey", "left").withColumn("rep", F.col("at") == F.col("_rep"))
    return ingest.deal_view(rows, "o_orderkey", "at", "rep", "title", "price")


@query("""SELECT p_partkey, concat_ws(chr(10), 'title: ' || p_name, CASE WHEN p_size % 2 = 0 THEN 'type: ' || p_type END, 'size: ' || p_size) AS summary,
    array_to_string(list_filter(string_split(p_name || ' ' || regexp_replace(p_brand, '[^a-zA-Z0-9]', '', 'g'), ' '), lambda w: w <> ''), ' | ') AS clause FROM part""")
def record_summary(spark, sf_dir):
    lines = contact.summary({"title": F.col("p_name"), "type": F.when(F.col("p_size") % 2 == 0, F.col("p_type")).otherwise(" "), "size": F.col("p_size")})
    return parts(spark, sf_dir).select("p_partkey", lines.alias("summary"), contact.or_clause(F.concat("p_name", F.lit(" | "), "p_brand")).alias("clause"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN '—' ELSE CASE WHEN c_acctbal < 0 THEN '-' ELSE '' END || '$' || format('{:,}', CAST(abs(round(c_acctbal)) AS BIGINT)) END AS money,
    CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE floor(abs(c_acctbal) + 0.5) END::DOUBLE AS parsed FROM customer""")
def money_shown(spark, sf_dir):
    balance = F.col("c_acctbal")
    shown = contact.shown_money(F.when(F.col("c_custkey") % 7 != 0, balance))
    said = F.when(F.col("c_custkey") % 5 == 0, "Price on Request: $5").otherwise(F.concat(F.lit("$"), F.format_number(F.abs(balance), 2)))
    return table(spark, sf_dir, "customer").select("c_custkey", shown.alias("money"), contact.money_on_request(said).alias("parsed"))


@query("""WITH e AS (SELECT event_id, CAST(round(value * 100) AS BIGINT) * (CASE event_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 5 ELSE 30 END) AS ms FROM events WHERE value IS NOT NULL)
    SELECT event_id, CASE WHEN ms < 1000 THEN ms || 'ms' WHEN ms < 60000 THEN ((ms + 50) // 100 // 10) || '.' || ((ms + 50) // 100 % 10) || 's'
        ELSE (ms // 60000) || 'm' || CASE WHEN ms // 1000 % 60 > 0 THEN ' ' || (ms // 1000 % 60) || 's' ELSE '' END END AS took FROM e""")
def duration_shown(spark, sf_dir):
    k = F.col("event_id") % 3
    ms = F.round(F.col("value") * 100).cast("long") * F.when(k == 0, 1).when(k == 1, 5).otherwise(30)
    return table(spark, sf_dir, "events").filter("value IS NOT NULL").select("event_id", contact.shown_duration(ms).alias("took"))


@query("""SELECT c_custkey, c_custkey % 3 = 2 AS internal, lpad(CAST(c_custkey * 7919 AS VARCHAR), 7 + c_custkey % 6, '5') AS phone, c_custkey % 6 IN (3, 4) AS plausible,
    CASE WHEN c_custkey % 4 < 3 THEN c_name END AS name, ['US', 'US', 'CA', 'GB', 'DE', NULL][c_custkey % 6 + 1] AS country FROM customer WHERE c_custkey < 1000000""".replace(" WHERE c_custkey < 1000000", "").replace("7 + c_custkey % 6", "CAST(7 + c_custkey % 6 AS INTEGER)"))
def contact_fields(spark, sf_dir):
    k = F.col("c_custkey")
    user = F.when(k % 3 == 0, F.concat(F.lit("u"), text(k), F.lit("@example.com"))).when(k % 3 == 1, "  ").otherwise(F.col("c_name"))
    phone = F.lpad(text(k * 7919), (7 + k % 6).cast("int"), F.lit("5"))
    raw = F.when(k % 4 == 0, F.concat(F.lit("Business Listed By:  "), "c_name", F.lit("\n<script>x"))).when(k % 4 == 1, F.concat(F.lit("listed by "), "c_name", F.lit(" Phone Number")))
    raw = raw.when(k % 4 == 2, F.concat(F.lit("business "), "c_name", F.lit("$(function () {}"))).otherwise(F.concat("c_name", F.lit(" Contact form")))
    countries = F.array(*(F.lit(x) for x in ("usa", " United States", "canada", "UK", "deu", "  ")))
    number = contact.telephone(F.concat(F.lit("TEL: "), phone))
    return table(spark, sf_dir, "customer").select(
        "c_custkey", contact.internal_user(user).alias("internal"), number.alias("phone"), contact.plausible_phone(number).alias("plausible"),
        contact.person(raw).alias("name"), contact.country_code(F.element_at(countries, (k % 6 + 1).cast("int"))).alias("country"),
    )
