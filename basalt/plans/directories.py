"""Queries over brokers' directories and catalogue walks, each with its SQL; they join those of the catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from basalt.functions import markup
from basalt.operators import directories, walks
from basalt.plans.catalogue import query
from basalt.plans.listings import number, text
from basalt.sources.shared import settled
from basalt.sources.tables import table


@query("""SELECT 'https://www.ibba.org/broker-profile/' || CASE WHEN s_nationkey % 2 = 0 THEN 'nevada' ELSE 'nv' END || '/town-' || s_nationkey || '/' || replace(lower(s_name), '#', '-') || '/' AS profile_url, s_name AS name, CAST(s_suppkey AS VARCHAR) AS external_id,
    'NV' AS state, 'Town ' || s_nationkey AS city, 'US' AS country, 'b' || s_suppkey || '.example' AS website, CASE s_suppkey % 3 WHEN 0 THEN 'CBI,MCBI' WHEN 1 THEN 'M&AMI' END AS designations FROM supplier""")
def association_records(spark, sf_dir):
    """Suppliers as an association's list of records: made profile addresses, certificates, web sites, countries by name."""
    k = F.col("s_suppkey")
    record = F.struct(
        number(k).alias("id"), F.col("s_name").alias("first_name"), F.lit("").alias("last_name"), F.concat(F.lit(" Town "), number(F.col("s_nationkey"))).alias("city"), F.when(F.col("s_nationkey") % 2 == 0, "Nevada").alias("state"), F.lit("NV").alias("state_code"),
        F.lit("united states").alias("country"), text("https://WWW.b", number(k), ".example/about").alias("website"), F.when(k % 3 == 0, F.lit(1)).otherwise(F.lit(0)).alias("cbi_cert"), F.when(k % 3 == 1, "1").alias("mami_cert"), F.when(k % 3 == 0, "1").otherwise("0").alias("master_cert"),
    )
    rows = table(spark, sf_dir, "supplier").select(F.explode(directories.of_all(F.to_json(F.array(record)))).alias("r")).select("r.*")
    return rows.select("profile_url", "name", "external_id", "state", "city", "country", "website", F.array_join("designations", ",").alias("designations"))


@query("""SELECT 'https://p.example/' || s_suppkey AS profile_url, s_name || ' of ' || s_nationkey AS name, CASE WHEN s_suppkey % 2 = 0 THEN 'Firm ' || s_nationkey ELSE 'first firm' END AS firm, 'NV' AS state, CASE WHEN s_suppkey % 2 = 0 THEN 'MCBI' END AS designations FROM supplier""")
def directories_merged(spark, sf_dir):
    """The same suppliers out of a search and of a map: the later one renews what it has, and empties nothing."""
    k = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier").withColumn("link", text("https://p.example/", number(k)))
    post = F.struct(F.array(F.col("s_name")).alias("first_name"), F.array(text("of ", number(F.col("s_nationkey")))).alias("last_name"), F.array(F.lit("first firm")).alias("company"), F.array(F.lit("NV")).alias("state"), F.col("link").alias("permalink"))
    detail = F.struct(F.col("link").alias("url"), text(F.col("s_name"), " of  ", number(F.col("s_nationkey"))).alias("name"), F.when(k % 2 == 0, text("Firm ", number(F.col("s_nationkey")))).alias("company"), F.when(k % 2 == 0, "1").alias("master_cbi"))
    nowhere = F.struct(F.lit("").alias("url"), F.lit("x").alias("name"), F.lit("y").alias("company"), F.lit("1").alias("master_cbi"))
    searched = rows.select(F.lit(0).alias("at"), F.explode(directories.of_search(F.to_json(F.struct(F.array(post).alias("posts"))))).alias("r"))
    mapped = rows.select(F.lit(1).alias("at"), F.explode(directories.of_map(F.to_json(F.struct(F.array(F.struct(detail.alias("details")), F.struct(nowhere.alias("details"))).alias("features"))))).alias("r"))
    found = directories.merged(searched.unionByName(mapped).select("at", "r.*"), ["at"])
    return found.select("profile_url", "name", "firm", "state", F.array_join("designations", ",").alias("designations"))


@query("""SELECT page_id, lpad(CAST(page_id AS VARCHAR), 8, '0') AS external_id, s_name AS name, 'Firm ' || s_nationkey AS firm, 'Reno' AS city, 'town-' || page_id AS office FROM pages JOIN supplier ON page_id % 10 = s_suppkey""")
def licences_and_offices(spark, sf_dir):
    """A licence table and links to offices within real pages."""
    pages = table(spark, sf_dir, "pages").join(table(spark, sf_dir, "supplier"), F.col("page_id") % 10 == F.col("s_suppkey"))
    block = text(
        "<table><tr><th>Name<th>Firm<tr><td><a href='/publicasp/ppldetail.asp?id=1'>", F.col("s_name"), "</a><td>Firm ", number(F.col("s_nationkey")), "<td>Reno, NV<td>", F.lpad(number(F.col("page_id")), 8, "0"), "</table><a href='/town-", number(F.col("page_id")), "/'>An office</a><a href='/blog/'>no</a>"
    )
    at = F.instr("html", "<article>") + 8
    made = pages.select("page_id", F.concat(F.expr("left(html, instr(html, '<article>') + 8)"), block, F.substring("html", at + 1, F.length("html"))).alias("html"))
    dom = markup.with_dom(made)
    found = dom.select("page_id", F.get(directories.licences(F.col("dom"), "CA"), F.lit(0)).alias("l"), F.get(directories.offices(F.col("dom"), F.lit("https://www.sunbeltnetwork.com/locations/")), F.lit(0)).alias("o"))
    return found.select("page_id", "l.external_id", "l.name", "l.firm", "l.city", F.col("o.external_id").alias("office"))


#: Pages of ten orders each, by customers' remainder; every seventh page leads nowhere, some keys come again.
_WALK = """WITH o AS (SELECT o_orderkey, o_custkey % 5 AS walk, row_number() OVER (PARTITION BY o_custkey % 5 ORDER BY o_orderkey) - 1 AS n FROM orders),
    r AS (SELECT walk, n // 10 AS page, n % 10 AS at, CASE WHEN (n // 10) % 4 = 3 THEN n - 10 ELSE n END AS key FROM o),
    f AS (SELECT walk, key, min(page) AS page FROM r WHERE page < 30 GROUP BY 1, 2),
    p AS (SELECT r.walk, r.page, count(DISTINCT r.key) AS n_refs, count(DISTINCT CASE WHEN f.page = r.page THEN r.key END) AS n_new FROM r JOIN f USING (walk, key) WHERE r.page < 30 GROUP BY 1, 2)"""


@query(f"""{_WALK} SELECT CAST(walk AS VARCHAR) AS walk, CAST(page AS BIGINT) AS position, n_refs, n_new, CASE WHEN page = max(page) OVER (PARTITION BY walk) THEN CASE WHEN page = 29 THEN 'pages' ELSE 'end' END END AS reason FROM p""")
def catalog_walks(spark, sf_dir):
    """Walks over pages of orders: every fourth page repeats the one before, and a walk ends after 30 pages or at its last."""
    from pyspark.sql import Window

    by = Window.partitionBy("walk").orderBy("o_orderkey")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", number(F.col("o_custkey") % 5).alias("walk")).withColumn("n", F.row_number().over(by) - 1)
    page = F.floor(F.col("n") / 10)
    key = number(F.when(page % 4 == 3, F.col("n") - 10).otherwise(F.col("n")))
    refs = rows.select("walk", page.alias("p"), F.struct(key.alias("key"), text("https://a.example/", key).alias("url")).alias("r"))
    pages = refs.groupBy("walk", "p").agg(F.array_sort(F.collect_list("r")).alias("refs"))
    pages = settled(pages.select("walk", number(F.col("p")).alias("page"), number(F.col("p") + 1).alias("next"), "refs", F.lit(None).cast("string").alias("blocked")))
    kept, _ = walks.walked(pages, pages.select("walk").distinct().withColumn("page", F.lit("0")), most_pages=30)
    return kept.select("walk", "position", "n_refs", "n_new", "reason")
