"""Queries over whole pages, linked data and sites' address rules, each with its SQL; they join those of the catalogue.

The pages are those of ``pages``, with their open paragraphs and scripts. A listing's block, made of a record's columns,
stands in the page's article, where a shape needs one.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from basalt.functions import markup, url_rules
from basalt.operators import linked_data, listing_pages
from basalt.plans.catalogue import query
from basalt.sources.tables import spread, table

_ENTITIES = "regexp_replace(regexp_replace(regexp_replace(regexp_replace({}, '&copy;', '©', 'g'), '&middot;', '·', 'g'), '&quot;?', '\"', 'g'), '&amp;?', '&', 'g')"


def _shown(x: str) -> str:
    """An element's text in SQL: tags out, entities decoded."""
    return _ENTITIES.format(f"regexp_replace({x}, '<[^>]+>', '', 'g')")


_H1 = "regexp_replace(" + _shown("regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)") + ", '^\\s+|\\s+$', '', 'g')"


def money(x):
    return F.concat(F.lit("$"), F.format_number(x, 2))


def listed(spark, sf_dir, block, link):
    """Pages with a record and a broker each, whose ``block`` stands in the article, at the address ``link``."""
    pages = table(spark, sf_dir, "pages").join(table(spark, sf_dir, "part"), F.col("page_id") == F.col("p_partkey")).join(table(spark, sf_dir, "supplier"), F.col("page_id") % 10 == F.col("s_suppkey"))
    pages = spread(pages)  # before the block goes in, as that costs more than reading the page
    # The block goes in by position, as it may hold what a replacement would read as a group.
    at = F.instr("html", "<article>") + 8
    html = F.concat(F.expr("left(html, instr(html, '<article>') + 8)"), block, F.substring("html", at + 1, F.length("html")))
    return pages.select("page_id", link.alias("url"), html.alias("html"))


def text(*parts):
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def number(x):
    return x.cast("string")


def listing_number():
    return F.col("page_id") + 1_000_000


_RECORD_SQL = "FROM pages JOIN part ON page_id = p_partkey JOIN supplier ON page_id % 10 = s_suppkey"


@query(f"""SELECT page_id, len(regexp_extract_all(html, '<[a-z]')) AS n_elements, len(regexp_extract_all(html, '<p[ >]')) AS n_paragraphs, len(regexp_extract_all(html, '<a ')) AS n_links,
    nullif({_H1}, '') AS heading, sha256(regexp_replace({_shown("regexp_extract(html, '(?s)<article>(.*?)</article>', 1)")}, '\\s+', ' ', 'g')) AS article_sha256,
    {_shown("regexp_extract(html, '(?s)<footer>(.*?)</footer>', 1)")} AS footer, {_shown("regexp_extract(html, '(?s)<li>(.*?)</li>', 1)")} AS first_item FROM pages""")
def page_outline(spark, sf_dir):
    """Every page as a tree: counts, heading, the article's text, the footer, the first item of the navigation."""
    dom = F.col("dom")
    each = dom["elements"]

    def one(selector):
        return markup.text(dom, markup.first(markup.select(each, selector)))

    return markup.with_dom(table(spark, sf_dir, "pages").select("page_id", "html")).select(
        "page_id", F.size(each).cast("long").alias("n_elements"), F.size(markup.select(each, "p")).cast("long").alias("n_paragraphs"), F.size(markup.select(each, "nav a[href]")).cast("long").alias("n_links"),
        markup.filled(markup.trimmed(one("article h1"))).alias("heading"), F.sha2(F.regexp_replace(one("article"), r"\s+", " "), 256).alias("article_sha256"), one("footer").alias("footer"), one("nav ul li").alias("first_item"),
    )


@query(f"""SELECT page_id, CAST(page_id + 1000000 AS VARCHAR) AS listing_id, nullif({_H1}, '') AS title, round(p_retailprice, 2) AS asking_price, CAST(1950 + p_size AS INTEGER) AS year_established,
    p_size || ' Full-time | ' || p_type AS employees, 'Included' AS inventory_note, p_brand AS colour, 'Town ' || p_size AS city, 'NV' AS state, 'Listed as ' || p_type AS industry, s_name AS broker,
    '510555' || lpad(CAST(page_id % 10000 AS VARCHAR), 4, '0') AS phone, 'b' || s_suppkey || '@x.example' AS email, 'https://www.bizbuysell.com/business-broker/b/firm/' || s_suppkey || '/' AS profile {_RECORD_SQL}""")
def listing_market(spark, sf_dir):
    p = F.col("p_size")
    crumbs = F.to_json(F.struct(F.lit("BreadcrumbList").alias("@type"), F.array(F.struct(F.struct(text("Listed as ", F.col("p_type")).alias("name")).alias("item"))).alias("itemListElement")))
    block = text(
        '<script type="application/ld+json">', crumbs, '</script><p class="dt-grid-2 m-listing-row"><span class="title">Asking Price:</span><span class="price">', money(F.col("p_retailprice")), '<i class="help">before $1 of tax</i></span>',
        '<p class="m-listing-row"><span class="title"> Established:</span><span class="normal">in ', number(p + 1950), '</span></p><dl id="dlDetailedInformation"><dt><span class="normal">Employees:</span><dd>', number(p), " Full-time<br>",
        F.col("p_type"), "<dt>Inventory:</dt><dd>$1,000<br>Included in asking price</dd><dt>Colour:<dd><p>", F.col("p_brand"), '</dl><dl id="dlLocationInformation"><dt>Location:<dd>Town ', number(p), ', NV</dl><div class="broker"><div class="broker-card"><div><span>Business Listed By:</span><br>',
        F.col("s_name"), '</div><span class="lblViewTpnTelephone_1"><a href="tel:510555', F.lpad(number(F.col("page_id") % 10_000), 4, "0"), '">call</a></span><a href="mailto:b', number(F.col("s_suppkey")), '@x.example?subject=hello">mail</a>',
        '<a href="/business-broker/b/firm/', number(F.col("s_suppkey")), '/?q=1">View profile</a></div></div>',
    )
    found = listing_pages.market(listed(spark, sf_dir, block, text("https://www.bizbuysell.com/business-opportunity/x/", number(listing_number()), "/?from=a#b")))
    x = F.col("listing")
    note = F.when(x["inventory_included"] & (x["inventory_value"] == 1000), "Included")
    return found.select(
        "page_id", x["listing_id"].alias("listing_id"), x["title"].alias("title"), x["asking_price"].alias("asking_price"), x["year_established"].alias("year_established"), x["number_of_employees"].alias("employees"), note.alias("inventory_note"),
        F.element_at(x["extra"], "colour").alias("colour"), x["city"].alias("city"), x["state"].alias("state"), x["industry"].alias("industry"), x["broker_name"].alias("broker"), x["broker_phone"].alias("phone"), x["broker_email"].alias("email"), x["broker_profile_url"].alias("profile"),
    )


@query(f"""SELECT page_id, nullif({_H1}, '') AS title, floor(round(p_retailprice, 2) + 0.5) AS asking_price, CASE WHEN p_size % 2 = 0 THEN CAST(p_size AS DOUBLE) END AS cash_flow, 'Town ' || p_size AS city, 'NV' AS state,
    s_name AS broker, 'https://dealstream.com/d/biz-broker/b/west/' || s_suppkey AS profile, CAST(page_id AS VARCHAR) AS listing_id, 'a' || page_id AS external_id, p_size % 3 = 0 AS by_broker {_RECORD_SQL}""")
def listing_captioned(spark, sf_dir):
    p = F.col("p_size")
    block = text(
        "<div>Asking Price</div><div>", money(F.col("p_retailprice")), "</div><dl><dt>Cash Flow</dt><dd>", F.when(p % 2 == 0, text("$", number(p))).otherwise("On request"), "</dl><p>Represented by broker? ", F.when(p % 3 == 0, "Yes").otherwise("No"),
        "<p>\nTown  ", number(p), ', NV\n</p><a href="/about">About</a><a href="/d/biz-broker/b/west/', number(F.col("s_suppkey")), '?x=1"> ', F.col("s_name"), "\n</a><p>LISTING ID # ", number(F.col("page_id")), "</p>",
    )
    x = F.col("listing")
    found = listing_pages.captioned(listed(spark, sf_dir, block, text("https://dealstream.com/d/biz-sale/x/a", number(F.col("page_id")))))
    return found.select("page_id", *(x[a].alias(b) for a, b in (("title", "title"), ("asking_price", "asking_price"), ("cash_flow", "cash_flow"), ("city", "city"), ("state", "state"), ("broker_name", "broker"), ("broker_profile_url", "profile"), ("listing_id", "listing_id"), ("external_id", "external_id"))), F.coalesce(x["by_broker"], F.lit(False)).alias("by_broker"))


@query(f"""SELECT page_id, floor(round(p_retailprice, 2) + 0.5) AS asking_price, CASE WHEN p_size % 2 = 0 THEN CAST(p_size AS DOUBLE) END AS revenue, CAST(page_id + 1000 AS VARCHAR) AS listing_id, 'Town ' || p_size AS city, 'NV' AS state,
    'Town ' || p_size || ', NV; Reno, NV' AS location, s_name AS broker, p_type || ' Businesses For Sale' AS industry, p_name || ' ' || p_brand AS description {_RECORD_SQL}""")
def listing_facts(spark, sf_dir):
    p = F.col("p_size")
    block = text(
        '<ol id="breadcrumbs"><li><a>Home</a><li><a>', F.col("p_type"), ' Businesses For Sale</a></ol><div class="busListingQuickFacts">Asking Price: ', money(F.col("p_retailprice")), " Annual Revenue: ", F.when(p % 2 == 0, number(p)).otherwise("Not Disclosed"),
        "<br>\nYear Established: 1999 BBN Listing #: ", number(F.col("page_id") + 1000), '</div><span class="location">Town ', number(p), ', NV</span><span class="location">Reno,  NV</span><div class="busListingContent">', F.col("p_name"), "\n  ", F.col("p_brand"),
        '</div><ul class="contact_seller_content"><li>Phone: 1<li>Contact: ', F.col("s_name"), "</ul>",
    )
    x = F.col("listing")
    found = listing_pages.facts(listed(spark, sf_dir, block, text("https://businessbroker.net/business-for-sale/x/", number(listing_number()), ".aspx")))
    return found.select("page_id", *(x[a].alias(b) for a, b in (("asking_price", "asking_price"), ("revenue", "revenue"), ("listing_id", "listing_id"), ("city", "city"), ("state", "state"), ("location", "location"), ("broker_name", "broker"), ("industry", "industry"), ("description", "description"))))


@query(f"""SELECT page_id, floor(round(p_retailprice, 2) + 0.5) AS asking_price, p_brand AS industry, 'NV' AS location, 'BW' || page_id AS listing_id, s_name AS broker {_RECORD_SQL}""")
def listing_classed(spark, sf_dir):
    offer = F.to_json(F.struct(F.col("p_name").alias("name"), F.array(F.struct(F.format_number("p_retailprice", 2).alias("price"))).alias("offers")))
    block = text('<script type="application/ld+json">', offer, '</script><b class="listing-location"> NV </b><i data-testid="industry">', F.col("p_brand"), '</i><div class="listing-broker">', F.col("s_name"), "</div>")
    x = F.col("listing")
    found = listing_pages.classed(listed(spark, sf_dir, block, text("https://www.bizquest.com/business-for-sale/x/BW", number(F.col("page_id")), "/")))
    return found.select("page_id", *(x[a].alias(b) for a, b in (("asking_price", "asking_price"), ("industry", "industry"), ("location", "location"), ("listing_id", "listing_id"), ("broker_name", "broker"))))


@query(f"""SELECT page_id, nullif({_H1}, '') AS title, floor(round(p_retailprice, 2) + 0.5) AS asking_price, CAST(p_size * 1000 AS DOUBLE) AS cash_flow, 'Town' AS city, 'NV' AS state, p_type AS industry {_RECORD_SQL}""")
def listing_plain(spark, sf_dir):
    block = text("<p>Asking price: ", money(F.col("p_retailprice")), " now. SDE: $", F.format_number(F.col("p_size") * 1000, 0), '</p><div class="our-location">Town, NV</div><em class="industry">', F.col("p_type"), "</em>")
    x = F.col("listing")
    found = listing_pages.plain(listed(spark, sf_dir, block, F.col("url")))
    return found.select("page_id", *(x[a].alias(a) for a in ("title", "asking_price", "cash_flow", "city", "state", "industry")))


@query(f"""SELECT page_id, s_name AS name, p_brand AS firm, '1' || lpad(CAST(page_id AS VARCHAR), 9, '0') AS phone, CAST(page_id + 1000000 AS VARCHAR) AS sold, CAST(page_id + 2000000 AS VARCHAR) || ',' || CAST(page_id + 3000000 AS VARCHAR) AS active {_RECORD_SQL}""")
def broker_profiles(spark, sf_dir):
    person = F.to_json(F.struct(F.lit("Person").alias("@type"), F.col("s_name").alias("name"), F.struct(F.col("p_brand").alias("name")).alias("worksFor")))
    sold = text('<a href="/sold-business/x/', F.base64(number(listing_number()).cast("binary")), '/7/">X</a>')
    block = text(
        '<script type="application/ld+json">', person, '</script><a href="tel:1', F.lpad(number(F.col("page_id")), 9, "0"), '">call</a><section class="sold">', sold, sold, '</section><div id="activeListings"><a href="/about">no</a><a href="/listings/Profile/?q=',
        number(F.col("page_id") + 2_000_000), '">A</a><a href="/business-for-sale/x/', number(F.col("page_id") + 3_000_000), '/?a=1">B</a></div>',
    )
    x = F.col("profile")
    found = listing_pages.profile(listed(spark, sf_dir, block, F.lit("https://www.bizbuysell.com/business-broker/b/firm/7/")))
    return found.select("page_id", x["name"].alias("name"), x["firm"].alias("firm"), x["phone"].alias("phone"), F.array_join(x["sold_ids"], ",").alias("sold"), F.array_join(F.transform(x["active"], lambda c: c["external_id"]), ",").alias("active"))


@query("""SELECT p_partkey, p_name AS title, p_brand AS category, 'second' AS description, 'Town ' || p_size AS city, 'NV' AS state, 'Town ' || p_size || ', NV' AS location, p_type || ',' || p_name AS categories FROM part""")
def linked_data_types(spark, sf_dir):
    """Products, a business and breadcrumbs of each record's linked data: which of several counts differs by field."""
    product = F.to_json(F.struct(F.array(F.lit("Thing"), F.lit("Product")).alias("@type"), F.col("p_name").alias("name"), F.lit("first").alias("category"), F.lit("first").alias("description"), F.lit(7).alias("productid")))
    again = F.to_json(F.struct(F.lit("Product").alias("@type"), F.lit("another").alias("name"), F.col("p_brand").alias("category"), F.lit("second").alias("description")))
    place = F.struct(text("Town ", number(F.col("p_size"))).alias("addressLocality"), F.lit("nevada").alias("addressRegion"))
    graph = F.to_json(F.struct(F.array(F.struct(F.lit("LocalBusiness").alias("@type"), place.alias("address"))).alias("@graph")))
    crumbs = F.to_json(F.struct(F.lit("BreadcrumbList").alias("@type"), F.array(*(F.struct(F.struct(x.alias("name")).alias("item")) for x in (F.lit("Site"), F.col("p_type"), F.lit("Nevada Businesses For Sale"), F.col("p_name")))).alias("itemListElement")))
    html = text(*(x for block in (product, graph, crumbs, again) for x in ("<script type='application/ld+json'>", block, "</script>")))
    rows = spread(table(spark, sf_dir, "part")).select("p_partkey", linked_data.objects(html).alias("ld"))
    found = linked_data.listing(F.col("ld"), "Site")
    return rows.select("p_partkey", *(found[k].alias(k) for k in ("title", "category", "description", "city", "state", "location")), F.array_join(found["categories"], ",").alias("categories"))


_RULES = (
    url_rules.Rule("com", "listing", "example.com", "^/[a-z]{2}/[0-9]+", id=r"/([0-9]+)(?:\.html)?/?$"),
    url_rules.Rule("org", "catalog", "example.org", "^/en/", without=("utm_source", "page")),
    url_rules.Rule("org", "listing", "example.org", "^/[a-z]{2}/[0-9]+", but="^/en/", id=r"/([0-9]+)(?:\.html)?/?$", www=True),
)
_PATH = "coalesce(nullif(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), ''), '/')"
_UNDER = "regexp_matches(lower(regexp_extract(url, '^https?://([^/?#]+)', 1)), '(^|\\.)example\\.{}$')"
_LONE = f"regexp_extract({_PATH}, '/([0-9]+)(?:\\.html)?/?$', 1)"


@query(f"""WITH u AS (SELECT page_id, url, CASE WHEN {_UNDER.format("com")} AND regexp_matches({_PATH}, '^/[a-z]{{2}}/[0-9]+') AND {_LONE} <> '' THEN 'com listing'
        WHEN {_UNDER.format("org")} AND starts_with({_PATH}, '/en/') AND NOT regexp_matches(url, '[?&](utm_source|page)=') THEN 'org catalog'
        WHEN {_UNDER.format("org")} AND regexp_matches({_PATH}, '^/[a-z]{{2}}/[0-9]+') AND NOT starts_with({_PATH}, '/en/') AND {_LONE} <> '' THEN 'org listing' END AS found FROM pages)
    SELECT page_id, found, CASE WHEN found LIKE '% listing' THEN {_LONE} END AS external_id, CASE WHEN found = 'com listing' THEN regexp_extract(url, '^https?://[^/?#]+', 0) || {_PATH}
        WHEN found = 'org listing' THEN regexp_replace(regexp_extract(url, '^https?://[^/?#]+', 0), '^(https?://)(www\\.)?', '\\1www.') || {_PATH} END AS normal FROM u""")
def url_rules_pages(spark, sf_dir):
    """Rule rows of one's own over the pages' addresses: the first rule that holds, the id, the normal form of listings."""
    x, ref = url_rules.found("url", _RULES), url_rules.reference("url", _RULES)
    return table(spark, sf_dir, "pages").select("page_id", F.concat_ws(" ", x["site"], x["kind"]).alias("found"), x["external_id"].alias("external_id"), ref["url"].alias("normal")).withColumn("found", markup.filled(F.col("found")))


#: Shapes of addresses by turns, ``{}`` an order's key of seven digits: with their site, kind, id and whether that is told.
_SHAPES = (
    ("https://www.bizbuysell.com/business-opportunity/x/{}/?a=1", "bizbuysell listing", True), ("http://bizbuysell.com/nevada-business-for-sale/{}", "bizbuysell listing", True),
    ("https://www.bizbuysell.com/nevada-businesses-for-sale/{}/", "bizbuysell catalog", False), ("https://www.bizbuysell.com/businesses-for-sale/?q={}", None, False),
    ("https://www.bizbuysell.com/business-broker/a/b/{}/", "bizbuysell broker", False), ("https://www.bizbuysell.com/business-brokers/nevada/{}/", "bizbuysell directory", False),
    ("https://www.bizquest.com/business-for-sale/x/BW{}/", "bizquest listing", True), ("https://www.bizquest.com/businesses-for-sale-in-x{}/page-2/", "bizquest catalog", False),
    ("https://businessbroker.net/business-for-sale/x/{}.aspx", "businessbroker listing", True), ("https://www.businessbroker.net/state/x{}-businesses-for-sale.aspx", "businessbroker catalog", False),
    ("https://loopnet.com/Listing/x/{}", "loopnet listing", True), ("https://www.loopnet.com/biz/x-businesses-for-sale//{}/", "loopnet catalog", False),
    ("https://dealstream.com/d/biz-sale/x/{}", "dealstream listing", True), ("https://dealstream.com/off-market-businesses-for-sale/{}", "dealstream catalog", False), ("https://dealstream.com/d/biz-members/x/{}", "dealstream broker", False),
    ("https://us.businessesforsale.com/us/x{}.aspx", "businessesforsale listing", False), ("https://us.businessesforsale.com/us/search/x-{}", "businessesforsale catalog", False), ("https://us.businessesforsale.com/us/faq.aspx?x={}", None, False),
    ("https://www.sunbeltnetwork.com/x{}/", "sunbelt office", False), ("https://www.sunbeltnetwork.com/blog/?x={}", None, False), ("https://www.tworld.com/locations/nevada/x{}", "transworld office", False), ("https://other.example/x/{}", None, False),
)
_TURNS = f"o_orderkey % {len(_SHAPES)}"


@query("SELECT o_orderkey, CASE " + _TURNS + " " + " ".join(f"WHEN {i} THEN '{kind}'" for i, (_, kind, _) in enumerate(_SHAPES) if kind) + " END AS found, CASE " + _TURNS + " "
    + " ".join(f"WHEN {i} THEN '{'BW' if 'BW' in url else ''}' || (o_orderkey + 1000000)" for i, (url, _, told) in enumerate(_SHAPES) if told) + " END AS external_id FROM orders")
def url_rules_sites(spark, sf_dir):
    """The sites' own rules over addresses of every shape."""
    key = number(F.col("o_orderkey") + 1_000_000)
    url = F.element_at(F.array(*(text(shape.split("{}")[0], key, shape.split("{}")[1]) for shape, _, _ in _SHAPES)), (F.col("o_orderkey") % len(_SHAPES) + 1).cast("int"))
    x = url_rules.found(F.col("url"))
    return table(spark, sf_dir, "orders").select("o_orderkey", url.alias("url")).select("o_orderkey", markup.filled(F.concat_ws(" ", x["site"], x["kind"])).alias("found"), markup.filled(x["external_id"]).alias("external_id"))


@query("""SELECT o_orderkey, o_orderkey % 7 + 1 AS page, 'https://a.example/x' || (o_orderkey % 50) || '-businesses-for-sale/' || (o_orderkey % 7 + 2) || '/' AS next,
    CASE WHEN o_orderkey % 7 = 0 THEN 'https://a.example/us/search/x' || (o_orderkey % 50) ELSE 'https://a.example/us/search/x' || (o_orderkey % 50) || '-' || (o_orderkey % 7 + 1) END AS searched FROM orders""")
def catalog_paging(spark, sf_dir):
    """Page numbers in paths: of a catalogue's page, its next page, and another site's form of the same page."""
    n, k = F.col("o_orderkey") % 7 + 1, number(F.col("o_orderkey") % 50)
    forms = {(p.site, p.kind): p for p in url_rules.PAGES}
    slash, dash = forms["bizbuysell", "catalog"], forms["businessesforsale", "catalog"]
    url = text("https://a.example/x", k, "-businesses-for-sale", F.when(n == 1, "").otherwise(text("/", number(n))), "/?sort=1#top")
    other = text("https://a.example/us/search/x", k, "/")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", url.alias("url"), other.alias("other"))
    at = url_rules.page("url", slash)["page"]
    return rows.select("o_orderkey", at.alias("page"), url_rules.page_url("url", at + 1, slash).alias("next"), url_rules.page_url("other", at, dash).alias("searched"))
