"""Whole pages by shape, against pages of our own: open tags, help texts, several linked-data blocks, hidden phones, encoded ids."""

import pytest
from pyspark.sql import functions as F

from basalt.functions import markup, url_rules
from basalt.operators import linked_data, listing_pages

MARKET = """<!doctype html><html><head><title>Harbour Bakery | Site</title>
<script type="application/ld+json">{"@type":"Product","name":"Bakery by the harbour - BizBuySell","description":"LD product text","productid":"999","category":"Food","image":"https://images.bizbuysell.com/ld.jpg","alternateName":"Fresh daily"}</script>
<script type='application/ld+json'>[{"@graph":[{"@type":["LocalBusiness","Bakery"],"address":{"addressLocality":"Oakland","addressRegion":"California"},"description":"LD business text"},
{"@type":"BreadcrumbList","itemListElement":[{"item":{"name":"BizBuySell"}},{"item":{"name":"California Businesses For Sale"}},{"name":"Restaurants"},{"item":{"name":"Bakeries"}}]}]}]</script>
<script type="application/ld+json">{broken</script></head><body>
<h1> Harbour Bakery </h1><span class="profileAdLine">Ad line</span><div class="listing-status">Sale Pending!</div>
<p class="dt-grid-2 m-listing-row"><span class="title">Asking Price:</span><span class="price">$1,250,000<i class="help">what? $9</i></span></p>
<p class="m-listing-row"><span class="title">Gross Revenue:</span><span class="normal">$2,000,000.50</span>
<p class="m-listing-row"><span class="title">Cash Flow (SDE):</span><span class="normal">Not Disclosed</span></p>
<p class="m-listing-row"><span class="title">EBITDA</span><span class="normal">$310,000</span></p>
<p class="m-listing-row"><span class="title">Established:</span><span class="normal">since 1987</span></p>
<dl id="dlDetailedInformation" class="listingProfile_details"><dt><span class="normal">Inventory:</span></dt><dd>$40,000<br>Included in asking price</dd>
<dt><span class="normal">Furniture, Fixtures, &amp; Equipment (FF&amp;E):</span></dt><dd>$125,000<br/>Not included</dd>
<dt>Employees:<dd><p>10 Full-time</p><p>2 part-time</p><span class="help">hint</span><dt>Parking:<dd>street
<dt>No value:</dt></dl>
<dl id="dlLocationInformation"><dt><span class="normal">Location:</span></dt><dd>San  Leandro, CA</dd><dt>Real Estate:</dt><dd>Leased</dd><dt>Building SF:</dt><dd>160,000</dd><dt>Rent:</dt><dd>$2,240.00</dd></dl>
<dl class="listingProfile_details"><dt>Financing:</dt><dd>Seller</dd><dt>Parking:</dt><dd>own lot</dd></dl>
<div id="slider"><img class="image" src="https://images.bizbuysell.com/a.jpg"><img class="image" src="https://images.bizbuysell.com/a.jpg"><img class="image" src="https://ads.example/x.jpg"></div>
<div class="businessDescription">page text</div>
<div class="broker"><div class="broker-card"><div><span>Business Listed By:</span><br>Ann Lee</div><span class="ctc lblViewTpnTelephone_2412345"><a href="tel:510-555-0100">show</a></span>
<a href="mailto:ann@shore.example?subject=x">mail</a><a href="/business-broker/ann-lee/shore-realty/31464/?q=1#top">Shore Realty</a><p class="broker-about">Serves   the bay.</p></div></div></body></html>"""
CAPTIONED = """<html><body><nav><a href="/x-businesses-for-sale">HVAC Businesses for Sale</a></nav><h1>HVAC platform</h1>
<p>Dallas, TX</p>
<main><h2>Business For Sale Details</h2><p>Expand  the platform.</p></main>
<div>Asking Price</div><div>$950,000</div><div>Cash Flow</div><div>On request</div><span>Sales</span><b>$1,307,780.60</b>
<p>Represented by broker? Yes</p><a href="/d/biz-broker/acme/west/abc12/?r=1">Acme  Advisors</a><p>LISTING ID # 52650</p></body></html>"""
FACTS = """<html><head><meta property="og:description" content="Laundry - Reno, NV - great"></head><body><ol id="breadcrumbs"><li><a>Home</a><li><a>Laundry Businesses for Sale</a></ol><h1>Laundry</h1>
<div class="busListingQuickFacts">Asking Price: $300,000 Annual Revenue: Not Disclosed Cash Flow: $90,000
Year Established: 2001 BBN Listing #: 700999</div><div class="busListingContent">Coin   laundry.</div><ul class="contact_seller_content"><li>Contact: Bo Li<li>Phone: 1</ul></body></html>"""
CLASSED = """<html><head><script type="application/ld+json">{"@type":"Product","name":"LD Cafe","offers":{"price":"350,000"}}</script></head><body><div class="location">Bakersfield,  CA</div><p class="description"> A cafe. </p>
<span class="industry">Cafes</span><div class="broker-name">Cy</div><p>Cash flow: $80,000. Revenue: $400,000</p></body></html>"""
PLAIN = """<html><head><title>Shop | Broker</title><meta property="og:title" content="Shop OG"></head><body><div class="listing-location">near Austin, TX</div><article><p>A shop with a long description that goes beyond forty characters.</p></article>
<p>Asking price: $1,200,000</p><p>Gross revenue: $2,500,000 SDE $300,000</p><div class="broker-card">Dee</div><em itemprop="industry">Retail</em></body></html>"""
PROFILE = """<html><head><script type="application/ld+json">{"@type":"Person","name":"Ann Lee","url":"https://www.bizbuysell.com/x","worksFor":{"@type":"Organization","name":"Shore Realty","description":"a firm"}}</script></head><body><h1>A. Lee</h1>
<a href="tel:1-510-555-0100">call</a><a href="mailto:ann@shore.example">mail</a><div id="soldListings"><a href="/sold-business/cafe/MjQ4MzUyMw==/31464/">Cafe</a><a href="/sold-business/cafe-again/MjQ4MzUyMw==/31464/">Cafe again</a><a href="/about">About</a><a href="/sold-business/odd/xyz/1/">Odd</a></div>
<div id="activeListings"><a href="https://www.bizbuysell.com/listings/Profile/?q=9999999">Other</a><a href="/business-opportunity/pub/2222222/">Pub</a></div></body></html>"""
SHORT = """<html><body><h1>Acme</h1><main>We  sell.</main><a href="/d/biz-sale/hvac/9m25ky?x=1">HVAC
 firm</a><a href="/d/biz-sale/hvac/9m25ky/">again</a><a href="/d/biz-sale/mill/abc9">Mill</a><a href="/about">About</a></body></html>"""


def parsed(spark, shape, html, url, into):
    rows = [(url, html, "kept"), (None, None, None), ("no address", "plain words < with > signs", "x"), ("https://a.example/", "", "_x_title")]
    found = shape(spark.createDataFrame(rows, "url string, html string, _dom string"))
    assert found.columns == ["url", "html", "_dom", into] and found.count() == 4
    got = found.collect()
    assert got[0]["_dom"] == "kept" and all(v in (None, [], {}) for k, v in got[1][into].asDict().items())
    return {k: v for k, v in got[0][into].asDict(True).items() if v not in (None, [], {})}


def test_market(spark):
    url = "https://www.bizbuysell.com/business-opportunity/harbour-bakery-for-sale/2412345/?utm=1"
    assert parsed(spark, listing_pages.market, MARKET, url, "listing") == {
        "listing_id": "2412345", "external_id": "2412345", "title": "Harbour Bakery", "tagline": "Fresh daily", "description": "LD business text", "link": url, "asking_price": 1250000.0, "revenue": 2000000.5,
        "ebitda": 310000.0, "year_established": 1987, "financing": "Seller", "real_estate": "Leased", "building_sf": "160,000", "number_of_employees": "10 Full-time | 2 part-time", "inventory": "$40,000 | Included in asking price",
        "rent": "$2,240.00", "ffe": "$125,000 | Not included", "inventory_included": True, "inventory_value": 40000.0, "rent_amount": 2240.0, "extra": {"parking": "own lot"}, "images": ["https://images.bizbuysell.com/a.jpg"],
        "status": "Sale Pending", "broker_name": "Ann Lee", "broker_phone": "510-555-0100", "broker_email": "ann@shore.example", "broker_profile_url": "https://www.bizbuysell.com/business-broker/ann-lee/shore-realty/31464/",
        "broker_firm": "Shore Realty", "broker_note": "Serves the bay.", "location": "San Leandro, CA", "city": "San Leandro", "state": "CA", "state_name": "California", "category": "Food", "categories": ["Restaurants", "Bakeries"], "industry": "Bakeries",
    }


@pytest.mark.parametrize(("html", "want"), [
    ("<title> A shop | Site </title><div class='x asking-price-y'>$450,000</div>", {"title": "A shop", "asking_price": 450000.0}),
    ("<span class='h3 hidden'>Hidden</span><title>T</title><dl class='listingProfile_details'><dt>Location:<dd>Nowhere<dt>Odd:<dd><br><dt>Odd:<dd>a<br><br>b", {"title": "Hidden", "location": "Nowhere", "extra": {"odd": "a | b"}}),
    ("<h1>x</h1><p class='m-listing-row'><span class='title'>Asking Price:</span><span class='price'>$5</span><p class='m-listing-row'><span class='title'>Price</span><span class='normal'>Not disclosed</span>", {"title": "x"}),
    ("<form id=contactForm><span>Listed by:</span> Bo <script>TrackListingAction()</script><a href='tel:12'>1</a><a href='tel:5105550101'>2</a></form>", {"broker_name": "Bo"}),
    ('<script type="application/ld+json">{"@type":"Product","name":"Only - BizBuySell"}</script><div class=broker>Enter a valid full name</div>', {"title": "Only"}),
])
def test_market_with_less(spark, html, want):
    got = parsed(spark, listing_pages.market, html, "https://www.bizbuysell.com/about", "listing")
    assert {k: v for k, v in got.items() if k != "link"} == want


def test_captioned(spark):
    assert parsed(spark, listing_pages.captioned, CAPTIONED, "https://dealstream.com/d/biz-sale/hvac/9m25ky", "listing") == {
        "title": "HVAC platform", "asking_price": 950000.0, "revenue": 1307781.0, "city": "Dallas", "state": "TX", "location": "Dallas, TX", "industry": "HVAC Businesses", "description": "Business For Sale DetailsExpand the platform.",
        "broker_name": "Acme Advisors", "broker_profile_url": "https://dealstream.com/d/biz-broker/acme/west/abc12/", "by_broker": True, "external_id": "9m25ky", "listing_id": "52650",
    }


def test_facts(spark):
    assert parsed(spark, listing_pages.facts, FACTS, "https://www.businessbroker.net/business-for-sale/laundry/700123.aspx", "listing") == {
        "title": "Laundry", "asking_price": 300000.0, "cash_flow": 90000.0, "city": "Reno", "state": "NV", "location": "Reno, NV", "industry": "Laundry Businesses for Sale", "broker_name": "Bo Li", "description": "Coin laundry.",
        "external_id": "700999", "listing_id": "700999",
    }


def test_classed(spark):
    got = parsed(spark, listing_pages.classed, CLASSED, "https://www.bizquest.com/business-for-sale/cafe/BW2486214/", "listing")
    assert got == {"title": "LD Cafe", "asking_price": 80000.0, "revenue": 400000.0, "cash_flow": 80000.0, "city": "Bakersfield", "state": "CA", "location": "Bakersfield, CA", "industry": "Cafes", "broker_name": "Cy", "description": "A cafe.", "external_id": "BW2486214", "listing_id": "BW2486214"}
    only = """<script type="application/ld+json">[{"name":" A ","offers":[{"price":0},{"price":"350,000"}]},{"offers":{"price":9}}]</script><p data-listing-id=" 77 ">"""
    assert parsed(spark, listing_pages.classed, only, "https://www.bizquest.com/", "listing") == {"title": "A", "asking_price": 350000.0, "external_id": "77", "listing_id": "77"}


def test_plain(spark):
    assert parsed(spark, listing_pages.plain, PLAIN, "https://broker.example/listing/1", "listing") == {
        "title": "Shop OG", "asking_price": 1200000.0, "revenue": 2500000.0, "cash_flow": 300000.0, "city": "near Austin", "state": "TX", "location": "near Austin, TX", "industry": "Retail",
        "description": "A shop with a long description that goes beyond forty characters.", "broker_name": "Dee",
    }


def test_profiles(spark):
    got = parsed(spark, listing_pages.profile, PROFILE, "https://www.bizbuysell.com/business-broker/ann-lee/shore-realty/31464/?x=1", "profile")
    assert [(c["title"], c["external_id"]) for c in got["sold"]] == [("Cafe", "2483523"), ("Odd", None)] and [c["external_id"] for c in got["active"]] == ["9999999", "2222222"]
    assert (got["profile_url"], got["name"], got["firm"], got["about"], got["phone"], got["email"], got["sold_ids"]) == ("https://www.bizbuysell.com/business-broker/ann-lee/shore-realty/31464/", "Ann Lee", "Shore Realty", "a firm", "1-510-555-0100", "ann@shore.example", ["2483523"])
    loose = "<div><p><a href='/sold-business/x/MTIzNDU2Nw/1/'>S</a></p><a href='/business-opportunity/y/7654321/'>B</a></div>"
    got = parsed(spark, listing_pages.profile, loose, "https://other.example/", "profile")
    assert got["sold_ids"] == ["1234567", "7654321"] and got["profile_url"] == "https://other.example/"
    got = parsed(spark, listing_pages.short_profile, SHORT, "https://dealstream.com/d/biz-broker/acme/west/abc12", "profile")
    assert [(c["title"], c["url"], c["external_id"]) for c in got["active"]] == [("HVAC firm", "https://dealstream.com/d/biz-sale/hvac/9m25ky", "9m25ky"), ("Mill", "https://dealstream.com/d/biz-sale/mill/abc9", "abc9")]


def test_trees(spark):
    html = '<p>one<br>two<p>three <b>bold<div class="x y">d &amp; e</div><ul><li>a<li>b<ul><li>c</ul></ul><script>var t="</p>";</script><table><tr><td>1<td>2<tr><td>3</table><img src=q><DIV ID=Z>last'
    dom = F.col("dom")

    def texts(selector):
        return F.transform(markup.select(dom["elements"], selector), lambda e: markup.text(dom, e)).alias(selector)

    want = {"p": ["onetwo", "three bold"], ".x.y": ["d & e"], "ul li": ["a", "bc", "c"], "td, li": ["a", "bc", "c", "1", "2", "3"], "tr": ["12", "3"], "#Z": ["last"], "img[src='q']": [""], "ul ul li, b": ["bold", "c"], "script": ['var t="</p>";'], "[class*='x'], .none": ["d & e"], "em": []}
    got = markup.with_dom(spark.createDataFrame([(html,)], "html string")).select(*(texts(s) for s in want)).first()
    assert got.asDict() == want
    with pytest.raises(ValueError):
        markup.select(dom["elements"], "a > b")


def test_linked_data_walk(spark):
    deep = "[" * 400 + '{"@type":"Product","name":"deep"}' + "]" * 400
    html = f'<script type="application/ld+json">{deep}</script><script type="application/ld+json">' + '{"a":' * 90_000 + "</script>"
    found = spark.createDataFrame([(html,), (None,), ('<script type="application/ld+json">{"@type":"Product","name":5,"productid":"x","image":["a"]}</script>',)], "html string").select(linked_data.objects(F.col("html")).alias("ld"))
    got = found.select(*(v.alias(k) for k, v in linked_data.listing(F.col("ld")).items())).collect()
    assert [(r.title, r.listing_id) for r in got] == [("deep", None), (None, None), (None, "x")]


URLS = [
    ("https://www.bizquest.com/businesses-for-sale-in-midwest-region/", "bizquest", "catalog", None), ("https://www.bizbuysell.com/california-businesses-for-sale/", "bizbuysell", "catalog", None),
    ("https://www.bizbuysell.com/businesses-for-sale/3/?geo=1", None, None, None), ("https://m.bizbuysell.com/Business-Opportunity/x/1234567/", "bizbuysell", "listing", "1234567"), ("https://bizbuysell.com/business-asset/x/12/", None, None, None),
    ("https://www.bizquest.com/", "bizquest", "catalog", None), ("https://www.bizquest.com/start-up-business/x/BW9/", "bizquest", "listing", "BW9"), ("https://www.businessbroker.net/county/x-businesses-for-sale.aspx", "businessbroker", "catalog", None),
    ("https://www.loopnet.com/biz/california-united-states/businesses-for-sale//2/", "loopnet", "catalog", None), ("https://www.loopnet.com/biz/business-opportunity/x/12/", "loopnet", "listing", "12"), ("https://www.loopnet.com/Listing/x/", None, None, None),
    ("https://dealstream.com/biz-sale", "dealstream", "catalog", None), ("https://dealstream.com/d/biz-sale/x/9m25ky/", "dealstream", "listing", "9m25ky"), ("https://us.businessesforsale.com/us/search/quick-sale-3", None, None, None),
    ("https://us.businessesforsale.com/us/search/california?x=1", None, None, None), ("https://us.businessesforsale.com/us/login.aspx", None, None, None), ("https://www.sunbeltnetwork.com/reno-nv/", "sunbelt", "office", None), ("https://www.sunbeltnetwork.com/Blog/", None, None, None),
    ("https://www.tworld.com/locations/nevada/reno/team", None, None, None), ("https://notbizquest.com/", None, None, None), ("bizquest.com/", None, None, None), (None, None, None, None), ("", None, None, None),
]


def test_sites(spark):
    x = url_rules.found("url")
    got = spark.createDataFrame([(u,) for u, *_ in URLS], "url string").select(x["site"], x["kind"], x["external_id"], url_rules.scrape_site("url"), url_rules.catalog_site("url"), url_rules.listing_site("url")).collect()
    assert [tuple(r)[:3] for r in got] == [tuple(u[1:]) for u in URLS]
    assert [r[3] for r in got] == ["bizquest", "bizbuysell", "bizbuysell", "bizbuysell", "bizbuysell", "bizquest", "bizquest", "businessbroker", "loopnet", "loopnet", "loopnet", "dealstream", "dealstream", *["us.businessesforsale.com"] * 3, "sunbeltnetwork.com", "sunbeltnetwork.com", "tworld.com", "notbizquest.com", *["unknown"] * 3]
    assert got[1][4] == "bizbuysell" and got[3][4] == "m.bizbuysell.com" and got[6][5] == "bizquest" and got[11][5] is None


def test_normal_forms_ids_and_pages(spark):
    rows = [("https://BusinessBroker.net/business-for-sale/x/7.aspx?a#b", "https://www.businessbroker.net/business-for-sale/x/7.aspx"), ("https://loopnet.com:443/Listing/x/7", "https://www.loopnet.com/Listing/x/7"), ("https://m.bizbuysell.com/business-for-sale/x/1234567?q", "https://m.bizbuysell.com/business-for-sale/x/1234567")]
    assert [r[0] for r in spark.createDataFrame(rows, "url string, want string").select(url_rules.reference("url")["url"]).collect()] == [w for _, w in rows]
    ids = [("https://www.bizbuysell.com/sold-business/x/MjQ4MzUyMw==/1/", "2483523"), ("https://www.bizbuysell.com/sold-business/x/2483523/1/", "2483523"), ("https://www.bizbuysell.com/sold-business/x/abc/1/", None), ("https://a.example/?z=1&q=123456", "123456"), ("https://www.bizbuysell.com/business-asset/x/777777/", "777777")]
    assert [r[0] for r in spark.createDataFrame(ids, "url string, want string").select(url_rules.any_id("url")).collect()] == [w for _, w in ids]
    forms = {(p.site, p.kind): p for p in url_rules.PAGES}
    cases = [
        ("bizbuysell", "catalog", "https://w.example/x-businesses-for-sale/2/?a#b", 2, "https://w.example/x-businesses-for-sale/3/"), ("bizbuysell", "catalog", "https://w.example/businesses-for-sale", 1, "https://w.example/businesses-for-sale/2/"), ("bizbuysell", "catalog", "https://w.example/about#x", None, "https://w.example/about"),
        ("bizquest", "catalog", "https://w.example/businesses-for-sale/page-4/", 4, "https://w.example/businesses-for-sale/page-5/"), ("loopnet", "catalog", "https://w.example/biz/x/y-businesses//2/", 2, "https://w.example/biz/x/y-businesses/3/"), ("dealstream", "catalog", "https://w.example/biz-sale/9", 9, "https://w.example/biz-sale/10/"),
        ("businessesforsale", "catalog", "https://w.example/us/search/nevada-2", 2, "https://w.example/us/search/nevada-3"), ("bizbuysell", "directory", "https://w.example/business-brokers/nevada/", 1, "https://w.example/business-brokers/nevada/2/"), ("businessbroker", "catalog", "https://w.example/state/x.aspx?page=3&y=1", 3, "https://w.example/state/x.aspx?page=4"),
    ]
    for site, kind, url, page, following in cases:
        form, one = forms[site, kind], spark.createDataFrame([(url,)], "url string")
        at = url_rules.page("url", form)["page"]
        assert tuple(one.select(at, url_rules.page_url("url", F.coalesce(at, F.lit(1)) + 1, form)).first()) == (page, following), url
    keys = spark.createDataFrame([("https://w.example/x-businesses-for-sale/1/",), ("https://w.example/x-businesses-for-sale?page=1",)], "url string").select(url_rules.page_key("url", forms["bizbuysell", "catalog"])).distinct()
    assert keys.count() == 1
    assert spark.createDataFrame([("https://www.bizbuysell.com/x",), ("http://bizbuysell.com",), ("https://o.example/www.bizbuysell.com/",)], "u string").select(url_rules.mobile("u", "bizbuysell.com")).collect() == [("https://m.bizbuysell.com/x",), ("http://m.bizbuysell.com",), ("https://o.example/www.bizbuysell.com/",)]


@pytest.mark.parametrize("said", ["<p>LISTING ID # 381</p>56.187 in all", "<b>Listing ID</b> #<i>381</i><h2>56 rooms</h2>", "<div>LISTING <b>ID</b># <u>381</u></div><div>4</div>"])
def test_a_listing_number_ends_with_its_element(spark, said):
    html = f"<html><body><h1>Inn</h1>{said}</body></html>"
    assert parsed(spark, listing_pages.captioned, html, "https://dealstream.com/d/biz-sale/inn/9m25ky", "listing")["listing_id"] == "381"


def test_signs_in_a_row_are_no_price(spark):
    html = CLASSED.replace("<p>Cash flow: $80,000. Revenue: $400,000</p>", "<p>Rean$$$ 1142126282388588 du%%%</p>")
    assert html != CLASSED
    assert parsed(spark, listing_pages.classed, html, "https://www.bizquest.com/business-for-sale/x/BW1/", "listing")["asking_price"] == 350000
