"""Directories against records and pages of our own."""

from pyspark.sql import functions as F

from basalt.functions import markup
from basalt.operators import directories


def refs(spark, body, of):
    found = spark.createDataFrame([(body,)], "b string").select(of(F.col("b")).alias("r")).first().r
    return found if found is None else [{k: v for k, v in r.asDict().items() if v is not None} for r in found]


def test_three_shapes_of_records(spark):
    whole = '[{"id":"7","first_name":"Jo","middle_name":null,"last_name":"Li","company":" Shore & Co ","website":"https://www.shore.example/x","city":"Bakersfield","state":"California","state_code":"CA","country_code":"us","cbi_cert":"1","mami_cert":0,"master_cert":1},{"id":"8","first_name":"","last_name":""}]'
    assert refs(spark, whole, directories.of_all) == [
        {"profile_url": "https://www.ibba.org/broker-profile/california/bakersfield/jo-li/", "external_id": "7", "name": "Jo Li", "firm": "Shore & Co", "state": "CA", "city": "Bakersfield", "country": "US", "source": "ibba", "website": "shore.example", "designations": ["CBI", "MCBI"]},
        {"profile_url": "https://www.ibba.org/broker-profile/us/unknown//", "external_id": "8", "source": "ibba"},
    ]
    searched = '{"posts":[{"first_name":["Jo"],"last_name":["Li"],"city":[],"permalink":"https://p.example/jo-li/"},{"first_name":["A"],"id":["9"]}]}'
    assert [(r["external_id"], r["profile_url"], r["name"]) for r in refs(spark, searched, directories.of_search)] == [("jo-li", "https://p.example/jo-li/", "Jo Li"), ("9", "https://www.ibba.org/broker-profile/us/unknown/a/", "A")]
    mapped = '{"features":[{"details":{"url":"https://p.example/1","name":" Jo  van Li ","state":"NV","cbi":"1","mami":"0"}},{"details":{"name":"lost"}},{}]}'
    assert refs(spark, mapped, directories.of_map) == [{"profile_url": "https://p.example/1", "external_id": "https://p.example/1", "name": "Jo van Li", "state": "NV", "source": "ibba", "designations": ["CBI"]}]
    assert refs(spark, None, directories.of_all) is None and refs(spark, "{}", directories.of_search) is None


def test_tables_and_links(spark):
    html = """<table><tr><td><a href="ppldetail.asp?id=1">Jo Li</a><td>Shore<td>Reno, NV<td>01234567<tr><td><a href="/ppldetail?x">No number</a></table>
        <table><tr><td><a href="/LicenseDetail/1">Az One</a></td>\n<td>BR12345</td></tr></table><a href="/reno-nv/"> Reno </a><a href="/blog/">Blog</a><a href="https://www.sunbeltnetwork.com/x-y/"></a>"""
    d = F.col("dom")
    pages = markup.with_dom(spark.createDataFrame([(html,), (None,)], "html string"))
    got = pages.select(directories.licences(d, "CA").alias("ca"), directories.licences(d, "AZ").alias("az"), directories.offices(d, F.lit("https://www.sunbeltnetwork.com/locations/")).alias("o")).collect()
    assert [(r.name, r.external_id, r.firm, r.city, r.profile_url) for r in got[0].ca] == [("Jo Li", "01234567", "Shore", "Reno", "https://www2.dre.ca.gov/publicasp/ppldetail.asp?id=1"), ("No number", None, None, None, "https://www2.dre.ca.gov/ppldetail?x")]
    assert [(r.name, r.external_id, r.state) for r in got[0].az] == [("Az One", "BR12345", "AZ")]
    assert [(r.external_id, r.name, r.website) for r in got[0].o] == [("reno-nv", "Reno", "sunbeltnetwork.com"), ("x-y", "Sunbelt x-y", "sunbeltnetwork.com")]
    assert list(got[1]) == [[], [], []]


def test_later_references_fill_and_renew(spark):
    schema = "at int, profile_url string, external_id string, name string, firm string, state string, city string, country string, source string, website string, phone string, email string, designations array<string>"
    rows = [(1, "p", "1", "A", None, None, None, None, "s", None, "5", None, ["CBI"]), (2, "p", None, "B", "F", None, None, None, "t", None, None, None, None), (1, "q", None, None, None, None, None, None, None, None, None, None, None)]
    got = {r.profile_url: r for r in directories.merged(spark.createDataFrame(rows, schema), ["at"]).collect()}
    assert (got["p"].external_id, got["p"].name, got["p"].firm, got["p"].source, got["p"].phone, got["p"].designations) == ("1", "B", "F", "t", "5", ["CBI"]) and got["q"].name is None
