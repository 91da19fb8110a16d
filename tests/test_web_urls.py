"""Addresses as browsers read them, keys, artifacts and documents."""

from pyspark.sql import functions as F

from basalt.functions import web_urls
from basalt.operators import artifacts, keys
from basalt.plans.artifacts import deal_documents
from basalt.plans.catalogue import SQL

FORMS = [
    ("https://A.Example/x?b=2&a=1#f", "https://a.example/x?a=1&b=2"), ("not a url", "not a url"), ("http://a.example", "http://a.example/"), ("HTTP://a.example:80/x", "http://a.example/x"), ("http://a.example:443/", "http://a.example:443/"),
    ("https://a.example:443", "https://a.example/"), ("https://a.example/a/./b/../c", "https://a.example/a/c"), ("https://a.example/a/%2E%2e/b/..", "https://a.example/"), ("https://a.example/../../x", "https://a.example/x"),
    ("https://a.example/a b?x y=1&é=ü", "https://a.example/a%20b?x+y=1&%C3%A9=%C3%BC"), ("https:a.example/x", "https://a.example/x"), ("https:////a.example\\x\\y", "https://a.example/x/y"), ("  https://a.ex\nample/ ", "https://a.example/"),
    ("https://u:p@a.example/", "https://u:p@a.example/"), ("https://u@a.example:8080/?", "https://u@a.example:8080/"), ("http://0x7f.1/", "http://127.0.0.1/"), ("http://256/", "http://0.0.1.0/"), ("http://1.2.3.4.5/", "http://1.2.3.4.5/"),
    ("http://a.example:99999/", "http://a.example:99999/"), ("http://a b/", "http://a b/"), ("http:///", "http:///"), ("ftp://a.example/x?b&a", "ftp://a.example/x?b&a"), ("https://a.example/x?a=2&b=1&a=1", "https://a.example/x?a=2&a=1&b=1"),
    ("https://a.example/x?a", "https://a.example/x?a="), ("https://a.example/x?a=b=c&&", "https://a.example/x?a=b%3Dc"), ("https://a.example/x?z=%20&y=~*-._", "https://a.example/x?y=%7E*-._&z=+"), ("https://[::1]/x", "https://[::1]/x"), (None, None), ("", ""),
    ("http://EXAMPLE%2Ecom/", "http://example.com/"), ("https://a.example/x{y}|`", "https://a.example/x%7By%7D|%60"), ("https://a.example/x?q='\"", "https://a.example/x?q=%27%22"), ("https://a.example/x?p=100%", "https://a.example/x?p=100%25"),
    ("http://010.1.2.3/", "http://8.1.2.3/"), ("http://1.2.3.256/", "http://1.2.3.256/"), ("https://a.example./", "https://a.example./"), ("https://a@b@c.example/", "https://a%40b@c.example/"), ("https://a.example/x/.", "https://a.example/x/"), ("https://a.example:0/", "https://a.example:0/"),
]


def test_forms_of_addresses(spark):
    df = spark.createDataFrame(FORMS, "u string, want string").select("u", "want", web_urls.dedup_form("u").alias("got"))
    assert [(r.u, r.got) for r in df.collect()] == FORMS


def test_parts_of_addresses(spark):
    x = web_urls.parsed("u")
    df = spark.createDataFrame([("https://U:@A.example:8443/x/../ü?q=ü#f g",), ("no",), (None,)], "u string").select(x.alias("x"))
    assert [r.x if r.x is None else tuple(r.x) for r in df.collect()] == [("https", "U", "a.example", "8443", "/%C3%BC", "q=%C3%BC", "f%20g"), None, None]


def test_keys_of_sources(spark):
    rows = [("bizquest", "https://a.example/#x", "7"), ("own", "https://a.example/", "7"), ("own", "https://a.example/?", ""), (None, "https://a.example/", "7"), ("own", None, None)]
    df = spark.createDataFrame(rows, "a string, u string, i string")
    got = df.select(F.transform(keys.named_keys(F.col("a"), F.col("u"), F.col("i")), lambda k: k["kind"]).alias("n"), keys.lookup_keys(F.col("a"), F.col("u"), F.col("i")).alias("l")).collect()
    assert [r.n for r in got] == [["external", "url"], ["url", "external"], ["url"], ["url", "external"], ["url"]] and got[0].l[1] == got[1].l[1] == got[2].l[0]
    parts = spark.createDataFrame([("external", "own", None, None), ("broker-listing", None, "site/7", None), ("broker-listing", None, "/7", None), ("url", None, None, "https://WWW.LoopNet.com/x"), ("url", None, None, "https://us.businessesforsale.com/"), ("url", None, None, "https://www.o.example/"), ("url", None, None, "x")], "k string, a string, b string, u string")
    assert [r[0] for r in parts.select(keys.key_source(F.col("k"), F.col("a"), F.col("b"), F.col("u"))).collect()] == ["own", "site", "/7", "loopnet", "businessesforsale", "o.example", "unknown"]


def test_artifacts_of_a_new_version_alone(spark, tmp_path):
    path, schema = str(tmp_path / "store"), "adapter string, sha256 string, body string"
    some = [("a", "1", "x"), ("a", "1", "x"), ("b", "1", "y"), ("b", "2", None)]
    sizes = []
    for rows, version in ((some[:2], "v1"), (some, "v1"), (some, "v1"), (some[:1], "v2")):
        new = artifacts.derive(spark.createDataFrame(rows, schema), artifacts.stored(spark, path), "markdown", version, lambda: F.upper("body")).cache()
        sizes.append(new.count())
        artifacts.put(new, path)
    assert sizes == [1, 1, 0, 1]
    kept = {(r.adapter, r.derived_from, r.version, r.content, r.content_type, r.size_bytes) for r in artifacts.stored(spark, path).collect()}
    assert kept == {("a", "1", "v1", "X", "text/markdown", 1), ("b", "1", "v1", "Y", "text/markdown", 1), ("a", "1", "v2", "X", "text/markdown", 1)}
    assert {(r.adapter, r.version) for r in artifacts.latest(artifacts.stored(spark, path), ["v1", "v2"]).collect()} == {("a", "v2"), ("b", "v1")}


def test_documents_of_deals(spark):
    rows = [(1, 2, True, "b", "u2", "", "Reno", "NV", "shops", None, 5.5), (1, 1, False, "a", "u1", None, None, "CA", "", "Bo", None), (1, 3, False, "a", "u3", "Third", None, None, None, None, 1e7), (2, 1, None, "c", None, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "d int, p int, r boolean, adapter string, url string, title string, city string, state string, industry string, broker_name string, asking_price double")
    got = {r.d: (r.adapters, r.title, r.location, r.document) for r in artifacts.deal_documents(df, "d", "p", "r").collect()}
    assert got == {1: (["a", "b"], "Third", "Reno, NV", "Third Reno, NV shops Bo u1 u2 u3 5.5 10000000"), 2: (["c"], None, None, "")}


def test_lines_at_the_last_position_each_give_a_row(spark, tmp_path):
    """Part keys above a million share positions with those of the next line number. The SQL leaves the order of such lines within a
    text open (``document_sha256``, and a title that both have), not their rows. A line without a part is no source."""
    import duckdb

    con = duckdb.connect()
    con.sql(f"""COPY (SELECT p_partkey, 'n' || p_partkey AS p_name, 'b' || p_partkey AS p_brand, 't' || p_partkey AS p_type, CAST(p_partkey % 7 + 1 AS INTEGER) AS p_size
        FROM (SELECT unnest([3, 5, 8, 1000005]) AS p_partkey)) TO '{tmp_path}/part.parquet'""")
    con.sql(f"""COPY (SELECT l[1] AS l_orderkey, l[2]::INTEGER AS l_linenumber, l[3] AS l_partkey FROM (SELECT unnest([[1, 1, 3], [1, 1, 1000005], [1, 2, 5], [2, 1, 1000005], [2, 2, 5], [2, 3, 8],
        [3, 1, 3], [3, 2, 8], [3, 7, 99], [NULL, 1, 3], [4, 6, 3], [4, 6, 3]]::BIGINT[][]) AS l)) TO '{tmp_path}/lineitem.parquet'""")
    for name in ("part", "lineitem"):
        con.sql(f"CREATE VIEW {name} AS FROM '{tmp_path}/{name}.parquet'")
    got = deal_documents(spark, str(tmp_path)).collect()
    want = con.sql(f"SELECT l_orderkey, adapters, title, location, document_sha256 FROM ({SQL["deal_documents"]})").fetchall()
    assert sorted(str((r.l_orderkey, r.adapters, r.location)) for r in got) == sorted(str((r[0], r[1], r[3])) for r in want)
    assert [r.l_orderkey for r in sorted(got, key=lambda r: r.l_orderkey)] == [1, 1, 2, 3, 4] and len({r.location for r in got if r.l_orderkey == 1}) == 2
    assert {tuple(r) for r in got if r.l_orderkey > 2} == {r for r in want if r[0] > 2}
