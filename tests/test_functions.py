from pyspark.sql import functions as F

from basalt.functions import contact, parse, text, urls
from basalt.operators import discovery, ingest, pages, references, resolution, robots, search, state, workspace
from basalt.sources import tables


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column.alias("y")).first().y


def test_urls(spark):
    assert one(spark, "HTTPS://A.Example/x?b=2&a=1#f", urls.normalized("x")) == "https://a.example/x?a=1&b=2"
    assert one(spark, "not a url", urls.normalized("x")) == "not a url"
    assert one(spark, "https://m.a.example/en/12345.html?x=1", urls.external_id("x")) == "12345"
    assert one(spark, "https://a.example/list", urls.with_page("x", F.lit(2))) == "https://a.example/list?page=2"
    assert one(spark, "https://a.example/list?page=2&q=1", urls.with_page("x", F.lit(3))) == "https://a.example/list?page=3&q=1"
    assert one(spark, None, urls.adapter("x")) == "unknown"


def test_parse(spark):
    assert one(spark, "$1,234.50", parse.money("x")) == 1234.5
    assert one(spark, "Not Disclosed", parse.money("x")) is None
    assert one(spark, "$1 - $2", parse.money("x")) is None and one(spark, "\u2014", parse.money("x")) is None
    assert one(spark, "$1.5m", parse.money_scaled("x")) == 1_500_000
    assert one(spark, "1.2.3", parse.money_rounded("x")) == 1
    assert one(spark, "est. 1998", parse.year("x")) == 1998
    assert tuple(one(spark, "City of X, CA", parse.city_state("x"))) == ("City of X", "CA")
    assert tuple(one(spark, "nowhere", parse.city_state("x"))) == (None, None)


def test_scores(spark):
    row = spark.sql("SELECT array(1D, 0D) AS a, array(0D, 1D) AS b, array() AS e, 'CA' AS s, '' AS n")
    got = row.select(
        resolution.embedding_score(F.col("a"), F.col("b")).alias("e"), resolution.geo_score(F.col("s"), F.col("n")).alias("g"), resolution.geo_score(F.col("s"), F.col("s")).alias("h"),
        text.jaccard(F.array(), F.array()).alias("j"), resolution.decision(resolution.composite(F.lit(1.0), F.lit(1.0), F.lit(0.5))).alias("d"),
        resolution.numeric_score([(F.lit(0.0), F.lit(5.0))]).alias("n"),
    ).first()
    assert tuple(got) == (0.5, 0.5, 1.0, 0.0, "auto_merge", 0.5)


def test_blocking_loses_no_pair(spark):
    import itertools
    import random

    random.seed(3)
    rows = [(i, "a", " ".join(random.choices("red blue old new cold ring rod gear".split(), k=random.randint(1, 4)))) for i in range(60)]
    df = spark.createDataFrame(rows, "seq long, block string, title string")
    got = {(r.l_seq, r.r_seq) for r in resolution.candidate_pairs(df, "block", "title", "seq", 0.53125).filter("lexical >= 0.53125").collect()}
    sets = {i: set(t.split()) for i, _, t in rows}
    assert got == {(i, j) for i, j in itertools.combinations(range(60), 2) if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.53125}


def test_prepare():
    p = search.prepare("Hvac ecom, TX!", {"ecom": "ecommerce", "hvac": "heating cooling"}, {"tx": ("texas",)})
    assert p.tokens == ("heating cooling", "ecommerce", "tx") and p.relaxed == ("heating", "cooling", "ecommerce", "tx", "texas")


def test_state(spark):
    rows = [(1, 1, "ingested"), (1, 2, "skipped_known"), (2, 1, "failed"), (2, 2, "skipped_fresh"), (3, 1, "failed"), (3, 2, "failed")]
    df = spark.createDataFrame(rows, "k int, at int, status string")
    assert {r.k: r.status for r in state.without_downgrades(df, "k", ["at"]).collect()} == {1: "ingested", 2: "skipped_fresh", 3: "failed"}
    assert {r.k: r.attempts for r in state.attempts(df, "k", ["at"]).collect()} == {2: 1, 3: 2}


def test_upsert_keeps_what_is_fixed(spark):
    old, new = (spark.createDataFrame(x, "k int, created string, v int") for x in ([(1, "a", 1), (2, "b", 2)], [(2, "c", 3), (3, "d", None)]))
    assert sorted(map(tuple, workspace.upserted(old, new, ["k"], ["created"], ["v"]).collect())) == [(1, "a", 1), (2, "b", 3), (3, "d", None)]


def test_stale_stop(spark):
    df = spark.createDataFrame([("w", 1, 5, 5), ("w", 2, 5, 0), ("w", 3, 0, 0), ("w", 4, 5, 0), ("w", 5, 1, 1)], "w string, p int, r int, n int")
    assert discovery.stale_stop(df, "w", "p", "r", "n").first().stop_page == 4


def test_evidence_is_put_once(spark, tmp_path):
    df = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "y")], "adapter string, body string")
    for _ in range(2):
        tables.put_evidence(df, str(tmp_path / "store"), "adapter", "body")
    assert spark.read.parquet(str(tmp_path / "store")).count() == 2


def test_checkpoint_round_trip(spark, tmp_path):
    refs = spark.createDataFrame([(1, "u1", "1"), (0, "u0", None)], "seq int, url string, external_id string")
    tables.write_checkpoint(refs, str(tmp_path / "c"), 1, "a")
    assert [tuple(r) for r in tables.read_checkpoint(spark, str(tmp_path / "c"), 1, "a").orderBy("seq").collect()] == [(0, "u0", None), (1, "u1", "1")]


def test_chains_do_not_join_what_is_unlike_the_representative(spark):
    records = spark.createDataFrame([(i,) for i in range(1, 6)], "seq long")
    pairs = spark.createDataFrame([(1, 2, 0.9), (2, 3, 0.95), (3, 4, 0.86), (1, 4, 0.85), (1, 5, 0.9), (3, 5, 0.9)], "l long, r long, score double")
    got = {r.seq: (r.canonical, r.action) for r in ingest.ingested(records, pairs).collect()}
    assert got == {1: (1, "new"), 2: (1, "merged"), 3: (3, "new"), 4: (3, "merged"), 5: (1, "merged")}
    assert ingest.ingested(records.limit(0), pairs.limit(0)).count() == 0


def test_ingest_equals_one_by_one(spark):
    import random

    random.seed(5)
    scores = {(i, j): random.choice([0.8, 0.85, 0.9, 0.95]) for j in range(80) for i in range(j) if random.random() < 0.1}
    reps, wanted = [], {}
    for j in range(80):
        best = max(((scores[i, j], -i) for i in reps if scores.get((i, j), 0) >= 0.85), default=None)
        wanted[j] = -best[1] if best else j
        if best is None:
            reps.append(j)
    records = spark.createDataFrame([(i,) for i in range(80)], "seq long")
    pairs = spark.createDataFrame([(i, j, s) for (i, j), s in scores.items()], "l long, r long, score double")
    assert {r.seq: r.canonical for r in ingest.ingested(records, pairs).collect()} == wanted


def test_linked_data(spark):
    html = """<script type='application/ld+json'>{"a":[{"url":"u/7654321","productId":" "},{"@id":"v","productId":9},{"url":"w"},{"url":"x/7654321"}]}</script><script type="application/ld+json">{no</script>"""
    assert [tuple(r) for r in one(spark, html, references.linked_data_refs(F.col("x")))] == [("u/7654321", "7654321"), ("v", "9")]
    assert one(spark, None, references.linked_data_refs(F.col("x"))) == []
    assert one(spark, "<LOC> a11 </LOC><loc>a11</loc>", references.sitemap(F.col("x"))) == ["a11"]


def test_robots(spark):
    body = "user-agent: a\nuser-agent: *\nDisallow: /\nAllow: /x # y\nCrawl-delay: 0.5\nUser-agent: *\nDisallow: /x\n"
    rules, delays = robots.policies(spark.createDataFrame([("s", body), ("t", None)], "site string, body string"), "site", "body", "zed")
    asked = spark.createDataFrame([("s", "/x/1"), ("s", "/y"), ("t", "/y"), ("s", None)], "site string, path string")
    got = {(r.site, r.path): r.allowed for r in robots.allowed(asked, rules, "site", "path").collect()}
    assert got == {("s", "/x/1"): True, ("s", "/y"): False, ("t", "/y"): True, ("s", None): True}
    assert [tuple(r) for r in delays.collect()] == [("s", 500)]
    one_site = spark.createDataFrame([("/", True), ("/de/", False), ("/de/1", True)], "prefix string, allow boolean")
    met = pages.robots_allowed(spark.createDataFrame([(1, "/de/2"), (1, "/de/2"), (2, "/de/12"), (3, "")], "id long, path string"), one_site, "path", "id")
    assert sorted(tuple(r) for r in met.collect()) == [(1, "/de/2", False), (1, "/de/2", False), (2, "/de/12", True), (3, "", True)]


def test_contacts(spark):
    assert one(spark, "Business listed by: A  B\n<script>", contact.person("x")) == "A B"
    assert one(spark, "Contact form", contact.person("x")) is None and one(spark, None, contact.person("x")) is None
    assert one(spark, "a b@c.de", contact.internal_user("x")) is True and one(spark, "b@c.de", contact.internal_user("x")) is False
    assert one(spark, "|| ,", contact.or_clause("x")) is None and one(spark, "a|b c-d", contact.or_clause("x")) == "a | b | cd"
    assert one(spark, "+1 (555) 123-4567", contact.plausible_phone("x")) is True
    assert one(spark, "$1,234.5 asking", contact.money_on_request("x")) == 1235
    assert one(spark, None, contact.shown_money(F.col("x").cast("double"))) == "—" and one(spark, "-0.4", contact.shown_money(F.col("x").cast("double"))) == "-$0"
    assert one(spark, "120000", contact.shown_duration("x")) == "2m" and one(spark, "999", contact.shown_duration("x")) == "999ms"


def test_states_and_stores(spark):
    now = F.to_timestamp(F.lit("2024-01-02 00:00:00"))
    rows = spark.createDataFrame([("ingested", "2024-01-01 12:00:00"), ("failed", "2024-01-01 12:00:00"), ("ingested", None), (None, None)], "s string, at string").withColumn("at", F.to_timestamp("at"))
    assert [r.k for r in rows.select(ingest.skip(F.col("s"), F.col("at"), now, 24).alias("k")).collect()] == ["skipped_fresh", None, None, None]
    assert [r.k for r in rows.select(ingest.skip(F.col("s"), F.col("at"), now, 0, skip_known=True).alias("k")).collect()] == ["skipped_known", None, "skipped_known", None]
    a, b = (spark.createDataFrame(x, "k string, v string") for x in ([("x", None)], [("x", "2"), ("y", "3")]))
    assert sorted(tuple(r) for r in ingest.composite([a, b], "k", "v").collect()) == [("x", 0, None), ("y", 1, "3")]
    paths = spark.createDataFrame([("w/a",), ("w/../a",), ("w/_snapshots/a",), ("v/a",)], "p string")
    assert [r.p for r in workspace.under(paths, "p", "w/").collect()] == ["w/a"]
    empty = spark.createDataFrame([], "price double")
    assert [tuple(r) for r in workspace.violations(empty, {"some": F.col("price") > 0}).collect()] == [("some", 0)]


def test_robots_with_tabs_and_a_hot_site(spark):
    """Tabs and other white space around names and values; one site of many paths, one without rules, repeated requests."""
    body = "User-agent:\t*\n\tDisallow :\t/x \nAllow: /x/open\t# why\nDisallow:\t\nCrawl-delay:\t2\n"
    rules, delays = robots.policies(spark.createDataFrame([("s", body)], "site string, body string"), "site", "body", "zed")
    assert {(r.prefix, r.allow) for r in rules.collect()} == {("/x", False), ("/x/open", True)} and delays.first().delay_ms == 2000
    asked = [("s", f"/x/{k}") for k in range(500)] + [("s", "/x/open/1"), ("s", "/x/open/1"), ("s", "/"), ("t", "/x"), (None, "/x"), ("s", None)]
    got = robots.allowed(spark.createDataFrame(asked, "site string, path string"), rules, "site", "path")
    assert got.columns == ["site", "path", "allowed"] and got.count() == len(asked) and got.filter("NOT allowed").count() == 500


def test_linked_data_order_filters_and_ids(spark):
    """An item comes before its list's own address; ids keep their spaces; whole numbers have no point; filters hold twice."""
    html = """<script type="application/ld+json">{"@type":"ItemList","url":"https://a.example/list/1111111","itemListElement":[
        {"url":"https://m.a.example/7654321","item":{"url":"https://m.a.example/2222222","productId":" 9 "}},{"@id":"https://b.example/3333333"},{"url":"https://m.a.example/x","productId":9.0},{"url":"https://m.a.example/7654321?again"}]}</script>"""
    got = one(spark, html, references.linked_data_refs(F.col("x")))
    assert [tuple(r) for r in got] == [("https://m.a.example/2222222", " 9 "), ("https://m.a.example/7654321", "7654321"), ("https://b.example/3333333", "3333333"), ("https://m.a.example/x", "9"), ("https://a.example/list/1111111", "1111111")]
    some = references.linked_data_refs(F.col("x"), lambda u: u.contains("a.example/"), lambda u: F.regexp_replace(u, "//m\\.", "//www."), lambda u: F.regexp_extract(u, "/([0-9]+)$", 1))
    assert [tuple(r) for r in one(spark, html, some)] == [("https://www.a.example/2222222", " 9 "), ("https://www.a.example/7654321", "7654321"), ("https://www.a.example/x", "9"), ("https://a.example/list/1111111", "1111111")]


def test_verdicts_on_responses(spark):
    cases = [
        (200, "fine", "ok", None, "ok"), (429, "x", "rate_limited", None, "retry_http"), (403, "x", "challenge", "thin_challenge_page", "persist_needs_browser"), (503, "x", "block", None, "persist_needs_browser"), (503, "Captcha", "challenge", "thin_challenge_page", "persist_needs_browser"),
        (200, "captcha" + " " * 3000, "ok", None, "ok"), (403, "<TITLE>Access Denied</TITLE>" + " " * 3000, "challenge", "http_forbidden", "persist_needs_browser"), (200, "Access Denied. Reference #18.ab", "ok", "akamai_hard_denial", "fail_hard"),
        (200, "automated bot" + " " * 3000, "ok", None, "ok"), (200, "an automated bot: activity on your network" + " " * 3000, "ok", "datadome_challenge", "ok"), (403, "Just a moment" + " " * 3000, "challenge", "http_forbidden", "persist_needs_browser"), (200, None, "ok", None, "ok"),
    ]
    rows = spark.createDataFrame([(i, c[0], c[1]) for i, c in enumerate(cases)], "i int, status int, body string")
    got = rows.select("i", pages.waf_class(F.col("status"), F.col("body")), pages.page_block(F.col("status"), F.col("body")), pages.http_plan(F.col("status"), F.col("body"), F.lit(0), F.lit(2))).orderBy("i").collect()
    assert [tuple(r)[1:] for r in got] == [c[2:] for c in cases]
    plans = rows.filter("i IN (2, 7)").select("i", *(pages.browser_plan(F.col("status"), F.col("body"), F.lit(k), F.lit(2)) for k in (0, 1))).orderBy("i").collect()
    assert [tuple(r)[1:] for r in plans] == [("retry_browser", "fail_hard"), ("fail_hard", "fail_hard")]
    assert one(spark, "fetch it", pages.transient_error(F.col("x"), cause=F.lit("Socket Hang Up"))) is True and one(spark, None, pages.transient_error(F.col("x"), F.col("x"))) is False


def test_scaled_money_rounds_halves_as_its_sql_does(spark, tmp_path):
    import duckdb

    from basalt.plans import catalogue

    where = str(tmp_path / "customer.parquet")
    amounts = spark.createDataFrame([(i, x) for i, x in enumerate((9825.0, 8495.0, 9325.0, 2675.0, 1005.0, 125.0, 0.0, 9999.99))], "c_custkey long, c_acctbal double")
    amounts.coalesce(1).write.parquet(where)
    wanted = duckdb.connect().sql(catalogue.SQL["parse_money_scaled"].replace("FROM customer", f"FROM '{where}/*.parquet'")).fetchall()
    assert sorted(map(tuple, catalogue.parse_money_scaled(spark, str(tmp_path)).collect())) == sorted(wanted)
