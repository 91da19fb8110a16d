"""Selectors pass over a page's elements once for each of their parts, however many elements they name."""

import re
import time

from pyspark.sql import functions as F

from basalt.functions import markup
from basalt.operators import listing_pages
from basalt.plans import listings

WAYS = ["article p, .x", ".x, article p, article p", "nav li a, p, article .x", "article article p", "em, article b", "nav p, p"]


def test_ways_of_a_selector_are_in_document_order_and_once(spark):
    html = "<p id=a>1<nav><ul><li><a id=b class=x>2</a></ul></nav><article id=c><p id=d class=x>3<article id=e><p id=f>4</article><b id=g class='y x'>5</b></article><p id=h class=x>6"
    dom = F.col("dom")
    pages = markup.with_dom(spark.createDataFrame([(html,), (None,), ("no tags",)], "html string"))
    got = pages.select(*(F.transform(markup.select(dom["elements"], w), lambda e: e["id"]).alias(str(k)) for k, w in enumerate(WAYS))).collect()
    assert list(got[0]) == [list("bdfgh"), list("bdfgh"), list("abdfgh"), ["f"], ["g"], list("adfh")]
    assert all(list(r) == [[]] * len(WAYS) for r in got[1:])
    none = pages.select(markup.select(F.when(F.lit(False), dom["elements"]), "article p, .x").alias("x"))
    assert [r.x for r in none.collect()] == [None] * 3


def test_a_long_page_costs_no_more_than_its_length(spark):
    html = "<body><h1> Inn </h1><article>" + "<p>A room above the harbour, with a view of the boats and of the <b>old</b> mill.</p>" * 400 + "</article><p>Price: $900</p>"
    pages = spark.createDataFrame([(html,)], "html string")
    began = time.time()
    got = [r.listing for r in listing_pages.plain(pages).collect()]
    assert time.time() - began < 30
    assert [(x.title, x.asking_price, x.description) for x in got] == [("Inn", 900.0, "A room above the harbour, with a view of the boats and of the old mill.")]


def test_fields_share_what_is_selected(spark):
    found = listing_pages.plain(spark.createDataFrame([("<p>",)], "html string"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"filter\(_dom#\d+\.elements", plan)) <= 12  # seven selections, one of them within another, and the body, which is named four times
    assert len(re.findall(r"regexp_extract\(_x_body#", plan)) <= 6  # four amounts, and a place that is looked for where none is marked


def test_blocks_go_in_after_pages_are_dealt_out(spark, small):
    plan = listings.listing_plain(spark, small)._jdf.queryExecution().optimizedPlan().toString()
    above, _, below = plan.partition("Repartition ")
    assert "<article>" in above and below and "<article>" not in below
