"""References to listings out of structured parts of pages, and their union."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from basalt.functions import urls
from basalt.functions.markup import WS

#: Objects with an address, in the order in which a walk meets them.
FOUND = ArrayType(StructType([StructField("url", StringType()), StructField("product", StringType())]))
BLOCKS = r"""(?is)<script[^>]*type=["']application/ld\+json["'][^>]*>(.*?)</script>"""


def _met(root: object) -> list[dict]:
    """A list's elements and an object's item are met before the object itself, and that before its other members; each once."""
    out, todo, entered = [], [root], set()
    while todo:
        node = todo.pop()
        if isinstance(node, tuple):  # an object whose elements and item have been met
            (node,) = node
            url = next((node[k] for k in ("url", "@id") if isinstance(node.get(k), str)), None)
            if url is not None:
                product = node.get("productId")
                if isinstance(product, float) and product.is_integer():
                    product = int(product)
                out.append({"url": url, "product": None if product is None else str(product)})
            todo += list(node.values())[::-1]
        elif isinstance(node, list):
            todo += node[::-1]
        elif isinstance(node, dict) and id(node) not in entered:
            entered.add(id(node))
            elements = node.get("itemListElement")
            listed = elements if node.get("@type") in ("ItemList", ["ItemList"]) and isinstance(elements, list) else []
            todo += [(node,), node.get("item"), *listed[::-1]]
    return out


@F.pandas_udf(FOUND)
def _objects(blocks: pd.Series) -> pd.Series:
    def of(texts) -> list[dict]:
        found: list[dict] = []
        for text in texts if texts is not None else ():
            try:
                found += _met(json.loads(text))
            except (ValueError, RecursionError):  # a block that is no JSON, or too deep to read, tells nothing
                continue
        return found

    return blocks.map(of)


def linked_data_refs(html: Column, kept: Callable[[Column], Column] | None = None, normal: Callable[[Column], Column] | None = None, id_of: Callable[[Column], Column] | None = None) -> Column:
    """``url, external_id`` of every object with an address and an id in a page's linked data, each id once, in the order of the
    walk. The id is the product's as it stands, unless that is blank, else what ``id_of`` finds in the address (six digits or
    more). Addresses must be ``kept`` before and after they are made ``normal``. Null pages have none."""
    number = id_of or (lambda u: F.regexp_extract(u, "([0-9]{6,})", 1))
    found = _objects(F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(BLOCKS), F.lit(1)))
    if kept:
        found = F.filter(found, lambda r: kept(r["url"]))

    def ref(r: Column) -> Column:
        url = normal(r["url"]) if normal else r["url"]
        own = F.when(~r["product"].rlike(f"^{WS}*$"), r["product"])
        return F.struct(url.alias("url"), F.coalesce(own, number(url)).alias("external_id"))

    def once(refs: Column) -> Column:
        ids = F.transform(refs, lambda r: r["external_id"])
        return F.filter(refs, lambda r, i: F.array_position(ids, r["external_id"]) == i + 1)

    refs = F.filter(F.transform(found, ref), lambda r: (r["url"] != "") & (r["external_id"] != "") & (kept(r["url"]) if kept else F.lit(True)))
    return F.element_at(F.transform(F.array(refs), once), 1)  # bound, as a lambda may not hold a Python function


def search_results(body: Column) -> Column:
    """The organic results of a search service's JSON response, as an array of ``link, title``."""
    return F.from_json(body, "organic array<struct<link:string,title:string>>")["organic"]


def sitemap(xml: Column) -> Column:
    """The distinct addresses of a sitemap."""
    return F.array_distinct(F.transform(F.regexp_extract_all(xml, F.lit("(?i)<loc>([^<]+)</loc>"), F.lit(1)), lambda x: F.trim(x)))


def ref_key(url: Column, external_id: Column | None = None) -> Column:
    """What a reference is known by: its id, the id in its URL, or its URL."""
    known = F.coalesce(F.when(external_id != "", external_id), urls.external_id(url)) if external_id is not None else urls.external_id(url)
    return F.coalesce(F.concat(F.lit("id:"), known), F.concat(F.lit("url:"), url))


def merged(parts: list[DataFrame], order: list[str]) -> DataFrame:
    """``key, url``: the union of references (``url, external_id`` and the order's columns), where that of an earlier part,
    then the earlier one, stands for its key."""
    rows = None
    for i, part in enumerate(parts):
        one = part.select(ref_key(F.col("url"), F.col("external_id")).alias("key"), F.struct(F.lit(i).alias("part"), *order, "url").alias("x"))
        rows = one if rows is None else rows.unionByName(one)
    return rows.groupBy("key").agg(F.min("x")["url"].alias("url"))
