"""What a page's linked data says of each type: products, businesses, breadcrumbs, persons, offers.

A small pass lists every object of a page's blocks in the order of a walk, with its types and its plain members. The rules
(of which type, which member, whether the first or the last one counts) are expressions over that list.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from basalt.functions import markup, parse

#: An object: how deep it lies, its types, its strings and numbers (those of an object in it as ``member.name``), the offers'
#: prices, and the names of its list's items (of the item's own object, else its own).
OBJECTS = "array<struct<depth:int,types:array<string>,strings:map<string,string>,numbers:map<string,double>,offers:array<struct<text:string,number:double>>,items:array<string>>>"
BLOCKS = r"""(?is)<script[^>]*type=["']application/ld\+json["'][^>]*>(.*?)</script>"""

# Names of states and their codes.
STATES = {
    "alabama": "AL", "alaska": "AK", "arizona": "AZ", "arkansas": "AR", "california": "CA", "colorado": "CO", "connecticut": "CT", "delaware": "DE", "florida": "FL", "georgia": "GA",
    "hawaii": "HI", "idaho": "ID", "illinois": "IL", "indiana": "IN", "iowa": "IA", "kansas": "KS", "kentucky": "KY", "louisiana": "LA", "maine": "ME", "maryland": "MD",
    "massachusetts": "MA", "michigan": "MI", "minnesota": "MN", "mississippi": "MS", "missouri": "MO", "montana": "MT", "nebraska": "NE", "nevada": "NV", "new hampshire": "NH", "new jersey": "NJ",
    "new mexico": "NM", "new york": "NY", "north carolina": "NC", "north dakota": "ND", "ohio": "OH", "oklahoma": "OK", "oregon": "OR", "pennsylvania": "PA", "rhode island": "RI", "south carolina": "SC",
    "south dakota": "SD", "tennessee": "TN", "texas": "TX", "utah": "UT", "vermont": "VT", "virginia": "VA", "washington": "WA", "west virginia": "WV", "wisconsin": "WI", "wyoming": "WY",
}


def _plain(node: dict, prefix: str, strings: dict, numbers: dict) -> None:
    for k, v in node.items():
        if isinstance(v, str):
            strings[prefix + k] = v
        elif isinstance(v, (int, float)) and not isinstance(v, bool):
            numbers[prefix + k] = float(v)


def _listed(root: object) -> list[dict]:
    out, todo = [], [(root, 0)]
    while todo:  # a stack, so that no nesting is too deep
        node, depth = todo.pop()
        if isinstance(node, list):
            todo += [(x, depth) for x in reversed(node)]
            continue
        if not isinstance(node, dict):
            continue
        types, strings, numbers = node.get("@type"), {}, {}
        _plain(node, "", strings, numbers)
        for k, v in node.items():
            if isinstance(v, dict):
                _plain(v, f"{k}.", strings, numbers)
        offers = node.get("offers")
        prices = [o.get("price") for o in (offers if isinstance(offers, list) else [offers]) if isinstance(o, dict)]
        names = []
        for item in node["itemListElement"] if isinstance(node.get("itemListElement"), list) else ():
            if isinstance(item, dict):
                inner = item["item"].get("name") if isinstance(item.get("item"), dict) else None
                names.append(next((x for x in (inner, item.get("name")) if isinstance(x, str)), None))
        out.append(
            {
                "depth": depth, "types": [t for t in (types if isinstance(types, list) else [types]) if isinstance(t, str)], "strings": strings, "numbers": numbers,
                "offers": [{"text": p if isinstance(p, str) else None, "number": float(p) if isinstance(p, (int, float)) and not isinstance(p, bool) else None} for p in prices],
                "items": [n for n in names if n],
            }
        )
        todo += [(x, depth + 1) for x in reversed(list(node.values()))]
    return out


def _objects(blocks: pd.Series) -> pd.Series:
    def of(texts) -> list[dict]:
        out = []
        for text in texts if texts is not None else ():
            try:
                out += _listed(json.loads(text))
            except (ValueError, RecursionError):  # a block that is no JSON, or too deep to read, tells nothing
                continue
        return out

    return blocks.map(of)


def objects(html: Column) -> Column:
    """All objects in a page's linked data, in the order of a walk that sees an object before its members."""
    return F.pandas_udf(_objects, OBJECTS)(F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(BLOCKS), F.lit(1)))


def of_type(found: Column, kind: str) -> Column:
    return F.filter(found, lambda o: F.array_contains(o["types"], kind))


def strings(found: Column, member: str) -> Column:
    """The strings of a member over a list of objects."""
    return F.filter(F.transform(found, lambda o: F.try_element_at(o["strings"], F.lit(member))), lambda x: x.isNotNull())


def first(found: Column, member: str) -> Column:
    """The first that isn't empty."""
    return F.get(F.filter(strings(found, member), lambda x: x != ""), F.lit(0))


def last(found: Column, member: str) -> Column:
    return F.try_element_at(strings(found, member), F.lit(-1))


def state_code(name: Column) -> Column:
    """The code of a state's name; two letters in upper case; null for others."""
    key = F.lower(markup.trimmed(name))
    known = F.create_map(*(F.lit(x) for pair in STATES.items() for x in pair))
    return F.when(F.length(key) == 2, F.upper(key)).otherwise(F.try_element_at(known, key))


def listing(found: Column, brand: str = "") -> dict[str, Column]:
    """A listing's fields out of products (first name, last category, description, id and tagline, all images), businesses (last
    place, first description) and breadcrumbs without the site's own."""
    products, business = of_type(found, "Product"), of_type(found, "LocalBusiness")
    name = first(products, "name")
    short = markup.trimmed(F.substring_index(name, f" - {brand}", 1)) if brand else name
    crumbs = F.flatten(F.transform(of_type(found, "BreadcrumbList"), lambda o: o["items"]))
    crumbs = F.filter(crumbs, lambda x: (x != brand) & ~x.contains("Business For Sale"))
    categories = F.filter(crumbs, lambda x: ~x.rlike("(?i)businesses for sale") & (F.length(x) < 80))
    categories = F.when(F.size(categories) > 0, categories)
    city, region = last(business, "address.addressLocality"), last(business, "address.addressRegion")
    region = F.when(region != "", region)
    state = F.when(F.length(region) == 2, F.upper(region)).otherwise(F.coalesce(state_code(region), region))
    images = strings(products, "image")
    return {
        "title": F.coalesce(markup.filled(short), name),
        "category": F.coalesce(last(products, "category"), F.array_join(categories, " > ")),
        "categories": categories,
        "final_category": F.try_element_at(categories, F.lit(-1)),
        "listing_id": last(products, "productid"),
        "images": F.when(F.size(images) > 0, images),
        "tagline": last(products, "alternateName"),
        "city": F.when(city != "", city),
        "state_name": region,
        "state": state,
        "location": F.when(city != "", F.concat(city, F.lit(", "), state)),
        "description": F.substring(F.coalesce(first(business, "description"), markup.filled(last(products, "description"))), 1, 50_000),
    }


def offers(found: Column) -> dict[str, Column]:
    """Of the outermost objects the first name and the first price that isn't 0, of numbers and texts alike."""
    top = F.filter(found, lambda o: o["depth"] == 0)
    prices = F.flatten(F.transform(top, lambda o: F.transform(o["offers"], lambda p: F.coalesce(p["number"], parse.money_rounded(p["text"])))))
    prices = F.filter(prices, lambda x: x.isNotNull())
    priced = F.coalesce(F.get(F.filter(prices, lambda x: x != 0), F.lit(0)), F.try_element_at(prices, F.lit(-1)))
    return {"title": markup.trimmed(first(top, "name")), "price": priced}


def person(found: Column) -> dict[str, Column]:
    """Name, firm, about and address of the first person among the outermost objects."""
    one = F.get(F.filter(found, lambda o: (o["depth"] == 0) & F.array_contains(o["types"], "Person")), F.lit(0))

    def member(name: str) -> Column:
        return F.try_element_at(one["strings"], F.lit(name))

    return {"name": member("name"), "firm": member("worksFor.name"), "about": F.coalesce(member("description"), member("worksFor.description")), "url": member("url")}
