"""Listings and brokers' profiles out of whole pages, by shape of page.

Pages get their trees and linked data in one pass each; a shape is then a set of expressions: selectors, label tables
and which source comes first. Every function takes pages with an address and markup, keeps all their columns and adds
one struct; nothing is shuffled. A null page, and one without what a field asks for, has null there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basalt.functions import contact, markup, parse, url_rules, urls
from basalt.functions.markup import filled, first, select, squeezed, text, trimmed, within
from basalt.operators import linked_data

# Labels of the pages' tables and the fields that they fill.
AMOUNTS = {"asking_price": ("asking price", "price"), "revenue": ("gross revenue", "revenue"), "cash_flow": ("cash flow (sde)", "cash flow"), "ebitda": ("ebitda",)}
ESTABLISHED = ("established",)
DETAILS = {
    "facilities": ("facilities",), "competition": ("competition",), "growth_and_expansion": ("growth & expansion",), "financing": ("financing",), "support_and_training": ("support & training",),
    "home_based": ("home-based",), "franchise": ("franchise",), "real_estate": ("real estate",), "building_sf": ("building sf", "building square feet"), "reason_for_selling": ("reason for selling",),
    "seller_type": ("seller type",), "number_of_employees": ("number of employees", "employees"), "industry": ("industry",), "location": ("location",),
    "inventory": ("inventory",), "rent": ("rent",), "ffe": ("furniture, fixtures, & equipment (ff&e)", "ff&e"),
}
FACTS = ("Asking Price", "Annual Revenue", "Net Profit", "Cash Flow", "Total Debt", "FF&E", "Real Estate", "Year Established", "Employees", "BBN Listing #")
HELP, INCLUDED = "i.help, .help", "(?i)included in asking price"
LONG, SHORT = 50_000, 8_000


def _dom() -> Column:
    return F.col("_dom")


def _all(selector: str, scope: Column | None = None) -> Column:
    return select(_dom()["elements"] if scope is None else within(_dom(), scope), selector)


def _one(selector: str, scope: Column | None = None) -> Column:
    return first(_all(selector, scope))


def _text(element: Column) -> Column:
    """Trimmed, null for none and for blank."""
    return filled(trimmed(text(_dom(), element)))


def _line(element: Column) -> Column:
    return filled(squeezed(text(_dom(), element)))


def _place(whole: Column) -> dict[str, Column]:
    """City and state of ``City, ST``, the state of ``ST``."""
    both = parse.city_state(whole)
    return {"city": both["city"], "state": F.coalesce(both["state"], F.when(whole.rlike("^[A-Z]{2}$"), whole)), "location": whole}


def _absolute(href: Column, base: str | Column) -> Column:
    base = F.lit(base) if isinstance(base, str) else base
    return F.when(href.startswith("//"), F.concat(F.regexp_extract(base, "^([A-Za-z][A-Za-z0-9+.-]*:)", 1), href)).otherwise(urls.resolved(href, base))


def _f(name: str) -> Column:
    """A field that an earlier step has found."""
    return F.col(f"_x_{name}")


def _parsed(pages: DataFrame, html: str, steps: list[dict[str, Column]], into: str, linked: bool = False, hidden: tuple[str, ...] = ()) -> DataFrame:
    """Adds a struct of the fields of all steps but the hidden ones. A later step may name what an earlier one has found (``_f``),
    and has the last word on fields that both have. Each field is a column until the end, so that it is computed once."""
    rest = [F.col(f"_row.`{c}`").alias(c) for c in pages.columns if c != into]
    df = markup.with_dom(pages.select(F.struct("*").alias("_row"), F.col(html).alias("_html")), "_html", "_dom")
    if linked:
        df = df.withColumn("_ld", linked_data.objects(F.col("_html")))
    known: dict[str, None] = {}
    for step in steps:
        df = df.withColumns({f"_x_{k}": v for k, v in step.items()})
        known = dict.fromkeys([*known, *step])
    return df.select(*rest, F.struct(*(_f(k).alias(k) for k in known if k not in hidden)).alias(into))


def _labelled(found: Column, labels: tuple[str, ...], value) -> Column:
    """The value of the last pair with one of the labels, as ``value`` reads it."""
    return F.try_element_at(F.transform(F.filter(found, lambda p: p["label"].isin(*labels)), value), F.lit(-1))


def _joined(lines: Column) -> Column:
    return F.array_join(lines, " | ")


def market(pages: DataFrame, url: str = "url", html: str = "html", site: str = "bizbuysell", base: str = "https://www.bizbuysell.com", brand: str = "BizBuySell", images: str = "images.bizbuysell.com", into: str = "listing") -> DataFrame:
    """Pages with rows of amounts, lists of details and a broker's card. The heading comes before the linked data's name,
    the linked data's description before the page's; of equal labels the last one counts."""
    rules = [r for r in url_rules.SITES if r.site == site]
    address = F.col(f"_row.{url}")
    ld = linked_data.listing(F.col("_ld"), brand)
    own_id = url_rules.reference(address, rules)["external_id"]
    rows = markup.pairs(_dom(), _all("p.m-listing-row"), "span.title", "span.normal, span.price", HELP)
    terms = F.concat(
        _all("#dlDetailedInformation dt"), _all("#dlLocationInformation dt"),
        F.filter(_all("dl.listingProfile_details dt"), lambda t: ~F.exists(_all("#dlDetailedInformation, #dlLocationInformation"), lambda o: (o["at"] < t["at"]) & (t["at"] <= o["last"]))),
    )
    begin = {"rows": rows, "details": markup.definitions(_dom(), terms, "span.normal", HELP), "listing_id": F.coalesce(own_id, ld["listing_id"])}
    head = F.coalesce(_text(_one("h1")), ld["title"], _text(_one("span.h3.hidden")), filled(trimmed(F.substring_index(_text(_one("title")), "|", 1))))
    rows, details = _f("rows"), _f("details")
    fields = {
        "external_id": _f("listing_id"),
        "title": head,
        "tagline": F.coalesce(ld["tagline"], _text(_one("span.profileAdLine"))),
        "description": F.coalesce(ld["description"], F.substring(_line(_one(".businessDescription")), 1, LONG)),
        "link": address,
    }
    for name, labels in AMOUNTS.items():
        fields[name] = _labelled(rows, labels, lambda p: parse.money(p["value"]))
    fields["asking_price"] = F.coalesce(fields["asking_price"], parse.money(squeezed(text(_dom(), _one(".asking-price, .business-price, [class*='asking-price']")))))
    fields["year_established"] = _labelled(rows, ESTABLISHED, lambda p: parse.year(p["value"]))
    for name, labels in DETAILS.items():
        fields[name] = _labelled(details, labels, lambda p: _joined(p["lines"]))
    for name in ("inventory", "ffe"):
        hit = F.exists(_labelled(details, DETAILS[name], lambda p: p["lines"]), lambda x: x.rlike(INCLUDED))
        fields[f"{name}_included"] = F.when(hit, True)
    fields["inventory_value"] = parse.money(fields["inventory"])
    fields["rent_amount"] = parse.money(fields["rent"])
    mapped = [x for labels in DETAILS.values() for x in labels]
    more = F.filter(details, lambda p: ~p["label"].isin(*mapped))
    names = F.array_distinct(F.transform(more, lambda p: p["label"]))
    fields["extra"] = F.map_from_arrays(names, F.transform(names, lambda n: _joined(F.try_element_at(F.filter(more, lambda p: p["label"] == n), F.lit(-1))["lines"])))
    pictures = F.array_distinct(F.filter(F.transform(_all("#slider img.image, .listing-img img, img.mainPhoto-print"), lambda e: markup.attr(e, "src")), lambda x: x.contains(images)))
    fields["images"] = F.when(F.size(pictures) > 0, pictures).otherwise(ld["images"])
    badge = _text(_one(".listing-status, .status-badge, [class*='sale-pending']"))
    fields["status"] = F.when(badge.rlike("(?i)sale pending"), "Sale Pending").when(badge.rlike("(?i)sold"), "Sold").when(badge.rlike("(?i)active"), "Active")

    card = F.coalesce(_one(".broker .broker-card"), _one(".broker"), _one("#contactForm, #contactSellerForm"))
    scope = {"card": card}
    card = _f("card")
    caption = first(F.filter(_all("span", card), lambda e: text(_dom(), e).rlike("(?i)listed by")))
    name = contact.person(F.when(caption["at"].isNotNull(), text(_dom(), markup.parent(_dom(), caption))).otherwise(text(_dom(), card)))
    revealed = F.filter(_dom()["elements"], lambda e: e["id"] == F.concat(F.lit("lblViewTpnTelephone_"), F.coalesce(_f("listing_id"), F.lit(""))))
    phones = [_one('a[href^="tel:"]', first(revealed))] + [_one(f'{x} a[href^="tel:"]') for x in ("[class*='lblViewTpnTelephone']", ".contact-phone-selector", ".broker-card", ".broker")] + [_one('a[href^="tel:"]', card)]
    phones = [contact.telephone(markup.attr(x, "href")) for x in phones]
    profile = _one('a[href*="/business-broker/"]')
    link = _absolute(markup.attr(profile, "href"), base)
    firm = F.filter(_all('a[href*="/business-brokers/"]', card), lambda e: ~F.coalesce(markup.attr(e, "href").endswith("/directory/"), F.lit(False)))
    told = _text(profile)
    broker = {
        "broker_name": name,
        "broker_phone": F.coalesce(*(F.when(contact.plausible_phone(x), x) for x in phones)),
        "broker_email": filled(trimmed(F.substring_index(F.regexp_replace(markup.attr(_one('a[href^="mailto:"]', card), "href"), "(?i)^mailto:", ""), "?", 1))),
        "broker_profile_url": F.coalesce(url_rules.reference(link, rules, "broker")["url"], link),
        "broker_firm": F.coalesce(F.when(~told.rlike("(?i)view profile|broker profile"), told), _text(first(firm))),
        "broker_note": F.substring(_line(_one(".broker-about, .broker-description, .broker-note", card)), 1, SHORT),
    }
    where = parse.city_state(_f("location"))
    told_city = where["city"].isNotNull()
    end = {
        "location": F.coalesce(_f("location"), ld["location"]),
        "city": F.when(told_city, where["city"]).otherwise(ld["city"]),
        "state": F.when(told_city, where["state"]).otherwise(ld["state"]),
        "state_name": ld["state_name"],
        "category": ld["category"],
        "categories": ld["categories"],
        "industry": F.coalesce(_f("industry"), ld["final_category"], ld["category"]),
    }
    return _parsed(pages, html, [begin, fields, scope, broker, end], into, linked=True, hidden=("rows", "details", "card"))


def captioned(pages: DataFrame, url: str = "url", html: str = "html", site: str = "dealstream", into: str = "listing") -> DataFrame:
    """Pages whose amounts stand in the element after their caption; the caption in the page's running text comes second."""
    rules = [r for r in url_rules.SITES if r.site == site]
    address = F.col(f"_row.{url}")
    own_id = url_rules.reference(address, rules)["external_id"]
    captions = _all("h2, h3, dt, th, strong, label, div, span")
    whole = {"body": markup.body(_dom()), "parted": markup.body(_dom(), "\x01"), "captions": F.filter(F.transform(captions, lambda e: F.struct(F.lower(trimmed(text(_dom(), e))).alias("label"), text(_dom(), markup.next_sibling(_dom(), e)).alias("value"))), lambda p: p["label"].isin("asking price", "cash flow", "sales"))}
    body, pairs = _f("body"), _f("captions")

    def amount(caption: str) -> Column:
        beside = F.filter(F.transform(F.filter(pairs, lambda p: p["label"] == caption.lower()), lambda p: contact.money_on_request(p["value"])), lambda x: x.isNotNull())
        running = filled(trimmed(F.regexp_extract(F.regexp_replace(body, f"{markup.WS}+", " "), rf"(?i){caption}\s*([^\n$]+)", 1)))
        return F.coalesce(F.try_element_at(beside, F.lit(-1)), contact.money_on_request(running))

    place = F.get(F.filter(F.transform(F.split(body, "\n"), trimmed), lambda x: x.rlike(r",\s*[A-Z]{2}$|^[A-Z]{2}$")), F.lit(0))
    place = squeezed(place)
    profile = first(F.filter(_all("a[href]"), lambda e: url_rules.reference(_absolute(markup.attr(e, "href"), address), rules, "broker").isNotNull()))
    named = F.when(F.length(_line(profile)) < 120, _line(profile))
    crumbs = F.transform(_all("a[href*='-businesses-for-sale'], nav a"), lambda e: trimmed(text(_dom(), e)))
    told = first(F.filter(_all("section, article, .listing, main"), lambda e: text(_dom(), e).rlike("(?i)business for sale details")))
    # A number ends with its piece of text: what follows in the next element, without a space, is another one.
    number = F.regexp_extract(_f("parted"), r"(?i)LISTING\x01* \x01*ID[\s\x01]*#[\s\x01]*(\d+)", 1)
    fields = {
        "title": _text(_one("h1")), "asking_price": amount("Asking Price"), "cash_flow": amount("Cash Flow"), "revenue": amount("Sales"), **_place(place),
        "industry": filled(trimmed(F.regexp_replace(F.get(F.filter(crumbs, lambda x: x.rlike("(?i)businesses for sale")), F.lit(0)), r"(?i)\s+for sale$", ""))),
        "description": F.substring(F.coalesce(_line(told), _line(_one("main, article"))), 1, LONG),
        "broker_name": named, "broker_profile_url": url_rules.reference(_absolute(markup.attr(profile, "href"), address), rules, "broker")["url"],
        "status": F.when(body.rlike("(?i)no longer available|listing is no longer"), "Unavailable"),
        "by_broker": F.when(body.rlike(r"(?i)represented by broker\?\s*yes"), True),
        "external_id": own_id, "listing_id": F.coalesce(filled(number), own_id),
    }
    return _parsed(pages, html, [whole, fields], into, hidden=("body", "parted", "captions"))


def facts(pages: DataFrame, url: str = "url", html: str = "html", site: str = "businessbroker", into: str = "listing") -> DataFrame:
    """Pages with one block of facts, in which each value runs from its caption to the next one."""
    address = F.col(f"_row.{url}")
    own_id = url_rules.reference(address, [r for r in url_rules.SITES if r.site == site])["external_id"]
    every = F.array_join(F.transform(_all(".busListingQuickFacts"), lambda e: text(_dom(), e)), "")
    other = F.array_join(F.transform(_all(".pbd_left"), lambda e: text(_dom(), e)), "")
    whole = {"facts": squeezed(F.coalesce(filled(every), other))}

    def fact(caption: str) -> Column:
        found = trimmed(F.regexp_extract(_f("facts"), rf"(?i){caption}\s*:\s*(.+?)(?=\s+(?:{'|'.join(FACTS)})\s*:|$)", 1))
        return F.when((found != "") & ~found.rlike("(?i)^not disclosed$"), found)

    places = F.filter(F.transform(_all(".location"), lambda e: squeezed(text(_dom(), e))), lambda x: x != "")
    shared = trimmed(markup.attr(_one("meta[property='og:description']"), "content"))
    dashed, within_ = (r"-\s*([^,-]+),\s*([A-Za-z]{2,})\s*-", r"(?i)\bin\s+([^,-]+),\s*([A-Za-z]{2,})\b")
    pattern = [F.struct(trimmed(F.regexp_extract(shared, p, 1)).alias("city"), F.upper(F.substring(F.regexp_extract(shared, p, 2), 1, 2)).alias("state")) for p in (dashed, within_)]
    guessed = F.when(shared.rlike(dashed), pattern[0]).when(shared.rlike(within_), pattern[1])
    guessed = F.when(F.size(_all(".location")) == 0, F.concat(guessed["city"], F.lit(", "), guessed["state"]))
    primary = F.coalesce(F.get(places, F.lit(0)), guessed)
    place = _place(primary) | {"location": F.coalesce(filled(F.array_join(places, "; ")), guessed)}
    contacts = F.filter(F.transform(_all(".contact_seller_content li"), lambda e: F.regexp_extract(squeezed(text(_dom(), e)), "(?i)^Contact:\\s*(.+)$", 1)), lambda x: x != "")
    crumbs = F.filter(F.transform(_all("#breadcrumbs a"), lambda e: trimmed(text(_dom(), e))), lambda x: x.rlike("(?i)business(es)? for sale"))
    number = filled(F.regexp_extract(fact("BBN Listing #"), "([0-9]{4,})", 1))
    price = parse.money_rounded(fact("Asking Price"))
    near = text(_dom(), first(F.filter(_all(".result-img span, .listing-text span"), lambda e: text(_dom(), e).rlike("(?i)asking price"))))
    fields = {
        "title": _text(_one("h1")), "asking_price": F.when(F.coalesce(price, F.lit(0.0)) != 0, price).otherwise(parse.money_rounded(near)), "revenue": parse.money_rounded(fact("Annual Revenue")),
        "cash_flow": parse.money_rounded(fact("Cash Flow")), **place, "industry": F.get(crumbs, F.lit(0)), "broker_name": trimmed(F.try_element_at(contacts, F.lit(-1))),
        "description": F.substring(_line(_one(".busListingContent")), 1, LONG), "external_id": F.coalesce(number, own_id), "listing_id": F.coalesce(number, own_id),
    }
    return _parsed(pages, html, [whole, fields], into, hidden=("facts",))


def classed(pages: DataFrame, url: str = "url", html: str = "html", site: str = "bizquest", into: str = "listing") -> DataFrame:
    """Pages whose fields have classes or test names; the price's class comes before the first amount of the markup, that
    before the linked data's offers. Several dollar signs in a row are no amount's."""
    address, raw = F.col(f"_row.{url}"), F.col("_html")
    ld = linked_data.offers(F.col("_ld"))
    listed = F.coalesce(url_rules.reference(address, [r for r in url_rules.SITES if r.site == site])["external_id"], trimmed(markup.attr(_one("[data-listing-id]"), "data-listing-id")))

    def amount(pattern: str) -> Column:
        return parse.money_rounded(filled(F.regexp_extract(raw, pattern, 0)))

    place = squeezed(_text(_one(".location, [data-testid='location'], .listing-location")))
    fields = {
        "title": F.coalesce(_text(_one("h1")), filled(ld["title"]), filled(trimmed(markup.attr(_one("meta[property='og:title']"), "content")))),
        "asking_price": F.coalesce(
            parse.money_rounded(text(_dom(), _one("[data-testid='asking-price']"))), parse.money_rounded(text(_dom(), _one(".listing-price, .price, .asking-price"))), amount(r"(?<!\$)\$\s*([\d,]+(?:\.\d{2})?)"), ld["price"]
        ),
        "revenue": amount(r"(?i)revenue[:\s]*\$?\s*([\d,]+(?:\.\d{2})?)"),
        "cash_flow": amount(r"(?i)cash\s*flow[:\s]*\$?\s*([\d,]+(?:\.\d{2})?)"),
        **_place(place),
        "industry": _text(_one(".industry, [data-testid='industry'], .breadcrumb-industry")),
        "broker_name": _text(_one(".broker-name, [data-testid='broker-name'], .listing-broker")),
        "description": _text(_one(".listing-description, .description, #description")),
        "external_id": listed,
        "listing_id": listed,
    }
    return _parsed(pages, html, [fields], into, linked=True)


def plain(pages: DataFrame, html: str = "html", into: str = "listing") -> DataFrame:
    """Pages of any broker's own site: amounts after their words in the running text, fields by what classes are called. Elements,
    texts and what matches are steps of their own, as the fields name each more than once."""
    found = {
        "body": F.regexp_replace(markup.body(_dom()), f"{markup.WS}+", " "),
        "h1": _one("h1"), "shared": _one('meta[property="og:title"]'), "tab": _one("title"),
        "where": _one("[class*='location'], .location, [itemprop='address']"),
        "near": _one("article p, .description, [class*='description'], [itemprop='description']"),
        "trade": _one("[class*='industry'], .industry, [itemprop='industry']"),
        "agent": _one("[class*='broker'], .broker-name"),
    }

    def said(pattern: str) -> Column:
        return F.regexp_extract(_f("body"), pattern, 0)

    texts = {x: trimmed(text(_dom(), _f(x))) for x in ("h1", "tab", "where", "trade", "agent")} | {
        "shared": trimmed(markup.attr(_f("shared"), "content")),
        "near": squeezed(text(_dom(), _f("near"))),
        "asked": said(r"(?i)(?:asking|price|list(?:ed)?)\s*(?:price)?[:\s]*\$[\d,]+(?:\.\d{2})?"),
        "any": said(r"\$[\d,]+(?:\.\d{2})?"),
        "earned": said(r"(?i)(?:gross\s+)?revenue[:\s]*\$[\d,]+"),
        "kept": said(r"(?i)(?:cash\s+flow|sde|ebitda)[:\s]*\$[\d,]+"),
    }

    def amount(x: str) -> Column:
        return parse.money_scaled(filled(_f(x)))

    read = {
        "asked": amount("asked"),
        "where": trimmed(F.coalesce(filled(_f("where")), filled(F.regexp_extract(_f("body"), "(?i)location[:\\s]*([A-Za-z0-9 ,.-]{3,60})", 1)))),
        "tab": trimmed(F.substring_index(filled(_f("tab")), "|", 1)),
    }
    asked, place, near = _f("asked"), _f("where"), filled(_f("near"))
    us = r"([A-Za-z .'-]+),\s*([A-Z]{2})\b"
    fields = {
        "title": F.coalesce(*(filled(_f(x)) for x in ("h1", "shared", "tab"))),
        "asking_price": F.when(F.coalesce(asked, F.lit(0.0)) != 0, asked).otherwise(F.coalesce(amount("any"), asked)),
        "revenue": amount("earned"),
        "cash_flow": amount("kept"),
        "city": F.when(place.rlike(us), trimmed(F.regexp_extract(place, us, 1))),
        "state": F.when(place.rlike(us), F.regexp_extract(place, us, 2)).when(place.rlike("^[A-Z]{2}$"), place),
        "location": filled(place),
        "industry": filled(_f("trade")),
        "description": F.substring(F.when(F.length(near) > 40, near), 1, 4000),
        "broker_name": filled(_f("agent")),
    }
    return _parsed(pages, html, [found, texts, read, fields], into, hidden=tuple({**found, **texts}))


def _cards(scope: Column, base: str, rules) -> Column:
    """The listings that an element links to, each once: title, address and id."""

    def of(e: Column) -> Column:
        link = _absolute(markup.attr(e, "href"), base)
        number = url_rules.any_id(link, rules)
        ok = number.isNotNull() | link.rlike("(?i)sold-business/")
        return F.when(ok, F.struct(filled(trimmed(text(_dom(), e))).alias("title"), link.alias("url"), number.alias("external_id")))

    cards = F.filter(F.transform(_all("a[href]", scope), of), lambda c: c.isNotNull())
    return _once(cards, lambda c: F.coalesce(c["external_id"], c["url"]))


def _once(cards: Column, key) -> Column:
    """Without those whose key an earlier one has."""
    keys = F.transform(cards, key)
    return F.filter(cards, lambda c, i: F.array_position(keys, key(c)) == i + 1)


def profile(pages: DataFrame, url: str = "url", html: str = "html", site: str = "bizbuysell", base: str = "https://www.bizbuysell.com", into: str = "profile") -> DataFrame:
    """Brokers' profiles with their sold and active listings; sold ones are told by their encoded ids. Where a part of the
    page isn't marked, it is what surrounds its first link."""
    rules = [r for r in url_rules.SITES if r.site == site]
    address = F.col(f"_row.{url}")
    ld = linked_data.person(F.col("_ld"))

    def around(selector: str) -> Column:
        return markup.parent(_dom(), markup.parent(_dom(), _one(selector)))

    sold = F.coalesce(_one("#soldListings, [id*='sold'], [data-tab='sold'], .sold-listings, section.sold"), around("a[href*='/sold-business/']"))
    active = F.coalesce(_one("#activeListings, [id*='for-sale'], [data-tab='for-sale'], .active-listings, section.for-sale"), around("a[href*='business-opportunity'], a[href*='business-for-sale']"))
    mail = markup.attr(_one('a[href^="mailto:"]'), "href")
    roots = {"sold": _cards(sold, base, rules), "active": _cards(active, base, rules)}
    loose = F.transform(_all("a[href*='/sold-business/']"), lambda e: F.struct(filled(trimmed(text(_dom(), e))).alias("title"), _absolute(markup.attr(e, "href"), base).alias("url"), url_rules.any_id(_absolute(markup.attr(e, "href"), base), rules).alias("external_id")))
    more = {"sold": F.when(F.size(_f("sold")) > 0, _f("sold")).otherwise(loose)}
    fields = {
        "profile_url": F.coalesce(url_rules.reference(address, rules, "broker")["url"], address),
        "name": F.coalesce(ld["name"], _text(_one("h1"))), "firm": ld["firm"], "about": ld["about"], "tagline": _text(_one(".broker-tagline, .profile-tagline")),
        "phone": contact.telephone(markup.attr(_one('a[href^="tel:"]'), "href")), "email": trimmed(F.substring_index(F.regexp_replace(mail, "(?i)^mailto:", ""), "?", 1)),
        "sold_ids": F.array_distinct(F.filter(F.transform(_f("sold"), lambda c: c["external_id"]), lambda x: x.isNotNull())),
    }
    return _parsed(pages, html, [roots, more, fields], into, linked=True)


def short_profile(pages: DataFrame, url: str = "url", html: str = "html", site: str = "dealstream", into: str = "profile") -> DataFrame:
    """Brokers' profiles that list active listings anywhere on the page."""
    rules = [r for r in url_rules.SITES if r.site == site]
    address = F.col(f"_row.{url}")

    def of(e: Column) -> Column:
        ref = url_rules.reference(_absolute(markup.attr(e, "href"), address), rules)
        return F.when(ref["external_id"].isNotNull(), F.struct(_line(e).alias("title"), ref["url"].alias("url"), ref["external_id"].alias("external_id")))

    cards = _once(F.filter(F.transform(_all("a[href]"), of), lambda c: c.isNotNull()), lambda c: c["external_id"])
    fields = {"profile_url": F.coalesce(url_rules.reference(address, rules, "broker")["url"], address), "name": _text(_one("h1")), "about": F.substring(_line(_one("main, article, .profile, .bio")), 1, SHORT), "active": cards}
    return _parsed(pages, html, [fields], into)
