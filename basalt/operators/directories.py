"""Brokers' directories as references of one form: association records in three JSON shapes, office pages, licence tables; and
their union by profile, where a later reference fills and renews fields but doesn't empty them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basalt.functions import contact, markup, text, url_rules, urls
from basalt.functions.markup import filled, select, trimmed

#: The fields of a reference besides its profile's address.
FIELDS = ("external_id", "name", "firm", "state", "city", "country", "source", "website", "phone", "email", "designations")
_RECORD = "struct<id:string,first_name:string,middle_name:string,last_name:string,company:string,email:string,website:string,phone:string,city:string,state:string,state_code:string,country:string,country_code:string,cbi_cert:string,mami_cert:string,master_cert:string,permalink:string>"
_POST = "array<string>"
# Which certificate is which designation, and where profiles, offices and licences are.
CERTIFICATES = {"cbi_cert": "CBI", "mami_cert": "M&AMI", "master_cert": "MCBI"}
PROFILES, LICENCES = "https://www.ibba.org/broker-profile/", {"CA": ("a[href*='ppldetail']", "https://www2.dre.ca.gov/publicasp/pplinfo.asp"), "AZ": ("a[href*='IndividualLicense'], a[href*='LicenseDetail']", "https://services.azre.gov")}


def _blank(x: Column) -> Column:
    return filled(trimmed(x))


def _reference(fields: dict[str, Column], profile: Column) -> Column:
    kinds = {"designations": "array<string>"}
    return F.struct(profile.alias("profile_url"), *(fields.get(f, F.lit(None)).cast(kinds.get(f, "string")).alias(f) for f in FIELDS))


def _of_record(r: Column) -> Column:
    """A reference of an association's record; without a link of its own the profile's is made of its place and name."""
    name = filled(trimmed(F.concat_ws(" ", *(filled(r[n]) for n in ("first_name", "middle_name", "last_name")))))
    full = F.concat_ws(" ", F.coalesce(r["first_name"], F.lit("")), F.coalesce(r["last_name"], F.lit("")))
    made = F.concat(F.lit(PROFILES), *(x for part in (F.coalesce(r["state"], r["state_code"], F.lit("us")), F.coalesce(r["city"], F.lit("unknown")), full) for x in (text.slug(part), F.lit("/"))))
    has = F.filter(F.array(*(F.when(r[c] == "1", F.lit(d)) for c, d in CERTIFICATES.items())), lambda x: x.isNotNull())
    host = filled(F.regexp_replace(urls.host(trimmed(r["website"])), r"^www\.", ""))
    fields = {
        "external_id": r["id"], "name": name, "firm": _blank(r["company"]), "state": F.coalesce(_blank(r["state_code"]), _blank(r["state"])), "city": _blank(r["city"]), "country": contact.country_code(F.coalesce(r["country_code"], r["country"])),
        "source": F.lit("ibba"), "website": host, "phone": _blank(r["phone"]), "email": _blank(r["email"]), "designations": F.when(F.size(has) > 0, has),
    }
    return _reference(fields, F.coalesce(_blank(r["permalink"]), made))


def _record(values: dict[str, Column]) -> Column:
    names = [f.split(":")[0] for f in _RECORD[7:-1].split(",")]
    return F.struct(*(values.get(n, F.lit(None).cast("string")).cast("string").alias(n) for n in names))


def of_all(body: Column) -> Column:
    """The references of a list of records; null where it is none."""
    return F.transform(F.from_json(body, f"array<{_RECORD}>"), _of_record)


def of_search(body: Column) -> Column:
    """The references of a search's posts, whose members are lists: the first of each counts. A post without an id has the last
    part of its link, or its name."""
    posts = F.from_json(body, f"posts array<struct<id:{_POST},first_name:{_POST},last_name:{_POST},company:{_POST},city:{_POST},state:{_POST},permalink:string>>")["posts"]

    def one(p: Column) -> Column:
        first = {n: F.get(p[n], F.lit(0)) for n in ("id", "first_name", "last_name", "company", "city", "state")}
        given, family = (F.coalesce(first[n], F.lit("")) for n in ("first_name", "last_name"))
        tail = filled(F.regexp_extract(p["permalink"], "([^/]+)/*$", 1))
        return _of_record(_record(first | {"first_name": given, "last_name": family, "permalink": p["permalink"], "id": F.coalesce(first["id"], tail, F.concat(given, F.lit("-"), family))}))

    return F.transform(posts, one)


def of_map(body: Column) -> Column:
    """The references of a map's features; those without an address are left out, and names are parted at their first space."""
    details = "struct<url:string,name:string,company:string,city:string,state:string,cbi:string,master_cbi:string,mami:string>"
    features = F.from_json(body, f"features array<struct<details:{details}>>")["features"]

    def one(f: Column) -> Column:
        d = f["details"]
        parts = F.split(trimmed(F.coalesce(d["name"], F.lit(""))), f"{markup.WS}+")
        values = {
            "id": d["url"], "first_name": F.get(parts, F.lit(0)), "last_name": F.array_join(F.slice(parts, F.lit(2), F.size(parts)), " "), "company": d["company"], "city": d["city"], "state": d["state"],
            "state_code": F.when(F.length(d["state"]) == 2, d["state"]), "permalink": d["url"], "cbi_cert": F.when(d["cbi"] == "1", "1"), "master_cert": F.when(d["master_cbi"] == "1", "1"), "mami_cert": F.when(d["mami"] == "1", "1"),
        }
        return _of_record(_record(values))

    return F.transform(F.filter(features, lambda f: F.coalesce(f["details"]["url"], F.lit("")) != ""), one)


def _absolute(href: Column, base: Column) -> Column:
    return urls.resolved(href, base)


def offices(dom: Column, page_url: Column, site: str = "sunbelt", firm: str = "Sunbelt Business Brokers", called: str = "Sunbelt ") -> Column:
    """The references of the offices that a page links to: the name is the link's, or made of its address."""

    def one(e: Column) -> Column:
        link = _absolute(markup.attr(e, "href"), page_url)
        slug = F.regexp_extract(url_rules.path(link), "^/([^/]+)/", 1)
        name = F.coalesce(_blank(markup.text(dom, e)), F.concat(F.lit(called), slug))
        return F.when(url_rules.is_a(link, site, "office"), _reference({"external_id": slug, "name": name, "firm": F.lit(firm), "source": F.lit(site), "website": F.regexp_replace(urls.host(link), r"^www\.", "")}, link))

    return F.filter(F.transform(select(dom["elements"], "a[href]"), one), lambda r: r.isNotNull())


def licences(dom: Column, state: str) -> Column:
    """The references of a state's table of licences: name and address of each licence's link, and out of its row the number,
    the firm and the city."""
    links, base = LICENCES[state]
    rows = select(dom["elements"], "tr")

    def one(e: Column) -> Column:
        row = F.try_element_at(F.filter(rows, lambda r: (r["at"] < e["at"]) & (e["at"] <= r["last"])), F.lit(-1))
        cells = F.transform(select(markup.within(dom, row), "td"), lambda td: trimmed(markup.text(dom, td)))
        whole = F.coalesce(F.when(row["at"].isNotNull(), markup.text(dom, row)), F.lit(""))
        number = F.get(F.filter(cells, lambda c: c.rlike("^[0-9]{8}$")), F.lit(0)) if state == "CA" else filled(F.regexp_extract(whole, r"\b(BR[0-9]{5,}|[0-9]{6,})\b", 1))
        fields = {"external_id": number, "name": _blank(markup.text(dom, e)), "state": F.lit(state), "source": F.lit(f"state-dre-{state.lower()}")}
        if state == "CA":
            fields |= {"firm": F.get(cells, F.lit(1)), "city": trimmed(F.substring_index(F.get(F.filter(cells, lambda c: c.contains(",")), F.lit(0)), ",", 1))}
        return _reference(fields, _absolute(markup.attr(e, "href"), F.lit(base)))

    return F.transform(select(dom["elements"], links), one)


def merged(refs: DataFrame, order: list[str]) -> DataFrame:
    """One reference a profile: of each field the last one in order that isn't null."""
    place = F.struct(*order)
    return refs.groupBy("profile_url").agg(*(F.max_by(f, F.when(F.col(f).isNotNull(), place)).alias(f) for f in FIELDS))
