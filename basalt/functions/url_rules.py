"""Rules about sites' addresses as rows: which are catalogues, listings, brokers, directories or offices, their ids and
normal forms, and how their pages are numbered. A rule set is data; any of one's own does as well as ``SITES``.

A rule holds for a host and the hosts under it. Addresses are expressions over one column, nothing is joined or shuffled.
Null, and what is no address with a host, matches no rule.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from basalt.functions import urls


@dataclass(frozen=True)
class Rule:
    """``path`` (any case) must be found in the path, ``but`` must not; ``id`` finds the id, which a listing of a site with
    ids must have; none of the parameters ``without`` may be there (``*``: no query at all); ``www``: the host's normal form
    begins so; without ``shared`` the rule
    holds only where its site or catalogues are asked for, not among the listings and hosts of all sites."""

    site: str
    kind: str
    host: str
    path: str
    but: str | None = None
    id: str | None = None
    without: tuple[str, ...] = ()
    www: bool = False
    shared: bool = True


@dataclass(frozen=True)
class Paging:
    """Group 1 of ``path`` is a catalogue's path, group 2 its page; ``first`` and ``later`` make a path of ``{base}`` and
    ``{page}``. With ``parameter`` the page is a query parameter, whether or not the path has one."""

    site: str
    kind: str
    path: str
    first: str = "{base}/"
    later: str = "{base}/{page}/"
    parameter: str | None = None


# Hosts, path shapes and page forms of the sites.
_SLUGS = "advancedsearch|login|forgotpassword|subscribe|shortlist|emailalerts?|advertise|faq|buyer-registration|sellerreferral"
_SEARCHES = "last-3-days|last-14-days|last-months|last-3-months|quick-sale|distressed|turnaround-opportunity|bankruptcy|closed-asset-sale|real-property"
_PEOPLE = "broker|brokers|professional|professionals|intermediary|intermediaries|member|members"
_OTHER = "locations|blog|wp-admin|login-register|about|contact|privacy|terms"
_INDEX = "(^/businesses-for-sale|-businesses-for-sale)(/[0-9]+)?/?$"
SITES = (
    Rule("bizbuysell", "listing", "bizbuysell.com", "/(business-opportunity|business-for-sale|business-asset)/|-business-for-sale/[0-9]{6,}/?$", but=_INDEX, id="([0-9]{6,})"),
    Rule("bizbuysell", "catalog", "bizbuysell.com", "^/businesses-for-sale(/[0-9]+)?/?$", without=("q", "geo")),
    Rule("bizbuysell", "catalog", "bizbuysell.com", "-businesses-for-sale(/[0-9]+)?/?$"),
    Rule("bizbuysell", "broker", "bizbuysell.com", "^/business-broker/[^/]+/[^/]+/[0-9]+/?$"),
    Rule("bizbuysell", "directory", "bizbuysell.com", "^/business-brokers/[^/]+(/[0-9]+)?/?$"),
    Rule("bizquest", "listing", "bizquest.com", "/(business-for-sale|start-up-business)/.*/BW[0-9]+/?$", id="/(BW[0-9]+)/?$"),
    Rule("bizquest", "catalog", "bizquest.com", "^/((businesses-for-sale(-in-[^/]+)?|buy-a-business-for-sale)(/page-[0-9]+)?/?)?$"),
    Rule("businessbroker", "listing", "businessbroker.net", r"/business-for-sale/[^/]+/[0-9]+\.aspx$", id=r"/([0-9]+)\.aspx$", www=True),
    Rule("businessbroker", "catalog", "businessbroker.net", r"^/(state|industry|keyword|city|county)/[^/]+-businesses-for-sale\.aspx$"),
    Rule("loopnet", "listing", "loopnet.com", "^/(listing|biz/business-(opportunity|for-sale))/[^/]+/[0-9]+/?$", id="/([0-9]+)/?$", www=True),
    Rule("loopnet", "catalog", "loopnet.com", "^/biz/([^/]+/[^/]*businesses[^/]*|[^/]*businesses(-for-sale)?)(/+[0-9]+)?/?$", but="^/(listing|biz/business-(opportunity|for-sale))/"),
    Rule("dealstream", "listing", "dealstream.com", "^/d/biz-sale/[^/]+/[a-z0-9]+/?$", id="/([a-z0-9]+)/?$"),
    Rule("dealstream", "catalog", "dealstream.com", "^(/biz-sale|.+-businesses-for-sale)(/[0-9]+)?/?$"),
    Rule("dealstream", "broker", "dealstream.com", f"^/d/(biz-)?({_PEOPLE})(/[^/]+){{2,}}/?$"),
    Rule("businessesforsale", "listing", "businessesforsale.com", r"^/us/[^/]+\.aspx$", but=rf"^/us/({_SLUGS})\.aspx$", shared=False),
    Rule("businessesforsale", "catalog", "businessesforsale.com", "^/us/search/[^/]+/?$", but=f"^/us/search/({_SEARCHES})(-0*([2-9]|[1-9][0-9]+))?/?$", without=("*",), shared=False),
    Rule("sunbelt", "office", "sunbeltnetwork.com", "^/[a-z0-9][a-z0-9-]*/$", but=f"^/({_OTHER})/$"),
    Rule("transworld", "office", "tworld.com", "^/locations/[a-z0-9-]+/[a-z0-9-]+/?$"),
)
PAGES = (
    Paging("bizbuysell", "catalog", "^(/businesses-for-sale|.*-businesses-for-sale)(?:/([0-9]+))?/?$"),
    Paging("bizbuysell", "directory", "^(/business-brokers/[^/]+)(?:/([0-9]+))?/?$"),
    Paging("bizquest", "catalog", "^(.*?)(?:/page-([0-9]+))?/?$", later="{base}/page-{page}/"),
    Paging("loopnet", "catalog", "^(/biz/[^/]+/[^/]*[^/0-9][^/]*|/biz/[^/]*businesses[^/]*)(?:/+([0-9]+))?/?$"),
    Paging("dealstream", "catalog", "^(/biz-sale|.+-businesses-for-sale)(?:/([0-9]+))?/?$"),
    Paging("businessesforsale", "catalog", "^(/us/search/[^/]+?)(?:-([0-9]+))?/?$", first="{base}", later="{base}-{page}"),
    Paging("businessbroker", "catalog", "^(.*)()$", first="{base}", later="{base}?page={page}", parameter="page"),
)


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _origin(u: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(u, "^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)", 1)), "^(http://.*):80$|^(https://.*):443$", "$1$2")


def path(url: Column | str) -> Column:
    """The path, ``/`` for none; null without a host."""
    u = _c(url)
    found = F.regexp_extract(u, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+([^?#]*)", 1)
    return F.when(urls.host(u) != "", F.when(found == "", "/").otherwise(found))


def query(url: Column | str) -> Column:
    return F.regexp_extract(_c(url), r"^[^?#]*\?([^#]*)", 1)


def parameter(url: Column | str, name: str) -> Column:
    """The first value of a parameter; null without it."""
    found = F.regexp_extract_all(query(url), F.lit(f"(?:^|&){name}(?:=([^&]*))?(?=&|$)"), F.lit(1))
    return F.get(found, F.lit(0))


def on(url: Column | str, host: str) -> Column:
    h = urls.host(url)
    return (h == host) | h.endswith(f".{host}")


def holds(url: Column | str, rule: Rule) -> Column:
    p = path(url)
    out = on(url, rule.host) & p.rlike(f"(?i){rule.path}")
    if rule.but:
        out = out & ~p.rlike(f"(?i){rule.but}")
    if rule.id:
        out = out & p.rlike(f"(?i){rule.id}")
    for name in rule.without:
        out = out & ((query(url) == "") if name == "*" else parameter(url, name).isNull())
    return F.coalesce(out, F.lit(False))


def _chosen(url: Column | str, rules, value) -> Column:
    """``value`` of the first rule that holds; null for none."""
    out = None
    for rule in rules:
        out = F.when(holds(url, rule), value(rule)) if out is None else out.when(holds(url, rule), value(rule))
    return F.lit(None) if out is None else out


def is_a(url: Column | str, site: str, kind: str, rules=SITES) -> Column:
    return F.coalesce(_chosen(url, [r for r in rules if (r.site, r.kind) == (site, kind)], lambda r: F.lit(True)), F.lit(False))


def found(url: Column | str, rules=SITES) -> Column:
    """``site, kind, external_id`` of the first rule that holds; null for none."""

    def of(rule: Rule) -> Column:
        number = F.regexp_extract(path(url), f"(?i){rule.id}", 1) if rule.id else F.lit(None).cast("string")
        return F.struct(F.lit(rule.site).alias("site"), F.lit(rule.kind).alias("kind"), number.alias("external_id"))

    return _chosen(url, rules, of)


def normal(url: Column | str, rule: Rule) -> Column:
    """Without query and fragment; host in lower case, with ``www.`` where the rule has it."""
    origin = _origin(_c(url))
    if rule.www:
        origin = F.regexp_replace(origin, r"^([a-z][a-z0-9+.-]*://)(?!www\.)", "$1www.")
    return F.concat(origin, path(url))


def reference(url: Column | str, rules=SITES, kind: str = "listing", shared: bool = True) -> Column:
    """``site, url, external_id`` in normal form, by the first rule of that kind that holds; null for none."""

    def of(rule: Rule) -> Column:
        number = F.regexp_extract(path(url), f"(?i){rule.id}", 1) if rule.id else F.lit(None).cast("string")
        return F.struct(F.lit(rule.site).alias("site"), normal(url, rule).alias("url"), number.alias("external_id"))

    return _chosen(url, [r for r in rules if r.kind == kind and (r.shared or not shared)], of)


def listing_site(url: Column | str, rules=SITES) -> Column:
    """The site of a listing's address; null for any other."""
    return reference(url, rules)["site"]


def catalog_site(url: Column | str, rules=SITES) -> Column:
    """The site of a catalogue's address, else the host without ``www.``; ``unknown`` without one."""
    bare = F.regexp_replace(urls.host(url), r"^www\.", "")
    return F.coalesce(_chosen(url, [r for r in rules if r.kind == "catalog"], lambda r: F.lit(r.site)), F.when(bare != "", bare), F.lit("unknown"))


def scrape_site(url: Column | str, rules=SITES) -> Column:
    """The site that an address belongs to: of any listing or catalogue, else by its host."""
    kinds = [r for r in rules if r.kind in ("listing", "catalog") and r.shared]
    hosts = None
    for site, host in dict.fromkeys((r.site, r.host) for r in kinds):
        hosts = F.when(on(url, host), F.lit(site)) if hosts is None else hosts.when(on(url, host), F.lit(site))
    return F.coalesce(_chosen(url, kinds, lambda r: F.lit(r.site)), F.lit(None).cast("string") if hosts is None else hosts, catalog_site(url, rules))


def page(url: Column | str, paging: Paging) -> Column:
    """``base, page`` of a catalogue's address; null where its path isn't one."""
    p = path(url)
    base, number = (F.regexp_extract(p, f"(?i){paging.path}", k) for k in (1, 2))
    asked = parameter(url, paging.parameter or "page") if paging.parameter or (paging.site, paging.kind) == ("bizbuysell", "catalog") else F.lit(None).cast("string")
    asked = F.regexp_extract(asked, r"^\s*([0-9]+)", 1)
    n = F.greatest(F.lit(1).cast("long"), F.coalesce(asked.try_cast("long"), number.try_cast("long"), F.lit(1).cast("long")))
    return F.when(p.rlike(f"(?i){paging.path}"), F.struct(base.alias("base"), n.alias("page")))


def page_url(url: Column | str, number: Column, paging: Paging) -> Column:
    """The address of another page of the catalogue, without query and fragment; what is no catalogue stays, without a fragment."""
    base = page(url, paging)["base"]

    def filled(form: str) -> Column:
        parts = form.replace("{base}", "\0b\0").replace("{page}", "\0p\0").split("\0")
        return F.concat(*({"b": base, "p": number.cast("string")}.get(x, F.lit(x)) for x in parts))

    made = F.concat(_origin(_c(url)), F.when(number <= 1, filled(paging.first)).otherwise(filled(paging.later)))
    return F.when(base.isNotNull(), made).otherwise(F.regexp_replace(_c(url), "#.*$", ""))


def page_key(url: Column | str, paging: Paging) -> Column:
    """What two addresses of the same page of a catalogue have in common."""
    return page_url(url, F.coalesce(page(url, paging)["page"], F.lit(1).cast("long")), paging)


def mobile(url: Column | str, host: str) -> Column:
    """The address on the site's host for phones; other hosts stay."""
    return F.regexp_replace(_c(url), rf"(?i)^([a-z][a-z0-9+.-]*://)(www\.)?({host.replace('.', '[.]')})(?=[/?#:]|$)", "$1m.$3")


def encoded_id(segment: Column) -> Column:
    """A number of six digits or more, plain or in Base64; null for others."""
    plain = F.regexp_extract(segment, "^([0-9]{6,})$", 1)
    padded = F.rpad(F.translate(segment, "-_", "+/"), (F.ceil(F.length(segment) / 4) * 4).cast("int"), "=")
    decoded = F.regexp_extract(F.trim(F.try_to_binary(padded, F.lit("base64")).cast("string")), "^([0-9]{6,})$", 1)
    return F.coalesce(F.when(plain != "", plain), F.when(decoded != "", decoded))


def any_id(url: Column | str, rules=SITES) -> Column:
    """A listing's id out of its own address, a profile's link (``q``), or that of a sold listing."""
    asked = F.regexp_extract(_c(url), "[?&]q=([0-9]{6,})", 1)
    sold = F.regexp_extract(path(url), "(?i)/sold-business/[^/]+/([^/]+)/[0-9]+/?$", 1)
    return F.coalesce(reference(url, rules)["external_id"], F.when(asked != "", asked), F.when(sold != "", encoded_id(sold)))
