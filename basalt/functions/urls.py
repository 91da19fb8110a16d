"""URLs as columns: normal forms, hosts, ids, pages, links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def normalized(url: Column | str) -> Column:
    """Without fragment and default port, scheme and host in lower case, query parameters in order of their names; what is no
    URL stays as it is."""
    u = _c(url)
    origin = F.lower(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1))
    origin = F.regexp_replace(origin, "^(http://.*):80$|^(https://.*):443$", "$1$2")
    path = F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    params = F.split(F.regexp_extract(u, r"\?([^#]*)", 1), "&")
    name = F.transform(params, lambda p, i: F.struct(F.substring_index(p, "=", 1).alias("n"), i.alias("i"), p.alias("p")))
    query = F.array_join(F.transform(F.array_sort(name), lambda p: p["p"]), "&")
    query = F.when(query == "", F.lit("")).otherwise(F.concat(F.lit("?"), query))
    whole = F.concat(origin, F.when(path == "", F.lit("/")).otherwise(path), query)
    return F.when(origin == "", u).otherwise(whole)


def host(url: Column | str) -> Column:
    return F.lower(F.regexp_extract(_c(url), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)", 1))


def bare_host(url: Column | str) -> Column:
    return F.regexp_replace(host(url), r"^(www|m)\.", "")


def registrable(url: Column | str) -> Column:
    """The last two labels of the host."""
    return F.regexp_extract(host(url), r"([^.]+\.[^.]+)$", 1)


def adapter(url: Column | str, hosts: dict[str, str] | None = None) -> Column:
    """The source that a URL belongs to: by a table of hosts, else its bare host; ``unknown`` without one."""
    bare = bare_host(url)
    named = F.lit(None).cast("string")
    for suffix, name in (hosts or {}).items():
        named = F.when((bare == suffix) | bare.endswith(f".{suffix}"), F.lit(name)).otherwise(named)
    return F.coalesce(named, F.when(bare != "", bare), F.lit("unknown"))


def desktop(url: Column | str) -> Column:
    return F.regexp_replace(_c(url), r"^(https?://)m\.", "$1www.")


def external_id(url: Column | str) -> Column:
    """The number that ends the path; null if there is none."""
    found = F.regexp_extract(_c(url), r"^[^?#]*/([0-9]+)(\.html)?/?([?#].*)?$", 1)
    return F.when(found != "", found)


def page_number(url: Column | str) -> Column:
    """The ``page`` parameter, 1 without one."""
    found = F.regexp_extract(_c(url), r"[?&]page=([0-9]+)", 1)
    return F.when(found != "", found.cast("long")).otherwise(F.lit(1).cast("long"))


def with_page(url: Column | str, page: Column) -> Column:
    """The URL of another page: the parameter is replaced, or added where there is none."""
    base = F.regexp_replace(_c(url), r"#.*$", "")
    has = base.rlike(r"[?&]page=[0-9]+")
    replaced = F.concat(F.regexp_extract(base, r"^(.*[?&]page=)[0-9]+", 1), page.cast("string"), F.regexp_extract(base, r"[?&]page=[0-9]+(.*)$", 1))
    added = F.concat(base, F.when(base.contains("?"), "&").otherwise("?"), F.lit("page="), page.cast("string"))
    return F.when(has, replaced).otherwise(added)


def links(html: Column | str) -> Column:
    return F.regexp_extract_all(_c(html), F.lit(r'<a\s[^>]*href="([^"]*)"'), F.lit(1))


def resolved(link: Column | str, page_url: Column | str) -> Column:
    """An absolute link as it is, a rooted one behind the page's origin, another in the page's folder."""
    link, page = _c(link), _c(page_url)
    origin = F.regexp_extract(page, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    folder = F.regexp_extract(page, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*/)?)", 1)
    return F.when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), link).when(link.startswith("/"), F.concat(origin, link)).otherwise(
        F.concat(F.when(folder.endswith("/"), folder).otherwise(F.concat(folder, F.lit("/"))), link)
    )


def preferred(url: str, order: str) -> Column:
    """An aggregate: of the URLs of one reference that of a ``www.`` host, then the first."""
    return F.min_by(url, F.struct(~host(url).startswith("www."), F.col(order)))
