"""Addresses as browsers read them, in parts, for addresses of the web (http and https): the published parsing rules as steps
over a column. Tabs and line breaks are dropped, backslashes are slashes, missing or doubled slashes behind the scheme don't
matter, user names are kept, hosts are lower-cased and decoded, numbers for hosts are IPv4 addresses, default ports are
dropped, dot segments are resolved, and what may not stand in a part is percent-encoded by it.

What has no host, a bad port or a forbidden character in its host is no address: its parts are null. Hosts with other
than ASCII characters are taken as they are, in lower case (names in Punycode stay so).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ports that go without saying, and what each part encodes besides controls and characters beyond ASCII.
_PORTS = {"http": "80", "https": "443"}
_PATH, _QUERY, _USER = " \"#<>?`{}", " \"#<>'", " \"#<>?`{}/:;=@[\\]^|"
_FORBIDDEN = r"[\x00-\x20#/:<>?@\[\\\]^|%\x7f]"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once, however often ``then`` names it."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _encoded(text: Column, also: str) -> Column:
    """Percent-encodes the bytes of characters beyond ASCII, controls and those named, one character at a time."""
    return let(text, lambda t: _encoded_once(t, also))


def _encoded_once(text: Column, also: str) -> Column:

    def one(ch: Column) -> Column:
        return F.regexp_replace(F.hex(F.encode(ch, "UTF-8")), "(..)", "%$1")

    plain = "^[\\x21-\\x7e]*$"
    named = "".join(("\\" if ch in "\\]^[" else "") + ch for ch in also if ch != " ")
    safe = text.rlike(plain) & ~text.rlike(f"[{named}]")
    each = F.transform(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)), lambda ch: F.when(ch.rlike(plain) & ~ch.rlike(f"[{named}]"), ch).otherwise(one(ch)))
    return F.when(safe, text).otherwise(F.array_join(each, ""))


def _decoded(text: Column) -> Column:
    """Percent-encoded ASCII characters as themselves."""
    pieces = F.regexp_extract_all(text, F.lit("(?s)%[0-7][0-9A-Fa-f]|."), F.lit(0))
    return F.when(~text.contains("%"), text).otherwise(F.array_join(F.transform(pieces, lambda p: F.when(p.rlike("^%[0-7][0-9A-Fa-f]$"), F.char(F.conv(F.substring(p, 2, 2), 16, 10).cast("int"))).otherwise(p)), ""))


def _segments(path: Column) -> Column:
    """A path without ``.`` and with ``..`` resolved, in any spelling of the dots."""

    def resolved(path: Column) -> Column:
        kept = let(F.split(F.substring(path, 2, 1 << 30), "/", -1), lambda parts: let(F.transform(parts, lambda p: F.regexp_replace(F.lower(p), "%2e", ".")), lambda dots: _walked(parts, dots)))
        return F.when(path.rlike(r"(?i)(^|/)(\.|%2e){1,2}(/|$)"), F.concat(F.lit("/"), F.array_join(kept, "/"))).otherwise(path)

    return let(path, resolved)


def _walked(parts: Column, dots: Column) -> Column:
    """What is left of a path's segments when those that are dots (``dots`` spells them so) have been followed."""
    n = F.size(parts)

    def step(done: Column, i: Column) -> Column:
        dot, part, last = F.get(dots, i), F.get(parts, i), i == n - 1
        shorter = F.slice(done, F.lit(1), F.greatest(F.lit(0), F.size(done) - 1))
        up = F.when(last, F.array_append(shorter, F.lit(""))).otherwise(shorter)
        here = F.when(last, F.array_append(done, F.lit(""))).otherwise(done)
        return F.when(dot == "..", up).when(dot == ".", here).otherwise(F.array_append(done, part))

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.array().cast("array<string>"), step)


def _number(part: Column) -> Column:
    """A part of a host that is a number: decimal, octal with a leading 0, hexadecimal with 0x."""
    hexa = part.rlike("(?i)^0x[0-9a-f]*$")
    octal = part.rlike("^0[0-7]+$")
    digits = F.when(hexa, F.coalesce(F.conv(F.when(F.length(part) == 2, "0").otherwise(F.substring(part, 3, 99)), 16, 10))).when(octal, F.conv(part, 8, 10)).when(part.rlike("^[1-9][0-9]*$|^0$"), part)
    return digits.cast("decimal(20,0)").cast("long")


def _host(raw: Column) -> Column:
    """A host in its one form; null for what is none."""

    def named(name: Column) -> Column:
        v6 = name.rlike(r"^\[[0-9a-f:.]+\]$")
        good = (name != "") & (v6 | ~name.rlike(_FORBIDDEN))
        numeric = name.rlike(r"(?:^|\.)(?:[0-9]+|0x[0-9a-f]*)\.?$")
        ip = let(F.transform(F.split(F.regexp_replace(name, r"\.$", ""), r"\.", -1), _number), _ipv4)
        return F.when(good & numeric & ~v6, ip).when(good, name)

    return let(F.lower(_decoded(raw)), named)


def _ipv4(values: Column) -> Column:
    """The address of up to four numbers, the last of which fills what the others leave."""
    n = F.size(values)
    front, tail = F.slice(values, F.lit(1), F.greatest(F.lit(0), n - 1)), F.get(values, n - 1)
    fits = (n <= 4) & F.forall(values, lambda v: v.isNotNull()) & F.forall(front, lambda v: v < 256)
    zero = F.struct(F.lit(0).cast("long").alias("v"), F.lit(3).alias("k"))
    left = F.aggregate(front, zero, lambda s, v: F.struct((s["v"] + F.call_function("shiftleft", v, s["k"] * 8)).alias("v"), (s["k"] - 1).alias("k")), lambda s: s["v"])
    whole = F.when(fits & (tail < F.call_function("shiftleft", F.lit(1).cast("long"), (5 - n) * 8)), left + tail)
    return let(whole, lambda w: F.when(w.isNotNull(), F.concat_ws(".", *((F.shiftright(w, 8 * k) % 256).cast("string") for k in (3, 2, 1, 0)))))


def parsed(url: Column | str) -> Column:
    """``scheme, user, host, port, path, query, fragment``; null for what is no address of the web. ``user`` holds a password
    behind a colon; ``port`` is null where it goes without saying; ``query`` and ``fragment`` are null where there is none."""
    x = F.regexp_replace(F.regexp_replace(_c(url), r"^[\x00-\x20]+|[\x00-\x20]+$", ""), "[\t\n\r]", "")
    return let(x, lambda x: let(F.translate(F.regexp_extract(x, "^[A-Za-z][A-Za-z0-9+.-]*:/*([^?#]*)", 1), "\\", "/"), lambda front: _parts(x, F.regexp_replace(front, "^/*", ""))))


def _parts(x: Column, front: Column) -> Column:
    """The parts of an address ``x``, of which ``front`` stands between the scheme and the query."""
    scheme = F.lower(F.regexp_extract(x, "^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    fragment = F.when(x.contains("#"), F.regexp_extract(x, r"^[^#]*#(.*)$", 1))
    query = F.when(x.rlike(r"^[^#]*\?"), F.regexp_extract(x, r"^[^?#]*\?([^#]*)", 1))
    authority = F.regexp_extract(front, "^([^/]*)", 1)
    path = F.regexp_extract(front, "^[^/]*(.*)$", 1)
    place = F.regexp_replace(authority, "^.*@", "")

    def with_user(user: Column) -> Column:
        both = F.concat(_encoded(F.substring_index(user, ":", 1), _USER), F.lit(":"), _encoded(F.regexp_extract(user, "^[^:]*:(.*)$", 1), _USER))
        return F.regexp_replace(F.when(user.contains(":"), both).otherwise(_encoded(user, _USER)), ":$", "")

    usual = F.create_map(*(F.lit(v) for kv in _PORTS.items() for v in kv))
    found = F.struct(
        scheme.alias("scheme"),
        F.nullif(let(F.regexp_extract(authority, "^(.*)@", 1), with_user), F.lit("")).alias("user"),
        _host(F.regexp_replace(place, r":[^:\]]*$", "")).alias("host"),
        F.regexp_extract(place, r":([^:\]]*)$", 1).alias("port"),
        _encoded(_segments(F.when(path == "", "/").otherwise(path)), _PATH).alias("path"),
        _encoded(query, _QUERY).alias("query"),
        _encoded(fragment, ' "<>`').alias("fragment"),
    )

    def checked(s: Column) -> Column:
        number = F.when(s["port"].rlike("^[0-9]{1,18}$"), s["port"].cast("long"))
        bad = (s["port"] != "") & F.coalesce(number > 65535, F.lit(True))
        port = F.when(number != F.try_element_at(usual, s["scheme"]).cast("long"), number.cast("string"))
        return F.when(s["scheme"].isin(*_PORTS) & s["host"].isNotNull() & ~bad, F.struct(*((port if n == "port" else s[n]).alias(n) for n in ("scheme", "user", "host", "port", "path", "query", "fragment"))))

    return let(found, checked)


def _form_decoded(x: Column) -> Column:
    return F.coalesce(F.try_url_decode(F.regexp_replace(F.translate(x, "+", " "), r"%(?![0-9A-Fa-f]{2})|\+", "%25")), x)


def sorted_query(query: Column) -> Column:
    """A query's parameters in the order of their names, equal names as they stand, as a form sends them; null for none."""
    pairs = F.filter(F.split(query, "&", -1), lambda p: p != "")
    named = F.transform(pairs, lambda p, i: F.struct(_form_decoded(F.substring_index(p, "=", 1)).alias("n"), i.alias("i"), F.when(p.contains("="), _form_decoded(F.regexp_extract(p, "^[^=]*=(.*)$", 1))).otherwise("").alias("v")))
    sent = F.array_join(F.transform(F.array_sort(named), lambda p: F.concat(F.url_encode(p["n"]), F.lit("="), F.url_encode(p["v"]))), "&")
    return F.when(sent != "", sent)


def joined(parts: Column, query: Column | None = None, fragment: bool = True) -> Column:
    q = parts["query"] if query is None else query
    origin = F.concat(parts["scheme"], F.lit("://"), F.coalesce(F.concat(parts["user"], F.lit("@")), F.lit("")), parts["host"], F.coalesce(F.concat(F.lit(":"), parts["port"]), F.lit("")))
    end = F.coalesce(F.concat(F.lit("#"), parts["fragment"]), F.lit("")) if fragment else F.lit("")
    return F.concat(origin, parts["path"], F.coalesce(F.concat(F.lit("?"), q), F.lit("")), end)


def dedup_form(url: Column | str) -> Column:
    """An address without fragment, its parameters sorted by name; what is no address of the web stays as it is."""
    given = _c(url)

    def form(x: Column) -> Column:
        q = F.when(x["query"].isNotNull(), sorted_query(x["query"]))
        return F.concat(joined(x, F.lit(None).cast("string"), False), F.coalesce(F.concat(F.lit("?"), q), F.lit("")))

    return F.coalesce(let(parsed(given), form), given)
