"""What a response is: blocked or fine, allowed or not; title and structure of a page."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basalt.functions.text import body_text
from basalt.operators import robots


@dataclass(frozen=True)
class Sign:
    """Any of the words in the first ``chars`` of a response (of its title, with ``titled``), in any case; or a pattern there."""

    words: tuple[str, ...] = ()
    chars: int = 24_000
    titled: bool = False
    pattern: str | None = None


@dataclass(frozen=True)
class Rule:
    """A verdict on responses with all the signs, of one of the statuses, from a status on, shorter than so many characters."""

    verdict: str
    signs: tuple[Sign, ...] = ()
    statuses: tuple[int, ...] = ()
    least_status: int | None = None
    shorter: int | None = None


# What denials and challenges say, and what failed connections are called.
_DENIED, _REFUSED = "access denied", (401, 403)
_LIFTED_BY_NOTHING = ("edgesuite.net", "you don't have permission to access", "you dont have permission to access")
_GATES = ("akamai", _DENIED, "captcha", "cf-browser-verification")
_RESTRICTED = ("access is temporarily restricted", "unusual activity from your device")
_SCRIPTS = ("captcha-delivery.com", "datadome")
_WAITING = ("cf-browser-verification", "just a moment")
_THIN = ("captcha", "challenge", "verify you are human")
TRANSIENT = ("fetch failed", "ECONNRESET", "ECONNREFUSED", "ETIMEDOUT", "socket hang up", "EPIPE", "ENOTFOUND", "Request was cancelled")
TRANSIENT_CODES = ("UND_ERR_CONNECT_TIMEOUT", "UND_ERR_HEADERS_TIMEOUT", "UND_ERR_BODY_TIMEOUT", "UND_ERR_SOCKET")

#: Denials that asking again doesn't lift: they say so, or carry their provider's reference.
DENIALS = tuple(Rule("akamai_hard_denial", (Sign((_DENIED,), 20_000), more)) for more in (Sign(_LIFTED_BY_NOTHING, 20_000), Sign(chars=4_000, pattern=r"reference\s*#\s*[\d.a-f]+")))
WAF = (
    Rule("rate_limited", statuses=(429,)),
    Rule("challenge", statuses=_REFUSED),
    Rule("challenge", (Sign(_GATES, 8_000),), least_status=400),
    Rule("block", least_status=500),
)
BLOCKS = (
    *DENIALS,
    Rule("datadome_challenge", (Sign(_RESTRICTED + _SCRIPTS),)),
    Rule("datadome_challenge", (Sign(("automated",)), Sign(("bot",)), Sign(("activity on your network",)))),
    Rule("datadome_challenge", (Sign(("please enable js",)), Sign(("ad blocker",)))),
    Rule("http_forbidden", (Sign((_DENIED,), titled=True),), statuses=_REFUSED),
    Rule("http_forbidden", (Sign(_WAITING),), statuses=_REFUSED),
    Rule("thin_challenge_page", statuses=_REFUSED, shorter=2_000),
    Rule("thin_challenge_page", (Sign(_THIN),), shorter=2_000),
)


def _shows(body: Column, sign: Sign) -> Column:
    part = F.lower(F.substring(body, 1, sign.chars))
    if sign.titled:
        part = F.regexp_extract(part, "<title[^>]*>([^<]{0,120})", 1)
    if sign.pattern:
        return part.rlike(sign.pattern)
    return reduce(Column.__or__, (part.contains(w) for w in sign.words))


def verdict(rules: tuple[Rule, ...], body: Column, status: Column | None = None) -> Column:
    """The verdict of the first rule that holds for a response; null for none. A null body is an empty one."""
    body = F.coalesce(body, F.lit(""))
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for rule in rules:
        tests = [_shows(body, sign) for sign in rule.signs]
        tests += [status.isin(*rule.statuses)] if rule.statuses else []
        tests += [status >= rule.least_status] if rule.least_status is not None else []
        tests += [F.length(body) < rule.shorter] if rule.shorter is not None else []
        out = out.when(reduce(Column.__and__, tests), rule.verdict)
    return out


def waf_class(status: Column, body: Column) -> Column:
    """``ok``, ``rate_limited``, ``challenge`` or ``block``."""
    return F.coalesce(verdict(WAF, body, status), F.lit("ok"))


def hard_denial(body: Column) -> Column:
    return verdict(DENIALS, body).isNotNull()


def page_block(status: Column, html: Column) -> Column:
    """Why a catalogue page is a challenge and no catalogue page; null if it is one."""
    return verdict(BLOCKS, html, status)


def http_plan(status: Column, body: Column, attempt: Column, most: Column) -> Column:
    """What follows a response over plain HTTP: ``ok``, ``retry_http``, ``persist_needs_browser`` or ``fail_hard``."""
    kind = F.when(hard_denial(body), "denied").otherwise(waf_class(status, body))
    after = F.create_map(*(F.lit(x) for kv in (("denied", "fail_hard"), ("ok", "ok")) for x in kv))
    again = F.when((kind == "rate_limited") & (attempt < most - 1), "retry_http").otherwise("persist_needs_browser")
    return F.coalesce(F.try_element_at(after, kind), again)


def browser_plan(status: Column, body: Column, attempt: Column, most: Column) -> Column:
    """What follows a page that a browser has loaded: as over HTTP, but what needs a browser is tried again while attempts last."""
    plan = http_plan(status, body, attempt, most)
    return F.when((plan == "persist_needs_browser") & (attempt < most - 1), "retry_browser").when(plan == "persist_needs_browser", "fail_hard").otherwise(plan)


def transient_error(message: Column, code: Column | None = None, cause: Column | None = None) -> Column:
    """Failures of sockets and proxies that are worth another try, by what they or their cause say, or by their code."""
    said = F.lower(F.concat_ws(" ", *(x for x in (message, cause) if x is not None)))
    out = reduce(Column.__or__, (said.contains(x.lower()) for x in TRANSIENT))
    return out if code is None else out | F.coalesce(code.isin(*TRANSIENT_CODES), F.lit(False))


def title(html: Column) -> Column:
    found = F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))
    return F.when(found != "", found)


def heading(html: Column) -> Column:
    found = F.trim(F.regexp_replace(F.regexp_extract(html, r"(?is)<h1[^>]*>(.*?)</h1>", 1), r"<[^>]+>", ""))
    return F.when(found != "", found)


def markdown(html: Column, url: Column) -> Column:
    return F.concat(F.lit("# "), F.coalesce(title(html), F.lit("Listing")), F.lit("\n\nSource: "), url, F.lit("\n\n"), body_text(html), F.lit("\n"))


def robots_allowed(requests: DataFrame, rules: DataFrame, path: str, request: str) -> DataFrame:
    """``rules``: ``prefix, allow`` of one site. The longest rule that a path starts with decides, an allowing one at
    equal length; without a rule a path is allowed. Repeated requests stay."""
    one = rules.select(F.lit(0).alias("_site"), "prefix", "allow")
    return robots.allowed(requests.withColumn("_site", F.lit(0)), one, "_site", path).select(request, path, "allowed")
