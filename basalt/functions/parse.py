"""Numbers, years and places out of text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def money(text: Column | str) -> Column:
    """The first amount, with cents; null where the text says that it isn't disclosed, or has a hyphen or dash."""
    amount = F.regexp_extract(_c(text), r"\$?([0-9][0-9,]*(\.[0-9]+)?)", 1)
    closed = F.lower(_c(text)).rlike("not disclosed|n/a|\u2014|-")
    return F.when(~closed & (amount != ""), F.regexp_replace(amount, ",", "").try_cast("double"))


def money_rounded(text: Column | str) -> Column:
    """All digits and the first point, rounded half up."""
    kept = F.regexp_extract(F.regexp_replace(_c(text), r"[^0-9.]", ""), r"^([0-9]*\.?[0-9]*)", 1)
    return F.floor(kept.try_cast("double") + 0.5).cast("double")


def money_scaled(text: Column | str) -> Column:
    """An amount with a suffix k or m, rounded half up."""
    t = F.lower(_c(text))
    amount = F.regexp_replace(F.regexp_extract(t, r"([0-9][0-9,]*(\.[0-9]+)?)\s*([km]?)", 1), ",", "").try_cast("double")
    unit = F.regexp_extract(t, r"([0-9][0-9,]*(\.[0-9]+)?)\s*([km]?)", 3)
    return F.floor(amount * F.when(unit == "k", 1e3).when(unit == "m", 1e6).otherwise(1.0) + 0.5).cast("double")


def year(text: Column | str) -> Column:
    found = F.regexp_extract(_c(text), r"\b((19|20)[0-9]{2})\b", 1)
    return F.when(found != "", found.cast("int"))


def city_state(text: Column | str) -> Column:
    """``City, ST`` as a struct; both null for anything else."""
    city = F.trim(F.regexp_extract(_c(text), r"^(.+),\s*([A-Z]{2})$", 1))
    state = F.regexp_extract(_c(text), r"^(.+),\s*([A-Z]{2})$", 2)
    return F.struct(F.when(city != "", city).alias("city"), F.when(state != "", state).alias("state"))


def location(city: Column | str, state: Column | str) -> Column:
    city, state = (F.when(F.trim(_c(x)) != "", _c(x)) for x in (city, state))
    return F.when(city.isNotNull() & state.isNotNull(), F.concat(city, F.lit(", "), state)).otherwise(F.coalesce(city, state))


def name_hash(text: Column | str) -> Column:
    """The 31-hash of a string as an unsigned 32-bit integer, character by character."""
    points = F.transform(F.array_remove(F.split(F.coalesce(_c(text), F.lit("")), ""), ""), lambda c: F.ascii(c).cast("long"))
    return F.aggregate(points, F.lit(0).cast("long"), lambda h, c: F.pmod(h * 31 + c, F.lit(1 << 32)))


def jitter(text: Column | str) -> Column:
    """A fixed offset from -1 to 1 degrees in both directions, so that places of one state don't coincide."""
    h = name_hash(F.lower(_c(text)))
    h = F.abs(F.when(h >= 1 << 31, h - (1 << 32)).otherwise(h))
    return F.struct(((h % 100 - 50) / 50).alias("lat"), ((F.shiftright(h, 8) % 100 - 50) / 50).alias("lng"))
