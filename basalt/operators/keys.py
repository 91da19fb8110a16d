"""Keys that records are known by, in the order of lookup, and the source that a key belongs to."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from basalt.functions import web_urls
from basalt.operators.resolution import external_key, url_key

# Sources whose listing number comes before the address, and hosts and the sources that they belong to.
NUMBER_FIRST = ("bizbuysell", "bizquest", "businessbroker", "dealstream")
HOSTS = {
    "bizbuysell.com": "bizbuysell", "m.bizbuysell.com": "bizbuysell", "bizben.com": "bizben", "businessbroker.net": "businessbroker", "bizquest.com": "bizquest", "dealstream.com": "dealstream", "loopnet.com": "loopnet",
    "businessesforsale.com": "businessesforsale", "us.businessesforsale.com": "businessesforsale",
}


def named_keys(adapter: Column, url: Column, external_id: Column, number_first: tuple[str, ...] = NUMBER_FIRST) -> Column:
    """``kind, key`` of a record: its number at its source, where it has one, and its address; the number first for some
    sources, the address for all others."""
    number = F.struct(F.lit("external").alias("kind"), external_key(adapter, external_id).alias("key"))
    address = F.struct(F.lit("url").alias("kind"), url_key(web_urls.dedup_form(url)).alias("key"))
    both = F.when(F.coalesce(adapter.isin(*number_first), F.lit(False)), F.array(number, address)).otherwise(F.array(address, number))
    return F.filter(both, lambda k: k["key"].isNotNull())


def lookup_keys(adapter: Column, url: Column, external_id: Column) -> Column:
    """A record's keys as they are looked up: numbers before addresses, whatever the source."""
    keys = named_keys(adapter, url, external_id)
    return F.transform(F.concat(F.filter(keys, lambda k: k["kind"] != "url"), F.filter(keys, lambda k: k["kind"] == "url")), lambda k: k["key"])


def host_source(host: Column, hosts: dict[str, str] | None = None) -> Column:
    """The source of a host, with or without ``www.``; a host without one is its own."""
    bare = F.regexp_replace(F.lower(host), r"^www\.", "")
    known = F.create_map(*(F.lit(x) for kv in (hosts or HOSTS).items() for x in kv))
    return F.coalesce(F.try_element_at(known, F.lower(host)), F.try_element_at(known, bare), bare)


def key_source(kind: Column, adapter: Column, broker: Column, url: Column, hosts: dict[str, str] | None = None) -> Column:
    """What a key's partition is called: a number's source, what stands before a broker's first slash, an address's host's
    source; ``unknown`` for what is no address."""
    before = F.when(F.instr(broker, "/") > 1, F.substring_index(broker, "/", 1)).otherwise(broker)
    of_url = F.coalesce(host_source(web_urls.parsed(url)["host"], hosts), F.lit("unknown"))
    return F.when(kind == "external", adapter).when(kind == "broker-listing", before).otherwise(of_url)
