"""Robots files of many sites: parsing, the group for an agent, rules and delays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basalt.functions.markup import trimmed


def _lines(body: Column) -> Column:
    def line(raw: Column) -> Column:
        x = F.substring_index(raw, "#", 1)
        value = F.when(F.instr(x, ":") > 0, trimmed(F.regexp_extract(x, r"^[^:]*:(.*)$", 1)))
        return F.struct(F.lower(trimmed(F.substring_index(x, ":", 1))).alias("key"), value.alias("value"))

    rows = F.transform(F.split(F.coalesce(body, F.lit("")), r"\r?\n"), line)
    return F.filter(rows, lambda x: x["value"].isNotNull() & ((x["value"] != "") | (x["key"] == "disallow")))


def _groups(lines: Column) -> Column:
    """The group of each line. Agents add to the group at hand, until one comes again: that begins a new group."""
    kind = "struct<agents:array<string>,g:int,out:array<int>>"
    begin = F.struct(F.array().alias("agents"), F.lit(0).alias("g"), F.array().alias("out")).cast(kind)

    def step(s: Column, x: Column) -> Column:
        name, agent = F.lower(x["value"]), x["key"] == "user-agent"
        new = agent & ((s["g"] == 0) | F.array_contains(s["agents"], name))
        g = F.when(new, s["g"] + 1).otherwise(s["g"])
        agents = F.when(new, F.array(name)).when(agent, F.array_append(s["agents"], name)).otherwise(s["agents"])
        return F.struct(agents.alias("agents"), g.alias("g"), F.array_append(s["out"], g).alias("out")).cast(kind)

    return F.aggregate(lines, begin, step, lambda s: s["out"])


def policies(files: DataFrame, site: str, body: str, agent: str) -> tuple[DataFrame, DataFrame]:
    """Of each site the rules for an agent (``site, prefix, allow``) and its delay (``site, delay_ms``): those of the group that
    names the longest beginning of the agent, the first of equals; ``*`` is the shortest. A site without a file, or
    without such a group, has neither."""
    parsed = files.select(site, _lines(F.col(body)).alias("lines")).withColumn("groups", _groups(F.col("lines")))
    each = parsed.select(site, F.posexplode(F.arrays_zip("lines", "groups")).alias("at", "x")).select(site, "at", "x.lines.key", "x.lines.value", F.col("x.groups").alias("g"))
    name = F.lower("value")
    fits = (F.col("key") == "user-agent") & ((name == "*") | F.lit(agent.lower()).startswith(name))
    rank = F.struct(F.when(name == "*", 0).otherwise(F.length(name)), -F.col("g"))
    best = each.filter(fits).groupBy(site).agg(F.max_by("g", rank).alias("g"))
    own = each.join(best, [site, "g"])
    rules = own.filter(F.col("key").isin("allow", "disallow") & (F.col("value") != "")).select(site, F.col("value").alias("prefix"), (F.col("key") == "allow").alias("allow"))
    number = F.regexp_extract("value", r"^([0-9]*\.?[0-9]+)", 1).try_cast("double")
    delays = own.filter((F.col("key") == "crawl-delay") & (number >= 0)).groupBy(site).agg(F.max_by(number, "at").alias("s"))
    return rules.distinct(), delays.filter("s > 0").select(site, F.ceil(F.col("s") * 1000).alias("delay_ms"))


def allowed(requests: DataFrame, rules: DataFrame, site: str, path: str) -> DataFrame:
    """Requests with ``allowed``: the longest rule that the path begins with decides, an allowing one at equal length. A site's
    rules, one file's, are one row that its requests meet, so Spark splits the requests of a hot site over tasks."""
    own = rules.groupBy(F.col(site).alias("_of")).agg(F.collect_set(F.struct(F.length("prefix").alias("n"), "allow", "prefix")).alias("_rules"))
    met = requests.join(own, F.col(site) == F.col("_of"), "left")
    fits = F.filter("_rules", lambda r: F.startswith(F.col(path), r["prefix"]))
    best = F.array_max(F.transform(fits, lambda r: F.struct(r["n"].alias("n"), r["allow"].alias("allow"))))
    return met.withColumn("allowed", F.coalesce(best["allow"], F.lit(True))).drop("_of", "_rules")


def resource_blocked(host: Column, kind: Column, blocked: Column, allowed: Column, exempt: Column, images: bool = True) -> Column:
    """Whether a browser's request is dropped. Documents never are; of hosts, the blocked list comes before the allowed one,
    of which exempt hosts keep their images, fonts and styles; others, and no host, are dropped."""
    kind, none = F.lower(kind), F.coalesce(host, F.lit("")) == ""
    heavy = F.lit(images) & kind.isin("image", "media", "font", "stylesheet") & ~exempt
    return F.when(kind.isin("document", "main_frame"), False).when(none | blocked, True).when(allowed, heavy).otherwise(True)
