"""Ingest of records, in their order, against representatives; state stores of several backends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basalt.operators import records as one_by_one
from basalt.operators.state import SATISFIED


def ingested(records: DataFrame, pairs: DataFrame, seq: str = "seq") -> DataFrame:
    """``seq, canonical, action``. A record joins the representative that it scores highest with, from ``MERGE`` on (the
    first of equals); if it reaches none, it becomes one. Only representatives are compared with: what is like a member
    of a group, but unlike its representative, stays out. ``pairs``: ``l, r, score``, the earlier record left. These are
    records without keys, decided component by component."""
    rows = records.select(F.col(seq).cast("long").alias("seq"), F.array().cast("array<string>").alias("keys"), F.lit(None).cast("string").alias("fingerprint"))
    found = one_by_one.decided(rows, pairs.select(F.col("l").cast("long").alias("l"), F.col("r").cast("long").alias("r"), "score"))
    return found.select(F.col("seq").alias(seq), "canonical", "action")


def composite(stores: list[DataFrame], key: str, *values: str) -> DataFrame:
    """The union of the stores' keys, each with the values of the first store that has it, and that store's number."""
    rows = None
    for i, store in enumerate(stores):
        one = store.select(key, F.struct(F.lit(i).alias("store"), *values).alias("x"))
        rows = one if rows is None else rows.unionByName(one)
    return rows.groupBy(key).agg(F.min_by("x", F.col("x.store")).alias("x")).select(key, "x.*")


def skip(status: Column, at: Column, now: Column, hours: float, skip_known: bool = False, retry_failures: bool = False) -> Column:
    """Why a listing with a prior state isn't fetched again; null if it is. Only satisfied states skip."""
    fresh = (F.unix_micros(now) - F.unix_micros(at)) < int(hours * 3_600_000_000)
    satisfied = status.isin(*SATISFIED)
    out = F.when(satisfied & F.lit(skip_known), "skipped_known").when(satisfied & F.lit(hours > 0) & fresh, "skipped_fresh")
    return F.when(~(F.lit(retry_failures) & (status == "failed")), out)


def failures(states: DataFrame, key: str, *values: str) -> DataFrame:
    """The failures that states tell of, each with one attempt."""
    return states.filter("status = 'failed'").select(key, *values, F.lit(1).cast("long").alias("attempts"))


def failure_entries(body: Column) -> Column:
    """A collection of failures by key, as an array of ``key, value``."""
    return F.map_entries(F.from_json(body, "map<string,struct<adapter:string,attempts:long>>"))


def next_run(runs: DataFrame, by: str, run: str) -> DataFrame:
    return runs.groupBy(by).agg((F.coalesce(F.max(run), F.lit(0)) + 1).alias("next_run"))


def satisfied_refs(refs: DataFrame, states: DataFrame, key: str) -> DataFrame:
    """How many references there are, and how many have a satisfied state."""
    done = states.filter(F.col("status").isin(*SATISFIED)).select(key, F.lit(True).alias("_done"))
    return refs.join(done, key, "left").agg(F.count("*").alias("n_refs"), F.count_if(F.col("_done")).alias("n_satisfied"))


def enrich_gaps(category: Column, categories: Column, employees: Column, industry: Column, ambiguous: list[tuple[Column, Column]]) -> Column:
    """Whether a parsed listing leaves blanks: no category of either kind, no employees, no industry, or a part of the sale
    (``ambiguous``: its text, and whether the price includes it) of which that isn't known."""
    def blank(x: Column) -> Column:
        return F.coalesce(F.trim(x), F.lit("")) == ""

    gaps = (blank(category) & (F.coalesce(F.size(categories), F.lit(0)) <= 0)) | blank(employees) | blank(industry)
    for text, included in ambiguous:
        gaps = gaps | (~blank(text) & included.isNull())
    return gaps


def deal_view(sources: DataFrame, deal: str, seq: str, rep: str, title: str, price: str) -> DataFrame:
    """A deal's title (its representative's, else the first that isn't blank), its first price, and its number of sources;
    ``rep`` tells the representative's row."""
    said = F.trim(F.coalesce(F.col(title), F.lit(""))) != ""
    own = F.max(F.when(F.col(rep) & said, F.col(title)))
    first = F.min_by(title, F.when(said, F.col(seq)))
    return sources.groupBy(deal).agg(
        F.coalesce(own, first).alias("title"), F.min_by(price, F.when(F.col(price).isNotNull(), F.col(seq))).alias("price"), F.count(seq).alias("n_sources")
    )


def of_hosts(host: Column, suffixes: list[str]) -> Column:
    """Whether a host is one of the given ones or below it; ``www.`` doesn't count."""
    h, found = F.regexp_replace(F.lower(host), r"^www\.", ""), F.lit(False)
    for s in suffixes:
        found = found | (h == s) | h.endswith(f".{s}")
    return found


def crawl_allowed(host: Column, allowed: list[str] | None) -> Column:
    """Whether the allow-list has a host or its last two labels; without a list all are allowed."""
    if allowed is None:
        return F.lit(True)
    h = F.regexp_replace(F.lower(host), r"^www\.", "")
    return F.coalesce(h.isin(*allowed) | F.regexp_extract(h, r"([^.]+\.[^.]+)$", 1).isin(*allowed), F.lit(False))
