"""What is derived from evidence (texts, structured fields, classes, vectors), under its own hash and with its lineage: the
hash of the evidence and the version of what derived it. Only what lacks an artifact of the version at hand is derived.

Source records, as parsed pages give them, and the documents that a search index holds of a deal's sources.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "sha256 string, content string, size_bytes long, content_type string, derived_from string, version string, adapter string, kind string"
# A kind's type of content, and the fields of a source record that a parsed page gives.
TYPES = {"markdown": "text/markdown", "structured": "application/json", "embedding": "application/json", "classification": "application/json"}
FIELDS = ("title", "asking_price", "revenue", "cash_flow", "ebitda", "city", "state", "state_name", "location", "industry", "broker_name", "broker_profile_url", "year_established", "status", "category", "categories")


def stored(spark: SparkSession, path: str) -> DataFrame:
    """All artifacts of a store; none, if there is no store yet."""
    try:
        return spark.read.schema(SCHEMA).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], SCHEMA)


def stale(evidence: DataFrame, artifacts: DataFrame, kind: str, version: str) -> DataFrame:
    """Evidence (``adapter, sha256``) without an artifact of that kind and version."""
    done = artifacts.filter((F.col("kind") == kind) & (F.col("version") == version)).select("adapter", F.col("derived_from").alias("sha256")).distinct()
    return evidence.join(done, ["adapter", "sha256"], "left_anti")


def derive(evidence: DataFrame, artifacts: DataFrame, kind: str, version: str, content: Callable[[], Column]) -> DataFrame:
    """The artifacts that are missing: ``content`` of evidence with none of that kind and version, each evidence once.
    Evidence that gives no content has none."""
    todo = stale(evidence, artifacts, kind, version).dropDuplicates(["adapter", "sha256"])
    made = todo.select("adapter", F.col("sha256").alias("derived_from"), content().alias("content")).filter(F.col("content").isNotNull())
    return made.select(
        F.sha2(F.col("content").cast("binary"), 256).alias("sha256"), "content", F.octet_length("content").cast("long").alias("size_bytes"), F.lit(TYPES[kind]).alias("content_type"), "derived_from", F.lit(version).alias("version"), "adapter", F.lit(kind).alias("kind")
    )


def put(new: DataFrame, path: str) -> None:
    """Appends, by source and kind."""
    new.write.mode("append").partitionBy("adapter", "kind").parquet(path)


def latest(artifacts: DataFrame, order: list[str]) -> DataFrame:
    """Of each evidence and kind the artifact of the last version in the given order; versions that it lacks don't count."""
    rank = F.array_position(F.array(*(F.lit(v) for v in order)), F.col("version"))
    known = artifacts.filter(rank > 0)
    return known.groupBy("adapter", "kind", "derived_from").agg(F.max_by(F.struct("sha256", "content", "version"), rank).alias("a")).select("adapter", "kind", "derived_from", "a.*")


def source_record(id_: Column, adapter: Column, url: Column, listing: Column, names: list[str], external_id: Column | None = None, seen: Column | None = None) -> Column:
    """A source record of a parsed listing (a struct with the fields ``names``): the given number wins over the listing's, and
    is its listing id too; the description's first 4,000 characters; fields that the page's shape lacks are null."""

    def field(name: str) -> Column:
        return listing[name] if name in names else F.lit(None)

    known = F.coalesce(*(x for x in (external_id, field("external_id"), field("listing_id")) if x is not None)).cast("string")
    fields = [field(n).alias(n) for n in FIELDS] + [F.coalesce(known, field("listing_id")).alias("listing_id"), F.substring(field("description").cast("string"), 1, 4000).alias("description")]
    at = seen if seen is not None else F.current_timestamp()
    return F.struct(id_.alias("id"), adapter.alias("adapter"), url.alias("url"), known.alias("external_id"), F.lit(None).cast("string").alias("canonical_id"), F.struct(*fields).alias("parsed"), at.alias("first_seen"), at.alias("last_seen"))


def deal_documents(sources: DataFrame, deal: str | list[str], position: str, representative: str) -> DataFrame:
    """One search document a deal out of its sources (``adapter, url, title, city, state, industry, broker_name,
    asking_price``): the sources' adapters, the first title in order, the place of the representative (else of the first),
    and all of it with industries, brokers, addresses and prices as one text. Deals without sources have none. Sources at one
    position are in the order of their fields, whichever stands for the deal."""
    by = [deal] if isinstance(deal, str) else deal
    names = ("adapter", "url", "title", "city", "state", "industry", "broker_name", "asking_price")
    entry = F.struct(F.col(position).alias("at"), *names, F.coalesce(representative, F.lit(False)).alias("rep"))
    rows = sources.groupBy(*by).agg(F.array_sort(F.collect_list(entry)).alias("s"))  # a deal's own sources

    def filled(x: Column) -> Column:
        return F.when(x != "", x)

    def each(f: Callable[[Column], Column]) -> Column:
        return F.filter(F.transform("s", f), lambda x: x.isNotNull())

    rep = F.coalesce(F.get(F.filter("s", lambda x: x["rep"]), F.lit(0)), F.get("s", F.lit(0)))
    place = filled(F.concat_ws(", ", filled(rep["city"]), filled(rep["state"])))
    title = F.get(each(lambda x: filled(x["title"])), F.lit(0))
    price = F.col("s").getField("asking_price")
    shown = F.transform(F.filter(price, lambda p: p.isNotNull()), lambda p: F.regexp_replace(p.cast("decimal(38,6)").cast("string"), r"\.?0+$", ""))
    parts = F.concat(F.array(title, place), each(lambda x: filled(x["industry"])), each(lambda x: filled(x["broker_name"])), each(lambda x: filled(x["url"])), shown)
    return rows.select(*by, F.array_sort(F.array_distinct(each(lambda x: x["adapter"]))).alias("adapters"), title.alias("title"), place.alias("location"), F.array_join(F.filter(parts, lambda x: x.isNotNull()), " ").alias("document"))
