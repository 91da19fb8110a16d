"""Workspace tables: upserts, scoped lists, references that lead nowhere, field-wise merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upserted(current: DataFrame, changes: DataFrame, key: list[str], fixed: list[str], mutable: list[str]) -> DataFrame:
    """Rows after the changes (one a key): ``fixed`` columns keep their first value, ``mutable`` take the new."""
    c = current.select(*key, *(F.col(x).alias(f"_c_{x}") for x in (*fixed, *mutable)), F.lit(True).alias("_old"))
    n = changes.select(*key, *(F.col(x).alias(f"_n_{x}") for x in (*fixed, *mutable)), F.lit(True).alias("_new"))
    kept = [F.when(F.col("_old"), F.col(f"_c_{x}")).otherwise(F.col(f"_n_{x}")).alias(x) for x in fixed]
    taken = [F.when(F.col("_new"), F.col(f"_n_{x}")).otherwise(F.col(f"_c_{x}")).alias(x) for x in mutable]
    return c.join(n, key, "full_outer").select(*key, *kept, *taken)


def orphans(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    return child.join(parent.select(key), key, "left_anti")


def latest_non_null(rows: DataFrame, key: str, order: list[str], *fields: str) -> DataFrame:
    """Field by field the last value that isn't null."""
    at = F.struct(*order)
    return rows.groupBy(key).agg(*(F.max_by(f, F.when(F.col(f).isNotNull(), at)).alias(f) for f in fields), F.count("*").alias("n_rows"))


def filled(current: Column, patch: Column, overwrite: bool = False) -> Column:
    """A patch for what is blank, or for everything."""
    blank = F.when(F.trim(current) != "", current)
    return F.coalesce(patch, blank) if overwrite else F.coalesce(blank, patch)


def promoted(canonicals: DataFrame, workspace: Column, bucket: Column) -> tuple[DataFrame, DataFrame]:
    """What promotion adds: a project for each canonical (``canonical``), and a place in a bucket where one is named."""
    rows = canonicals.select("canonical", workspace.alias("workspace"), bucket.alias("bucket"))
    projects = rows.select("workspace", "canonical", F.lit("researching").alias("status"))
    return projects, rows.filter("trim(bucket) <> ''").select("workspace", "canonical", "bucket")


def attached(canonicals: DataFrame, new: DataFrame, key: str, sources: str) -> DataFrame:
    """Sources (arrays) of each canonical with the new ones behind, each once; none is ever removed."""
    more = new.select(key, F.col(sources).alias("_new"))
    none = F.array().cast(canonicals.schema[sources].dataType)
    return canonicals.join(more, key, "full").select(key, F.array_union(F.coalesce(sources, none), F.coalesce("_new", none)).alias(sources))


def violations(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """How many rows break each rule; a rule that isn't known to hold is broken. One pass for all rules."""
    counts = rows.agg(*(F.count_if(~F.coalesce(ok, F.lit(False))).alias(name) for name, ok in rules.items()))
    return counts.select(F.explode(F.array(*(F.struct(F.lit(n).alias("rule"), F.col(n).alias("n")) for n in rules))).alias("x")).select("x.*")


def under(pages: DataFrame, path: str, prefix: str) -> DataFrame:
    """Pages of a store below a prefix; snapshots, and paths that leave the store, are left out."""
    unsafe = F.col(path).rlike(r"^/|(^|/)\.\.(/|$)") | F.col(path).rlike("(^|/)_snapshots(/|$)")
    return pages.filter(F.col(path).startswith(prefix) & ~unsafe)


def replay_mismatches(evidence: DataFrame, parsed: Column, stored: str) -> DataFrame:
    """Evidence that parses to another value than what is stored."""
    return evidence.withColumn("parsed", parsed).filter(~F.col("parsed").eqNullSafe(F.col(stored)))


def classification(adapter: Column, category: Column, enriched: Column, marker: str = "llm") -> Column:
    """A classification as JSON; its method tells whether a model's marker is among what enriched the record."""
    method = F.when(F.coalesce(F.array_contains(enriched, marker), F.lit(False)), "adapter+llm-enrich").otherwise("adapter-heuristic")
    return F.to_json(F.struct(adapter.alias("adapter"), category.alias("category"), method.alias("method")))


def chosen(models: DataFrame, by: str, name: str, price: str, preferred: list[str]) -> DataFrame:
    """Of each group's models one: the first of the preferred, else the free one of the shortest name, else the cheapest."""
    place = F.coalesce(F.nullif(F.array_position(F.array(*(F.lit(p) for p in preferred)), F.col(name)), F.lit(0)), F.lit(len(preferred) + 1))
    free = F.coalesce(F.col(price) <= 0, F.lit(False))
    rank = F.struct(place.alias("a"), (~free).alias("b"), F.when(free, F.length(name)).otherwise(0).alias("c"), F.col(price).alias("d"), F.col(name).alias("e"))
    return models.groupBy(by).agg(F.min_by(name, rank).alias(name))


def by_sources(deals: DataFrame, adapters: str, wanted: str | None) -> DataFrame:
    """Deals of which some source is of the adapter; null, blank and ``all`` keep every deal."""
    return deals if (wanted or "").strip() in ("", "all") else deals.filter(F.array_contains(adapters, wanted))
