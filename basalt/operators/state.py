"""States of listings over their events: latest, successes, failures, what to fetch next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SATISFIED = ("ingested", "skipped_known", "skipped_fresh")
SKIPS = ("skipped_known", "skipped_fresh")


def latest(events: DataFrame, key: list[str], order: list[str], *values: str) -> DataFrame:
    """Each key's values of its last event: an aggregate with a map-side part, no window."""
    return events.groupBy(*key).agg(*(F.max_by(v, F.struct(*order)).alias(v) for v in values))


def without_downgrades(events: DataFrame, key: str, order: list[str], status: str = "status") -> DataFrame:
    """The last status of each key, where a skip doesn't replace a satisfied status before it. As a skip is
    itself satisfied, only the first of a run of skips can stand, after a status that isn't."""
    back = Window.partitionBy(key).orderBy(*order)
    before = F.lag(status).over(back)
    rows = events.withColumn("_stays", ~(F.col(status).isin(*SKIPS) & F.coalesce(before.isin(*SATISFIED), F.lit(False))))
    return rows.filter("_stays").groupBy(key).agg(F.max_by(status, F.struct(*order)).alias(status), F.count("*").alias("n_kept"))


def last_success(events: DataFrame, key: str, order: list[str], run: str) -> DataFrame:
    """Each event with the run of the last success up to it."""
    upto = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("last_success", F.last(F.when(F.col("status") == "ingested", F.col(run)), ignorenulls=True).over(upto))


def status_counts(states: DataFrame, by: str, statuses: tuple[str, ...]) -> DataFrame:
    """How many of each status, and in all; other statuses count in all alone."""
    return states.groupBy(by).agg(*(F.count_if(F.col("status") == s).alias(f"n_{s}") for s in statuses), F.count("*").alias("n_total"))


def cooldown(last_seen: Column, known: Column, now: Column, hours: float, skip_known: bool = False) -> Column:
    """Why a listing isn't fetched: it is known, or was seen within the hours; else ``none``."""
    fresh = (F.unix_micros(now) - F.unix_micros(last_seen)) < int(hours * 3_600_000_000)
    return F.when(F.lit(skip_known) & known, "known").when(F.lit(hours > 0) & known & fresh, "fresh").otherwise("none")


def failure_buckets(failures: DataFrame, bucket: str, message: str, order: str, most: int = 8) -> DataFrame:
    """The most frequent kinds of failure with their first message; the limit is the report's length."""
    grouped = failures.groupBy(bucket).agg(F.count("*").alias("n"), F.min_by(message, order).alias("sample"))
    return grouped.orderBy(F.desc("n"), bucket).limit(most)


def attempts(events: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Failures of each key since its last success; keys without any are left out."""
    last = events.groupBy(key).agg(F.max(F.when(F.col("status") == "ingested", F.struct(*order))).alias("_ok"))
    failed = events.filter(F.col("status") == "failed").join(last, key)
    return failed.filter(F.col("_ok").isNull() | (F.struct(*order) > F.col("_ok"))).groupBy(key).agg(F.count("*").alias("attempts"))


def hard_failure(message: Column) -> Column:
    return F.lower(message).rlike("hard block|not retriable|access denied")


def ingest_order(refs: DataFrame, failures: DataFrame, key: str, seq: str, retry_first: bool = False) -> DataFrame:
    """References in order of ingestion, with failures that can be retried behind (or before) and, without
    priority, references that failed for good left out. ``bucket`` and ``seq`` give the order."""
    failed = failures.select(F.col(key), F.col("hard"))
    joined = refs.join(failed, key, "left")
    if retry_first:
        bucket = F.when(F.col("hard").isNull(), 1).when(F.col("hard"), 2).otherwise(0)
        return joined.select(key, seq, bucket.alias("bucket"))
    kept = joined.filter(~F.coalesce("hard", F.lit(False))).select(key, seq, F.lit(0).alias("bucket"))
    others = failed.filter("not hard").join(refs.select(key), key, "left_anti").select(key, F.lit(None).cast(refs.schema[seq].dataType).alias(seq), F.lit(1).alias("bucket"))
    return kept.unionByName(others)


def throttle_gaps(events: DataFrame, key: str, ts: str, least_ms: int) -> DataFrame:
    """Per key how many gaps between events are shorter than the least, and the shortest in microseconds."""
    gap = F.unix_micros(F.col(ts)) - F.unix_micros(F.lag(ts).over(Window.partitionBy(key).orderBy(ts)))
    return events.withColumn("_gap", gap).groupBy(key).agg(F.count_if(F.col("_gap") < least_ms * 1000).alias("n_short"), F.min("_gap").alias("shortest_us"))


def content_updated(observations: DataFrame, key: str, order: list[str], fingerprint: str) -> DataFrame:
    """Each observation with whether its fingerprint differs from that of the key's first one (null: unknown, no)."""
    first = observations.groupBy(key).agg(F.min_by(F.struct(fingerprint), F.struct(*order))[fingerprint].alias("_first"))
    changed = F.coalesce(F.col(fingerprint) != F.col("_first"), F.lit(False))
    return observations.join(first, key).withColumn("updated", changed).drop("_first")


def first_of_key(jobs: DataFrame, key: list[str], order: str) -> DataFrame:
    """Of jobs with one idempotency key the first."""
    return jobs.groupBy(*key).agg(F.min(order).alias(order), F.count("*").alias("n_enqueued"))
