"""Streams that keep tables: ingest of records with its state, and a search index that follows its records.

Each batch of a stream writes its own part of a table, under its number. A batch that runs again after a failure sees
the parts before it alone and writes its part anew, so the tables hold every batch once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basalt.operators import fulltext, records, walks
from basalt.sources.shared import settled


def parts(spark: SparkSession, path: str, schema: str, before: int | None = None) -> DataFrame:
    """What the batches (before a number) have written, with their number as ``batch``; nothing, if there is no table yet."""
    try:
        found = spark.read.option("basePath", path).schema(f"{schema}, batch long").parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        found = spark.createDataFrame([], f"{schema}, batch long")
    return found if before is None else found.filter(F.col("batch") < before)


def put(part: DataFrame, path: str, batch: int) -> None:
    part.write.mode("overwrite").parquet(f"{path}/batch={batch}")


_DECISION, _MAPPING = "seq long, canonical long, action string, content_updated boolean", "key string, canonical long"
_RECORD = "seq long, id string, keys array<string>, fingerprint string, title string"


def mappings(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """Where every key points: the last batch that had it."""
    return parts(spark, f"{path}/mappings", _MAPPING, before).groupBy("key").agg(F.max_by("canonical", "batch").alias("canonical"))


def decisions(spark: SparkSession, path: str) -> DataFrame:
    return parts(spark, f"{path}/decisions", _DECISION).drop("batch")


def ingest_batch(path: str, scored: Callable[[DataFrame, DataFrame], DataFrame] | None = None, schema: str = _RECORD) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: decides a batch's records (``seq, id, keys, fingerprint`` and what ``scored`` needs) against all batches
    before. ``scored`` gets the earlier records that may stand for canonical ones (representatives, and the batch itself)
    and the batch's, and gives ``l, r, score``."""

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = settled(batch)
        reps = parts(spark, f"{path}/representatives", schema, number).drop("batch")
        pairs = scored(reps.unionByName(new.select(*reps.columns)), new) if scored else None
        found = settled(records.decided(new, pairs, mappings(spark, path, number), reps.select(F.col("seq").alias("canonical"), "fingerprint")))
        put(records.new_mappings(new, found), f"{path}/mappings", number)
        put(new.join(found.filter("action = 'new'").select("seq"), "seq").select(*reps.columns), f"{path}/representatives", number)
        put(found, f"{path}/decisions", number)

    return run


def index_batch(path: str, id_: str, fields: list[tuple[str, str, bool]], deleted: str = "deleted", order: str = "version") -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: writes the postings of the records that a batch has changed (the last version of each), and which
    they are. A deleted record has no postings."""

    def run(batch: DataFrame, number: int) -> None:
        last = settled(batch.groupBy(id_).agg(F.max_by(F.struct(*batch.columns), order).alias("r")).select("r.*"))
        put(last.select(id_), f"{path}/records", number)
        put(fulltext.postings(last.filter(~F.coalesce(deleted, F.lit(False))), id_, fields), f"{path}/postings", number)

    return run


def index(spark: SparkSession, path: str, id_: str, kind: str = "long") -> DataFrame:
    """The postings of the last version of every record."""
    last = parts(spark, f"{path}/records", f"{id_} {kind}").groupBy(id_).agg(F.max("batch").alias("batch"))
    rows = parts(spark, f"{path}/postings", f"term string, {id_} {kind}, at array<struct<pos:int,class:string>>")
    return rows.join(last, [id_, "batch"]).select("term", id_, "at")


def run_batches(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Runs a stream over what is there now."""
    stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def run_loads(loads: Iterable[DataFrame], each: Callable[[DataFrame, int], None], path: str) -> None:
    """Loads that come one after another under a path, each a batch of its own: the stream runs over what is new after each, by
    however many tasks it was written."""
    for load in loads:
        load.write.mode("append").parquet(f"{path}/in")
        run_batches(load.sparkSession.readStream.schema(load.schema).parquet(f"{path}/in"), each, f"{path}/checkpoint")


_REF, _PAGE = "walk string, key string, url string, position long", "walk string, page string, position long, reason string"


def walk_batch(path: str, starts: DataFrame, stale: int = 0) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: goes on with every walk over a batch of fetched pages (as ``walks.walked`` takes them) from where
    the batches before have left it, and writes what is found after each. A batch holds whole pages of a walk from there on;
    a walk that has stopped for good stays so."""

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        pages = settled(batch)
        done = settled(parts(spark, f"{path}/pages", f"{_PAGE}, next string", number))
        refs = parts(spark, f"{path}/refs", _REF, number).select("walk", "key")
        last = done.groupBy("walk").agg((F.max("position") + 1).alias("pages"), F.max_by(F.struct("next", "reason"), "position").alias("x"))
        further = last.filter("x.reason IN ('end', 'pages') AND x.next IS NOT NULL").select("walk", F.col("x.next").alias("page"))
        begin = starts.select("walk", "page").join(last.select("walk"), "walk", "left_anti").unionByName(further)
        kept, found = walks.walked(pages, begin, refs, last.select("walk", "pages"), stale)
        following = pages.groupBy("walk", "page").agg(F.min("next").alias("next"))
        put(found, f"{path}/refs", number)
        put(kept.join(following, ["walk", "page"]).select("walk", "page", "position", "reason", "next"), f"{path}/pages", number)

    return run


def walk_refs(spark: SparkSession, path: str) -> DataFrame:
    return parts(spark, f"{path}/refs", _REF).drop("batch")
