"""Incremental ingest: a stream of events, each idempotency key once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def deduplicated(events: DataFrame, key: list[str], ts: str, late: str = "7 days") -> DataFrame:
    """The first event of each key within the watermark, state older than which is dropped."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).dropDuplicatesWithinWatermark(key)


def drain(stream_: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Runs a stream over what is there now, and reads what it has written."""
    stream_.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(path).awaitTermination()
    return stream_.sparkSession.read.parquet(path)
