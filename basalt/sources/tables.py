"""Sources and sinks: content-addressed evidence, JSON checkpoints, append logs, tables."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """Rows dealt out evenly, for costly work on each: a small file, or one with few row groups, would be read by few tasks."""
    spark = rows.sparkSession
    return rows.repartition(max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def evidence(rows: DataFrame, adapter: str, content: str) -> DataFrame:
    """One row for each content of an adapter, under its hash."""
    keyed = rows.select(F.col(adapter).alias("adapter"), F.sha2(F.col(content).cast("binary"), 256).alias("sha256"), F.col(content).alias("content"))
    return keyed.groupBy("adapter", "sha256").agg(F.first("content").alias("content"), F.count("*").alias("n_puts")).withColumn("size_bytes", F.octet_length("content"))


def put_evidence(rows: DataFrame, path: str, adapter: str, content: str) -> None:
    """Appends what the store lacks, partitioned by adapter; putting a content twice leaves one."""
    spark, new = rows.sparkSession, evidence(rows, adapter, content).drop("n_puts")
    try:
        known = spark.read.parquet(path).select("adapter", "sha256")
        new = new.join(known, ["adapter", "sha256"], "left_anti")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":  # the store's first write
            raise
    new.write.mode("append").partitionBy("adapter").parquet(path)


def read_checkpoint(spark: SparkSession, path: str, version: int, adapter: str) -> DataFrame:
    """References of a JSON checkpoint; one of another version or adapter is refused."""
    rows = spark.read.json(path, multiLine=True, schema="version int, adapter string, refs array<struct<url:string,externalId:string>>")
    right = F.assert_true((F.col("version") == version) & (F.col("adapter") == adapter), F.lit("a checkpoint of another version or adapter"))
    return rows.select("refs", right.alias("_ok")).filter(F.col("_ok").isNull()).select(F.posexplode("refs").alias("seq", "r")).select("seq", "r.url", F.col("r.externalId").alias("external_id"))


def write_checkpoint(refs: DataFrame, path: str, version: int, adapter: str) -> None:
    entry = F.struct(F.col("seq"), F.struct("url", F.col("external_id").alias("externalId")).alias("r"))
    one = refs.groupBy().agg(F.array_sort(F.collect_list(entry)).alias("x"))  # one catalogue's references
    one.select(F.lit(version).alias("version"), F.lit(adapter).alias("adapter"), F.transform("x", lambda e: e["r"]).alias("refs")).write.mode("overwrite").json(path)


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)
