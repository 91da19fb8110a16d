"""From raw documents to packed training sequences: five stages, each of which works on what the one before
it kept. Null and empty texts, repeated rows, extra columns and empty tables pass as the operators define."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basalt.llm import jaccard, langid, linededup, packing, secretscan
from basalt.llm.common import table, text_hash, written

#: Below this score a text's language counts as unknown.
LEAST_SCORE = 0.2
#: Ids that are broadcast at most; beyond, the join is a shuffle.
BROADCAST_ROWS = 1_000_000

#: A text's shingles, edits and learned filters are beyond SQL; the tests hold each stage against brute force.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose text is in no language: without a letter, or unlike all that is learned from the
    rows with a language. If none has one, every text with a letter stays."""
    learned = langid.train(docs.filter(~langid.held_out()).select("text", "lang"))
    known = F.col("lang_pred") != langid.UNKNOWN if learned.langs else F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    found = langid.predict(docs, learned)
    sure = F.col("score") >= LEAST_SCORE if learned.langs else F.lit(True)
    return found.filter(known & sure).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated lines out of the texts. A document that loses all of its text so is dropped."""
    found = linededup.dedup(docs)
    gone = (F.col("n_removed") > 0) & ~F.col("kept").rlike(r"\S")
    new = {"text": F.col("kept"), "n_chars": F.char_length("kept").cast("long")}
    return found.filter(~gone).select(*(new[c].alias(c) if c in new else F.col(f"rest.`{c}`").alias(c) for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays (where rows share that id, the one
    with the smallest hash of its text); of rows that share id and text, one. Rows without an id stay, all of them."""
    found = jaccard.join(docs.select("doc_id", "text")).filter(F.col("doc_id").isNotNull())
    place = F.struct("doc_id", "text_hash")
    firsts = found.filter(F.col("component").isNotNull()).groupBy("component").agg(F.min(place).alias("first"))
    later = found.join(firsts, "component").filter(place > F.col("first"))
    later = written(later.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct())
    small = later.count() <= BROADCAST_ROWS
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("_id"), text_hash().alias("_hash"))
    kept = rows.join(F.broadcast(later) if small else later, ["_id", "_hash"], "left_anti")
    twice = written(found.groupBy("doc_id", "text_hash").count().filter(F.col("count") > 1).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")))
    if not twice.isEmpty():
        several = twice.count() <= BROADCAST_ROWS
        of = kept.join(F.broadcast(twice) if several else twice, ["_id", "_hash"], "left_semi").dropDuplicates(["_id", "_hash"])
        kept = kept.join(F.broadcast(twice) if several else twice, ["_id", "_hash"], "left_anti").unionByName(of)
    return kept.select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the texts; every document stays, a null text too."""
    return secretscan.redacted(docs).withColumn("n_chars", F.coalesce(F.char_length("text").cast("long"), F.lit(0).cast("long"))).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 1024 tokens. Null texts count as empty; rows
    that repeat are packed as often."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


STAGES = [
    ("language ID", language_id),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("secret scans", secret_scan),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
