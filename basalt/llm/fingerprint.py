"""Document fingerprints: bottom-k sketches of word-shingle hashes, in DataFrame functions alone.

A text's shingles are its runs of ``SHINGLE`` words (the whole text where it has fewer), split at ASCII
white space. The fingerprint is the ``k`` smallest distinct hashes. Fingerprints of parts merge into the
fingerprint of the whole, and two of them estimate resemblance, containment and distinct counts.

Null texts count as empty and have an empty fingerprint; two empty fingerprints are alike (1.0), an empty
and a non-empty one are not (0.0). Texts of any length are read whole. In ``edited``, rows that repeat an
id and a text are one document in the order of ids and come back as often as they are given, rows that share an
id come by text hash, and rows without an id come last; a single document is its own next one; an empty table gives
an empty result. Other columns are left out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

SHINGLE, K = 5, 128
_ONE = float(2**64)


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once, however often ``then`` names it."""
    return F.element_at(F.transform(F.array(value), then), 1)


def shingle_hashes(text: Column, n: int = SHINGLE) -> Column:
    def of(h: Column) -> Column:
        runs = F.transform(h, lambda x, i: F.xxhash64(x, *(F.get(h, i + k) for k in range(1, n))))
        whole = F.slice(runs, 1, F.greatest(F.size(h) - (n - 1), F.lit(0)))
        return F.when((F.size(h) > 0) & (F.size(h) < n), F.array(F.xxhash64(h))).otherwise(whole)

    return let(F.transform(words(text), lambda w: F.xxhash64(w)), of)


def sketch(text: Column, k: int = K, n: int = SHINGLE) -> Column:
    return bottom(shingle_hashes(text, n), k)


def bottom(hashes: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def sketch_parts(parts: DataFrame, key: str, text: str = "text", k: int = K, salts: int = 16) -> DataFrame:
    """One sketch for each value of ``key`` over all its rows: rows are sketched where they are, merged
    in ``salts`` groups of a key and then over the groups, k hashes at a time.

    Shingles don't cross rows. A key without words has an empty sketch."""
    one = parts.select(key, F.explode_outer(sketch(F.col(text), k)).alias("_h"))
    some = one.withColumn("_salt", F.pmod(F.xxhash64("_h"), F.lit(salts))).distinct()
    rank = F.row_number().over(Window.partitionBy(key, "_salt").orderBy("_h"))
    least = some.withColumn("_r", rank).filter(F.col("_r") <= k)
    return least.groupBy(key).agg(F.slice(F.sort_array(F.collect_list("_h")), 1, k).alias("sketch"))


def merged(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of what two sketches stand for together."""
    return bottom(F.concat(a, b), k)


def distinct(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    part = (F.element_at(a, -1).cast("double") + _ONE / 2) / _ONE
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / part)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity of what two sketches stand for, from 0 to 1."""

    def of(both: Column) -> Column:
        shared = F.size(F.array_intersect(F.array_intersect(a, b), both)).cast("double")
        return F.when(F.size(both) == 0, F.lit(1.0)).otherwise(shared / F.greatest(F.size(both), F.lit(1)))

    return let(merged(a, b, k), of)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated part of a's shingles that b has, from 0 to 1."""
    shared = resemblance(a, b, k) * let(merged(a, b, k), lambda u: distinct(u, k))
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), shared / F.greatest(distinct(a, k), F.lit(1.0))))


def text_of(a: Column) -> Column:
    """A sketch as a string: 16 hexadecimal digits a hash."""
    return F.array_join(F.transform(a, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def following(ids: DataFrame) -> DataFrame:
    """``ids`` with ``next_id, next_th`` of the row after it in order, the first after the last.
    Only ids move: ranges are numbered, each range knows its own successors, and the ends are joined by a
    list of the ranges' first rows, as long as there are partitions."""
    order = [F.col("doc_id").asc_nulls_last(), F.col("th")]
    at = F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "th")
    ranged = written(ids.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    inside = Window.partitionBy("part").orderBy(*order)
    firsts = ranged.groupBy("part").agg(F.min(at).alias("first"))
    ends = Window.orderBy("part")  # one row a partition
    nexts = firsts.select("part", F.coalesce(F.lead("first").over(ends), F.first("first").over(ends)).alias("wrap"))
    linked = ranged.withColumn("after", F.lead(at).over(inside)).join(F.broadcast(nexts), "part")
    found = F.coalesce("after", "wrap")
    return linked.select(*ids.columns, found["doc_id"].alias("next_id"), found["th"].alias("next_th"))


def edited(docs: DataFrame, k: int = K) -> DataFrame:
    """Every document with its edited text, whose second half (rounded down) is replaced by the first as
    many code points of the next document: ``doc_id, n_chars, text, edited, sketch, edited_sketch,
    next_sketch``.

    Texts are shuffled once, by id, for both joins; what is shuffled anew is the head that replaces."""
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select(F.col("doc_id").cast("long"), text.alias("text"), F.xxhash64(text).alias("th"))
    # Plain keys, for joins that find the texts where the grouping has put them.
    no, id_ = F.col("doc_id").isNull(), F.coalesce("doc_id", F.lit(0))
    once = keyed.groupBy(no.alias("no"), id_.alias("id"), "th").agg(F.first("text").alias("text"))
    # How often a row is there goes with the ids: both joins read the same texts, so these are shuffled once.
    sizes = keyed.groupBy("doc_id", "th", F.char_length("text").alias("n")).agg(F.count("*").alias("times"))
    half = F.floor(F.col("n") / 2).cast("int")
    links = following(sizes).select(
        no.alias("of_no"), id_.alias("of_id"), F.col("th").alias("of_th"), "n", "times", half.alias("half"),
        F.col("next_id").isNull().alias("no"), F.coalesce("next_id", F.lit(0)).alias("id"), F.col("next_th").alias("th"),
    )
    head = F.substring("text", F.lit(1), F.col("half")).alias("head")
    heads = once.join(links, ["no", "id", "th"]).select(
        F.col("of_no").alias("no"), F.col("of_id").alias("id"), F.col("of_th").alias("th"), "n", "times", "half", head, sketch(F.col("text"), k).alias("next_sketch")
    )
    new = F.concat(F.substring("text", F.lit(1), F.col("n") - F.col("half")), "head")
    out = once.join(heads, ["no", "id", "th"]).select(
        F.when(~F.col("no"), F.col("id")).alias("doc_id"), F.col("n").cast("long").alias("n_chars"), "text", new.alias("edited"), sketch(F.col("text"), k).alias("sketch"), "next_sketch", "times"
    ).withColumn("edited_sketch", sketch(F.col("edited"), k))
    return out.withColumn("_each", F.explode(F.sequence(F.lit(1).cast("long"), "times"))).drop("times", "_each")
