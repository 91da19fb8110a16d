"""Entity resolution: keys, blocking, pair scores, decisions, canonical records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basalt.functions.text import jaccard, tokens
from basalt.sources.shared import settled

MERGE, REVIEW = 0.85, 0.55


def url_key(url: Column) -> Column:
    return F.sha2(F.to_json(F.struct(F.lit("url").alias("kind"), url.alias("value"))), 256)


def external_key(adapter: Column, external_id: Column) -> Column:
    """Null without an id."""
    key = F.to_json(F.struct(F.lit("external").alias("kind"), adapter.alias("adapter"), external_id.alias("externalId")))
    return F.when(F.coalesce(external_id, F.lit("")) != "", F.sha2(key, 256))


def by_keys(records: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """Each record with the canonical record of each of its keys (the first that has the key): ``first_hit`` by
    the keys' order, and the number of different ones. The first record of a key is its own."""
    long = records.select(seq, F.explode(F.array(*(F.struct(F.lit(i).alias("prio"), F.col(k).alias("key")) for i, k in enumerate(keys)))).alias("k"))
    long = long.select(seq, "k.prio", "k.key").filter(F.col("key").isNotNull())
    firsts = long.groupBy("key").agg(F.min(seq).alias("canonical"))
    hits = long.join(firsts, "key").groupBy(seq).agg(F.min_by("canonical", "prio").alias("first_hit"), F.count_distinct("canonical").alias("n_canonicals"))
    return records.join(hits, seq, "left")


def numeric_score(pairs: list[tuple[Column, Column]]) -> Column:
    """Mean of the smaller over the larger, where both are positive; 0.5 if nowhere."""
    ratios = F.array_compact(F.array(*(F.when((a > 0) & (b > 0), F.least(a, b) / F.greatest(a, b)) for a, b in pairs)))
    total = F.aggregate(ratios, F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(ratios) > 0, total / F.greatest(F.size(ratios), F.lit(1))).otherwise(0.5)


def geo_score(a: Column, b: Column) -> Column:
    blank = F.coalesce(F.trim(a.cast("string")), F.lit("")).eqNullSafe("") | F.coalesce(F.trim(b.cast("string")), F.lit("")).eqNullSafe("")
    return F.when(blank, 0.5).when(a == b, 1.0).otherwise(0.0)


def cosine(a: Column, b: Column) -> Column:
    """0 if a norm is."""
    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, 0.0).otherwise(dot(a, b) / F.greatest(norm, F.lit(1e-300)))


def embedding_score(a: Column, b: Column) -> Column:
    """Cosine mapped to 0..1; 0.5 if a vector is missing or they differ in length."""
    unlike = a.isNull() | b.isNull() | (F.size(a) != F.size(b))
    return F.when(unlike, 0.5).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (cosine(a, b) + 1) / 2)))


def composite(lexical: Column, numeric: Column, geo: Column, embedding: Column | None = None) -> Column:
    if embedding is None:
        return 0.45 * lexical + 0.25 * numeric + 0.3 * geo
    return 0.32 * lexical + 0.18 * numeric + 0.15 * geo + 0.35 * embedding


def blended(base: Column, judged: Column, weight: float = 0.3) -> Column:
    """With a judge's score, if there is one."""
    w = min(max(weight, 0.0), 0.75)
    return F.when(judged.isNull(), base).otherwise((1 - w) * base + w * judged)


def decision(score: Column) -> Column:
    return F.when(score >= MERGE, "auto_merge").when(score >= REVIEW, "review").otherwise("new")


def candidate_pairs(records: DataFrame, block: str, title: str, seq: str, least: float) -> DataFrame:
    """Pairs of one block whose titles' Jaccard similarity can reach ``least``: they share one of the first
    tokens of each, as many as can be missing from a match and one, rarest first. Columns come twice, as
    ``l_`` and ``r_``, the earlier record left."""
    rows = records.withColumn("_tokens", tokens(F.col(title)))
    counts = rows.select(block, F.explode("_tokens").alias("_t")).groupBy(block, "_t").agg(F.count("*").alias("_df"))
    each = rows.select(block, seq, F.size("_tokens").alias("_n"), F.explode("_tokens").alias("_t")).join(counts, [block, "_t"])
    rank = F.row_number().over(Window.partitionBy(block, seq).orderBy("_df", "_t"))
    first = each.withColumn("_r", rank).filter(F.col("_r") <= F.col("_n") - F.ceil(F.lit(least) * F.col("_n") - 1e-9) + 1).select(block, "_t", seq, "_n")
    left = first.select(F.col(block).alias("_b"), "_t", F.col(seq).alias("_l"), F.col("_n").alias("_ln"))
    right = first.select(F.col(block).alias("_b"), "_t", F.col(seq).alias("_r"), F.col("_n").alias("_rn"))
    sizes = (F.least("_ln", "_rn") >= F.lit(least) * F.greatest("_ln", "_rn") - 1e-9) & (F.col("_l") < F.col("_r"))
    pairs = left.join(right, ["_b", "_t"]).filter(sizes).select("_l", "_r").distinct()
    l, r = (rows.select(*(F.col(c).alias(f"{p}{c}") for c in rows.columns)) for p in ("l_", "r_"))
    joined = pairs.join(l, F.col("_l") == F.col(f"l_{seq}")).join(r, F.col("_r") == F.col(f"r_{seq}"))
    return joined.withColumn("lexical", jaccard("l__tokens", "r__tokens")).drop("_l", "_r", "l__tokens", "r__tokens")


def best_candidate(pairs: DataFrame, record: str, candidate: str, score: str = "score") -> DataFrame:
    """Each record's highest score and its candidate; the first of equals."""
    return pairs.groupBy(record).agg(F.max(score).alias(score), F.max_by(candidate, F.struct(F.col(score), -F.col(candidate))).alias(candidate))


def merged_sources(records: DataFrame, key: list[str], seq: str, source: str) -> DataFrame:
    """Canonical records: the first record of each key stands for all; sources are kept, in order."""
    grouped = records.groupBy(*key).agg(F.min(seq).alias("canonical"), F.count("*").alias("n_sources"), F.array_sort(F.collect_set(source)).alias("sources"))
    return grouped.filter("n_sources > 1")


def clusters(records: DataFrame, pairs: DataFrame, seq: str = "seq") -> DataFrame:
    """``seq, canonical``: records in the order of ``seq`` each join the canonical record of the best earlier
    record that they match (``pairs``: ``l``, ``r``, ``score``, the earlier record left); those that match none
    found one. Rounds of pointer jumping, as many as the logarithm of the longest chain."""
    best = best_candidate(pairs.select(F.col("r").alias(seq), F.col("l").alias("parent"), "score"), seq, "parent").select(seq, "parent")
    found = records.select(seq).join(best, seq, "left").select(seq, F.coalesce("parent", seq).alias("canonical"))
    while True:
        found = settled(found)
        up = found.select(F.col(seq).alias("canonical"), F.col("canonical").alias("_up"))
        further = found.join(up, "canonical").select(seq, F.col("_up").alias("canonical"), (F.col("_up") != F.col("canonical")).alias("_moved"))
        if further.filter("_moved").isEmpty():
            return found
        found = further.select(seq, "canonical")
