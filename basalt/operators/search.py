"""Search over records: query rewriting, token filters, trigram similarity, ranked terms, the cascade."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basalt.functions.text import tokens, trigrams

TRIGRAM_LEAST, RELATED_WEIGHT = 0.25, 0.9


@dataclass(frozen=True)
class Prepared:
    """A query after corrections and expansions; each group is a set of alternatives."""

    raw: str
    tokens: tuple[str, ...]
    groups: tuple[tuple[str, ...], ...]

    @property
    def relaxed(self) -> tuple[str, ...]:
        """Every single word of every alternative."""
        return tuple(dict.fromkeys(w for g in self.groups for a in g for w in a.split()))


def prepare(query: str, corrections: dict[str, str] | None = None, expansions: dict[str, tuple[str, ...]] | None = None) -> Prepared:
    """Words in lower case, corrected once and expanded by the corrected word."""
    words = [w for w in (re.sub(r"[^a-z0-9'-]", "", x) for x in query.lower().split()) if w]
    fixed = [(corrections or {}).get(w, w) for w in words]
    return Prepared(query, tuple(fixed), tuple((w, *(expansions or {}).get(w, ())) for w in fixed))


def prepared_column(query: Column, corrections: dict[str, str]) -> Column:
    """Corrected words of a query column, for many queries at once."""
    words = F.array_remove(F.transform(F.split(F.lower(query), r"\s+"), lambda w: F.regexp_replace(w, r"[^a-z0-9'-]", "")), "")
    if not corrections:
        return words
    table = F.create_map(*(F.lit(x) for kv in sorted(corrections.items()) for x in kv))
    return F.transform(words, lambda w: F.coalesce(F.try_element_at(table, w), w))


def haystack(*fields: Column) -> Column:
    return F.lower(F.concat_ws(" ", *fields))


def matches_all(text: Column, words: tuple[str, ...]) -> Column:
    found = F.lit(True)
    for w in words:
        found = found & text.contains(w.lower())
    return found


def matches_any(text: Column, words: tuple[str, ...]) -> Column:
    found = F.lit(not words)
    for w in words:
        found = found | text.contains(w.lower())
    return found


def matched_words(text: Column, words: tuple[str, ...]) -> Column:
    return F.filter(F.array(*(F.lit(w) for w in words)), lambda w: text.contains(F.lower(w)))


def trigram_similarity(text: Column, query: str) -> Column:
    a, b = trigrams(text), trigrams(F.lit(query))
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(union, F.lit(1)))


def trigram_search(docs: DataFrame, fields: list[str], query: str, least: float = TRIGRAM_LEAST) -> DataFrame:
    score = F.greatest(*(trigram_similarity(F.col(f), query) for f in fields)) if len(fields) > 1 else trigram_similarity(F.col(fields[0]), query)
    return docs.withColumn("score", score).filter(F.col("score") >= least)


def postings(docs: DataFrame, id_: str, fields: dict[str, float]) -> DataFrame:
    """``term, id, weight``: the inverted index, each term with the sum of the weights of the fields it is in."""
    def of(field: str, weight: float) -> Column:
        return F.transform(tokens(F.col(field)), lambda t: F.struct(t.alias("term"), F.lit(weight).alias("weight")))

    entries = F.flatten(F.array(*(of(f, w) for f, w in fields.items())))
    each = docs.select(id_, F.explode(entries).alias("e"))
    return each.groupBy("e.term", id_).agg(F.sum("e.weight").alias("weight"))


def ranked_any(index: DataFrame, id_: str, words: tuple[str, ...]) -> DataFrame:
    """Records with any word: how many, and the weights' sum as rank."""
    hit = index.filter(F.col("term").isin(*words))
    return hit.groupBy(id_).agg(F.count("*").alias("n_terms"), F.sum("weight").alias("rank"))


def ranked_all(index: DataFrame, id_: str, words: tuple[str, ...]) -> DataFrame:
    return ranked_any(index, id_, words).filter(F.col("n_terms") == len(set(words)))


def cascade(docs: DataFrame, id_: str, fields: dict[str, float], words: tuple[str, ...]) -> DataFrame:
    """``id, kind, rank``: records with all words (strict), others with any (related, weighted down); if there
    is neither, those that contain all words as substrings (corpus). One plan; the fallback is a semi-join
    that is empty when an earlier kind has hits."""
    any_ = ranked_any(postings(docs, id_, fields), id_, words)
    strict = F.col("n_terms") == len(set(words))
    found = any_.select(id_, F.when(strict, "strict").otherwise("related").alias("kind"), F.when(strict, F.col("rank")).otherwise(F.col("rank") * RELATED_WEIGHT).alias("rank"))
    none = found.agg(F.count("*").alias("n")).filter("n = 0")
    text = haystack(*(F.col(f) for f in fields))
    corpus = docs.filter(matches_all(text, words)).select(id_, F.lit("corpus").alias("kind"), F.lit(0.0).alias("rank"))
    return found.unionByName(corpus.join(F.broadcast(none), how="left_semi"))  # one row or none


def search_documents(deals: DataFrame, items: DataFrame, deal: str, position: str, *fields: str) -> DataFrame:
    """One document a deal: its items' fields in order of position, and the first title."""
    entry = F.struct(position, *fields)
    grouped = items.groupBy(deal).agg(F.array_sort(F.collect_list(entry)).alias("items"))  # a deal's own items
    text = F.array_join(F.transform("items", lambda x: F.concat_ws(" ", *(x[f] for f in fields))), " ")
    return deals.join(grouped, deal).withColumn("document", text).withColumn("title", F.col("items")[0][fields[0]]).withColumn("n_items", F.size("items")).drop("items")


def missed_words(text: Column, words: tuple[str, ...]) -> Column:
    return F.array_except(F.array(*(F.lit(w) for w in words)), matched_words(text, words))


def search_url(base: str, query: Column) -> Column:
    return F.concat(F.lit(f"{base}?q="), F.url_encode(F.trim(query)))


def search_page(docs: DataFrame, id_: str, fields: dict[str, float], words: tuple[str, ...], adapter: str | None = None, source: str | None = None, fetched: DataFrame | None = None) -> DataFrame:
    """``id, kind, rank`` of a whole search: strict and related hits; if there is neither, what contains all words (corpus), or
    else any (related). A blank query shows the corpus. Records fetched just now (``fetched``: ids) come as corpus of
    rank 1 instead of as hits. ``source`` keeps records of that ``adapter`` column alone; null, blank and ``all`` keep every one."""
    if not words:
        found = docs.select(id_, F.lit("corpus").alias("kind"), F.lit(0.0).alias("rank"))
    else:
        any_ = ranked_any(postings(docs, id_, fields), id_, words)
        strict = F.col("n_terms") == len(set(words))
        hits = any_.select(id_, F.when(strict, "strict").otherwise("related").alias("kind"), F.when(strict, F.col("rank")).otherwise(F.col("rank") * RELATED_WEIGHT).alias("rank"))
        none = hits.agg(F.count("*").alias("n")).filter("n = 0").select()
        text = haystack(*(F.col(f) for f in fields))
        rest = docs.filter(matches_any(text, words)).select(id_, matches_all(text, words).alias("_all"))
        whole = rest.agg(F.coalesce(F.bool_or("_all"), F.lit(False)).alias("_some"))  # one row
        rest = rest.join(F.broadcast(whole), F.col("_all") == F.col("_some")).select(id_, F.when(F.col("_all"), "corpus").otherwise("related").alias("kind"), F.lit(0.0).alias("rank"))
        found = hits.unionByName(rest.join(F.broadcast(none), how="left_semi"))  # one row or none
    if fetched is not None:
        new = fetched.select(id_).distinct()
        found = found.join(new, id_, "left_anti").unionByName(new.select(id_, F.lit("corpus").alias("kind"), F.lit(1.0).alias("rank")))
    if adapter and (source or "").strip() not in ("", "all"):
        found = found.join(docs.filter(F.col(adapter) == source).select(id_), id_, "left_semi")
    return found


def diagnostics(found: DataFrame) -> DataFrame:
    """How many hits of each kind, and in all."""
    return found.agg(*(F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in ("strict", "related", "corpus")), F.count("*").alias("n_total"))
