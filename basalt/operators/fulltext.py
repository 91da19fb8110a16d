"""Ranked full-text search: positional postings of English stems, queries with phrases, exclusions and alternatives, cover
density; and similarity search over trigrams by counts of shared ones.

An index is a DataFrame of postings (or a table that they were written to): a query reads only its terms' rows, and what
it groups is a record's own occurrences of them. Words are runs of letters and digits. Positions count all words; words
without weight (stop words) have none, and a later field goes on behind the last position that an earlier one holds.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basalt.functions.stem import STOP_WORDS, stem, stems
from basalt.functions.text import trigrams

#: What an occurrence counts by its field's class.
WEIGHTS = {"A": 1.0, "B": 0.4, "C": 0.2, "D": 0.1}
LEAST = 0.25


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def occurrences(text: Column, english: bool = True) -> Column:
    """``term, pos`` of a text's words: of stems without stop words, or of the words as they are."""
    plain = words(text)
    placed = F.transform(F.arrays_zip((stems(plain) if english else plain).alias("term"), plain.alias("word")), lambda x, i: F.struct(x["term"].alias("term"), (i + 1).alias("pos"), x["word"].alias("word")))
    if english:
        placed = F.filter(placed, lambda x: ~x["word"].isin(*STOP_WORDS))
    return F.transform(placed, lambda x: F.struct(x["term"].alias("term"), x["pos"].alias("pos")))


def vector(docs: DataFrame, fields: list[tuple[str, str, bool]], into: str = "vector") -> DataFrame:
    """Adds ``term, pos, class`` of all fields (column, class, whether it is English), one behind the other."""
    for i, (name, _, english) in enumerate(fields):
        docs = docs.withColumn(f"_v{i}", occurrences(F.col(name), english))
    offset, parts = F.lit(0), []

    def behind(at: Column, kind: str):
        return lambda x: F.struct(x["term"].alias("term"), (x["pos"] + at).alias("pos"), F.lit(kind).alias("class"))

    for i, (_, kind, _) in enumerate(fields):
        parts.append(F.transform(f"_v{i}", behind(offset, kind)))
        offset = offset + F.coalesce(F.array_max(F.transform(f"_v{i}", lambda x: x["pos"])), F.lit(0))
    return docs.withColumn(into, F.concat(*parts)).drop(*(f"_v{i}" for i in range(len(fields))))


def postings(docs: DataFrame, id_: str, fields: list[tuple[str, str, bool]]) -> DataFrame:
    """``term, id, at``: of each term and record the places (``pos, class``) in order."""
    each = vector(docs.select(id_, *dict.fromkeys(f for f, _, _ in fields if f != id_)), fields, "_vector").select(id_, F.explode("_vector").alias("e"))
    return each.groupBy(F.col("e.term").alias("term"), id_).agg(F.array_sort(F.collect_list(F.struct("e.pos", "e.class"))).alias("at"))


@dataclass(frozen=True)
class Clause:
    """Terms that stand at fixed distances from the first (a single term, mostly), or must not be there."""

    terms: tuple[str, ...]
    steps: tuple[int, ...]
    excluded: bool = False


@dataclass(frozen=True)
class Query:
    """Any of the alternatives, in each of which all clauses hold."""

    alternatives: tuple[tuple[Clause, ...], ...]

    @property
    def terms(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys(t for a in self.alternatives for c in a for t in c.terms))


def web_query(said: str, english: bool = True) -> Query:
    """A query as people type it: words must all be there, ``"a phrase"`` in a row, ``-word`` not, ``or`` parts alternatives.
    Other signs part words; words without weight don't count but hold their place in a phrase."""
    alternatives: list[list[Clause]] = [[]]
    for minus, phrase, word in re.findall(r'(-?)(?:"([^"]*)"?|([^\s"]+))', said):
        if word.lower() == "or" and not minus:
            alternatives.append([])
            continue
        parts = [w for w in re.split(r"[^\w]+|_", (phrase or word).lower()) if w]
        placed = [(stem(w) if english else w, i) for i, w in enumerate(parts) if not (english and w in STOP_WORDS)]
        if placed:
            alternatives[-1].append(Clause(tuple(t for t, _ in placed), tuple(i - placed[0][1] for _, i in placed), bool(minus)))
    return Query(tuple(tuple(a) for a in alternatives if a))


def any_query(said: str) -> Query:
    """Any of the words, parted by white space or ``|``; other signs within them are left out."""
    found = [re.sub("[^a-zA-Z0-9]", "", w).lower() for w in re.split(r"\s*\|\s*|\s+", said)]
    return Query(tuple((Clause((stem(w),), (0,)),) for w in found if w and w not in STOP_WORDS))


def relaxed(*groups: str) -> str:
    """The query that any of several queries' words answer."""
    return " | ".join(g.strip() for g in groups if g and g.strip())


def _ends(entries: Column, clause: Clause):
    """Whether a clause's occurrence ends at an entry: with its last term, the others before it at their distances."""
    last = clause.steps[-1]

    def stands(term: str, place: Column):
        return F.exists(entries, lambda x: (x["term"] == term) & (x["pos"] == place))

    def test(e: Column) -> Column:
        out = e["term"] == clause.terms[-1]
        for t, s in zip(clause.terms[:-1], clause.steps[:-1]):
            out = out & stands(t, e["pos"] - (last - s))
        return out

    return test


def ranked(index: DataFrame, id_: str, query: Query, weights: dict[str, float] | None = None) -> DataFrame:
    """``id, rank`` of the records that answer the query. The rank is the sum over the covers, which are the least stretches
    of places that answer it: the harmonic mean of the weights of the query's terms in it, over 1 and the number of other
    places in it. An alternative whose excluded terms a record has doesn't count for it. Ranks have nine places, so that equal ones are equal
    in whatever order they were summed."""
    weight = weights or WEIGHTS
    if not query.alternatives or not query.terms:
        return index.select(id_, F.lit(0.0).alias("rank")).limit(0)
    hit = index.filter(F.col("term").isin(*query.terms))
    grouped = hit.groupBy(id_).agg(F.array_sort(F.flatten(F.collect_list(F.transform("at", lambda x: F.struct(x["pos"].alias("pos"), F.col("term").alias("term"), x["class"].alias("class")))))).alias("_e"))
    e = F.col("_e")
    value = F.create_map(*(F.lit(x) for kv in weight.items() for x in kv))
    wanted = [(i, c) for i, a in enumerate(query.alternatives) for c in a if not c.excluded]
    allowed = {i: F.lit(True) for i, _ in enumerate(query.alternatives)}
    for i, a in enumerate(query.alternatives):
        for c in a:
            if c.excluded:
                test = _ends(e, c)
                allowed[i] = allowed[i] & ~F.exists(e, test)
    flags = F.array(*(allowed[i] for i in range(len(query.alternatives))))
    kind = "struct<begins:array<int>,last:int,rank:double>"
    begin = F.struct(F.array(*(F.lit(-1) for _ in wanted)).alias("begins"), F.lit(-1).alias("last"), F.lit(0.0).alias("rank")).cast(kind)

    def step(s: Column, x: Column) -> Column:
        begins = [F.when(_ends(e, c)(x), x["pos"] - c.steps[-1]).otherwise(F.get(s["begins"], F.lit(k))) for k, (_, c) in enumerate(wanted)]
        starts = []
        for i, _ in enumerate(query.alternatives):
            own = [begins[k] for k, (j, _) in enumerate(wanted) if j == i]
            if own:
                starts.append(F.when(F.get(F.col("_ok"), F.lit(i)), F.least(*own) if len(own) > 1 else own[0]).otherwise(-1))
        start = F.greatest(*starts) if len(starts) > 1 else starts[0]
        inside = F.filter(e, lambda y: (y["pos"] >= start) & (y["pos"] <= x["pos"]))
        n = F.size(inside)
        inverse = F.aggregate(inside, F.lit(0.0), lambda a, y: a + 1.0 / F.element_at(value, y["class"]))
        noise = x["pos"] - start - (n - 1)
        noise = F.when(noise < 0, F.floor((n - 1) / 2)).otherwise(noise)
        new = start > s["last"]
        return F.struct(F.array(*begins).alias("begins"), F.when(new, start).otherwise(s["last"]).alias("last"), (s["rank"] + F.when(new, n / inverse / (1 + noise)).otherwise(0.0)).alias("rank")).cast(kind)

    if not wanted:
        return grouped.select(id_, F.lit(0.0).alias("rank")).limit(0)
    counted = grouped.withColumn("_ok", flags).withColumn("_s", F.aggregate("_e", begin, step))
    return counted.filter(F.col("_s.last") >= 0).select(id_, F.round(F.col("_s.rank"), 9).alias("rank"))


def top(found: DataFrame, id_: str, n: int) -> DataFrame:
    """The ``n`` highest ranks, equal ones by id."""
    return found.orderBy(F.desc("rank"), id_).limit(n)


def grams(docs: DataFrame, id_: str, fields: list[str]) -> DataFrame:
    """``gram, id, field, n``: every distinct trigram of each field, and how many the field has."""
    each = F.array(*(F.struct(F.lit(f).alias("field"), trigrams(F.col(f)).alias("grams")) for f in fields))
    rows = docs.select(id_, F.explode(each).alias("f")).select(id_, "f.field", F.size("f.grams").alias("n"), F.explode("f.grams").alias("gram"))
    return rows.select("gram", id_, "field", "n")


def similar(index: DataFrame, id_: str, query: str, least: float = LEAST) -> DataFrame:
    """``id, rank`` of the records one of whose fields has a trigram similarity of ``least`` or more with the query: the
    highest of the fields. Only fields that share enough trigrams are looked at further; the counts give the similarity."""
    spark = index.sparkSession
    asked = spark.range(1).select(F.explode(trigrams(F.lit(query))).alias("gram"), F.size(trigrams(F.lit(query))).alias("_q"))
    met = index.join(F.broadcast(asked), "gram").groupBy(id_, "field").agg(F.count("*").alias("c"), F.first("n").alias("n"), F.first("_q").alias("_q"))
    met = met.filter(F.col("c") >= F.ceil(F.col("_q") * least - 1e-9))
    score = F.col("c") / (F.col("n") + F.col("_q") - F.col("c"))
    return met.withColumn("_s", score).filter(F.col("_s") >= least).groupBy(id_).agg(F.max("_s").alias("rank"))


def search(index: DataFrame, gram_index: DataFrame, id_: str, said: str, fuzzy: str | None = None, least: float = LEAST, n: int = 100, among: DataFrame | None = None) -> DataFrame:
    """The ``n`` best answers: ranked ones, or, only where there is none, similar ones. ``among`` (ids) keeps those alone."""
    strict = ranked(index, id_, web_query(said)) if said.strip() else None
    loose = similar(gram_index, id_, fuzzy if fuzzy is not None else said, least) if (fuzzy if fuzzy is not None else said).strip() else None
    if among is not None:
        strict, loose = (x if x is None else x.join(among.select(id_), id_, "left_semi") for x in (strict, loose))
    if strict is None or loose is None:
        found = strict if strict is not None else loose
        return top(found if found is not None else index.select(id_, F.lit(0.0).alias("rank")).limit(0), id_, n)
    none = strict.agg(F.count("*").alias("n")).filter("n = 0").select()  # one row or none
    return top(strict.unionByName(loose.join(F.broadcast(none), how="left_semi")), id_, n)


def related(index: DataFrame, id_: str, said: str, shown: DataFrame, n: int = 100) -> DataFrame:
    """The ``n`` best records with any of the words, but those that are shown already."""
    return top(ranked(index, id_, any_query(said)).join(shown.select(id_), id_, "left_anti"), id_, n)


def with_rank(found: DataFrame, records: DataFrame, id_: str) -> DataFrame:
    """The records of the answers, ranks kept; answers without a record are left out."""
    return found.join(records, id_).orderBy(F.desc("rank"), id_)
