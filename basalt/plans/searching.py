"""Queries of ranked search, each with its SQL; they join those of the catalogue.

A record's title is its name, its place its brand, its document name and type with words between them, its source its
brand as it is. The names' words are all but their own stems (``larg``, ``medium``), so SQL can hold places and covers.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from basalt.operators import fulltext, search
from basalt.plans.catalogue import parts, query
from basalt.sources.tables import spread

FIELDS = [("title", "A", True), ("place", "B", True), ("document", "C", True), ("source", "D", False)]


def documents(spark, sf_dir):
    return spread(parts(spark, sf_dir)).select(
        "p_partkey", F.col("p_name").alias("title"), F.col("p_brand").alias("place"), F.concat(F.lit("The "), F.col("p_name"), F.lit(", sold by the "), F.lower("p_type"), F.lit(" of a "), F.element_at(F.split("p_name", " "), -1)).alias("document"), F.col("p_brand").alias("source")
    )


#: Places of the words that count: title 1 and 2; brand and its number 3 and 4; document "The <name>, sold by the <type> of a
#: <noun>" from 5 on, with places for words without weight; the source behind it.
_ENTRIES = """
    w AS (SELECT p_partkey AS id, string_split(p_name, ' ') AS n, lower(p_type) AS kind, string_split(lower(p_brand), '#') AS b FROM part),
    e AS (SELECT id, term, pos, wt FROM (
        SELECT id, n[1] AS term, 1 AS pos, 1.0 AS wt FROM w UNION ALL SELECT id, n[2], 2, 1.0 FROM w
        UNION ALL SELECT id, b[1], 3, 0.4 FROM w UNION ALL SELECT id, b[2], 4, 0.4 FROM w
        UNION ALL SELECT id, n[1], 6, 0.2 FROM w UNION ALL SELECT id, n[2], 7, 0.2 FROM w UNION ALL SELECT id, 'sold', 8, 0.2 FROM w UNION ALL SELECT id, kind, 11, 0.2 FROM w UNION ALL SELECT id, n[2], 14, 0.2 FROM w
        UNION ALL SELECT id, b[1], 15, 0.1 FROM w UNION ALL SELECT id, b[2], 16, 0.1 FROM w))"""


def _covers(ends: dict[str, str], begins: str, terms: str, without: str = "") -> str:
    """Ranks in SQL: ``ends`` gives for each clause the begin of an occurrence that ends at an entry (null for none)."""
    last = ", ".join(f"max({x}) OVER (PARTITION BY id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS {k}" for k, x in ends.items())
    return f"""WITH {_ENTRIES},
        h AS (SELECT * FROM e WHERE term IN ({terms}){without}),
        l AS (SELECT id, pos, {last} FROM h),
        s AS (SELECT id, pos, {begins} AS s FROM l),
        c AS (SELECT id, s, min(pos) AS e FROM s WHERE s IS NOT NULL GROUP BY 1, 2),
        r AS (SELECT c.id, c.s, c.e, count(*) AS n, sum(1 / wt) AS inv FROM c JOIN h ON h.id = c.id AND h.pos BETWEEN c.s AND c.e GROUP BY 1, 2, 3)
        SELECT id AS p_partkey, round(sum(n / inv / (1 + CASE WHEN e - s - (n - 1) < 0 THEN (n - 1) // 2 ELSE e - s - (n - 1) END)), 6) AS rank FROM r GROUP BY 1"""


def _rounded(found):
    return found.withColumn("rank", F.round("rank", 6))


def _index(spark, sf_dir):
    return fulltext.postings(documents(spark, sf_dir), "p_partkey", FIELDS)


@query(_covers({"a": "CASE WHEN term = 'large' THEN pos END", "b": "CASE WHEN term = 'bolt' THEN pos END"}, "CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN least(a, b) END", "'large', 'bolt'"))
def ranked_all_words(spark, sf_dir):
    """Both words, in any of their forms; two fields hold both, and the document has one of them twice."""
    return _rounded(fulltext.ranked(_index(spark, sf_dir), "p_partkey", fulltext.web_query("the Largely bolts?")))


@query(_covers({"a": "CASE WHEN term = 'widget' AND EXISTS (SELECT 1 FROM h x WHERE x.id = h.id AND x.term = 'cold' AND x.pos = h.pos - 1) THEN pos - 1 END", "b": "CASE WHEN term = 'promo' THEN pos END"},
    "nullif(greatest(coalesce(a, -1), coalesce(CASE WHEN id NOT IN (SELECT id FROM e WHERE term = '13') THEN b END, -1)), -1)", "'widget', 'cold', 'promo', '13'"))
def ranked_phrase_or_exclusion(spark, sf_dir):
    """A phrase, or else another word without a brand's number."""
    return _rounded(fulltext.ranked(_index(spark, sf_dir), "p_partkey", fulltext.web_query('"cold widgets" or promo -13')))


@query(f"SELECT * FROM ({_covers({'a': 'pos'}, 'a', chr(39) + 'hot' + chr(39) + ', ' + chr(39) + 'gear' + chr(39))}) ORDER BY rank DESC, p_partkey LIMIT 25")
def ranked_any_top(spark, sf_dir):
    """The first 25 of those with any of two words: a report of the best, equal ranks by key."""
    return _rounded(fulltext.top(_rounded(fulltext.ranked(_index(spark, sf_dir), "p_partkey", fulltext.any_query("hot | gears"))), "p_partkey", 25))


_GRAMS = "list_distinct(flatten(list_transform(list_filter(string_split(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> ''), lambda w: list_transform(range(1, len(w) + 2), lambda i: substr('  ' || w || ' ', CAST(i AS BIGINT), 3)))))"
_SIM = "len(list_intersect({0}, {1})) / len(list_distinct(list_concat({0}, {1})))"
_DOC = "'The ' || p_name || ', sold by the ' || lower(p_type) || ' of a ' || string_split(p_name, ' ')[2]"


@query(f"""WITH g AS (SELECT p_partkey, {_GRAMS.format("p_name")} AS a, {_GRAMS.format("p_brand")} AS b, {_GRAMS.format(_DOC)} AS c, {_GRAMS.format("'colb wiget 13'")} AS q FROM part)
    SELECT * FROM (SELECT p_partkey, round(greatest({_SIM.format("a", "q")}, {_SIM.format("b", "q")}, {_SIM.format("c", "q")}), 6) AS rank FROM g) WHERE rank >= 0.25""")
def trigram_index_search(spark, sf_dir):
    """Three fields through an index of trigrams: what shares too few is never compared."""
    return _rounded(fulltext.similar(fulltext.grams(documents(spark, sf_dir), "p_partkey", ["title", "place", "document"]), "p_partkey", "colb wiget 13"))


@query(f"""WITH g AS (SELECT p_partkey, {_GRAMS.format("p_name")} AS a, {_GRAMS.format(_DOC)} AS c, {_GRAMS.format("'cold wigdet'")} AS q FROM part WHERE p_brand = 'Brand#13')
    SELECT * FROM (SELECT p_partkey, round(greatest({_SIM.format("a", "q")}, {_SIM.format("c", "q")}), 6) AS rank FROM g) WHERE rank >= 0.25 ORDER BY rank DESC, p_partkey LIMIT 20""")
def search_falls_back_to_similar(spark, sf_dir):
    """No record has the misspelt word, so the similar ones of one source answer: the first 20."""
    docs = documents(spark, sf_dir)
    among = docs.filter("source = 'Brand#13'")
    found = fulltext.search(_index(spark, sf_dir), fulltext.grams(docs, "p_partkey", ["title", "document"]), "p_partkey", "cold wigdet", n=20, among=among)
    return _rounded(found)


@query(f"""WITH s AS ({_covers({'a': "CASE WHEN term = 'hot' THEN pos END", 'b': "CASE WHEN term = 'gear' THEN pos END"}, 'CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN least(a, b) END', "'hot', 'gear'")}),
    o AS ({_covers({'a': 'pos'}, 'a', "'hot', 'gear'")})
    SELECT p_partkey, p_brand, round(CASE WHEN s.rank IS NULL THEN {search.RELATED_WEIGHT} * o.rank ELSE s.rank END, 6) AS rank, CASE WHEN s.rank IS NULL THEN 'related' ELSE 'strict' END AS kind FROM o JOIN part USING (p_partkey) LEFT JOIN s USING (p_partkey)""")
def search_strict_and_related(spark, sf_dir):
    """Records with all words, and below them, at a lower weight, those with any; each joined to its record."""
    index, records = _index(spark, sf_dir), parts(spark, sf_dir).select("p_partkey", "p_brand")
    strict = fulltext.ranked(index, "p_partkey", fulltext.web_query("hot gear"))
    others = fulltext.ranked(index, "p_partkey", fulltext.any_query(fulltext.relaxed("hot gear", "", "gear"))).join(strict.select("p_partkey"), "p_partkey", "left_anti")
    both = strict.withColumn("kind", F.lit("strict")).unionByName(others.select("p_partkey", (F.col("rank") * search.RELATED_WEIGHT).alias("rank"), F.lit("related").alias("kind")))
    return _rounded(fulltext.with_rank(both, records, "p_partkey").select("p_partkey", "p_brand", "rank", "kind"))
