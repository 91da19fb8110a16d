"""Ranked search against a plain version, stems against published examples, trigram counts against sets."""

import random

import pytest
from pyspark.sql import functions as F

from basalt.functions.stem import STOP_WORDS, stem
from basalt.operators import fulltext

FIELDS = [("title", "A", True), ("place", "B", True), ("body", "C", True), ("source", "D", False)]
STEMS = {
    "consignment": "consign", "consistency": "consist", "conspiracy": "conspiraci", "knightly": "knight", "generously": "generous", "generate": "generat", "happy": "happi", "dies": "die", "cries": "cri", "gas": "gas", "this": "this",
    "kiwis": "kiwi", "hopping": "hop", "hoping": "hope", "luxuriated": "luxuri", "sensational": "sensat", "businesses": "busi", "restaurants": "restaur", "electricity": "electr", "communication": "communic", "by": "by", "say": "say",
    "enjoy": "enjoy", "proceed": "proceed", "controlled": "control", "agreed": "agre", "adjustable": "adjust", "cease": "ceas", "triplicate": "triplic", "vietnamization": "vietnam", "skis": "ski", "inning": "inning", "naïve": "naïve",
}


def test_stems():
    assert {w: stem(w) for w in STEMS} == STEMS


def entries(row):
    out, offset = [], 0
    for (_, kind, english), text in zip(FIELDS, row[1:]):
        ws = [w for w in "".join(c if c.isalnum() else " " for c in (text or "").lower()).split()]
        own = [(i + 1, stem(w) if english else w) for i, w in enumerate(ws) if not (english and w in STOP_WORDS)]
        out += [(p + offset, t, fulltext.WEIGHTS[kind]) for p, t in own]
        offset += max((p for p, _ in own), default=0)
    return sorted(out)


def has(window, clause):
    places = {(p, t) for p, t, _ in window}
    return any(all((p + s - clause.steps[0], t) in places for t, s in zip(clause.terms, clause.steps)) for p, t in places if t == clause.terms[0])


def plain_rank(row, query):
    every = entries(row)
    doc = [e for e in every if e[1] in query.terms]
    ways = [a for a in query.alternatives if not any(c.excluded and has(doc, c) for c in a)]
    ways = [[c for c in a if not c.excluded] for a in ways]
    ways = [a for a in ways if a]

    def holds(window):
        return any(all(has(window, c) for c in a) for a in ways)

    rank, at, found = 0.0, 0, False
    while at < len(doc):
        end = next((e for e in range(at, len(doc)) if holds(doc[at : e + 1])), None)
        if end is None:
            break
        begin = next(b for b in range(end, -1, -1) if holds(doc[b : end + 1]))
        n = end - begin + 1
        noise = doc[end][0] - doc[begin][0] - (n - 1)
        rank += n / sum(1 / w for _, _, w in doc[begin : end + 1]) / (1 + (noise if noise >= 0 else (n - 1) // 2))
        found, at = True, begin + 1
    return round(rank, 9) if found else None


SAID = [
    "red pools", "pool", '"red pool"', "red -blue", '"red the pool" or services', "red or blue or -green", 'pool -"red blue"', "the", "", "-red", "red pool blue", '"blue red" pool or green -red', "Pools & services!", "or", "red red", '"pool', "bbs",
]


@pytest.fixture(scope="module")
def rows():
    r = random.Random(4)
    vocabulary = ["red", "reds", "pool", "pooling", "blue", "green", "the", "of", "service", "services", "x"]
    return [(i, *(" ".join(r.choices(vocabulary, k=r.randint(0, n))) if r.random() > 0.1 else None for n in (3, 2, 14)), r.choice(["bbs", "red", None])) for i in range(250)]


def test_ranks_equal_a_plain_version(spark, rows):
    index = fulltext.postings(spark.createDataFrame(rows, "id long, title string, place string, body string, source string"), "id", FIELDS).cache()
    for said in SAID:
        query = fulltext.web_query(said)
        got = {r.id: round(r["rank"], 9) for r in fulltext.ranked(index, "id", query).collect()}
        want = {r[0]: x for r in rows if query.terms and (x := plain_rank(r, query)) is not None}
        assert got == want, said
    query = fulltext.any_query("red | pools|of")
    want = sorted(((-x, r[0]) for r in rows if (x := plain_rank(r, query)) is not None))
    shown = spark.createDataFrame([(want[0][1],)], "id long")
    assert [r.id for r in fulltext.related(index, "id", "red | pools|of", shown, 5).collect()] == [i for _, i in want[1:6]]


def test_queries_as_said():
    q = fulltext.web_query('cheap "pool the services" -old or x')
    assert [[(c.terms, c.steps, c.excluded) for c in a] for a in q.alternatives] == [[(("cheap",), (0,), False), (("pool", "servic"), (0, 2), False), (("old",), (0,), True)], [(("x",), (0,), False)]]
    assert fulltext.relaxed("a | b", " ", "c") == "a | b | c" and not fulltext.web_query("the of").alternatives


def plain_grams(text):
    words = "".join(c if c.isascii() and c.isalnum() else " " for c in (text or "").lower()).split()
    return {f"  {w} "[i : i + 3] for w in words for i in range(len(w) + 1)}


def test_similar_and_its_place_behind_ranked_answers(spark, rows):
    docs = spark.createDataFrame(rows, "id long, title string, place string, body string, source string")
    grams = fulltext.grams(docs, "id", ["title", "place", "body"])
    for said in ("redd pol", "poolng services", "zzz", ""):
        q = plain_grams(said)
        want = {}
        for r in rows:
            score = max(len(plain_grams(t) & q) / len(plain_grams(t) | q) if plain_grams(t) | q else 0 for t in r[1:4])
            if q and score >= 0.25:
                want[r[0]] = round(score, 9)
        assert {r.id: round(r["rank"], 9) for r in fulltext.similar(grams, "id", said).collect()} == want, said
    index = fulltext.postings(docs, "id", FIELDS)
    strict = {r.id for r in fulltext.search(index, grams, "id", "red pool", n=1000).collect()}
    assert strict == {r[0] for r in rows if plain_rank(r, fulltext.web_query("red pool")) is not None}
    loose = [r.id for r in fulltext.search(index, grams, "id", "redd pol", n=7).collect()]
    assert len(loose) == 7 and fulltext.search(index, grams, "id", " ").count() == 0
    among = docs.filter("source = 'bbs'")
    assert {r.id for r in fulltext.search(index, grams, "id", "red pool", n=1000, among=among).collect()} == strict & {r[0] for r in rows if r[4] == "bbs"}
    none = docs.limit(0)
    assert fulltext.search(fulltext.postings(none, "id", FIELDS), fulltext.grams(none, "id", ["title"]), "id", "red").count() == 0
    assert [r.id for r in fulltext.with_rank(fulltext.top(fulltext.ranked(index, "id", fulltext.web_query("red")), "id", 3), docs.filter(F.col("id") >= 0), "id").collect()] == [r.id for r in fulltext.top(fulltext.ranked(index, "id", fulltext.web_query("red")), "id", 3).collect()]
