"""Prefix trie, SentencePiece and importance resampling: against plain Python, the library, and over odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from basalt.llm import piecebpe, prefixtrie, queries, resample

MODEL = public_tokenizers.path("piece_bpe_32k.model")
TURNS = "conv_id long, turn long, role string, text string, keys string, sizes long, _depth int"


def sha(x):
    return hashlib.sha256(x).hexdigest()


# --- prefix trie -------------------------------------------------------------------------------------------


def plain_sequences(rows):
    by = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            text = (text or "").encode()
            by[c].append((turn is not None, turn or 0, role or "", sha(text), text))
    return {c: [(x[2], x[4]) for x in sorted(t)] for c, t in by.items()}


def plain_rebuilt(seq):
    out = {}
    for c, own in seq.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = seq.get(c - int(math.fmod(c, 5)), [])[:h] + own[h:]
    return out


def plain_trie(seq):
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in seq.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    kids, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for k, of in members.items():
        if k:
            kids[k[:-1]] += 1
    for k, of in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += not kids[k]
            saved[k[:d]] += (len(of) - 1) * len(k[-1][1]) if k else 0
    return sorted(
        (min(of), len(k), min(members[k[:-1]]) if k else -99, len(of), kids[k], leaves[k], saved[k], sha(",".join(map(str, sorted(ends[k]))).encode())) for k, of in members.items()
    )


def rows_of(found):
    return sorted(tuple(-99 if x is None else x for x in r) for r in found.select(*prefixtrie.COLUMNS).collect())


@pytest.mark.parametrize("limit", [prefixtrie.LIMIT, 60, 4, 1])
def test_trie_of_the_table(spark, small, limit):
    turns = spark.read.parquet(f"{small}/conversations.parquet")
    want = plain_trie(plain_rebuilt(plain_sequences([tuple(r) for r in turns.select("conv_id", "turn", "role", "text").collect()])))
    assert rows_of(prefixtrie.trie(prefixtrie.rebuilt(prefixtrie.sequences(turns)), limit)) == want


@pytest.mark.parametrize("limit", [10_000, 50, 5])
def test_trie_of_hot_prefixes_copies_and_deep_chains(spark, monkeypatch, limit):
    """A first turn that most share, many equal conversations (whose ids fill several chunks), one of 300 turns."""
    monkeypatch.setattr(prefixtrie, "CHUNK_BITS", 3)
    r = random.Random(5)
    rows = []
    for c in range(150):
        size = 300 if c == 140 else r.randint(1, 7)
        turns = [("user", "hello")] if c % 3 else []
        turns += [(r.choice("ab"), r.choice(["x", "yy", "ü"])) for _ in range(size)]
        if 40 <= c < 90:
            turns = [("user", "hello"), ("a", "same"), ("b", "text")]
        rows += [(c, k, *t) for k, t in enumerate(turns)]
    seq = prefixtrie.sequences(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert rows_of(prefixtrie.trie(seq, limit)) == plain_trie(plain_sequences(rows))


def test_trie_of_odd_rows(spark):
    """Nulls in every column, equal turn numbers, repeated rows, turnless and negative ids, clashing columns; and no rows."""
    rows = [
        (0, 0, "user", "a"), (0, 0, "user", "a"), (0, None, None, None), (0, 1, "b", "é" * 5000), (1, 3, None, "x"), (1, 2, "user", ""), (2, 0, "user", "tie"), (2, 0, "user", "tie 2"), (2, 0, "assistant", "tie"),
        (None, 0, "user", "lost"), (7, 0, "user", "a"), (-3, 0, "u", "neg"), (-5, 0, "u", "neg"), (11, 0, "u", "t"), (65_536, 1, "user", "a"), (131_075, 1, "user", "a"), (12, 1, "u", "t"),
    ]
    odd = spark.createDataFrame([(*r, "k", 1, 2) for r in rows], TURNS)
    want = plain_trie(plain_rebuilt(plain_sequences(rows)))
    for limit in (10_000, 2):
        assert rows_of(prefixtrie.trie(prefixtrie.rebuilt(prefixtrie.sequences(odd)), limit)) == want
    assert rows_of(prefixtrie.trie(prefixtrie.rebuilt(prefixtrie.sequences(odd.limit(0))))) == []


# --- SentencePiece -----------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def model():
    return piecebpe.Pieces(open(MODEL, "rb").read())


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def ids_of(model, texts):
    return [np.frombuffer(x, "<i4").tolist() for x in model.encode(texts)]


def test_pieces_equal_the_library(model, library):
    r = random.Random(7)
    texts = ["", " ", "  ", "a ", "  a  b", "\n", "▁", "▁▁x", "<s>", "</s> <0x41>", "日本語", "😀 e", "\x00a", "a\r\nb", "ﬁ é", "123456 789", "the" * 400, " " * 5000, "-" * 999, "ab" * 4000, "lol" * 3000]
    texts += ["".join(r.choices("abcdeth  \n-=.▁é日1", k=r.randint(1, 60))) for _ in range(2000)]
    texts += ["".join(r.choices("thelnoi  ", k=r.randint(1, 300))) for _ in range(300)]
    pieces = [library.id_to_piece(i).replace("▁", " ") for i in range(259, 32000)]
    texts += ["".join(r.choices(pieces, k=r.randint(1, 80))) for _ in range(500)]
    want = library.encode(texts)
    assert ids_of(model, texts) == want
    assert [model.decode(np.array([*x, 2])) for x in want] == [library.decode([*x, 2]) for x in want]


def test_pieces_by_the_heap_alone(monkeypatch, library):
    monkeypatch.setattr(piecebpe, "ROUNDS", 1)
    own = piecebpe.Pieces(open(MODEL, "rb").read())
    texts = ["the theorem " * 30, "xthexthe" * 100, "aaaa" * 50, "naïve 日本 \t tabs", "lol" * 500]
    assert ids_of(own, texts) == library.encode(texts)


def test_decoding_of_any_ids(model, library):
    r = random.Random(3)
    some = [[1, 15043, 2], [2, 15043], [198, 2, 172], [198, 172], [198], [15043, 0], [259, 259], [1, 29871, 15043], [258, 229, 133], []]
    some += [[r.choice([1, 2, *range(3, 259), 259, 29871, *range(300, 320)]) for _ in range(r.randint(1, 12))] for _ in range(3000)]
    for ids in some:
        assert model.decode(np.array(ids, int)) == library.decode(ids), ids
    with pytest.raises(ValueError):
        model.decode(np.array([32000]))


def test_sentencepiece_query(spark, small, library):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    found = queries.op12_sentencepiece(spark, small).collect()
    assert len(found) == len(docs)
    for r in found:
        ids = library.encode(docs[r.doc_id], add_eos=True)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids)).encode()), sha(library.decode(ids).encode()))


def test_sentencepiece_of_odd_rows(spark, library):
    rows = [(1, None, "i", "d"), (1, None, "i", "d"), (2, "", "i", "d"), (None, " a  b\n", "i", None), (3, "ü▁" * 40_000, None, "d")]
    odd = spark.createDataFrame(rows, "doc_id long, text string, ids string, decoded string")
    for found in (piecebpe.round_trip(odd, MODEL), piecebpe.decode(piecebpe.encode(odd, MODEL), MODEL)):
        got = found.collect()
        assert len(got) == len(rows)
        for r in got:
            ids = library.encode(r.text or "", add_eos=True)
            assert (r.ids, r.decoded) == (ids, library.decode(ids))
    assert piecebpe.round_trip(odd.limit(0), MODEL).count() == 0
    assert piecebpe.decode(odd.select("doc_id", F.lit(None).cast("array<int>").alias("ids")), MODEL).first().decoded == ""


# --- importance resampling ---------------------------------------------------------------------------------


def plain_draw(docs, target, percent=10, n=1, least=20, buckets=10_000, seed=2024):
    def words(t):
        return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))

    def features(t):
        w = words(t)
        return [zlib.crc32(b" ".join(w[i : i + k])) % buckets for k in range(1, n + 1) for i in range(len(w) - k + 1)]

    s, t = defaultdict(int), defaultdict(int)
    for side, texts in ((s, [x for _, x in docs]), (t, target)):
        for x in texts:
            for b in features(x):
                side[b] += 1
    S, T = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in range(buckets)]
    out = []
    for i, x in docs:
        f = features(x)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(sha(f"{seed}:{'' if i is None else i}".encode())[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, len(words(x)) >= least])
    able = sorted((r for r in out if r[5]), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = k + 1
    return sorted(map(str, (tuple(r[:5]) for r in out)))


def drawn(found):
    return sorted(str(tuple(r)) for r in found.select("doc_id", "n_features", "weight", "score", "rank").collect())


@pytest.mark.parametrize("few, percent", [(resample.FEW, 10), (3, 10), (3, 55), (0, 100)])
def test_resampling_of_the_table(spark, small, monkeypatch, few, percent):
    """The cutoff by a sort of few rows, and by the medians alone."""
    monkeypatch.setattr(resample, "FEW", few)
    docs, target = (spark.read.parquet(f"{small}/{x}.parquet") for x in ("documents", "benchmark"))
    want = plain_draw([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in target.collect()], percent)
    assert drawn(resample.draw(docs.repartition(7), target, percent, keep=False)) == want


def test_cutoff_is_the_kth_key(spark, monkeypatch):
    monkeypatch.setattr(resample, "FEW", 0)
    r = random.Random(1)
    rows = [(r.randint(-3, 3), r.randint(0, 1), r.randint(0, 9), i) for i in range(400)]
    keys = spark.createDataFrame(rows, "_neg long, _known long, _order long, _uid long").repartition(5)
    for k in (1, 2, 137, 399, 400):
        assert resample.cutoff(keys, k) == sorted(rows)[k - 1]
    assert resample.cutoff(keys, 0) is None


def test_resampling_of_odd_rows(spark):
    """Nulls, ties, repeated rows, words beside the ends of texts, long words, clashing columns, two-word features, no rows."""
    text = "Alpha BETA gamma-delta é1 日本 x_y " * 6
    rows = [(1, text, "r", 1), (2, text, "r", 1), (2, text, "r", 1), (None, text, None, 1), (None, None, None, None), (3, "", "r", 1), (4, "..!!", "r", 1), (5, "w" * 5000 + " tail", "r", 1), (6, text + "benchmark words", "r", 1), (7, "a " * 30_000, "r", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string, score long").repartition(3)
    target = spark.createDataFrame([("benchmark words alpha",), (None,), ("",)], "text string")
    plain = [r[:2] for r in rows]
    for n, least, percent in ((1, 20, 50), (2, 20, 90), (3, 1, 100)):
        want = plain_draw(plain, ["benchmark words alpha"], percent, n, least)
        found = resample.draw(docs, target, percent, n, least)
        assert drawn(found) == want
        assert found.filter("row.row = 'r' and row.score = 1").count() == 8
    assert drawn(resample.draw(docs, target.limit(0))) == plain_draw(plain, [])
    assert drawn(resample.draw(docs.limit(0), target)) == []
