"""The queries of this subpackage by name, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, fingerprint, jaccard, kdtree, langid, licenses, linededup, packing, piecebpe, prefixtrie, resample, secretscan, substring
from .common import table


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text").withColumn("path", licenses.document_path())
    return licenses.scan(docs, licence_file=F.lit(True)).select("doc_id", "licence", "score", "how", "licence_dir")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linededup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("rest.doc_id", "n_lines", "n_removed", "source_doc_id", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return kdtree.search(vectors, F.col("vec_id") % 100 == 0, 10)


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprint.edited(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint.text_of(F.col("sketch")).alias("fingerprint"),
        fingerprint.text_of(F.col("edited_sketch")).alias("edited_fingerprint"),
        fingerprint.resemblance(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        fingerprint.resemblance(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard.join(table(spark, sf_dir, "documents").select("doc_id", "text"), n=4, percent=85)
    return found.select("doc_id", "n_shingles", "component_id")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secretscan.scan(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    each = found.select("doc_id", F.explode_outer("found").alias("c"))
    return each.select(
        "doc_id", F.col("c.at").alias("word"), F.sha2(F.col("c.value").cast("binary"), 256).alias("value_sha256"), F.col("c.score").alias("score"), F.col("c.secret").alias("secret")
    )


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", langid.held_out())
    learned = langid.train(docs.filter(~F.col("held_out")).select("text", "lang"))
    return langid.predict(docs.drop("lang"), learned).drop("text")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.digest(bpe.round_trip(docs, *vocabulary))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return prefixtrie.trie(prefixtrie.rebuilt(prefixtrie.sequences(turns)))


def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return piecebpe.digest(piecebpe.round_trip(docs, public_tokenizers.path("piece_bpe_32k.model")))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, target = (table(spark, sf_dir, name) for name in ("documents", "benchmark"))
    return resample.draw(docs.select("doc_id", "text"), target.select("text"), keep=False)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": op1_license_scan,
    "op2_line_dedup": op2_line_dedup,
    "op3_exact_topk": op3_exact_topk,
    "op4_fingerprints": op4_fingerprints,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_secret_scan": op7_secret_scan,
    "op8_language_id": op8_language_id,
    "op9_packing": op9_packing,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_sentencepiece": op12_sentencepiece,
    "op13_importance_resampling": op13_importance_resampling,
}
SQL: dict[str, str] = {
    "op1_license_scan": licenses.sql(),
    "op3_exact_topk": """
        WITH v AS (
            SELECT vec_id, min(v) AS v FROM (
                SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
                FROM embeddings
                WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
                  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
            GROUP BY vec_id),
        s AS (
            SELECT q.vec_id AS query_id, v.vec_id,
                   CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(v.v AS DOUBLE[])) AS BIGINT) AS score
            FROM v q JOIN v ON q.vec_id % 100 = 0 AND v.vec_id <> q.vec_id),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10""",
    "op5_jaccard_join": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
            FROM documents),
        s AS (
            SELECT DISTINCT doc_id, array_to_string(ws[i:i + 3], ' ') AS token FROM w, unnest(range(1, len(ws) - 2)) AS r(i) WHERE len(ws) >= 4
            UNION ALL SELECT doc_id, array_to_string(ws, ' ') FROM w WHERE len(ws) BETWEEN 1 AND 3),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
        met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.token = b.token AND a.doc_id < b.doc_id GROUP BY 1, 2),
        link AS (SELECT a, b FROM met JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
        edge AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
        reach(a, b) AS (SELECT a, b FROM edge UNION SELECT reach.a, edge.b FROM reach JOIN edge ON reach.b = edge.a),
        least AS (SELECT a AS doc_id, min(b) AS least FROM reach GROUP BY 1)
        SELECT w.doc_id, coalesce(n, 0) AS n_shingles, least(w.doc_id, coalesce(least, w.doc_id)) AS component_id
        FROM w LEFT JOIN n USING (doc_id) LEFT JOIN least USING (doc_id)""",
    "op6_substring_dedup": r"""
        WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        p AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS run FROM w, unnest(range(1, len(ws) - 11)) AS r(i) WHERE len(ws) >= 13),
        m AS (SELECT run, min(doc_id) AS first FROM p GROUP BY 1),
        c AS (SELECT DISTINCT doc_id, i + k AS pos FROM p JOIN m USING (run), unnest(range(0, 13)) AS r(k) WHERE doc_id > first),
        e AS (SELECT doc_id, ws[i] AS word, i AS pos FROM w, unnest(range(1, len(ws) + 1)) AS r(i)),
        kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY pos) AS t FROM e ANTI JOIN c USING (doc_id, pos) GROUP BY 1)
        SELECT doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
        FROM w LEFT JOIN kept USING (doc_id)""",
    "op11_prefix_trie": prefixtrie.sql(),
    "op13_importance_resampling": resample.sql(),
}
