"""Registered queries of the operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import edits, html, langid, lm, minhash, mixing, quality, sentencepiece, topk, vectordedup
from .shared import read, remainder

Query = Callable[[SparkSession, str], DataFrame]


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece.tokenize(read(spark, sf_dir, "documents"))


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(read(spark, sf_dir, "pages"))


def op3_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, sf_dir, "documents"))


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_texts(read(spark, sf_dir, "documents"), remainder("doc_id", 5) == 1)


def op5_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectordedup.dedup_vectors(read(spark, sf_dir, "embeddings"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(read(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edits.count_edits(read(spark, sf_dir, "documents"), edits.standing_edits())


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_sentencepiece,
        op2_html,
        op3_minhash_dedup,
        op4_lm_score,
        op5_exact_topk,
        op6_embedding_dedup,
        op7_language_id,
        op8_quality,
        op9_token_counts,
        op10_mixing,
    )
}

_VECTORS = """
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
"""

ORACLE_SQL: dict[str, str] = {
    "op5_exact_topk": f"""
WITH v AS (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e
  {_VECTORS}
), s AS (
  SELECT q.rid AS query, q.vec_id AS query_id, c.rid AS rid, c.vec_id AS vec_id,
         CASE WHEN len(q.e) = len(c.e) THEN CAST(list_inner_product(q.e, c.e) AS BIGINT) END AS score
  FROM v q JOIN v c ON q.rid <> c.rid
  WHERE q.vec_id % 100 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id, rid) AS INTEGER) AS rank, vec_id, score
  FROM s WHERE score IS NOT NULL
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
""",
    "op6_embedding_dedup": f"""
WITH RECURSIVE every AS (SELECT row_number() OVER () AS rid, * FROM embeddings), v AS (
  SELECT rid, vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e
  {_VECTORS.replace("embeddings", "every")} AND label IS NOT NULL AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), u AS (
  SELECT rid, vec_id, label, list_transform(e, lambda x: x / list_max(list_transform(e, lambda y: abs(y)))) AS e FROM v
), link AS (
  SELECT a.rid AS a, a.vec_id AS x, b.rid AS b, b.vec_id AS y
  FROM u a JOIN u b ON a.label = b.label AND len(a.e) = len(b.e) AND a.rid <> b.rid
  WHERE list_inner_product(a.e, b.e) / (sqrt(list_inner_product(a.e, a.e)) * sqrt(list_inner_product(b.e, b.e))) >= 0.93
), reach AS (
  SELECT a, x AS least FROM link UNION SELECT a, y FROM link
  UNION
  SELECT l.a, r.least FROM link l JOIN reach r ON l.b = r.a
), n AS (SELECT x AS vec_id, a, count(*) AS n_links FROM link GROUP BY x, a),
  m AS (SELECT a, min(least) AS component_id FROM reach GROUP BY a)
SELECT every.vec_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, coalesce(component_id, every.vec_id) AS component_id,
       coalesce(component_id, every.vec_id) = every.vec_id AS kept
FROM every LEFT JOIN n ON n.a = every.rid LEFT JOIN m ON m.a = every.rid
""",
}
