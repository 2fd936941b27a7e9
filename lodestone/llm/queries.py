"""The registered queries of the training-data operators.

Each takes (spark, sf_dir), applies its operator with production parameters to
the whole of its table and derives the agreed columns from the result.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, embed_dedup, license_scan, line_dedup, mixing, ngram_join, sharding, topk, toxicity, urlfilter
from .common import table

VOCABULARY = "word_bpe_49k.json"


def unseen(doc_id: Column) -> Column:
    """Whether a document is held out of learning."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 3 == 1


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(table(sf_dir, t)) for t in ("documents", "labels"))
    found = toxicity.judge(docs, labels, ~unseen(F.col("doc_id")))
    return found.select("doc_id", unseen(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op2_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(spark.read.parquet(table(sf_dir, "pages")))


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(spark.read.parquet(table(sf_dir, "documents")), size=4, percent=85)


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(spark.read.parquet(table(sf_dir, "documents")))


def op5_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(table(sf_dir, "documents")).select("doc_id", "text")
    return line_dedup.dedup_lines(docs, counted=True)


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(table(sf_dir, "documents"))
    return bpe.encode_decode(docs, public_tokenizers.path(VOCABULARY))


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(table(sf_dir, "embeddings"))
    return topk.top_k(vectors, F.coalesce(F.col("vec_id") % 50 == 0, F.lit(False)))


def mix_levels() -> list[Column]:
    return [mixing.domain_of(F.col("source")), F.col("lang"), F.col("source")]


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(table(sf_dir, "documents"))
    found = mixing.mix(docs, mix_levels(), mixing.n_words(F.col("text")))
    names = [F.col("path")[i].alias(n) for i, n in enumerate(("domain", "lang", "source"))]
    return found.select("doc_id", *names, "epoch", "tokens", "budget")


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(spark.read.parquet(table(sf_dir, "documents")))


def op10_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(spark.read.parquet(table(sf_dir, "embeddings")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": op1_toxicity,
        "op2_urls": op2_urls,
        "op3_jaccard": op3_jaccard,
        "op4_sharding": op4_sharding,
        "op5_lines": op5_lines,
        "op6_bpe": op6_bpe,
        "op7_topk": op7_topk,
        "op8_mixing": op8_mixing,
        "op9_licenses": op9_licenses,
        "op10_embeddings": op10_embeddings,
    }


SQL: dict[str, str] = {}

SQL["op7_topk"] = """
WITH u AS (
  SELECT vec_id, [CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT) FOR x IN embedding] AS v
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum([q.v[i] * c.v[i] FOR i IN range(1, len(q.v) + 1)]) AS BIGINT) AS score
  FROM u q JOIN u c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


# Exact links and components by brute force.
SQL["op10_embeddings"] = """
WITH RECURSIVE u AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0
    AND len([x FOR x IN embedding IF x <> 0]) > 0
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.v, b.v) >= 0.93
), r(id, w) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT r.id, l.b FROM r JOIN l ON r.w = l.a
), c AS (SELECT id, min(w) AS component_id FROM r GROUP BY id)
SELECT e.vec_id, CAST((SELECT count(*) FROM l WHERE l.a = e.vec_id) AS BIGINT) AS n_links,
       c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN c ON c.id = e.vec_id
"""
