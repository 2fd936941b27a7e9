"""The retrieval lifecycle: load, parse, unite, featurise, search, shape."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import display
from ..operators import bm25, corpus, features, hybrid, knn
from ..operators.ordinals import with_ordinal
from ..sources import readers
from ..sources.scratch import stored


def load_corpus(spark: SparkSession, settings: readers.Settings, schema: str) -> DataFrame:
    """The datasets of ``settings`` in order, parsed, with doc_id from 0."""
    parts, left = [], settings.max_docs
    for dataset in settings.dataset_files:
        if left is not None and left <= 0:
            break
        rows = readers.json_array(spark, dataset.path, schema, None if left is None else "at_")
        if left is not None:
            rows = rows.orderBy("at_").limit(left).drop("at_")
        parsed = corpus.parse(rows, dataset.parser)
        if left is not None:
            left -= parsed.where(F.col("error").isNull()).count()
        parts.append(parsed)
    if not parts:
        raise ValueError("no dataset files")
    docs = corpus.union_corpora(parts)
    return with_ordinal(docs, [F.col("dataset"), F.col("index"), F.col("path")], "doc_id")


def shown(docs: DataFrame) -> DataFrame:
    """``docs`` with the string that results show."""
    return docs.withColumn("display", display(F.col("title"), F.col("func_name"), F.col("docstring_summary"), F.col("text"), F.col("path")))


def search(docs: DataFrame, queries: DataFrame, method: str = "bm25", k: int = 5, vector: Column | None = None, query_vector: Column | None = None, use_hybrid: bool = False, alpha: float = 0.7, probes: int = 1) -> DataFrame:
    """(query_id, doc_id, score, rank).  Methods: bm25, tfidf, flat, ivf, lsh,
    cosine; the last four need vectors.  With ``use_hybrid`` the cosine ranking
    is fused with BM25."""
    asks = queries.select(F.col("query_id").alias("item_id"), F.col("query").alias("text"))
    if method == "bm25":
        return bm25.top_k(bm25.scores(docs, asks), k)
    if method == "tfidf":
        return bm25.top_k(features.tfidf_scores(docs, asks), k)
    rows = docs.select(F.col("doc_id").alias("vec_id"), vector.alias("embedding"))
    points = queries.select(F.col("query_id").alias("vec_id"), query_vector.alias("embedding"))
    if use_hybrid or method == "cosine":
        dense = knn.exact(rows, points, 2 * k if use_hybrid else k, "cosine")
        sparse = bm25.normalised(bm25.scores(docs, asks)) if use_hybrid else None
        return hybrid.fuse(dense, sparse, k, alpha)
    found = {"flat": lambda: knn.exact(rows, points, k), "ivf": lambda: knn.by_cells(rows, points, k, probes), "lsh": lambda: knn.by_hashing(rows, points, k)}[method]()
    return found.select("query_id", "doc_id", (F.lit(1.0) / (F.lit(1.0) + F.col("distance"))).alias("score"), "rank")


def retrieve(docs: DataFrame, queries: DataFrame, **how) -> tuple[DataFrame, float]:
    """Result rows, and the seconds that embedding and searching took.  The ranking
    is written out inside the measured time; each row has its share of that as
    ``latency``, since the queries are answered together."""
    began = time.perf_counter()
    ranked = stored(search(docs, queries, **how))
    seconds = time.perf_counter() - began
    rows = hybrid.results(ranked, queries, shown(docs))
    return rows.withColumn("latency", F.lit(seconds / max(1, queries.count()))), seconds


def statistics(results: DataFrame) -> DataFrame:
    """Queries by type, with their share in percent."""
    counts = results.groupBy("query_type").agg(F.count(F.lit(1)).alias("n"))
    total = results.agg(F.count(F.lit(1)).alias("total"))
    return counts.crossJoin(total).select("query_type", "n", (F.col("n") * 100.0 / F.col("total")).alias("share"))  # one row on the right
