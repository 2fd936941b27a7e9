"""Fusion of a dense and a sparse ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import stored


def fuse(dense: DataFrame, sparse: DataFrame | None, k: int = 5, alpha: float = 0.7, gate: float = 0.1, digits: int = 6) -> DataFrame:
    """(query_id, doc_id, score, rank) from ``dense`` (query_id, doc_id, score,
    rank: the best 2k) and ``sparse`` (query_id, doc_id, score in 0..1).

    A dense document scores alpha * dense + (1 - alpha) * sparse; any other
    enters with its sparse part alone, if its sparse score is over ``gate``.
    Ties go to the better dense rank, then to the smaller id.  Without
    ``sparse`` the dense ranking is cut to k."""
    if sparse is None:
        return dense.where(F.col("rank") <= k).select("query_id", "doc_id", "score", "rank")
    left = stored(dense.select("query_id", "doc_id", F.col("score").alias("d"), F.col("rank").alias("dense_rank")))
    score = F.round(F.lit(alpha) * F.coalesce("d", F.lit(0.0)) + F.lit(1 - alpha) * F.coalesce("s", F.lit(0.0)), digits)
    # Of the sparse rows those of a dense document stay, one a rank, and of the others
    # the best k: the full table takes no part in a shuffle where ``left`` is small.
    both = sparse.select("query_id", "doc_id", F.col("score").alias("s")).join(left, ["query_id", "doc_id"], "left")
    both = both.where(F.col("dense_rank").isNotNull() | (F.col("s") > gate)).withColumn("score", score)
    alike = Window.partitionBy("query_id", "dense_rank").orderBy(F.col("score").desc(), F.col("doc_id"))
    both = stored(both.withColumn("place", F.row_number().over(alike)).where(F.col("place") <= k).select("query_id", "doc_id", "dense_rank", "score"))
    alone = left.join(both.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti").withColumn("s", F.lit(None).cast("double"))
    both = both.unionByName(alone.select("query_id", "doc_id", "dense_rank", score.alias("score")))
    by = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("dense_rank").asc_nulls_last(), F.col("doc_id"))
    return both.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "doc_id", "score", "rank")


def dump(ranked: DataFrame, queries: DataFrame, docs: DataFrame, value: str = "distance") -> DataFrame:
    """A row a query: query_id, query, and in rank order doc_ids, top_docs,
    doc_links and distances.  ``docs``: doc_id, text, link."""
    full = ranked.join(docs, "doc_id").groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "doc_id", "text", "link", F.col(value).alias("far")))).alias("r"))
    return queries.join(full, "query_id", "left").select(
        "query_id", "query", *[F.coalesce(F.col(f"r.{c}"), F.array()).alias(name) for c, name in (("doc_id", "doc_ids"), ("text", "top_docs"), ("link", "doc_links"), ("far", "distances"))]
    )


def results(ranked: DataFrame, queries: DataFrame, docs: DataFrame, with_func_name: bool = True) -> DataFrame:
    """The result rows: query_id, query, query_type, retrieved_docs and scores in
    rank order.  ``docs``: doc_id, index, path, source_type, func_name, display;
    ``queries``: query_id, query, query_type."""
    fields = ["index", "path", "source_type", *(["func_name"] if with_func_name else []), "display"]
    full = ranked.join(docs, "doc_id").groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "score", F.struct(*fields).alias("doc")))).alias("r"))
    return queries.join(full, "query_id", "left").select(
        "query_id", "query", "query_type", F.coalesce(F.col("r.doc"), F.array()).alias("retrieved_docs"), F.coalesce(F.col("r.score"), F.array()).alias("scores")
    )
