"""Retrieval metrics over nested results, one pass for all of them.

The hit vector of a query comes from a greedy assignment: in rank order, each
retrieved document takes the first relevant one, in list order, that matches and
is still free.  Every metric is an expression over that vector.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normal_path

CUTS = (1, 5, 10)


def matches(found: Column, relevant: Column, mode: str = "strict", require_index: bool = False) -> Column:
    """Whether a retrieved document is a relevant one: equal paths, and equal
    indices, or equal functions, or no function asked for.  With
    ``require_index`` a path alone is not enough where the truth has an index;
    mode ``always`` says yes to all."""
    if mode == "always":
        return F.lit(True)
    same = normal_path(F.coalesce(found["path"], F.lit(""))) == normal_path(F.coalesce(F.nullif(relevant["entry_filename"], F.lit("")), relevant["path"], F.lit("")))
    func = F.coalesce(relevant["func_name"], F.lit(""))
    by_index = relevant["index"].isNotNull() & F.coalesce(found["index"] == relevant["index"], F.lit(False))
    by_func = (func != "") & F.coalesce(found["func_name"] == func, F.lit(False))
    by_path = (func == "") & (relevant["index"].isNull() if require_index else F.lit(True))
    return same & (by_index | by_func | by_path)


def hits(retrieved: Column, relevant: Column, **how) -> Column:
    """array<int>: 1 where a retrieved document is assigned, in rank order."""
    places = F.sequence(F.lit(0), F.size(relevant) - 1)
    options = F.transform(retrieved, lambda d: F.filter(places, lambda i: matches(d, F.get(relevant, i), **how)))
    empty = F.struct(F.array().cast("array<int>").alias("used"), F.array().cast("array<int>").alias("hits"))

    def step(state: Column, option: Column) -> Column:
        free = F.array_except(option, state["used"])
        hit = F.size(free) > 0
        used = F.when(hit, F.concat(state["used"], F.slice(free, 1, 1))).otherwise(state["used"])
        return F.struct(used.alias("used"), F.concat(state["hits"], F.array(hit.cast("int"))).alias("hits"))

    return F.when(F.size(relevant) > 0, F.aggregate(options, empty, step, lambda s: s["hits"])).otherwise(F.transform(retrieved, lambda _: F.lit(0)))


def _sum(array: Column) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda s, x: s + x)


def precision(h: Column, k: int) -> Column:
    return _sum(F.slice(h, 1, k)) / F.lit(float(k))


def recall(h: Column, n_relevant: Column, k: int) -> Column:
    return F.when(n_relevant > 0, _sum(F.slice(h, 1, k)) / n_relevant).otherwise(0.0)


def reciprocal_rank(h: Column) -> Column:
    at = F.array_position(h, F.lit(1))
    return F.when(at > 0, F.lit(1.0) / at).otherwise(0.0)


def ndcg(h: Column, n_relevant: Column, k: int) -> Column:
    gain = _sum(F.transform(F.slice(h, 1, k), lambda x, i: x / F.log2(i + F.lit(2.0))))
    best = F.least(n_relevant, F.lit(k))
    ideal = F.when(best > 0, _sum(F.transform(F.sequence(F.lit(1), best), lambda i: F.lit(1.0) / F.log2(i + F.lit(1.0)))))
    return F.coalesce(F.when(ideal > 0, gain / ideal), F.lit(0.0))


def average_precision(h: Column, n_relevant: Column) -> Column:
    at_hits = F.transform(h, lambda x, i: F.when(x == 1, _sum(F.slice(h, 1, i + 1)) / (i + 1)).otherwise(0.0))
    return F.when(n_relevant > 0, _sum(at_hits) / n_relevant).otherwise(0.0)


def last_wins(truth: DataFrame, ordinal: str) -> DataFrame:
    """One row a query text: the last given."""
    by = Window.partitionBy("query").orderBy(F.col(ordinal).desc())
    return truth.withColumn("n_", F.row_number().over(by)).where("n_ = 1").drop("n_")


def per_query(results: DataFrame, truth: DataFrame, **how) -> DataFrame:
    """A row of metrics for each result whose query has relevant documents."""
    joined = results.join(truth.select("query", "relevant_docs"), "query").where(F.size("relevant_docs") > 0)
    h, n = F.col("hits"), F.size("relevant_docs")
    joined = joined.withColumn("hits", hits(F.col("retrieved_docs"), F.col("relevant_docs"), **how))
    metrics = [f(k).alias(f"{name}_at_{k}") for name, f in (("precision", lambda k: precision(h, k)), ("recall", lambda k: recall(h, n, k)), ("ndcg", lambda k: ndcg(h, n, k))) for k in CUTS]
    extra = ["latency"] if "latency" in results.columns else []
    return joined.select(
        "query_id", "query", "query_type", F.size("retrieved_docs").alias("n_retrieved"), n.alias("n_relevant"), *metrics,
        reciprocal_rank(h).alias("mrr"), average_precision(h, n).alias("average_precision"), *extra,
    )


def skipped(results: DataFrame, truth: DataFrame) -> DataFrame:
    """Results without a ground truth or without relevant documents."""
    return results.join(truth.where(F.size("relevant_docs") > 0).select("query"), "query", "left_anti")


def aggregates(metrics: DataFrame) -> DataFrame:
    """Means of all metrics over everything (query_type null) and by type, in
    one pass; latency also with its population deviation."""
    names = [c for c in metrics.columns if "_at_" in c or c in ("mrr", "average_precision")]
    cells = [F.count(F.lit(1)).alias("n_queries"), *[F.avg(c).alias(c) for c in names]]
    if "latency" in metrics.columns:
        cells += [F.avg("latency").alias("latency_mean"), F.stddev_pop("latency").alias("latency_std")]
    return metrics.rollup("query_type").agg(*cells)


def hit_rate(metrics: DataFrame, k: int) -> DataFrame:
    return metrics.agg(F.avg((F.col(f"recall_at_{k}") > 0).cast("double")).alias("hit_rate"))
