"""Exact top-k search by exhaustive term-at-a-time accumulation.

A vector component is a term, its quantised value floor(scale * x) the weight of
the posting.  Candidates are dealt into parts and queries into blocks, both of a
bounded number of rows; each (part, block) cell turns its candidates into
postings per term, scatters every query's weighted postings into a dense array
of scores, selects the part's best k by partition and passes those on; one
window merges the parts.  No side is broadcast, so that neither has to be small.

Defined cases.  A vector that is null, or holds a null or a component that is
not finite, takes no part, neither as query nor as candidate; an empty vector
scores 0 against all.  Vectors of different length: missing terms weigh 0.
Rows with one id are candidates of their own, and none of them answers a query of
that id; query rows with one id are one query, whose answers are the best of all
its rows'.  A null id takes no part.  Ties go to the smaller id.  A score beyond 64 bits is
held at the nearest 64-bit value.  With fewer than k candidates all come back.
An empty table gives no rows.  Further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PART_ROWS = 8192  # candidates of a cell
BLOCK_ROWS = 8192  # queries of a cell
_SAFE = 2.0**62


def quantised(vectors: pa.Array, scale: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, term and weight of every posting that is not 0, and the weights'
    largest absolute value by row, for list-typed ``vectors``."""
    offsets = vectors.offsets.to_numpy()
    values = vectors.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]].astype(np.float64)
    lengths = np.diff(offsets)
    rows = np.repeat(np.arange(len(vectors)), lengths)
    terms = np.arange(len(values)) - np.repeat(offsets[:-1] - offsets[0], lengths)
    weights = np.floor(values * scale)
    keep = weights != 0
    return rows[keep], terms[keep], weights[keep], lengths


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to the smaller id, in order."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        above = np.flatnonzero(scores > least)
        level = np.flatnonzero(scores == least)
        need = k - len(above)
        if len(level) > need:
            level = level[np.argpartition(ids[level], need - 1)[:need]]
        chosen = np.concatenate([above, level])
    else:
        chosen = np.arange(len(scores))
    return chosen[np.lexsort((ids[chosen], -scores[chosen].astype(object) if scores.dtype == object else ~scores[chosen]))]


def accumulate(query: tuple[np.ndarray, np.ndarray], postings: dict[int, tuple[np.ndarray | None, np.ndarray]], n: int, dtype: type) -> np.ndarray:
    """Scores of one query (terms, weights) against ``n`` candidates.  A posting
    list that has every candidate carries no positions."""
    scores = np.zeros(n, dtype)
    for term, weight in zip(query[0].tolist(), query[1].tolist(), strict=True):
        found = postings.get(term)
        if found is not None:
            at, value = found
            if at is None:
                scores += value * weight
            else:
                scores[at] += value * weight
    return scores


def _search(scale: float, k: int):
    def cell(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if queries.num_rows and candidates.num_rows:
            qid = queries.column("qid").to_numpy()
            cid = candidates.column("vid").to_numpy()
            qr, qt, qw, _ = quantised(queries.column("vector").combine_chunks(), scale)
            cr, ct, cw, lengths = quantised(candidates.column("vector").combine_chunks(), scale)
            reach = (np.abs(qw).max(initial=0) * np.abs(cw).max(initial=0)) * max(1, lengths.max(initial=1))
            exact = reach < _SAFE
            dtype = np.int64 if exact else object
            whole = (lambda w: w.astype(np.int64)) if exact else (lambda w: np.array([int(x) for x in w], object))
            qw, cw = whole(qw), whole(cw)
            order = np.argsort(ct, kind="stable")
            cr, ct, cw = cr[order], ct[order], cw[order]
            heads = np.flatnonzero(np.r_[True, ct[1:] != ct[:-1]]) if len(ct) else np.zeros(0, int)
            tails = np.r_[heads[1:], len(ct)]
            postings = {int(ct[a]): (None if b - a == len(cid) else cr[a:b], cw[a:b]) for a, b in zip(heads, tails, strict=False) if b > a}
            first = np.searchsorted(qr, np.arange(len(qid) + 1))
            for i, own in enumerate(qid):
                span = slice(first[i], first[i + 1])
                scores = accumulate((qt[span], qw[span]), postings, len(cid), dtype)
                others = cid != own
                ids, left = (cid, scores) if others.all() else (cid[others], scores[others])
                if len(ids):
                    top = best(ids, left, k)
                    got = left[top]
                    if not exact:
                        got = np.array([min(max(x, -(2**63)), 2**63 - 1) for x in got], np.int64)
                    out.append((np.full(len(top), own), ids[top], got))
        cols = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 3
        if queries.num_rows > len(set(cols[0].tolist())):  # query rows with one id
            order = np.lexsort((cols[1], ~cols[2], cols[0]))
            cols = [c[order] for c in cols]
            heads = np.flatnonzero(np.append(True, cols[0][1:] != cols[0][:-1])) if len(order) else np.zeros(0, np.int64)
            rank = np.arange(len(order)) - np.repeat(heads, np.diff(np.append(heads, len(order))))
            cols = [c[rank < k] for c in cols]
        return pa.table({"query_id": pa.array(cols[0], pa.int64()), "vec_id": pa.array(cols[1], pa.int64()), "score": pa.array(cols[2], pa.int64())})

    return cell


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite."""
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return vector.isNotNull() & ~F.coalesce(F.exists(vector, odd), F.lit(True))


def top_k(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, scale: float = 256.0) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of each query's ``k`` best rows."""
    kind = vectors.schema[vector_col].dataType.elementType.simpleString()
    vector = F.col(vector_col) if kind in ("float", "double") else F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("vid"), vector.alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = rows.where(F.col("vid").isNotNull() & usable(F.col("vector")))
    sizes = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if("asks").alias("q")).first()
    parts, blocks = max(1, -(-sizes["n"] // PART_ROWS)), max(1, -(-sizes["q"] // BLOCK_ROWS))
    # By row, not by id: an id that stands in many rows is dealt out too.
    row = F.monotonically_increasing_id()
    part = F.pmod(F.xxhash64("vid", row), F.lit(parts)).cast("int")
    block = F.pmod(F.xxhash64("vid", row, F.lit(1)), F.lit(blocks)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    queries = rows.where("asks").select(F.col("vid").alias("qid"), "vector", block.alias("block")).select("*", every(parts).alias("part"))
    candidates = rows.select("vid", "vector", part.alias("part")).select("*", every(blocks).alias("block"))
    found = queries.groupBy("part", "block").cogroup(candidates.groupBy("part", "block")).applyInArrow(_search(scale, k), "query_id long, vec_id long, score long")
    by_query = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    ranked = found.withColumn("rank", F.row_number().over(by_query)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
