"""Nearest neighbours: exact in blocks, by cells, by hashing.

Vectors that are null, or hold a null or a component that is not finite, take no
part, neither as query nor as row; of vectors of different length the missing
components are 0.  Where there is no row, no query has an answer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V

PART_ROWS, BLOCK_ROWS = 8192, 1024
MEASURED = 200  # queries on which the recall of a number of probes is measured


def _matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """The vectors as rows of ``width`` components, 0 behind their ends."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(flat.offsets.to_numpy())
    out = np.zeros((len(flat), width))
    out[np.repeat(np.arange(len(flat)), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat.flatten().to_numpy()
    return out


def _width(*columns: pa.ChunkedArray) -> int:
    sizes = [pc.max(pc.list_value_length(c)).as_py() for c in columns]
    return max(1, *[n or 0 for n in sizes])


def _slim(df: DataFrame, id_col: str, vector_col: str, name: str = "id", v: str = "v") -> DataFrame:
    rows = df.select(F.col(id_col).cast("long").alias(name), V.doubles(F.col(vector_col)).alias(v))
    return rows.where(F.col(name).isNotNull() & V.usable(F.col(v)))


def _widest(vector_col: str, *tables: DataFrame) -> int:
    """The number of components of the longest vector, 1 at least."""
    return max(1, *[df.agg(F.max(F.size(vector_col))).first()[0] or 0 for df in tables])


def _cell(metric: str, k: int, digits: int, reach: float = np.inf):
    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if queries.num_rows and rows.num_rows:
            width = _width(queries.column("v"), rows.column("v"))
            q, x = _matrix(queries.column("v"), width), _matrix(rows.column("v"), width)
            ids = rows.column("id").to_numpy()
            if metric == "cosine":
                q, x = (m / (np.linalg.norm(m, axis=1, keepdims=True) + 1e-8) for m in (q, x))
            for own, v in zip(queries.column("qid").to_numpy(), q, strict=True):
                # Smaller is nearer in either metric.
                raw = ((x - v) ** 2).sum(axis=1) if metric == "l2" else -(x * v).sum(axis=1)
                far = np.round(raw, digits)
                near = np.flatnonzero(raw < reach)
                if len(near) > k:
                    near = near[far[near] <= np.partition(far[near], k - 1)[k - 1]]
                near = near[np.lexsort((ids[near], far[near]))][:k]
                out.append((np.full(len(near), own), ids[near], far[near]))
        cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table({"query_id": pa.array(cols[0], pa.int64()), "doc_id": pa.array(cols[1], pa.int64()), "far": pa.array(cols[2], pa.float64())})

    return run


def exact(corpus: DataFrame, queries: DataFrame, k: int = 5, metric: str = "l2", id_col: str = "vec_id", vector_col: str = "embedding", digits: int = 6) -> DataFrame:
    """(query_id, doc_id, distance or score, rank): every query against every
    row, in cells of bounded size, the best k of a cell merged by a window.
    ``l2`` is the squared distance; ``cosine`` the product of unit vectors."""
    rows, asks = _slim(corpus, id_col, vector_col), _slim(queries, id_col, vector_col, "qid")
    parts, blocks = (max(1, -(-df.count() // size)) for df, size in ((rows, PART_ROWS), (asks, BLOCK_ROWS)))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asks = asks.withColumn("block", F.pmod(F.xxhash64("qid"), F.lit(blocks)).cast("int")).withColumn("part", every(parts))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")).withColumn("block", every(blocks))
    found = asks.groupBy("part", "block").cogroup(rows.groupBy("part", "block")).applyInArrow(_cell(metric, k, digits), "query_id long, doc_id long, far double")
    by = Window.partitionBy("query_id").orderBy("far", "doc_id")
    found = found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
    value = F.col("far").alias("distance") if metric == "l2" else (F.lit(0.0) - F.col("far")).alias("score")
    return found.select("query_id", "doc_id", value, "rank")


def fit_cells(corpus: DataFrame, vector_col: str = "embedding", sample: int = 50_000, seed: int = 5) -> np.ndarray:
    """Centres of the coarse cells: min(100, n // 10) of them, 1 at least, fitted
    on at most ``sample`` rows."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    width = _widest(vector_col, corpus)
    rows = corpus.select(V.doubles(F.col(vector_col)).alias("v")).where(V.usable(F.col("v")))
    n = rows.count()
    rows = rows.select(array_to_vector(V.padded(F.col("v"), width)).alias("features"))
    if n > sample:
        rows = rows.sample(fraction=sample / n, seed=seed).limit(sample)
    cells = max(1, min(100, n // 10))
    if cells == 1:
        return np.zeros((1, width))
    return np.array(KMeans(k=cells, seed=seed, maxIter=10).fit(rows).clusterCenters())


def _nearest(centres: np.ndarray, probes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(1), max(centres.shape[1], _width(batch.column(1))))[:, : centres.shape[1]]
            far = (x**2).sum(1)[:, None] - 2 * x @ centres.T + (centres**2).sum(1)[None, :]
            cells = np.argsort(far, axis=1, kind="stable")[:, :probes].astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(cells), pa.list_(pa.int32()))], names=["id", "v", "cells"])

    return run


def probes_for(corpus: DataFrame, queries: DataFrame, centres: np.ndarray, k: int, recall: float, id_col: str = "vec_id", vector_col: str = "embedding") -> int:
    """How many of its nearest cells a query has to look into, so that ``recall``
    of the k nearest by brute force are found.  Measured on all queries, or on
    ``MEASURED`` of them in order of a hash; twice the error of such a sample is
    then added to what is asked."""
    asks = queries.where(F.col(id_col).isNotNull() & V.usable(V.doubles(F.col(vector_col))))
    some = asks.orderBy(F.xxhash64(id_col), id_col).limit(MEASURED)
    near = exact(corpus, some, k, id_col=id_col, vector_col=vector_col).select("query_id", "doc_id")
    pairs = near.join(_slim(some, id_col, vector_col, "query_id", "q"), "query_id").join(_slim(corpus, id_col, vector_col, "doc_id"), "doc_id").select("q", "v").toArrow()  # k * MEASURED rows
    if not pairs.num_rows:
        return 1
    far = lambda x: (x**2).sum(1)[:, None] - 2 * x @ centres.T + (centres**2).sum(1)[None, :]
    width = max(centres.shape[1], _width(pairs.column("v"), pairs.column("q")))
    own = far(_matrix(pairs.column("v"), width)[:, : centres.shape[1]]).argmin(axis=1)
    order = np.argsort(far(_matrix(pairs.column("q"), width)[:, : centres.shape[1]]), axis=1, kind="stable")
    place = np.sort(np.argmax(order == own[:, None], axis=1))
    if asks.count() > MEASURED:
        recall += 2 * np.sqrt(recall * (1 - recall) / MEASURED)
    return int(place[min(len(place), int(np.ceil(recall * len(place)))) - 1]) + 1


def by_cells(corpus: DataFrame, queries: DataFrame, k: int = 5, probes: int = 1, id_col: str = "vec_id", vector_col: str = "embedding", digits: int = 6, recall: float | None = None) -> DataFrame:
    """As ``exact`` with ``l2``, but each query looks into its ``probes`` nearest
    cells only; with ``recall``, into as many as ``probes_for`` says."""
    centres = fit_cells(corpus, vector_col)
    if recall is not None:
        probes = probes_for(corpus, queries, centres, k, recall, id_col, vector_col)
    slim = lambda df: _slim(df, id_col, vector_col)
    schema = "id long, v array<double>, cells array<int>"
    rows = slim(corpus).mapInArrow(_nearest(centres, 1), schema).select("id", "v", F.col("cells")[0].alias("cell"))
    asks = slim(queries).mapInArrow(_nearest(centres, min(probes, len(centres))), schema).select(F.col("id").alias("qid"), "v", F.explode("cells").alias("cell"))
    # A large cell is dealt into parts; the sizes are a row a cell, 100 at most.
    pieces = lambda df, size, name: df.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias(name))
    known = [tuple(r) for r in pieces(rows, PART_ROWS, "parts").join(pieces(asks, BLOCK_ROWS, "blocks"), "cell").collect()]
    sizes = lambda: F.broadcast(corpus.sparkSession.createDataFrame(known, "cell int, parts int, blocks int"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asks = asks.join(sizes(), "cell").withColumn("block", F.pmod(F.xxhash64("qid"), F.col("blocks")).cast("int")).withColumn("part", every("parts"))
    rows = rows.join(sizes(), "cell").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).withColumn("block", every("blocks"))
    by = ["cell", "part", "block"]
    found = asks.groupBy(*by).cogroup(rows.groupBy(*by)).applyInArrow(_cell("l2", k, digits), "query_id long, doc_id long, far double")
    best = Window.partitionBy("query_id").orderBy("far", "doc_id")
    found = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return found.select("query_id", "doc_id", F.col("far").alias("distance"), "rank")


def by_hashing(corpus: DataFrame, queries: DataFrame, k: int = 5, width: float = 1.0, tables: int = 6, reach: float = np.inf, id_col: str = "vec_id", vector_col: str = "embedding", seed: int = 3) -> DataFrame:
    """As ``exact`` with ``l2``, among the rows that meet a query in one of the
    hash tables and lie within ``reach``."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector, vector_to_array

    width_ = _widest(vector_col, corpus, queries)
    slim = lambda df: _slim(df, id_col, vector_col).select("id", array_to_vector(V.padded(F.col("v"), width_)).alias("v"))
    if slim(corpus).isEmpty():
        return corpus.sparkSession.createDataFrame([], "query_id long, doc_id long, distance double, rank int")
    model = BucketedRandomProjectionLSH(inputCol="v", outputCol="h", bucketLength=width, numHashTables=tables, seed=seed).fit(slim(corpus))
    hashed = lambda df, name: model.transform(slim(df)).select(F.col("id").alias(name), vector_to_array("v").alias("v"), F.posexplode("h").alias("t", "h_")).select(name, "v", "t", vector_to_array("h_")[0].alias("bucket"))
    # The pairs of a bucket are not listed: its best k of a query hold what it has of the best k of all.
    pieces = lambda df, size, name: df.groupBy("t", "bucket").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias(name))
    sizes = lambda: pieces(hashed(corpus, "id"), PART_ROWS, "parts").join(pieces(hashed(queries, "qid"), BLOCK_ROWS, "blocks"), ["t", "bucket"])
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asks = hashed(queries, "qid").join(sizes(), ["t", "bucket"]).withColumn("block", F.pmod(F.xxhash64("qid"), F.col("blocks")).cast("int")).withColumn("part", every("parts"))
    rows = hashed(corpus, "id").join(sizes(), ["t", "bucket"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).withColumn("block", every("blocks"))
    by = ["t", "bucket", "part", "block"]
    found = asks.groupBy(*by).cogroup(rows.groupBy(*by)).applyInArrow(_cell("l2", k, 6, reach * reach), "query_id long, doc_id long, far double")
    found = found.groupBy("query_id", "doc_id").agg(F.min("far").alias("distance"))
    best = Window.partitionBy("query_id").orderBy("distance", "doc_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
