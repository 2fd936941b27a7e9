"""Connected components of a link table, by contraction.

Each round every vertex is merged into the neighbour with the smallest hash and
the links are rewritten between the merged vertices, so that the number of
vertices falls by a constant factor a round whatever the ids are.  Before the
first round each task contracts its own links with numpy, which already turns a
large group into a few stars.  Nothing is collected.  Once ``ONE_TASK`` links or
fewer are left, a bounded number, one task contracts them to the end, with the same
result; else the loop ends when no links are left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved

_ROWS = 1_000_000
ONE_TASK = 250_000


def components_of(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For vertices 0..n-1 the smallest vertex that links a-b reach."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while True:
            jump = new[new]
            if np.array_equal(jump, new):
                break
            new = jump
        if np.array_equal(new, label):
            return label
        label = new


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links with the same components: each vertex to the smallest one."""
    ids, index = np.unique(np.concatenate([a, b]), return_inverse=True)
    label = components_of(index[: len(a)], index[len(a) :], len(ids))
    keep = label != np.arange(len(ids))
    return ids[label[keep]], ids[keep]


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All links of a task as (v, to): each vertex to the smallest it reaches."""
    ends = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    if ends:
        to, v = stars(*(np.concatenate(x) for x in zip(*ends, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(v), pa.array(to)], names=["v", "to"])


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def flush() -> pa.RecordBatch:
        a, b = stars(np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held]))
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    for batch in batches:
        if batch.num_rows:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            if sum(len(x) for x, _ in held) >= _ROWS:
                yield flush()
    if held:
        yield flush()


def connected_components(links: DataFrame) -> DataFrame:
    """(id, component_id) for every vertex of ``links`` (columns a, b: long, not
    null); component_id is the smallest id reachable.  Loops and repeated links
    are allowed; an empty table gives an empty one."""
    edges = links.select(F.col("a").cast("long"), F.col("b").cast("long"))
    vertices = edges.select(F.col("a").alias("id")).union(edges.select(F.col("b").alias("id"))).distinct()
    edges = saved(edges.where("a <> b").mapInArrow(_contract, "a long, b long").distinct())
    steps: list[DataFrame] = []
    rounds = 0
    while left := edges.count():
        if left <= ONE_TASK:
            steps.append(saved(edges.coalesce(1).mapInArrow(_whole, "v long, to long")))
            break
        rounds += 1
        rank = lambda c: F.struct(F.xxhash64(c, F.lit(rounds)).alias("h"), c.alias("x"))
        both = edges.select(F.col("a").alias("v"), F.col("b").alias("w")).union(edges.select(F.col("b"), F.col("a")))
        least = both.groupBy("v").agg(F.min(rank(F.col("w"))).alias("m"))
        step = saved(least.select("v", F.least(F.col("m"), rank(F.col("v"))).getItem("x").alias("to")))
        steps.append(step)
        edges = (
            edges.join(step.select(F.col("v").alias("a"), F.col("to").alias("x")), "a")
            .join(step.select(F.col("v").alias("b"), F.col("to").alias("y")), "b")
            .where("x <> y")
            .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        )
        edges = saved(edges.distinct())
    out = vertices.withColumn("root", F.col("id"))
    for step in steps:
        out = out.join(step.select(F.col("v").alias("root"), "to"), "root", "left").select("id", F.coalesce("to", "root").alias("root"))
    smallest = out.groupBy("root").agg(F.min("id").alias("component_id"))
    return out.join(smallest, "root").select("id", "component_id")
