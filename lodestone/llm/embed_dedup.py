"""Embedding near-duplicates by cross-polytope hashing.

A vector is turned by three rounds of random signs and a fast Hadamard
transform, and hashed to its largest coordinate with its sign.  Each table has
turns of its own; a table's code joins as many such hashes as the number of rows
asks for: one in ``TABLES`` tables up to ``BUCKET`` rows, and with more hashes so
many more tables that a pair at the threshold is missed as seldom.  A vector stands in the bucket of its code and in
one probe bucket, that of the second-largest coordinate of the least certain
hash.  Two vectors of a bucket are a candidate pair if it is the own bucket of
one of them, and every candidate is verified by cosine in double precision.

Vectors equal in all components are one class with a weight.  A pair counts only
in the first of the buckets where it is found, so that links are summed without
listing the pairs; what leaves a bucket is a count a class and links that span
the bucket's components.  A bucket of more than ``BLOCK`` rows is dealt into
blocks, and each pair of blocks is a unit of its own, so that no bucket is
capped and none has to fit a task.

Defined cases.  A vector that is null, zero, empty, or holds null or a component
that is not finite, and any vector with a null label, links with nothing.
Vectors of different length: missing components are 0.  Repeated rows are
vectors of their own.  A null id links with nothing.  Further columns are
ignored; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import block_pairs, saved, sorted_runs
from .graph import connected_components, stars
from .topk import usable

TABLES = 6  # of codes of one hash
BLOCK = 1024
SEED = 11
BUCKET = 1 << 20  # rows from which a table's code takes one hash more


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of the rows, of a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


def codes(x: np.ndarray, table: int, functions: int) -> tuple[np.ndarray, np.ndarray]:
    """Own and probe code of each row in a table."""
    rng = np.random.default_rng((SEED, table))
    n, d = x.shape
    own, probe = np.zeros((functions, n), np.int64), np.zeros((functions, n), np.int64)
    margin = np.zeros((functions, n))
    for f in range(functions):
        y = x
        for _ in range(3):
            y = hadamard(y * rng.choice([-1.0, 1.0], d))
        size = np.abs(y)
        row = np.arange(n)
        first = size.argmax(axis=1)
        own[f] = 2 * first + (y[row, first] > 0)
        top = size[row, first]
        size[row, first] = -1
        second = size.argmax(axis=1)
        probe[f] = 2 * second + (y[row, second] > 0)
        margin[f] = top - size[row, second]
    weak = margin.argmin(axis=0)
    other = own.copy()
    other[weak, np.arange(n)] = probe[weak, np.arange(n)]
    weigh = (2 * d) ** np.arange(functions)
    return weigh @ own, weigh @ other


def meeting(size: int, width: int, functions: int, least: float) -> float:
    """The share of pairs of cosine ``least``, of ``size`` components, that meet
    in a table: 4,000 random trials."""
    rng = np.random.default_rng(SEED)
    x, y = (np.zeros((500, width)) for _ in range(2))
    x[:, :size] = rng.standard_normal((500, size))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y[:, :size] = rng.standard_normal((500, size))
    y -= (x * y).sum(axis=1, keepdims=True) * x
    y = least * x + np.sqrt(max(0.0, 1 - least * least)) * y / np.linalg.norm(y, axis=1, keepdims=True)
    met = 0
    for t in range(8):
        (a, b), (c, d) = codes(x, t, functions), codes(y, t, functions)
        met += int(((a == c) | (a == d) | (b == c)).sum())
    return met / 4000


def tables_for(size: int, width: int, functions: int, least: float) -> int:
    """How many tables miss a pair of cosine ``least`` no more often than
    ``TABLES`` tables of one hash."""
    if functions == 1:
        return TABLES
    one, more = (min(max(meeting(max(2, size), width, f, least), 1 / 4000), 1 - 1 / 4000) for f in (1, functions))
    return max(TABLES, int(np.ceil(TABLES * np.log(1 - one) / np.log(1 - more))))


def rows_of(vectors: pa.Array, width: int) -> np.ndarray:
    """The vectors as rows of their own type, 0 behind their ends."""
    offsets = vectors.offsets.to_numpy()
    values = vectors.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
    lengths = np.diff(offsets)
    x = np.zeros((len(vectors), width), values.dtype)
    x[np.repeat(np.arange(len(x)), lengths), np.arange(len(values)) - np.repeat(offsets[:-1] - offsets[0], lengths)] = values
    return x


def units(x: np.ndarray) -> np.ndarray:
    """The rows at length 1, in double precision."""
    x = x.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def code_type(width: int, functions: int) -> type:
    return np.int32 if (2 * width) ** functions < 1 << 31 else np.int64


def _hash(width: int, functions: int, tables: int, bodies: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                part = batch.slice(lo, 2000)
                raw = rows_of(part.column(3), width)
                x = units(raw)
                pairs = np.stack([np.stack(codes(x, t, functions), axis=1) for t in range(tables)], axis=1)  # row, table, own/probe
                flat = pairs.reshape(len(x), -1)
                packed = [r.tobytes() for r in flat.astype(code_type(width, functions))] if bodies else None
                solid = [r.tobytes() for r in raw] if bodies else None
                for t in range(tables):
                    for kind in (0, 1):
                        cols = [part.column(0), part.column(1), part.column(2), pa.array(np.full(len(x), t, np.int32)), pa.array(pairs[:, t, kind])]
                        if bodies:
                            cols += [pa.array(np.full(len(x), kind == 0)), pa.array(packed, pa.binary()), pa.array(solid, pa.binary())]
                        names = ["rep", "weight", "label", "t", "code", "own", "codes", "body"][: len(cols)]
                        yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


def _first_here(mine: np.ndarray, i: np.ndarray, j: np.ndarray, t: int, code: np.ndarray) -> np.ndarray:
    """Whether pairs i-j are found in no bucket before (t, code)."""
    a, b = mine[i], mine[j]  # pair, table, own/probe
    first = np.ones(len(i), bool)
    for s in range(t + 1):
        for x, y in ((a[:, s], b[:, s]), (b[:, s], a[:, s])):
            hit = (x[:, 0] == y[:, 0]) | (x[:, 0] == y[:, 1])  # in the own bucket of x
            first &= ~hit if s < t else ~hit | (x[:, 0] >= code)
    return first


def _compare(least: float, tables: int, codes_as: type, bodies_as: type):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run_ in sorted_runs(batches):
            n = run_.num_rows
            if n < 2:
                continue
            col = lambda name: run_.column(name).combine_chunks()  # noqa: B023, E731
            rep, weight = (col(c).to_numpy(zero_copy_only=False) for c in ("rep", "weight"))
            label = col("label").dictionary_encode().indices.to_numpy()
            side, own, t = (col(c).to_numpy(zero_copy_only=False) for c in ("side", "own", "t"))
            x = units(np.frombuffer(b"".join(col("body").to_pylist()), bodies_as).reshape(n, -1))
            mine = np.frombuffer(b"".join(col("codes").to_pylist()), codes_as).reshape(n, tables, 2)
            code = col("code").to_numpy()[0]
            whole = not side.any()
            counts = np.zeros(n, np.int64)
            links: list[tuple[np.ndarray, np.ndarray]] = []
            for lo in range(0, n, 256):
                near = x[lo : lo + 256] @ x.T
                i, j = np.nonzero(near >= least - 1e-9)
                i += lo
                keep = (i < j) if whole else ((side[i] == 0) & (side[j] == 1))
                keep &= (label[i] == label[j]) & (own[i] | own[j]) & (rep[i] != rep[j])
                i, j = i[keep], j[keep]
                exact = np.einsum("ij,ij->i", x[i], x[j])
                i, j = i[exact >= least], j[exact >= least]
                if len(i):
                    first = _first_here(mine, i, j, int(t[0]), code)
                    counts += np.bincount(i[first], weight[j[first]], n).astype(np.int64)
                    counts += np.bincount(j[first], weight[i[first]], n).astype(np.int64)
                    links.append(stars(rep[i], rep[j]))
            if links:
                a, b = stars(np.concatenate([x for x, _ in links]), np.concatenate([y for _, y in links]))
                some = np.flatnonzero(counts)
                cols = [np.concatenate([a, rep[some]]), np.concatenate([b, rep[some]]), np.concatenate([np.zeros(len(a), np.int64), counts[some]])]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["a", "b", "n"])

    return run


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", least: float = 0.93) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    narrow = vectors.schema[vector_col].dataType.elementType.simpleString() == "float"
    kind = "float" if narrow else "double"
    body = F.transform(F.col(vector_col).cast(f"array<{kind}>"), lambda v: v + F.lit(0.0).cast(kind))  # -0.0 is 0.0
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(label_col).cast("string"), F.lit("")).alias("label"), F.col(label_col).isNotNull().alias("named"), body.alias("v"))
    takes = F.col("named") & F.col("id").isNotNull() & usable(F.col("v")) & F.coalesce(F.exists("v", lambda v: v != 0), F.lit(False))
    rows = rows.withColumn("takes", takes)
    key = [F.when(F.col("takes"), F.xxhash64("v")), F.when(F.col("takes"), F.xxhash64(F.lit(1), F.col("v"), F.size("v")))]
    rows = rows.withColumn("h1", key[0]).withColumn("h2", key[1])
    classes = saved(rows.where("takes").groupBy("label", "h1", "h2").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("weight"), F.any_value("v").alias("v")))
    shape = classes.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("d")).first()
    width = 1 << max(1, ((shape["d"] or 1) - 1).bit_length())
    functions, reach = 1, BUCKET
    while shape["n"] > reach:
        functions, reach = functions + 1, reach * 2 * width
    tables = tables_for(shape["d"] or 1, width, functions, least)
    side = classes.select("rep", "weight", "label", "v")
    counts = side.mapInArrow(_hash(width, functions, tables, False), "rep long, weight long, label string, t int, code long").groupBy("label", "t", "code").agg(F.count(F.lit(1)).alias("n_"))
    hashed = side.mapInArrow(_hash(width, functions, tables, True), "rep long, weight long, label string, t int, code long, own boolean, codes binary, body binary")
    dealt = block_pairs(hashed, ["label", "t", "code"], F.xxhash64("rep"), BLOCK, counts)
    dealt = dealt.select("unit", "rep", "weight", "label", "t", "code", "side", "own", "codes", "body").repartition("unit").sortWithinPartitions("unit")
    found = saved(dealt.mapInArrow(_compare(least, tables, code_type(width, functions), np.float32 if narrow else np.float64), "a long, b long, n long"))
    linked = found.where("n > 0").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    comps = connected_components(found.where("a <> b").select("a", "b"))
    classes = classes.select("label", "h1", "h2", "rep", "weight").join(linked, "rep", "left").join(comps.withColumnRenamed("id", "rep"), "rep", "left")
    known = classes.select("label", "h1", "h2", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component_id", "rep").alias("component_id"))
    out = rows.select("id", "label", "h1", "h2").join(known, ["label", "h1", "h2"], "left")
    comp = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), comp.alias("component_id"), F.col("id").eqNullSafe(comp).alias("kept"))
