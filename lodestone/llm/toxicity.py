"""Toxicity by a factorization machine over hashed terms.

A document is the set of its hashed terms: every word, lower-cased and without
surrounding punctuation, and the word's beginnings of four to six characters.
The model is  bias + sum w_i + sum_{i<j} <v_i, v_j>  over the terms present, so
that a pair of terms can weigh what neither weighs alone.  It is fitted on at
most ``per_class`` labelled documents of each class, taken in the order of a
hash of their id (the documented bound, in rows: an id that stands in several rows
is learned from once, by its smallest text); the terms that enter it are the ``width``
buckets most associated with the label in that sample.  Every document is then
scored over its whole text.

Defined cases.  Null is the empty text, and its score that of the bias alone.
Without labelled rows of both classes every score is the share of toxic ones
among those there are, 0 where there are none.  Where an id has several labels,
the largest counts; null labels and null ids are not learned from.  Repeated
rows are scored one by one; further columns stay, but one with the name of the
score, which it replaces; an empty table gives an empty one.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import give_back, saved

BUCKETS = 1 << 18
KNOWN = 150_000  # words remembered in a worker
_EDGE = " \t\n\r.,;:!?\"'()[]{}<>|*#%&$-_/\\"


def terms_of(word: str) -> set[int]:
    """Buckets of a word, of its bare form and of the beginnings of that."""
    bare = word.strip(_EDGE)
    if not bare:
        return set()
    named = [f"w{bare}", *(f"{n}{bare[:n]}" for n in (4, 5, 6) if len(bare) >= n)]
    return {zlib.crc32(t.encode("utf-8", "replace")) % BUCKETS for t in named}


class Model:
    """Selected buckets with their weights and factors."""

    def __init__(self, buckets: np.ndarray, bias: float, w: np.ndarray, v: np.ndarray) -> None:
        self.index = {int(b): i for i, b in enumerate(buckets)}
        self.bias, self.w, self.v = bias, w, v

    def features(self, text: str | None, plain: set[str], telling: dict[str, frozenset[int]]) -> set[int]:
        """Positions of the document's selected terms.  ``plain`` and
        ``telling`` remember the words without and with such terms."""
        if not text:
            return set()
        found: set[int] = set()
        for word in set(text.lower().split()).difference(plain):
            got = telling.get(word)
            if got is None:
                got = frozenset(self.index[b] for b in terms_of(word) if b in self.index)
                if got:
                    telling[word] = got
                else:
                    plain.add(word)
                    continue
            found |= got
        return found

    def scores(self, rows: list[set[int]]) -> np.ndarray:
        sizes = np.fromiter(map(len, rows), np.int64, len(rows))
        flat = np.fromiter((i for r in rows for i in sorted(r)), np.int64, int(sizes.sum()))
        at = np.repeat(np.arange(len(rows)), sizes)
        n = len(rows)
        z = self.bias + np.bincount(at, self.w[flat], n)
        for f in range(self.v.shape[1]):
            x = self.v[flat, f]
            z += 0.5 * (np.bincount(at, x, n) ** 2 - np.bincount(at, x * x, n))
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(rows: list[np.ndarray], labels: np.ndarray, buckets: np.ndarray, factors: int = 8, epochs: int = 40, rate: float = 0.02, decay: float = 2e-4, seed: int = 7) -> Model:
    """A model by Adam on the logistic loss; ``rows``: positions in ``buckets``."""
    rng = np.random.default_rng(seed)
    n, d = len(rows), len(buckets)
    x = np.zeros((n, d), np.uint8)
    for i, r in enumerate(rows):
        x[i, r] = 1
    p = {"b": np.zeros(1, np.float32), "w": np.zeros(d, np.float32), "v": (0.01 * rng.standard_normal((d, factors))).astype(np.float32)}
    m = {k: np.zeros_like(a) for k, a in p.items()}
    s = {k: np.zeros_like(a) for k, a in p.items()}
    step = 0
    for _ in range(epochs):
        order = rng.permutation(n)
        for lo in range(0, n, 512):
            pick = order[lo : lo + 512]
            xb, yb = x[pick].astype(np.float32), labels[pick].astype(np.float32)
            sums = xb @ p["v"]
            z = p["b"][0] + xb @ p["w"] + 0.5 * ((sums**2).sum(1) - xb @ (p["v"] ** 2).sum(1))
            g = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - yb) / len(pick)
            grads = {
                "b": np.array([g.sum()], np.float32),
                "w": xb.T @ g + decay * p["w"],
                "v": xb.T @ (g[:, None] * sums) - p["v"] * (xb.T @ g)[:, None] + decay * p["v"],
            }
            step += 1
            for k, gr in grads.items():
                m[k] = 0.9 * m[k] + 0.1 * gr
                s[k] = 0.999 * s[k] + 0.001 * gr * gr
                p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)
    return Model(buckets, float(p["b"][0]), p["w"].astype(np.float64), p["v"].astype(np.float64))


def _tallies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with each bucket, by label, for one task."""
    seen = np.zeros((2, BUCKETS), np.int64)
    for batch in batches:
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found = set().union(*map(terms_of, set((text or "").lower().split())))
            seen[label, np.fromiter(found, np.int64, len(found))] += 1
    at = np.flatnonzero(seen.any(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[0, at]), pa.array(seen[1, at])], names=["bucket", "neg", "pos"])


def learn(docs: DataFrame, labels: DataFrame, learnable: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = 8000, width: int = 1024) -> Model:
    """A model of ``label_col`` from the rows of ``labels`` where ``learnable``."""
    one = labels.where(learnable & F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(id_col).agg(F.max(label_col).cast("int").alias("y_"))
    pick = lambda y: one.where(F.col("y_") == y).orderBy(F.xxhash64(id_col), id_col).limit(per_class)
    # At most 2 * per_class rows of an id and a label: small by that bound.
    sample = docs.select(id_col, text_col).join(F.broadcast(pick(0).union(pick(1))), id_col)
    sample = saved(sample.groupBy(id_col, "y_").agg(F.min(F.coalesce(text_col, F.lit(""))).alias(text_col)).select(text_col, "y_"))
    totals = {r["y_"]: r["n"] for r in sample.groupBy("y_").agg(F.count(F.lit(1)).alias("n")).collect()}
    n0, n1 = totals.get(0, 0), totals.get(1, 0)
    none = np.zeros(0)
    if not n0 or not n1:
        share = n1 / max(1, n0 + n1)
        return Model(none, float(np.clip(np.log(share or 1e-18) - np.log(1 - share or 1e-18), -40, 40)), none, none.reshape(0, 1))
    tallied = sample.mapInArrow(_tallies, "bucket long, neg long, pos long").groupBy("bucket").agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos"))
    share = (F.col("neg") + F.col("pos")) / (n0 + n1)
    spread = F.sqrt(share * (1 - share) * (1 / n0 + 1 / n1))
    strength = F.when(spread > 0, F.abs(F.col("pos") / n1 - F.col("neg") / n0) / spread).otherwise(0.0)
    chosen = tallied.where(F.col("neg") + F.col("pos") >= 3).orderBy(F.round(strength, 9).desc(), "bucket").limit(width)
    buckets = np.array(sorted(r["bucket"] for r in chosen.select("bucket").collect()), np.int64)
    empty = Model(buckets, 0.0, np.zeros(len(buckets)), np.zeros((len(buckets), 1)))

    def positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain, telling = set(), {}
        for batch in batches:
            rows = [sorted(empty.features(t, plain, telling)) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.int16())), batch.column(1)], names=["x", "y"])

    got = sample.mapInArrow(positions, "x array<short>, y int").toArrow()
    rows = [np.array(r, np.int64) for r in got.column("x").to_pylist()]
    y = got.column("y").to_numpy()
    # A fixed order, whatever the order of arrival.
    order = sorted(range(len(rows)), key=lambda i: (y[i], len(rows[i]), rows[i].tobytes()))
    return fit([rows[i] for i in order], y[order], buckets)


def score(docs: DataFrame, model: Model, text_col: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the column ``name`` (double, 0 to 1) behind its own."""
    docs = docs.drop(name)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        plain: set[str] = set()
        telling: dict[str, frozenset[int]] = {}
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                rows = [model.features(t, plain, telling) for t in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(model.scores(rows))], names=[*part.schema.names, name])
                if len(plain) + len(telling) > KNOWN:
                    plain.clear()
                    telling.clear()
        del plain, telling
        give_back()

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def judge(docs: DataFrame, labels: DataFrame, learnable: Column, at: float = 0.7) -> DataFrame:
    """doc_id, text, score and predicted (1 where the score reaches ``at``)."""
    found = score(docs.select("doc_id", "text"), learn(docs, labels, learnable))
    return found.withColumn("predicted", (F.col("score") >= at).cast("int"))
