"""Mixing sources to target weights by hierarchical budgeting.

A token budget goes down a tree of domain, language and source.  At each node it
is shared among the children by their weights; a child that cannot take its
share (``max_epochs`` times its tokens) leaves the shortage to its siblings, and
only what all of them together cannot take goes up to the siblings of the node.
A leaf with budget b and t tokens gives b // t whole epochs and, of one epoch
more, the longest prefix with at most b % t tokens, in an order by hash of seed,
epoch and id.

The tree's totals reach the driver, one row a leaf, at most ``MOST_LEAVES``.  The
prefix is found by a histogram of the order's keys: one bucket of a leaf holds
the cut, and only its documents are put in order.  What comes back is a cut key
a leaf, so that choosing the documents is a filter and moves no text.

Defined cases.  Null languages and sources are one child, named ``(none)``.
Tokens are words between white space; a document without any is never chosen.
Documents of one id (repeated rows) stand at one place of the order, all in or
all out.  An empty table, or a budget of 0, gives no rows.  Columns that clash
with the operator's own are kept in ``choose``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import clean_name, saved

MOST_LEAVES = 100_000
NONE = "(none)"

# The production mix: shares of the children of a node, 1 where not named.
WEIGHTS: dict[tuple[str, ...], float] = {
    ("crawl",): 3.0, ("forum",): 1.0, ("news",): 2.0, ("reference",): 2.0,
    **{(d, lang): w for d in ("crawl", "forum", "news", "reference") for lang, w in (("en", 4.0), ("de", 2.0), ("fr", 2.0), ("es", 1.0))},
}
SEED = 20


def domain_of(source: Column) -> Column:
    """The domain of a source by its number; ``other`` without one."""
    n = F.try_to_number(F.regexp_extract(F.coalesce(source, F.lit("")), r"^src(\d{1,9})$", 1), F.lit("999999999"))
    group = (n % 20 / 5).cast("int")
    return F.coalesce(F.element_at(F.array(*[F.lit(x) for x in ("crawl", "forum", "news", "reference")]), group + 1), F.lit("other"))


def shares(amount: int, weights: Sequence[float], room: Sequence[int]) -> list[int]:
    """``amount`` by weight, none above its room; shortages go to the others."""
    got = [0] * len(weights)
    open_ = [i for i, w in enumerate(weights) if w > 0 and room[i] > 0]
    left = min(amount, sum(room[i] for i in open_))
    while open_ and left > 0:
        total = sum(weights[i] for i in open_)
        full = [i for i in open_ if left * weights[i] / total >= room[i]]
        if not full:
            part = {i: left * weights[i] / total for i in open_}
            for i in open_:
                got[i] = int(part[i])
            over = left - sum(int(p) for p in part.values())
            for i in sorted(open_, key=lambda i: (int(part[i]) - part[i], i)):
                if over > 0 and got[i] < room[i]:
                    got[i] += 1
                    over -= 1
            break
        for i in full:
            got[i] = room[i]
            left -= room[i]
        open_ = [i for i in open_ if i not in set(full)]
    return got


def budgets(tokens: Mapping[tuple[str, ...], int], weights: Mapping[tuple[str, ...], float], budget: int, max_epochs: int) -> dict[tuple[str, ...], int]:
    """The budget of each leaf (a path); ``tokens``: what each leaf has."""
    depth = len(next(iter(tokens))) if tokens else 0
    room: dict[tuple[str, ...], int] = {}
    children: dict[tuple[str, ...], set[tuple[str, ...]]] = {}
    for path, n in tokens.items():
        for k in range(depth + 1):
            room[path[:k]] = room.get(path[:k], 0) + n * max_epochs
            if k:
                children.setdefault(path[: k - 1], set()).add(path[:k])
    given = {(): min(budget, room.get((), 0))}
    level = [()] if tokens else []
    for _ in range(depth):
        below = []
        for node in level:
            kids = sorted(children[node])
            for kid, n in zip(kids, shares(given[node], [weights.get(k, 1.0) for k in kids], [room[k] for k in kids]), strict=True):
                given[kid] = n
            below += kids
        level = below
    return {path: given[path] for path in tokens}


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"\S+")).cast("long")


def _key(seed: int, epoch: Column, id_: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), epoch.cast("string"), F.coalesce(id_.cast("string"), F.lit(NONE))))


def _levels(levels: Sequence[Column]) -> list[Column]:
    return [F.coalesce(c.cast("string"), F.lit(NONE)) for c in levels]


def plan(docs: DataFrame, levels: Sequence[Column], tokens: Column, id_col: str = "doc_id", weights: Mapping[tuple[str, ...], float] = WEIGHTS, share: float = 0.5, max_epochs: int = 2, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(slim, leaves): slim has id, path and tokens of each document; leaves has
    a row a leaf: path, whole epochs, cut (the last key of the prefix, or '')
    and budget.  The budget is ``share`` of all tokens."""
    spark = docs.sparkSession
    slim = saved(docs.select(F.col(id_col).alias("id"), F.array(*_levels(levels)).alias("path"), tokens.alias("tokens")))
    sums = slim.groupBy("path").agg(F.sum("tokens").alias("tokens")).limit(MOST_LEAVES + 1).collect()
    if len(sums) > MOST_LEAVES:
        raise ValueError(f"more than {MOST_LEAVES} sources")
    have = {tuple(r["path"]): r["tokens"] for r in sums}
    given = budgets(have, weights, int(share * sum(have.values())), max_epochs)
    rows = [{"path": list(p), "epochs": given[p] // n if n else 0, "rest": given[p] % n if n else 0, "budget": given[p]} for p, n in have.items()]
    # By Arrow: from rows, each executor would keep further Python workers for them.
    kinds = pa.schema([("path", pa.list_(pa.string())), ("epochs", pa.int64()), ("rest", pa.int64()), ("budget", pa.int64())])
    leaves = spark.createDataFrame(pa.Table.from_pylist(rows, kinds), "path array<string>, epochs long, rest long, budget long")
    keyed = slim.where("tokens > 0").join(F.broadcast(leaves.where("rest > 0")), "path").withColumn("key", _key(seed, F.col("epochs"), F.col("id")))
    keyed = keyed.withColumn("bucket", F.substring("key", 1, 3))
    by_leaf = Window.partitionBy("path")
    buckets = keyed.groupBy("path", "rest", "bucket").agg(F.sum("tokens").alias("n")).withColumn("end", F.sum("n").over(by_leaf.orderBy("bucket")))
    cut = buckets.where(F.col("end") > F.col("rest")).groupBy("path").agg(F.min("bucket").alias("bucket"), F.min(F.col("end") - F.col("n")).alias("before"))
    cut = saved(cut)
    inside = keyed.join(F.broadcast(cut), ["path", "bucket"]).groupBy("path", "rest", "before", "key").agg(F.sum("tokens").alias("n"))
    inside = inside.withColumn("end", F.col("before") + F.sum("n").over(by_leaf.orderBy("key")))
    last = inside.where(F.col("end") <= F.col("rest")).groupBy("path").agg(F.max("key").alias("last"))
    # Without a document of the cut's bucket the prefix ends before that bucket.
    leaves = leaves.join(F.broadcast(cut.select("path", "bucket")), "path", "left").join(F.broadcast(last), "path", "left")
    end = F.when(F.col("rest") > 0, F.coalesce("last", "bucket", F.lit("g"))).otherwise(F.lit(""))
    return slim, saved(leaves.select("path", "epochs", end.alias("cut"), "budget"))


def _chosen(rows: DataFrame, leaves: DataFrame, path: str, id_: Column, seed: int, cut: str, epochs: str) -> Column:
    """How often a document is chosen."""
    return F.col(epochs) + F.when((F.col(cut) != "") & (_key(seed, F.col(epochs), id_) <= F.col(cut)), 1).otherwise(0)


def choose(docs: DataFrame, levels: Sequence[Column], tokens: Column, id_col: str = "doc_id", copies: bool = False, seed: int = SEED, **settings) -> DataFrame:
    """The rows of ``docs`` that the mix takes, each once, or with ``copies`` as
    often as it takes them."""
    _, leaves = plan(docs, levels, tokens, id_col, seed=seed, **settings)
    path, times = clean_name(docs, "path_"), clean_name(docs, "times_")
    cut, epochs = clean_name(docs, "cut_"), clean_name(docs, "epochs_")
    side = leaves.select(F.col("path").alias(path), F.col("epochs").alias(epochs), F.col("cut").alias(cut))
    out = docs.withColumn(path, F.array(*_levels(levels))).join(F.broadcast(side), path)
    out = out.withColumn(times, _chosen(out, leaves, path, F.col(id_col), seed, cut, epochs)).where((F.col(times) > 0) & (tokens > 0))
    if copies:
        out = out.withColumn(times, F.explode(F.sequence(F.lit(1), F.col(times))))
    return out.select(*docs.columns)


def mix(docs: DataFrame, levels: Sequence[Column], tokens: Column, id_col: str = "doc_id", seed: int = SEED, **settings) -> DataFrame:
    """id, path, epoch, tokens and leaf budget of every choice."""
    slim, leaves = plan(docs, levels, tokens, id_col, seed=seed, **settings)
    out = slim.where("tokens > 0").join(F.broadcast(leaves), "path")
    out = out.withColumn("times", _chosen(out, leaves, "path", F.col("id"), seed, "cut", "epochs")).where("times > 0")
    return out.select(F.col("id").alias(id_col), "path", F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1)).alias("epoch"), "tokens", "budget")
