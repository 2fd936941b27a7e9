"""URL filter by rules, and by a character language-model ratio elsewhere.

Two interpolated variable-order Markov models over the characters of a URL, one
of URLs that the rules allow and one of those they block, are exact counts of
(order, context) and (order, context, character), a Spark table that grows with
the URLs.  URLs are scored in blocks, and a block's different n-grams are joined
with that table.  The probability of a character after its k last ones is
(n(context, character) + s * p_{k-1}) / (n(context) + s), from k = 0 to ``ORDER``,
so that an unseen context falls back to a shorter one.  The score is the
difference of the mean log-probabilities.  Counts are over all rows that a rule
decides, but for one in five (by hash), whose scores set the threshold with the
best balanced accuracy.

Defined cases.  A null URL is the empty text; without ``://`` host and path are
empty and no rule fits.  Where the rules leave no accepted or no rejected URL,
both models say the same, the score is 0 and the verdict allow.  Repeated rows
count as often as they stand there; further columns are ignored; an empty table
gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved, text_slices

ORDER = 5
SLOTS = 1 << 19  # n-grams handled by one round of numpy operations, but for a longer URL
BLOCK_BITS = 12  # 2^12 URLs are a block
PAD, END = 256, 257  # before and behind the bytes of a URL
SMOOTH = 2.0
BINS = 4001
REACH = 8.0  # scores beyond +-REACH share the outer bins

RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))


def host_of(url: Column) -> Column:
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest rule that fits, or null."""
    fits = []
    for rule, _ in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        name, slash, rest = rule.partition("/")
        fits.append(F.when(((host == name) | host.endswith("." + name)) & path.startswith(slash + rest), F.lit(rule)))
    return F.coalesce(*fits, F.lit(None).cast("string"))


def verdict_of(rule: Column, rules: Sequence[tuple[str, str]]) -> Column:
    return F.coalesce(*[F.when(rule == r, F.lit(v)) for r, v in rules], F.lit(None).cast("string"))


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every byte of every text and its end mark: the contexts and context
    with byte, by order, as numbers that say them exactly (nine bits a symbol);
    and its row."""
    lengths = np.diff(offsets)
    rows = np.repeat(np.arange(len(lengths)), lengths + 1)
    at = np.arange(len(rows)) + ORDER * (rows + 1)
    padded = np.full(len(rows) + ORDER * len(lengths), PAD, np.int64)
    chars = np.full(len(rows), END, np.int64)
    inner = np.ones(len(rows), bool)
    inner[np.cumsum(lengths + 1) - 1] = False
    chars[inner] = data
    padded[at] = chars
    context = np.zeros(len(rows), np.int64)
    contexts, joints = [], []
    for k in range(ORDER + 1):
        if k:
            context = context | (padded[at - k] << (9 * (k - 1)))
        contexts.append(context | (2 * k << 54))
        joints.append((context << 9) | chars | (2 * k + 1 << 54))
    return np.stack(contexts), np.stack(joints), rows


def _places(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different values, sorted, and the place of each value among them."""
    known, at = np.unique(values, return_inverse=True)
    return known, at.reshape(values.shape)


def slots(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``grams`` as places among the different contexts and among the different
    joints of these texts."""
    contexts, joints, rows = grams(data, offsets)
    return _places(contexts)[1], _places(joints)[1], rows


def _slices(column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    return text_slices(column, SLOTS // (ORDER + 1))


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of a slice, for (url, label) rows: label 0 rejected, 1 accepted."""
    for batch in batches:
        labels = batch.column(1).to_numpy(zero_copy_only=False)
        for lo, hi, data, offsets in _slices(batch.column(0)):
            contexts, joints, rows = grams(data, offsets)
            known, at = _places(np.stack([contexts, joints]))
            accepted = np.broadcast_to(labels[lo:hi][rows] == 1, at.shape)
            n1 = np.bincount(at[accepted], minlength=len(known))
            n0 = np.bincount(at[~accepted], minlength=len(known))
            yield pa.RecordBatch.from_arrays([pa.array(known), pa.array(n0), pa.array(n1)], names=["gram", "n0", "n1"])


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The different n-grams of (url, block) rows, by slice and block."""
    for batch in batches:
        blocks = batch.column(1).to_numpy()
        cuts = [0, *(np.flatnonzero(blocks[1:] != blocks[:-1]) + 1).tolist(), len(blocks)]
        for start, end in zip(cuts, cuts[1:], strict=False):
            for _, _, data, offsets in _slices(batch.column(0).slice(start, end - start)):
                contexts, joints, _ = grams(data, offsets)
                known = np.unique(np.stack([contexts, joints]))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(known), blocks[start])), pa.array(known)], names=["block", "gram"])


def ratios(tables: np.ndarray, data: np.ndarray, offsets: np.ndarray, places: tuple | None = None) -> np.ndarray:
    """Mean log-probability as accepted less that as rejected, of each text;
    ``tables`` has the counts by label, context or joint, and place in ``slots``."""
    contexts, joints, rows = places or slots(data, offsets)
    logs = []
    for y in (0, 1):
        p = np.full(len(rows), 1 / 256)
        for k in range(ORDER + 1):
            seen = tables[y, 0, contexts[k]]
            p = (tables[y, 1, joints[k]] + SMOOTH * p) / (seen + SMOOTH)
        logs.append(np.log(p))
    n = len(offsets) - 1
    return np.bincount(rows, logs[1] - logs[0], n) / (np.diff(offsets) + 1)


def _scores(pages: pa.Table, counts: pa.Table) -> pa.Table:
    """The rows of a block with their scores, from the counts of its n-grams."""
    order = np.argsort(counts.column("gram").to_numpy())
    known = counts.column("gram").to_numpy()[order]
    numbers = np.stack([counts.column(c).to_numpy()[order] for c in ("n0", "n1")]).astype(np.float64)
    numbers, known = np.c_[numbers, np.zeros(2)], np.r_[known, np.iinfo(np.int64).max]  # the last for all that is not there
    parts = [np.zeros(0)]
    for _, _, data, offsets in _slices(pages.column("url")):
        contexts, joints, rows = grams(data, offsets)
        (some, contexts), (both, joints) = _places(contexts), _places(joints)
        tables = np.zeros((2, 2, max(len(some), len(both))))
        for i, wanted in enumerate((some, both)):
            at = np.searchsorted(known, wanted)
            tables[:, i, : len(wanted)] = np.where(known[at] == wanted, numbers[:, at], 0)
        parts.append(ratios(tables, data, offsets, (contexts, joints, rows)))
    return pages.drop_columns(["block"]).append_column("score", pa.array(np.concatenate(parts)))


def cut_at(bins: list[tuple[int, int, int]]) -> float:
    """The threshold of best balanced accuracy, from (label, bin, count)."""
    tally = np.zeros((2, BINS))
    for y, b, n in bins:
        tally[y, b] += n
    if not tally.sum(axis=1).all():
        return 0.0
    below = np.cumsum(tally / tally.sum(axis=1, keepdims=True), axis=1)
    gain = np.r_[0.0, below[0] - below[1]]  # rejected below less accepted below
    top = np.flatnonzero(gain >= gain.max() - 1e-12)
    middle = top[np.argmin(np.abs(top - BINS / 2))]
    return float(middle * (2 * REACH / BINS) - REACH)


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, score of every row."""
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    rows = rows.withColumn("rule", rule_for(F.col("host"), F.col("path"), rules)).withColumn("ruled", verdict_of(F.col("rule"), rules))
    known = rows.where(F.col("ruled").isNotNull()).select("url", (F.col("ruled") == "allow").cast("int").alias("label"))
    held = F.pmod(F.xxhash64("url"), F.lit(5)) == 0
    # Blocks are runs of rows, so that no URL's copies have to be in one of them.
    rows = saved(rows.withColumn("held", held).withColumn("block", F.shiftright(F.monotonically_increasing_id(), BLOCK_BITS)))
    known = rows.where(F.col("ruled").isNotNull() & ~F.col("held")).select("url", (F.col("ruled") == "allow").cast("int").alias("label"))
    counts = known.mapInArrow(_gather, "gram long, n0 long, n1 long").groupBy("gram").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    if known.select("label").distinct().count() < 2:
        counts = counts.where(F.lit(False))
    asked = rows.select("url", "block").mapInArrow(_asked, "block long, gram long").distinct()
    found = asked.join(counts, "gram").select("block", "gram", "n0", "n1")
    names = ["page_id", "url", "host", "path", "rule", "ruled", "held"]
    kinds = dict(rows.dtypes)
    own = rows.select(*names, "block").groupBy("block").cogroup(found.groupBy("block"))
    scored = saved(own.applyInArrow(_scores, ", ".join(f"{c} {kinds[c]}" for c in names) + ", score double"))
    place = F.greatest(F.lit(0), F.least(F.lit(BINS - 1), F.floor((F.col("score") + REACH) * (BINS / (2 * REACH)))))
    judged = scored.where(F.col("ruled").isNotNull() & F.col("held")).select((F.col("ruled") == "allow").cast("int").alias("label"), place.cast("int").alias("bin"))
    tally = judged.groupBy("label", "bin").agg(F.count(F.lit(1)).alias("n")).collect()  # 2 * BINS rows at most
    cut = cut_at([(r["label"], r["bin"], r["n"]) for r in tally])
    verdict = F.when(F.col("score") >= cut, F.lit("allow")).otherwise(F.lit("block"))
    return scored.select("page_id", "host", "path", "rule", F.coalesce("ruled", verdict).alias("verdict"), "score")
