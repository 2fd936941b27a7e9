"""Shared pieces of the training-data operators.

Text is read on the executors from Arrow buffers and tokenised with numpy, a
bounded slice of a batch at a time.  Intermediate tables are written as Parquet
under the folder that ``spark.checkpoint.dir`` names, so that a lost executor
costs a re-read and never a recomputation of the whole lineage.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.scratch import stored as saved

CHUNK_BYTES = 1 << 20  # text handled by one round of numpy operations


# ---------------------------------------------------------------- tables


def table(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def shuffle_parts(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def clean_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, lengthened until no column of ``df`` has that name."""
    have = {c.lower() for c in df.columns}
    while wanted.lower() in have:
        wanted += "_"
    return wanted


# ---------------------------------------------------------------- hashing

_U = np.uint64
_K1, _K2 = _U(0x9E3779B97F4A7C15), _U(0xD6E8FEB86659FD93)
_LOW = np.array([(1 << (8 * i)) - 1 for i in range(9)], dtype=np.uint64)  # the low 0 to 8 bytes
LONG_WORD = 64  # bytes; longer words are rare and go through a cryptographic hash


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> _U(32))
    h = h * _K2
    h = h ^ (h >> _U(32))
    h = h * _K2
    return h ^ (h >> _U(32))


def _stirred(h: np.ndarray) -> np.ndarray:
    h ^= h >> _U(32)
    h *= _K2
    h ^= h >> _U(29)
    return h


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges, none empty.  Eight bytes at a time enter a
    state that is stirred in between, for all ranges together, so no regular
    text makes different words meet."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray((len(data) + 1,), "<u8", buffer=padded, strides=(1,))
    size = ends - starts
    h = eight[starts]
    h &= _LOW[np.minimum(size, 8)]
    h += size.astype(_U) * _K1
    _stirred(h)
    more, at = np.flatnonzero((size > 8) & (size <= LONG_WORD)), 8
    while len(more):
        x = eight[starts[more] + at]
        x &= _LOW[np.minimum(size[more] - at, 8)]
        x += h[more]
        x *= _K1
        h[more] = _stirred(x)
        at += 8
        more = more[size[more] > at]
    h *= _K1
    h ^= h >> _U(32)
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]], digest_size=8).digest(), "little")
    return h


# ---------------------------------------------------------------- text slices


def text_slices(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets of the rows in them) for slices
    of about ``most`` bytes; a longer text is a slice of its own.  Null is ''."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_string(column.type):
        column = column.cast(pa.large_string())
    column = pc.fill_null(column, "")
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = int(np.searchsorted(offsets, offsets[row] + most, side="right")) - 1
        end = min(max(end, row + 1), len(column))
        lo, hi = offsets[row], offsets[end]
        yield row, end, data[lo:hi], offsets[row : end + 1] - lo
        row = end


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs without space or x09-x0D), and for
    each row the index of its first word, with the total at the end."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    solid = (data != 32) & ((data - np.uint8(9)) > 4)
    turns = np.flatnonzero(solid[1:] != solid[:-1]) + 1
    turns = np.concatenate([np.zeros(int(solid[0]), np.int64), turns, np.full(int(solid[-1]), n, np.int64)])
    starts, ends = turns[0::2], turns[1::2]
    # A row can end within a run.
    cuts = np.unique(offsets[(offsets > 0) & (offsets < n)])
    cuts = cuts[solid[cuts] & solid[cuts - 1]]
    if len(cuts):
        starts = np.insert(starts, np.searchsorted(starts, cuts), cuts)
        ends = np.insert(ends, np.searchsorted(ends, cuts), cuts)
    return starts, ends, np.searchsorted(starts, offsets)


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z lower-cased."""
    return data | (((data - np.uint8(65)) < 26).view(np.uint8) << np.uint8(5))


# ---------------------------------------------------------------- ranks


def ranked_within(df: DataFrame, keys: list[str], order: list[Column], spread: Column, name: str) -> DataFrame:
    """``df`` with ``name``: 0, 1, 2 ... within ``keys`` (never null), without holding a key
    in one task.  ``spread`` is an integer column; rows are ordered by it and
    then by ``order``; one (keys, spread) cell is one sorted unit.  The offsets
    come from a window over cell counts, one row a cell."""
    cell, first = clean_name(df, "cell"), clean_name(df, "first")
    df = df.withColumn(cell, spread)
    sums = df.groupBy(*keys, cell).agg(F.count(F.lit(1)).alias("n_"))
    before = Window.partitionBy(*keys).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn(first, F.coalesce(F.sum("n_").over(before), F.lit(0))).drop("n_")
    inside = Window.partitionBy(*keys, cell).orderBy(*order)
    out = df.join(sums, [*keys, cell])
    return out.withColumn(name, F.row_number().over(inside).cast("long") - 1 + F.col(first)).drop(cell, first)


# ---------------------------------------------------------------- batches


def pieces(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of so many rows: what is made of one stays small."""
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)


def give_back() -> None:
    """Returns what this worker has freed to the system: a worker is kept for
    later tasks, and its peak would stay with it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


# ---------------------------------------------------------------- runs


def sorted_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of the rows with one value in the first column (long, not null),
    for batches that come sorted by it.  Only one run is held at a time."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy()
        heads = np.flatnonzero(key[1:] != key[:-1]) + 1
        if held and held[-1].column(0)[0].as_py() != int(key[0]):
            yield pa.Table.from_batches(held)
            held = []
        start = 0
        for end in [*heads.tolist(), len(key)]:
            if start:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(start, end - start))
            start = end
    if held:
        yield pa.Table.from_batches(held)


def block_pairs(df: DataFrame, keys: list[str], spread: Column, rows: int, counts: DataFrame | None = None) -> DataFrame:
    """Deals the rows of each key into blocks of about ``rows`` and gives, for
    each pair of blocks of a key, all rows of both: columns ``unit`` (a hash of
    key and pair), ``side`` (0 or 1; 0 throughout where a block meets itself).
    A key that fits one block is one unit."""
    if counts is None:
        counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_"))
    large = saved(counts.where(F.col("n_") > rows).select(*keys, F.ceil(F.col("n_") / rows).cast("int").alias("nb_")))
    out = df.join(large, keys, "left").withColumn("nb_", F.coalesce("nb_", F.lit(1)))
    out = out.withColumn("own_", F.pmod(spread, F.col("nb_")).cast("int"))
    out = out.withColumn("other_", F.explode(F.sequence(F.lit(0), F.col("nb_") - 1)))
    low, high = F.least("own_", "other_"), F.greatest("own_", "other_")
    out = out.withColumn("unit", F.xxhash64(*keys, low, high)).withColumn("side", (F.col("own_") > F.col("other_")).cast("int"))
    return out.drop("nb_", "own_", "other_")
