"""JSON arrays cut into their objects, a file by many tasks.

A file is read in pieces that end at "}", wherever Spark splits it.  Whether a
piece begins inside of a string, and how deep, follows from the pieces before it;
each run of pieces is written out with what it does to that state, a narrow row a
run tells the state at each, and then each run is cut by itself.  Only an object
that spans runs is put together from its parts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import stored

RUN_BYTES = 1 << 15  # text of a run, one piece more at most; it is packed, since Parquet is read 4,096 rows at once
_FAR = 1 << 40  # no piece ends outside of strings
_RUN = "path string, start long, k int, text binary, flips int, d0 long, d1 long, m0 long, m1 long, opened boolean"
_PART = "path string, number long, at int, run long, whole boolean, text binary"
_BLANK = b" \t\r\n"
_LAST = (1 << 31) - 1


def _quoted(piece: bytes, inside: bool) -> tuple[int, bool]:
    """What a piece adds to the depth, and whether it ends inside of a string."""
    if b'"' not in piece:
        plain = b"" if inside else piece
    else:
        cut = piece.replace(b"\\\\", b"").replace(b'\\"', b"").split(b'"')
        plain = b"".join(cut[inside::2])
        inside ^= not len(cut) & 1
    return plain.count(b"{") + plain.count(b"[") - plain.count(b"]"), inside


def _run(path: str, start: int, k: int, pieces: list[bytes]) -> tuple:
    """A row of ``_RUN``: the change of depth and the least depth at the end of a
    piece, where the run begins outside (0) and inside (1) of a string."""
    opened = True
    if start == 0 and k == 0:
        head = pieces[0].removeprefix(b"\xef\xbb\xbf").lstrip(_BLANK)
        opened = head.startswith(b"[")
        pieces[0] = head[1:]
    ends, flips = [], 0
    for begins in (False, True):
        inside, depth, least = begins, 0, _FAR
        for piece in pieces:
            step, inside = _quoted(piece, inside)
            depth += step
            if not inside:
                depth -= 1
                least = min(least, depth)
        ends.append((depth, least))
        flips = int(inside != begins)
    return (path, start, k, zlib.compress(b"}".join(pieces), 1), flips, ends[0][0], ends[1][0], ends[0][1], ends[1][1], opened)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


_RUN_ARROW = pa.schema([("path", pa.string()), ("start", pa.int64()), ("k", pa.int32()), ("text", pa.binary()), ("flips", pa.int32()), *[(c, pa.int64()) for c in ("d0", "d1", "m0", "m1")], ("opened", pa.bool_())])
_PART_ARROW = pa.schema([("path", pa.string()), ("number", pa.int64()), ("at", pa.int32()), ("run", pa.int64()), ("whole", pa.bool_()), ("text", pa.binary())])


def _runs(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Pieces (text, path, start) to runs."""
    key, k, held, size = None, 0, [], 0
    for batch in batches:
        for text, path, start in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if held and (key != (path, start) or size >= most):
                yield _batch([_run(*key, k, held)], _RUN_ARROW)
                k, held, size = k + 1, [], 0
            if key != (path, start):
                key, k = (path, start), 0
            held.append(text)
            size += len(text) + 1
    if held:
        yield _batch([_run(*key, k, held)], _RUN_ARROW)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs with their state to whole objects, and to the parts of those that
    began in an earlier run or go on in the next.  number: the run where an object
    began, and at its place there."""
    for batch in batches:
        for path, text, number, owner, inside, depth in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            rows, held, at = [], [], 0
            for piece in zlib.decompress(text).split(b"}"):
                held.append(piece)
                step, inside = _quoted(piece, inside)
                depth += step
                if inside:
                    continue
                depth -= 1
                if depth == 1:
                    found = b"}".join(held) + b"}"
                    rows.append((path, number, at, number, True, found.lstrip(_BLANK + b",")) if at else (path, owner, _LAST, number, False, found))
                    held, at = [], at + 1
            if held:
                rows.append((path, number if at else owner, _LAST, number, False, b"}".join(held) + b"}"))
            yield _batch(rows, _PART_ARROW)


def objects(spark: SparkSession, path: str, run_bytes: int = RUN_BYTES) -> DataFrame:
    """(path, number, at, text): the objects of files that each hold one JSON array,
    in the order of the first three.  A file that holds anything else, or whose array
    is not closed, is an error; what stands between objects is a text of its own or
    goes with the next one."""
    lines = spark.read.option("lineSep", "}").text(path)
    pieces = lines.select(F.col("value").cast("binary"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"))
    runs = stored(pieces.mapInArrow(lambda batches: _runs(batches, run_bytes), _RUN))
    order = Window.partitionBy("path").orderBy("start", "k")  # a row a run, without its text
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum("flips").over(before), F.lit(0)) % 2 == 1
    at = runs.drop("text").withColumns({"number": F.row_number().over(order).cast("long"), "inside": inside})
    at = at.withColumns({"d": F.when(F.col("inside"), F.col("d1")).otherwise(F.col("d0")), "m": F.when(F.col("inside"), F.col("m1")).otherwise(F.col("m0"))})
    at = at.withColumn("depth", F.coalesce(F.sum("d").over(before), F.lit(0)) + 1)
    ends = F.when(F.col("depth") + F.col("m") <= 1, F.col("number"))  # another object begins in such a run
    at = stored(at.withColumn("owner", F.coalesce(F.max(ends).over(before), F.lit(0))))
    last = F.max_by(F.struct((F.col("depth") + F.col("d")).alias("depth"), (F.col("inside") != (F.col("flips") == 1)).alias("inside")), "number")
    files = at.groupBy("path").agg(F.bool_and("opened").alias("opened"), last.alias("last"))
    bad = files.where(~F.col("opened") | (F.col("last.depth") != -1) | F.col("last.inside")).head(1)  # the end of the text counts as one more "}"
    if bad:
        raise ValueError(f"not a JSON array: {bad[0]['path']}")
    key = ["path", "start", "k"]
    cut = runs.select(*key, "text").join(at.select(*key, "number", "owner", "inside", "depth"), key)
    cut = stored(cut.select("path", "text", "number", "owner", "inside", "depth").mapInArrow(_cut, _PART))
    text = F.col("text").cast("string")
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("run", text.alias("t")))), lambda p: p["t"]), "")  # the parts of one object
    spanning = cut.where("NOT whole").groupBy("path", "number", "at").agg(F.regexp_replace(joined, r"^[\s,]+", "").alias("text"))
    spanning = spanning.where(~F.col("text").rlike(r"^[\s,\]}]*$"))  # else the end of the array
    return cut.where("whole").select("path", "number", "at", text.alias("text")).unionByName(spanning)
