"""Ordinals, splits and caps without a window over all rows in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import stored


def with_ordinal(df: DataFrame, order: Sequence[Column], name: str = "index", start: int = 0) -> DataFrame:
    """``name``: the position of each row in ``order``, from ``start``.

    The rows are range-partitioned and written out with the number of their
    partition; each takes its place in its own partition and the number of rows
    in the partitions before.  What is summed up in one place is a row a
    partition."""
    keys = [f"ord_{i}_" for i in range(len(order))]
    ranged = df.withColumns(dict(zip(keys, order, strict=True))).repartitionByRange(*[F.col(k) for k in keys])
    ranged = stored(ranged.withColumn("part_", F.spark_partition_id()))
    sizes = ranged.groupBy("part_").agg(F.count(F.lit(1)).alias("n_"))
    before = Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    firsts = sizes.select("part_", F.coalesce(F.sum("n_").over(before), F.lit(0)).alias("first_"))
    inside = Window.partitionBy("part_").orderBy(*[F.col(k) for k in keys])
    out = ranged.join(firsts, "part_").withColumn(name, F.row_number().over(inside).cast("long") - 1 + F.col("first_") + start)
    return out.drop("part_", "first_", *keys)


def split_of(ordinal: Column, total: int, train: float = 0.8, valid: float = 0.1) -> Column:
    """train, valid or test by position."""
    return F.when(ordinal < int(total * train), F.lit("train")).when(ordinal < int(total * (train + valid)), F.lit("valid")).otherwise(F.lit("test"))


def capped_union(datasets: Sequence[DataFrame], most: int | None, parsed: str = "error") -> DataFrame:
    """The datasets in order, as long as fewer than ``most`` rows are parsed.  A
    dataset gives the first rows of what is missing; rows of it that failed to
    parse (``parsed`` not null) are dropped and not replaced."""
    taken, left = [], most
    for number, df in enumerate(datasets):
        if left is not None and left <= 0:
            break
        rows = df.withColumn("dataset", F.lit(number))
        if left is not None:
            rows = rows.where(F.col("ordinal") < left)
        rows = rows.where(F.col(parsed).isNull())
        if left is not None:
            left -= rows.count()
        taken.append(rows)
    out = taken[0]
    for df in taken[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out
