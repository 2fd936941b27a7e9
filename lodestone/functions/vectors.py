"""Vector arithmetic as Column expressions over array<double>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def squared_l2(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def normalised(v: Column, n: Column | None = None) -> Column:
    """``v`` divided by its length, with a guard against the zero vector."""
    n = norm(v) if n is None else n
    return F.transform(v, lambda x: x / (n + F.lit(1e-8)))


def usable(v: Column) -> Column:
    """Whether a vector is there and all its components are finite."""
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return v.isNotNull() & ~F.coalesce(F.exists(v, odd), F.lit(True))


def padded(v: Column, width: int) -> Column:
    """``v`` with zeros behind it, ``width`` components in all; nothing in it is
    null, wherever the optimiser moves the test for that."""
    v = F.transform(F.coalesce(v, F.array().cast("array<double>")), lambda x: F.coalesce(x, F.lit(0.0)))
    return F.concat(v, F.array_repeat(F.lit(0.0), F.greatest(F.lit(width) - F.size(v), F.lit(0))))


def distance_score(d: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + d)
