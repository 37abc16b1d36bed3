"""Column expressions over dense vectors stored as ``array<double>``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_doubles(vec: Column) -> Column:
    return vec.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def norm(vec: Column) -> Column:
    return F.sqrt(F.aggregate(vec, F.lit(0.0), lambda acc, x: acc + x * x))


def l2_unit(vec: Column) -> Column:
    """Unit vector; a zero vector stays zero. The norm is evaluated once per row."""
    length = norm(vec)
    safe = F.when(length == 0, F.lit(1.0)).otherwise(length)
    return F.zip_with(vec, F.array_repeat(safe, F.size(vec)), lambda x, n: x / n)


def cosine(a: Column, b: Column) -> Column:
    return dot(l2_unit(a), l2_unit(b))
