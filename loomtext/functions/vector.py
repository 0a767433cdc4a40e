"""Column functions over array<float> vectors, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _d(v: Column | str) -> Column:
    return (F.col(v) if isinstance(v, str) else v).cast("array<double>")


def _sum(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column | str, b: Column | str) -> Column:
    return _sum(F.zip_with(_d(a), _d(b), lambda x, y: x * y))


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column | str, b: Column | str) -> Column:
    """0 if either vector has no length."""
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def l2(a: Column | str, b: Column | str) -> Column:
    return F.sqrt(_sum(F.zip_with(_d(a), _d(b), lambda x, y: (x - y) * (x - y))))


def unit(a: Column | str) -> Column:
    """Of length 1; a vector without length stays as it is."""
    n = norm(a)
    return F.transform(_d(a), lambda x: x / F.when(n == 0, F.lit(1.0)).otherwise(n))
