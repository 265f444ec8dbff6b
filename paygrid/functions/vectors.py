"""Dense-vector expressions (arrays of float/double)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def as_double(vec: Column | str) -> Column:
    return F.transform(_c(vec), lambda x: x.cast("double"))


def dot(a: Column | str, b: Column | str) -> Column:
    """Sum of element products, in double."""
    prods = F.zip_with(as_double(a), as_double(b), lambda x, y: x * y)
    return F.aggregate(prods, F.lit(0.0), lambda acc, x: acc + F.coalesce(x, F.lit(0.0)))


def norm(a: Column | str) -> Column:
    d = as_double(a)
    return F.sqrt(F.aggregate(d, F.lit(0.0), lambda acc, x: acc + x * x))
