"""Vector distance in built-in expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def vector(values: Sequence[float]) -> Column:
    """A constant vector, folded into the plan."""
    return F.lit([float(v) for v in values]) if len(values) else F.array().cast("array<double>")


def l2_distance(a: Column, b: Column | Sequence[float]) -> Column:
    """Euclidean distance in double precision; null where either is null, an error where sizes differ."""
    b = b if isinstance(b, Column) else vector(b)
    a, b = a.cast("array<double>"), b.cast("array<double>")
    squares = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    total = F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x))
    return F.when(F.size(a) == F.size(b), total).when(a.isNotNull() & b.isNotNull(), F.raise_error(F.lit("vectors differ in dimension")).cast("double"))
