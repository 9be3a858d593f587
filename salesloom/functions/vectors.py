"""Vector arithmetic on ``array<double>`` columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, v: s + v * v))


def cosine(a: Column, b: Column, norm_a: Column | None = None,
           norm_b: Column | None = None) -> Column:
    """Cosine similarity; 0.0 for empty, all-zero or differently long vectors."""
    norm_a = norm(a) if norm_a is None else norm_a
    norm_b = norm(b) if norm_b is None else norm_b
    usable = (F.size(a) == F.size(b)) & (norm_a > 0) & (norm_b > 0)
    return F.when(usable, dot(a, b) / (norm_a * norm_b)).otherwise(F.lit(0.0))


def squared_l2(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0),
                       lambda s, v: s + v)


def distance_score(distance: Column) -> Column:
    """Distance to a score in (0, 1]: smaller distance, higher score."""
    return 1.0 / (1.0 + F.greatest(distance, F.lit(0.0)))
