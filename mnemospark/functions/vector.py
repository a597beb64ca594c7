"""Vector functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + F.coalesce(v, F.lit(0.0)))


def cosine_similarity(a: Column, b: Column) -> Column:
    """0 for null, empty and zero vectors; of unequal lengths the shorter counts."""
    n = F.least(F.size(a), F.size(b))
    short = lambda v: F.slice(v, 1, F.greatest(n, F.lit(0)))
    norm = F.sqrt(_dot(short(a), short(a)) * _dot(short(b), short(b)))
    return F.when(a.isNull() | b.isNull() | (n <= 0), F.lit(0.0)).otherwise(F.coalesce(F.try_divide(_dot(short(a), short(b)), norm), F.lit(0.0)))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - similarity; 2 for null, empty and zero vectors."""
    nothing = a.isNull() | b.isNull() | (F.size(a) == 0) | (F.size(b) == 0) | ~F.exists(a, lambda x: x != 0) | ~F.exists(b, lambda x: x != 0)
    return F.when(nothing, F.lit(2.0)).otherwise(1 - cosine_similarity(a, b))


def fit_dimensions(v: Column, n: int) -> Column:
    """Cut or zero-padded to ``n`` components."""
    return F.slice(F.concat(v, F.array_repeat(F.lit(0.0), n)), 1, n)
