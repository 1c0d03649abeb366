"""Similarity of two ``array<double>`` columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + x * x))


def dot(left: Column, right: Column) -> Column:
    """Dot product over the length of the shorter vector."""
    products = F.zip_with(left, right, lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda acc, p: acc + F.coalesce(p, F.lit(0.0)))


def cosine(left: Column, right: Column, left_norm: Column, right_norm: Column) -> Column:
    """Cosine similarity given both norms; 0.0 when either vector has length zero."""
    zero = (left_norm == 0) | (right_norm == 0)
    return F.when(zero, F.lit(0.0)).otherwise(dot(left, right) / (left_norm * right_norm))


def cosine_similarity(left: Column, right: Column) -> Column:
    return cosine(left, right, norm(left), norm(right))


def usable(vector: Column) -> Column:
    """The vector, or NULL when it holds a NULL element."""
    return F.when(F.forall(vector, lambda x: x.isNotNull()), vector)
