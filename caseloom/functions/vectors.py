"""Vector arithmetic over array columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Distances are compared after rounding, so that engines agree on ties.
DISTANCE_DIGITS = 6


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, v: acc + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine similarity, rounded; NULL where a vector has no length."""
    return F.round(F.lit(1.0) - dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0)), DISTANCE_DIGITS)


def l2_distance(a: Column, b: Column) -> Column:
    squares = F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), 2))
    return F.round(F.sqrt(F.aggregate(squares, F.lit(0.0), lambda acc, v: acc + v)), DISTANCE_DIGITS)
