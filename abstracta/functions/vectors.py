"""Distances and scores over ``array<float>`` columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

SPACES = ("cosine", "l2sq")


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def distance_cosine(a: Column, b: Column) -> Column:
    """1 for a vector without length, as for orthogonal ones."""
    cosine = F.try_divide(dot(a, b), norm(a) * norm(b))
    return F.when(a.isNotNull() & b.isNotNull(), F.lit(1.0) - F.coalesce(cosine, F.lit(0.0)))


def distance_l2sq(a: Column, b: Column) -> Column:
    squares = F.zip_with(
        a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))
    )
    return F.aggregate(squares, F.lit(0.0), lambda total, x: total + x)


def score_search(distance: Column) -> Column:
    """Displayed score for the cosine space. Not monotone beyond 1: rank on distance."""
    return F.when(distance <= 1, F.round(F.lit(1.0) - distance, 4)).otherwise(F.round(distance, 4))


def score_affinity(distance: Column) -> Column:
    """Displayed score for the squared-L2 space: the cosine, on unit vectors."""
    return (F.lit(2.0) - distance) / 2
