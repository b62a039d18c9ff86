"""Vector arithmetic on array columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def l2_norm(v: Column) -> Column:
    """The Euclidean length; null for null."""
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def l2_distance(a: Column, b: Column) -> Column:
    """The Euclidean distance of two vectors of one length."""
    parts = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.sqrt(F.aggregate(parts, F.lit(0.0), lambda s, x: s + x))


def normalized(v: Column) -> Column:
    """The vector at length 1; a zero vector stays as it is."""
    norm = l2_norm(v)
    return F.when(norm == 0, v.cast("array<double>")).otherwise(F.transform(v, lambda x: x.cast("double") / norm))


def cosine_of_distance(distance: Column) -> Column:
    """Cosine similarity of unit vectors from their distance, within -1 and 1."""
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 1 - distance * distance / 2))


def rrf_term(rank: Column, k: int = 60) -> Column:
    """What a rank contributes to reciprocal rank fusion."""
    return F.lit(1.0) / (F.lit(k) + rank)
