"""Dense vectors: array<float> columns, double arithmetic, no fixed dimension."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x
    )


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def vec_literal(values) -> Column:
    """A driver-side vector as a constant column (folded once, not rebuilt per row)."""
    return F.lit([float(v) for v in values])


def _similarity(product: Column, lengths: Column) -> Column:
    # a zero vector is similar to nothing: distance 1, as in the vector join
    return F.coalesce(F.try_divide(product, lengths), F.lit(0.0))


def cosine_similarity(a: Column, b: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), _similarity(dot(a, b), norm(a) * norm(b)))


def cosine_distance(a: Column, b: Column) -> Column:
    return 1.0 - cosine_similarity(a, b)


def distance_to(a: Column, target) -> Column:
    """Cosine distance to one driver-side vector; its norm is computed once, here."""
    if isinstance(target, Column):
        return cosine_distance(a, target)
    values = [float(v) for v in target]
    length = sum(v * v for v in values) ** 0.5
    return F.when(a.isNotNull(), 1.0 - _similarity(dot(a, vec_literal(values)), norm(a) * F.lit(length)))
