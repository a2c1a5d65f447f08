"""Vector arithmetic on array columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F


def literal_vector(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def norm(a: Column) -> Column:
    return F.sqrt(
        F.aggregate(a, F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double"))
    )


def cosine_similarity(a: Column, b: Column) -> Column:
    """Cosine of two vectors; null when either is missing or has no length."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def cosine_to(a: Column, query: Sequence[float]) -> Column:
    """Cosine to a fixed vector whose length is known before the scan starts."""
    length = sum(float(v) * float(v) for v in query) ** 0.5
    if length == 0.0:
        return F.lit(None).cast("double")
    return dot(a, literal_vector(query)) / F.nullif(norm(a) * F.lit(length), F.lit(0.0))


def has_dimension(a: Column, size: int) -> Column:
    return F.size(a) == size
