"""Vectors as arrays of doubles. All arithmetic stays inside one row, in array order, so sums do not depend on partitions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Norm products (and norms) below this count as zero.
TINY = 1e-10


def doubles(v: Column | str) -> Column:
    return (F.col(v) if isinstance(v, str) else v).cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 if the product of the norms is next to nothing; null if a vector is null."""
    n = norm(a) * norm(b)
    return F.when(n < TINY, 0.0).otherwise(dot(a, b) / n)


def normalise(a: Column) -> Column:
    """The unit vector; a vector next to zero as it is."""
    n = norm(a)
    return F.when(n > TINY, F.transform(a, lambda x: x / n)).otherwise(a)


def midpoint(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: (x + y) / 2.0)


def refine(centroid: Column, content: Column, alpha: float) -> Column:
    """The centroid moved by alpha towards the content, on the unit sphere."""
    return normalise(F.zip_with(centroid, content, lambda p, c: p * (1.0 - alpha) + c * alpha))


def literal(vector) -> Column:
    return F.array(*(F.lit(float(x)) for x in vector))
