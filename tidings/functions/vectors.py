"""Vector expressions and 64-bit fingerprint distance."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def norm(v: Column) -> Column:
    return F.sqrt(_dot(v, v))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity, 0 when either side has no length."""
    scale = norm(a) * norm(b)
    return F.when(scale == 0, F.lit(0.0)).otherwise(_dot(a, b) / F.when(scale == 0, F.lit(1.0)).otherwise(scale))


def unit_vector(v: Column) -> Column:
    """The vector at length one in 32-bit precision; null for null or zero input."""
    length = norm(v)
    return F.when(length > 0, F.transform(v, lambda x: (x.cast("double") / length).cast("float")))


def parse_embedding(literal: Column) -> Column:
    """Array from a vector literal such as ``[0.1,0.2]``; null when it is not an array."""
    return F.from_json(literal, "array<double>")


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def running_centroid(centroid: Column, count: Column, vector: Column) -> Column:
    """Mean after one more vector joins a group of ``count``."""
    return F.zip_with(centroid, vector, lambda c, x: (c * count + x) / (count + 1))
