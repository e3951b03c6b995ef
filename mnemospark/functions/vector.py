"""Vector expressions that run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_vector(text: Column) -> Column:
    """``[v1,v2,...]`` text to an array column."""
    return F.from_json(text, "array<float>")


def format_vector(vector: Column) -> Column:
    """Array column to ``[v1,v2,...]`` text."""
    return F.to_json(vector)


def dot(left: Column, right: Column) -> Column:
    products = F.zip_with(left, right, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def norm(vector: Column) -> Column:
    squares = F.transform(vector, lambda x: x.cast("double") * x.cast("double"))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda total, x: total + x))


def cosine_similarity(left: Column, right: Column) -> Column:
    """Cosine of two arrays; NULL where either has length zero."""
    return F.try_divide(dot(left, right), norm(left) * norm(right))
