"""Vector expressions on ARRAY<FLOAT|DOUBLE> columns, computed in DOUBLE."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot_score(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def truncate_normalize(v: Column, dim: int) -> Column:
    """First ``dim`` elements scaled to unit length; an all-zero vector stays zero."""
    head = F.transform(F.slice(v, 1, dim), lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(head, F.lit(0.0), lambda acc, x: acc + x * x))
    scale = F.when(norm > 0, norm).otherwise(F.lit(1.0))
    return F.transform(head, lambda x: x / scale)
