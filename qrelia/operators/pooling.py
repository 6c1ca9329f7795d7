"""Combining a group's vectors into one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pool_vectors(df: DataFrame, key: str, vector: str, pos: str, mode: str = "mean") -> DataFrame:
    """One vector per ``key``: mean or max of each dimension, or (cls) the first by ``pos``.

    Mean and max aggregate per (key, dimension), so a group of any size is
    reduced before it is shuffled; only one value per dimension is collected.
    """
    if mode == "cls":
        doubles = F.transform(vector, lambda x: x.cast("double"))
        return df.groupBy(key).agg(F.min_by(doubles, pos).alias("pooled"))
    if mode not in ("mean", "max"):
        raise ValueError(f"unsupported pooling mode: {mode!r}")
    combine = {"mean": F.avg, "max": F.max}[mode]
    per_dim = (
        df.select(key, F.posexplode(vector).alias("dim", "x"))
        .groupBy(key, "dim")
        .agg(combine(F.col("x").cast("double")).alias("x"))
    )
    return per_dim.groupBy(key).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("dim", "x"))), lambda s: s["x"]).alias("pooled")
    )
