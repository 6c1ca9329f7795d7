"""Lookups of rows against a table of unique keys, safe for large and hot keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A lookup table is broadcast only when its measured size is below both bounds.
BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 64 << 20

# A key holding more than 1/HOT_SHARE of the rows is hot, so at most HOT_SHARE
# keys can be hot whatever the size of the table.
HOT_SHARE = 1_000


def measured_size(df: DataFrame) -> tuple[int, int]:
    """Row count and approximate bytes of ``df`` (one aggregate job)."""
    widths: list[Column] = []
    for name, kind in df.dtypes:
        if kind in ("string", "binary"):
            widths.append(F.coalesce(F.octet_length(F.col(name)), F.lit(0)) + 16)
        elif kind.startswith(("array", "map", "struct")):
            widths.append(F.coalesce(F.octet_length(F.to_json(F.struct(name))), F.lit(0)))
        else:
            widths.append(F.lit(8))
    width = reduce(lambda a, b: a + b, widths)
    row = df.agg(F.count(F.lit(1)).alias("n"), F.sum(width.cast("long")).alias("b")).first()
    return row["n"], row["b"] or 0


def fits_broadcast(df: DataFrame) -> bool:
    n, size = measured_size(df)
    return n <= BROADCAST_ROWS and size <= BROADCAST_BYTES


def broadcast_if_small(df: DataFrame) -> DataFrame:
    """``df`` with a broadcast hint if it was measured as small, else as it is."""
    return F.broadcast(df) if fits_broadcast(df) else df


def lookup_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Join ``left`` to ``right`` on ``key``; ``right`` holds each key once.

    ``how`` is inner, left, semi or anti. A right side measured as small is
    broadcast, so ``left`` is not shuffled at all. Otherwise both sides are
    shuffled, except for rows of hot keys: those meet a broadcast of the (at
    most HOT_SHARE) hot right rows and are spread over all tasks.
    """
    joins = {"inner": "inner", "left": "left", "semi": "left_semi", "anti": "left_anti"}
    if fits_broadcast(right):
        return left.join(F.broadcast(right), key, joins[how])
    return _hot_split_join(left, right, key, how)


def _hot_split_join(left: DataFrame, right: DataFrame, key: str, how: str) -> DataFrame:
    counts = left.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    total = left.count()
    hot = counts.where(F.col("_n") > total / HOT_SHARE).select(key)

    extra = [c for c in right.columns if c != key]
    packed = right.select(key, F.struct(F.lit(True).alias("_found"), *extra).alias("_right"))
    hot_right = packed.join(F.broadcast(hot), key, "left_semi").withColumnRenamed("_right", "_hot")

    # A row served by the broadcast no longer needs its key: a hash of the whole
    # row (repeatable, should a task be run again) sends it elsewhere, where it
    # matches nothing.
    spread = F.concat(F.lit("h"), F.xxhash64(*left.columns).cast("string"))
    shuffle_key = F.when(F.col("_hot").isNull(), F.concat(F.lit("k"), F.col(key).cast("string")))
    joined = (
        left.join(F.broadcast(hot_right), key, "left")
        .withColumn("_k", F.coalesce(shuffle_key, spread))
        .join(
            packed.select(
                F.concat(F.lit("k"), F.col(key).cast("string")).alias("_k"),
                F.col("_right").alias("_cold"),
            ),
            "_k",
            "left",
        )
        .withColumn("_match", F.coalesce("_hot", "_cold"))
    )
    found = F.coalesce(F.col("_match._found"), F.lit(False))
    if how in ("semi", "anti"):
        return joined.where(found if how == "semi" else ~found).select(*left.columns)
    if how == "inner":
        joined = joined.where(found)
    return joined.select(*left.columns, *[F.col(f"_match.{c}").alias(c) for c in extra])
