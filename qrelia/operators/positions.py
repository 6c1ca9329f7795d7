"""Global row numbers and first-N cutoffs without a single-task window."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qrelia.session import durable

HEAP_ROWS = 100_000  # largest N kept in a per-task heap

_ROW_BITS = 33  # monotonically_increasing_id keeps the row in its low 33 bits


def with_row_position(df: DataFrame, order_by: list[str], name: str) -> DataFrame:
    """Add a dense 0-based row number in the order of ``order_by`` (unique keys).

    Rows are range-partitioned and sorted in parallel; only one row count per
    partition is accumulated to get each partition's offset. The sorted rows are
    written first, because counting and numbering must see the same boundaries.
    """
    ordered = durable(
        df.repartitionByRange(*order_by)
        .sortWithinPartitions(*order_by)
        .withColumn("_mid", F.monotonically_increasing_id())
    )
    part = F.shiftrightunsigned("_mid", _ROW_BITS).cast("int")
    counts = ordered.groupBy(part.alias("part")).count().collect()  # one row per partition
    rows = dict(counts)
    offsets, total = [], 0
    for i in range(max(rows, default=0) + 1):
        offsets.append(total)
        total += rows.get(i, 0)
    offset = F.get(F.from_json(F.lit(json.dumps(offsets)), "array<bigint>"), part)
    row_in_part = F.col("_mid").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return ordered.withColumn(name, offset + row_in_part).drop("_mid")


def nth_position(df: DataFrame, pos: str, n: int):
    """The ``n``-th smallest value of ``pos`` (1-based), or None if there are fewer rows.

    Only the key column is sorted, so texts never travel for a limit, and a
    large ``n`` is found by row number instead of in one task's heap.
    """
    keys = df.select(pos)
    if n <= HEAP_ROWS:
        row = keys.orderBy(pos).offset(n - 1).limit(1).collect()
    else:
        row = with_row_position(keys, [pos], "_i").where(F.col("_i") == n - 1).collect()
    return row[0][0] if row else None


def at_most(pos: Column, bound) -> Column:
    """``pos <= bound`` for scalar or struct (file, row) positions."""
    if isinstance(bound, tuple):
        fields = bound.__fields__
        return pos <= F.struct(*[F.lit(v).alias(f) for f, v in zip(fields, bound)])
    return pos <= F.lit(bound)


def head_by_position(df: DataFrame, pos: str, n: int | None) -> DataFrame:
    """The first ``n`` rows in the order of the unique column ``pos``; None keeps all."""
    if n is None:
        return df
    if n <= 0:
        return df.limit(0)
    bound = nth_position(df, pos, n)
    return df if bound is None else df.where(at_most(F.col(pos), bound))
