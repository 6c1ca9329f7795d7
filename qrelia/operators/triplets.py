"""Preparing (query, positive, negative) rows: projections, split, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qrelia.operators.positions import head_by_position
from qrelia.session import durable
from qrelia.sources.tables import POS

_BUCKET_DIGITS = 4  # leading hex digits of a digest: 65,536 even buckets


def triplet_projection(df: DataFrame, hard_negatives: bool = True) -> DataFrame:
    """Query, positive and (with hard negatives) negative, next to ``pos``."""
    names = [POS, "query", "positive"] + (["negative"] if hard_negatives else [])
    return df.select(*names)


def text_columns(df: DataFrame) -> list[str]:
    return [n for n in ("query", "positive", "negative") if n in df.columns]


def texts_array(df: DataFrame) -> Column:
    """``[query, positive(, negative)]`` of a triplet table."""
    return F.array(*text_columns(df))


def validation_head(df: DataFrame, n: int | None) -> DataFrame:
    """The first ``n`` rows by ``pos``, or all if there are no more than that."""
    return head_by_position(df, POS, n)


def evaluator_payload(df: DataFrame, n: int | None = None) -> DataFrame:
    """Anchor, positive, negative of the head; an absent negative is the positive."""
    negative = F.col("negative") if "negative" in df.columns else F.lit(None).cast("string")
    return validation_head(df, n).select(
        POS,
        F.col("query").alias("anchor"),
        "positive",
        F.coalesce(negative, "positive").alias("negative"),
    )


def sentence_columns(
    df: DataFrame, texts: str = "texts", label: str | None = None, n: int | None = None
) -> DataFrame:
    """Spread a text array over ``sentence_0..``; keep labels only if some are not 0.

    The number of columns is ``n``, or else the array size in the first row.
    """
    if n is None:
        first = df.select(F.size(texts)).first()
        n = first[0] if first else 0
    columns = [F.get(texts, F.lit(i)).alias(f"sentence_{i}") for i in range(n)]
    others = [c for c in df.columns if c not in (texts, label)]
    if label is not None and not df.where(F.col(label) != 0).isEmpty():
        columns.append(F.col(label).alias("label"))
    return df.select(*others, *columns)


def _draw(seed: int) -> Column:
    """Repeatable draw of a query; all rows of a query draw the same."""
    return F.md5(F.concat(F.lit(f"{seed}|"), F.col("query")))


def split_by_query(df: DataFrame, validation_size: float, seed: int) -> DataFrame:
    """Add ``split``: the first ``max(1, floor(queries * size))`` draws are validation.

    Only the digests of distinct queries are grouped, to find the draw at which
    validation ends; the rows themselves are then split by comparing with it,
    without a join or a shuffle.
    """
    if validation_size <= 0:
        return df.withColumn("split", F.lit("train"))
    draws = durable(df.select(_draw(seed).alias("draw")).distinct())
    bucket = F.substring("draw", 1, _BUCKET_DIGITS)
    upto = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counts = draws.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    counts = counts.withColumn("upto", F.sum("n").over(upto))  # one row per bucket

    total = draws.count()
    wanted = min(total, max(1, int(total * validation_size)))
    edge = counts.where(F.col("upto") >= wanted).orderBy("bucket").first()
    if edge is None:
        return df.withColumn("split", F.lit("train"))
    nth = wanted - (edge["upto"] - edge["n"])
    last = draws.where(bucket == edge["bucket"]).orderBy("draw").offset(nth - 1).first()["draw"]
    held_out = _draw(seed) <= F.lit(last)
    return df.withColumn("split", F.when(held_out, "validation").otherwise("train"))


def split_counts(df: DataFrame) -> DataFrame:
    """Rows loaded, and rows of each split."""
    counted = df.rollup("split").agg(F.count(F.lit(1)).alias("n_rows"))
    return counted.select(F.coalesce("split", F.lit("loaded")).alias("split"), "n_rows")
