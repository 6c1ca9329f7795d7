"""Ranked lists: top-k per query, relevance join, cumulative hits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Scores are compared at this many digits, so that the order in which a sum was
# added up never decides a rank; equal scores are ordered by document id.
SCORE_DIGITS = 9

_SALTS = 64


def rank_topk(
    scores: DataFrame,
    k: int,
    by: Sequence[str] = ("query_id",),
    score: str = "score",
    doc_id: str = "doc_id",
    two_levels: bool = False,
) -> DataFrame:
    """The best ``k`` rows per query with a 1-based ``rank``.

    Two levels: salted by document, then per query, so that one query's candidates from very many
    tasks do not meet in one. Spark cuts each input partition to k rows before either
    shuffle up to a configured k.
    """
    order = [F.round(F.col(score), SCORE_DIGITS).desc(), F.col(doc_id)]
    spark = scores.sparkSession
    pre_cut = int(spark.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000"))
    if k > pre_cut or two_levels:
        salt = F.pmod(F.xxhash64(doc_id), F.lit(_SALTS))
        salted = Window.partitionBy(*by, salt).orderBy(*order)
        scores = scores.withColumn("_r", F.row_number().over(salted)).where(F.col("_r") <= k)
        scores = scores.drop("_r")
    best = Window.partitionBy(*by).orderBy(*order)
    return scores.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def join_run_qrels(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """Add ``rel`` (1 = judged relevant, else 0) to every ranked row."""
    relevant = qrels.where("score > 0").select("query_id", "doc_id", F.lit(1).alias("rel"))
    joined = run.join(relevant, ["query_id", "doc_id"], "left")
    return joined.withColumn("rel", F.coalesce("rel", F.lit(0)))


def cumulative_hits(judged_run: DataFrame, by: Sequence[str] = ("query_id",)) -> DataFrame:
    """Running number of relevant rows by rank (a list is at most k rows long)."""
    upto = (
        Window.partitionBy(*by)
        .orderBy("rank")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return judged_run.withColumn("hits", F.sum("rel").over(upto))
