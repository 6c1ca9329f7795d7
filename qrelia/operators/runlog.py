"""Early stopping and best step over metric logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from qrelia.operators.positions import with_row_position

CHUNK_ROWS = 65_536


def evaluations(
    log: DataFrame, greater_is_better: bool = False, chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """Each usable evaluation with ``improved``, ``wait`` and the best one so far.

    ``log(run_id, step, value)``; NULL and NaN values are skipped. A run is cut
    into chunks of bounded length: windows run inside chunks, and one row per
    chunk carries the best value on to the next, so a long run is not one task.
    """
    usable = log.select("run_id", "step", "value").where("value IS NOT NULL AND NOT isnan(value)")
    rows = with_row_position(usable, ["run_id", "step"], "_p")
    cost = -F.col("value") if greater_is_better else F.col("value")
    rows = rows.withColumn("_v", cost).withColumn("_c", F.floor(F.col("_p") / chunk_rows))

    in_chunk = Window.partitionBy("run_id", "_c").orderBy("_p")
    before = in_chunk.rowsBetween(Window.unboundedPreceding, -1)
    upto = in_chunk.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = (
        Window.partitionBy("run_id").orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    )

    chunk_best = rows.groupBy("run_id", "_c").agg(F.min("_v").alias("_m"))
    carried = chunk_best.select("run_id", "_c", F.min("_m").over(earlier).alias("_carry"))
    best_before = F.least("_carry", F.min("_v").over(before))  # least() skips NULL
    marked = (
        rows.join(carried, ["run_id", "_c"])
        .withColumn("_best", best_before)
        .withColumn("improved", F.col("_best").isNull() | (F.col("_v") < F.col("_best")))
    )

    # The latest improvement is the best evaluation so far.
    this = F.when(F.col("improved"), F.struct("_p", "step", "value"))
    last_in_chunk = marked.groupBy("run_id", "_c").agg(F.max(this).alias("_l"))
    carried = last_in_chunk.select("run_id", "_c", F.max("_l").over(earlier).alias("_last"))
    best = F.coalesce(F.max(this).over(upto), F.col("_last"))
    return (
        marked.join(carried, ["run_id", "_c"])
        .withColumn("best", best)
        .withColumn("wait", F.col("_p") - F.col("best._p"))
        .select("run_id", "step", "value", "improved", "wait", "best", "_p")
    )


def stop_and_best(log: DataFrame, patience: int, greater_is_better: bool = False) -> DataFrame:
    """Per run: ``stop_step`` (NULL if it never stops) and the best step up to there."""
    late = F.col("wait") >= patience
    per_run = evaluations(log, greater_is_better).groupBy("run_id").agg(
        F.min(F.when(late, F.struct("_p", "step", "best"))).alias("stop"),
        F.max("best").alias("last"),
    )
    best = F.coalesce("stop.best", "last")
    return per_run.select(
        "run_id",
        F.col("stop.step").alias("stop_step"),
        best["step"].alias("best_step"),
        best["value"].alias("best_value"),
    )


def early_stop(log: DataFrame, patience: int, greater_is_better: bool = False) -> DataFrame:
    """First step of each run at which ``patience`` evaluations brought no improvement."""
    return stop_and_best(log, patience, greater_is_better).select("run_id", "stop_step")


def best_step(log: DataFrame, patience: int, greater_is_better: bool = False) -> DataFrame:
    """Best evaluation of each run up to its stop step; the earliest of equal ones."""
    return stop_and_best(log, patience, greater_is_better).select("run_id", "best_step", "best_value")
