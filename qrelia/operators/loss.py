"""Mean in-batch ranking loss over given vectors."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qrelia.operators.dense import to_matrix, unit_rows, vector_length
from qrelia.operators.positions import with_row_position

SCALE = 20.0  # fixed value: factor on the cosine similarity

_ROWS_PER_TASK_GROUP = 4_096


def batch_loss(anchor: np.ndarray, candidates: np.ndarray) -> float:
    """Mean cross-entropy of picking candidate i for anchor i within one batch."""
    scores = SCALE * (unit_rows(anchor) @ unit_rows(candidates).T)
    top = scores.max(axis=1, keepdims=True)
    log_sum = top[:, 0] + np.log(np.exp(scores - top).sum(axis=1))
    return float((log_sum - np.diagonal(scores)).mean())


def batch_losses(
    triplets: DataFrame, batch_size: int, dims: Sequence[int] | None = None, numbered: bool = False
) -> DataFrame:
    """``(truncate_dim, batch_id, loss)`` of consecutive batches in ``pos`` order.

    Columns: pos, anchor, positive and optionally negative vectors. Rows are
    grouped by runs of whole batches, so a group has a fixed size and one call
    serves many batches. ``numbered`` says that ``pos`` counts the rows from 0, which saves
    sorting the vectors.
    """
    names = [c for c in ("anchor", "positive", "negative") if c in triplets.columns]
    dims = list(dims or ()) or [vector_length(triplets.select(F.col("anchor").alias("vector")))]
    per_group = max(1, _ROWS_PER_TASK_GROUP // batch_size) * batch_size
    rows = triplets.select("pos", *names)
    counted = rows.withColumnRenamed("pos", "_p") if numbered else with_row_position(rows, ["pos"], "_p").drop("pos")

    def losses(table: pa.Table) -> pa.Table:
        table = table.sort_by("_p")
        at = table.column("_p").to_numpy()
        vectors = [to_matrix(table.column(c)) for c in names]
        out = []
        for start in range(0, len(at), batch_size):
            rows = slice(start, start + batch_size)
            for d in dims:
                cut = [v[rows, :d] for v in vectors]
                out.append((d, int(at[start]) // batch_size, batch_loss(cut[0], np.concatenate(cut[1:]))))
        d, b, x = zip(*out)
        return pa.table(
            {"truncate_dim": pa.array(d, pa.int32()), "batch_id": pa.array(b, pa.int64()), "loss": x}
        )

    group = F.floor(F.col("_p") / per_group).alias("_group")
    keyed = counted.withColumn("_group", group)
    return keyed.groupBy("_group").applyInArrow(
        losses, "truncate_dim int, batch_id long, loss double"
    )


def in_batch_loss(
    triplets: DataFrame, batch_size: int, dims: Sequence[int] | None = None, numbered: bool = False
) -> DataFrame:
    """One row ``(n_batches, loss)``: mean over batches of the loss summed over dims."""
    per_batch = (
        batch_losses(triplets, batch_size, dims, numbered)
        .groupBy("batch_id")
        .agg(F.sum("loss").alias("loss"))
    )
    return per_batch.agg(
        F.count(F.lit(1)).alias("n_batches"), F.coalesce(F.avg("loss"), F.lit(0.0)).alias("loss")
    )
