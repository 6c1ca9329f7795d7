"""From triplet rows to training and validation tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qrelia.operators.batching import no_duplicate_batches
from qrelia.operators.positions import with_row_position
from qrelia.operators.triplets import (
    sentence_columns,
    split_by_query,
    text_columns,
    texts_array,
    validation_head,
)
from qrelia.session import durable
from qrelia.sources.tables import POS


@dataclass(frozen=True)
class PrepareSettings:
    validation_size: float = 0.05
    validation_subset: int | None = None
    batch_size: int = 32
    seed: int = 42


@dataclass
class Prepared:
    """train(batch_id, pos, sentence_*) without repeats in a batch; validation(pos, sentence_*).

    ``batches(row_id, batch_id)`` also has the training rows that fit into no batch, with a NULL batch.
    """

    rows: DataFrame
    train: DataFrame
    validation: DataFrame
    batches: DataFrame


def prepare_training(triplets: DataFrame, settings: PrepareSettings) -> Prepared:
    """Split by query, cut the validation head, and batch the training rows.

    ``triplets`` are normalised rows with a unique ``pos`` of any type.
    """
    if dict(triplets.dtypes)[POS] not in ("int", "bigint"):
        numbered = with_row_position(triplets.withColumnRenamed(POS, "_at"), ["_at"], POS)
        triplets = numbered.drop("_at")
    rows = split_by_query(triplets, settings.validation_size, settings.seed)
    train = rows.where("split = 'train'")
    batches = durable(
        no_duplicate_batches(
            train, texts_array(train), settings.batch_size, POS, seed=settings.seed
        )
    )
    in_batch = batches.where("batch_id IS NOT NULL").withColumnRenamed("row_id", POS)
    packed = train.select(POS, texts_array(train).alias("texts")).join(in_batch, POS)
    held_out = validation_head(rows.where("split = 'validation'"), settings.validation_subset)
    n = len(text_columns(rows))
    return Prepared(
        rows,
        sentence_columns(packed, n=n),
        sentence_columns(held_out.select(POS, texts_array(held_out).alias("texts")), n=n),
        batches,
    )


def write_prepared(prepared: Prepared, path: str) -> None:
    prepared.train.write.mode("overwrite").parquet(f"{path}/train")
    prepared.validation.write.mode("overwrite").parquet(f"{path}/validation")
