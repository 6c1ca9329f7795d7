"""Validation loss of held-out texts, from the texts to the stop and the best step of a run."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qrelia.functions.text import max_tokens
from qrelia.operators.encode import Encoder, encode_texts
from qrelia.operators.loss import in_batch_loss
from qrelia.operators.positions import with_row_position
from qrelia.operators.runlog import stop_and_best
from qrelia.sources.metric_log import append_metrics, read_metrics

_SIDES = ("anchor", "positive", "negative")


@dataclass(frozen=True)
class Checkpoint:
    """A model at one point of its training, as a factory of its encoder."""

    epoch: float
    steps: int
    encoder: Callable[[], Encoder]


@dataclass(frozen=True)
class LossSettings:
    batch_size: int = 32
    dims: Sequence[int] = ()  # the loss is summed over these truncations; none: the full vector
    encode_batch: int = 128
    max_tokens: int | None = None


def numbered(held_out: DataFrame) -> DataFrame:
    """``held_out`` with ``row``, its place by ``pos``; done once, it serves all checkpoints."""
    return held_out if "row" in held_out.columns else with_row_position(held_out, ["pos"], "row")


def encoded_triplets(held_out: DataFrame, encoder: Callable[[], Encoder], settings: LossSettings) -> DataFrame:
    """(pos, anchor, positive[, negative]) vectors of ``held_out(row, sentence_0, sentence_1[, sentence_2])``."""
    names = [f"sentence_{i}" for i in range(len(_SIDES)) if f"sentence_{i}" in held_out.columns]
    rows = held_out.select(F.col("row").alias("pos"), *names)
    for side, name in zip(_SIDES, names):
        text = F.col(name) if settings.max_tokens is None else max_tokens(F.col(name), settings.max_tokens)
        rows = encode_texts(rows, text, encoder, settings.encode_batch).withColumnRenamed("vector", side).drop(name)
    return rows


def validation_loss(held_out: DataFrame, encoder: Callable[[], Encoder], settings: LossSettings) -> DataFrame:
    """One row (n_batches, loss) of the validation rows of ``prepare_training``."""
    dims = list(settings.dims) or [encoder()([""]).shape[1]]
    vectors = encoded_triplets(numbered(held_out), encoder, settings)
    return in_batch_loss(vectors, settings.batch_size, dims, numbered=True)


def log_checkpoint(held_out: DataFrame, run_id: str, checkpoint: Checkpoint, path: str, settings: LossSettings, number: int | None = None) -> int:
    """Append the loss of one checkpoint to the log below ``path``; see ``append_metrics`` for ``number``."""
    loss = validation_loss(held_out, checkpoint.encoder, settings)
    at = [F.lit(run_id).alias("run_id"), F.lit(float(checkpoint.epoch)).alias("epoch"), F.lit(checkpoint.steps).cast("long").alias("steps")]
    return append_metrics(loss.select(*at, F.col("loss").alias("value")), path, number)


def log_run(held_out: DataFrame, run_id: str, checkpoints: Sequence[Checkpoint], path: str, settings: LossSettings) -> None:
    """Append all checkpoints of a run, one by one as a training would."""
    held_out = numbered(held_out)
    for checkpoint in checkpoints:
        log_checkpoint(held_out, run_id, checkpoint, path, settings)


def judge_runs(spark: SparkSession, path: str, patience: int) -> DataFrame:
    """(run_id, stop_step, best_step, best_value) of every run in the log; a smaller loss is better."""
    return stop_and_best(read_metrics(spark, path), patience)
