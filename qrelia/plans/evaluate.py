"""Evaluating systems on one or several datasets."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import partial, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qrelia.functions.text import max_tokens
from qrelia.operators.bm25 import BM25_DIM, bm25_rank
from qrelia.operators.bm25_store import rank_by_index, stored_index
from qrelia.operators.dense import dense_rank
from qrelia.operators.encode import Encoder, encode_texts
from qrelia.operators.metrics import Cutoffs, run_metrics
from qrelia.sources.retrieval import RetrievalData, RetrievalSpec

Loader = Callable[[RetrievalSpec], RetrievalData]


@dataclass(frozen=True)
class EvalSettings:
    """What to measure, and how texts become vectors."""

    cutoffs: Cutoffs = field(default_factory=Cutoffs)
    truncate_dims: Sequence[int] = ()
    encoder: Callable[[], Encoder] | None = None
    batch_size: int = 128
    max_tokens: int | None = None  # words of a text that are encoded; None: all
    index_dir: str | None = None  # where BM25 indexes are kept for later evaluations; None: nowhere


def bm25_metrics(data: RetrievalData, cutoffs: Cutoffs, index_dir: str | None = None) -> DataFrame:
    """One row: BM25 over the whole corpus, ``truncate_dim`` -1.

    With ``index_dir``, the corpus is indexed there once; later calls read the index only.
    """
    if index_dir:
        index = stored_index(data.corpus, index_dir, data.fingerprint)
        run = rank_by_index(index, data.queries, cutoffs.max_k)
    else:
        run = bm25_rank(data.corpus, data.queries, cutoffs.max_k)
    averaged = run_metrics(run, data.queries, data.qrels, [BM25_DIM], cutoffs, with_precision=False)
    return averaged.withColumn("system", F.lit("bm25")).withColumn("seq", F.lit(0))


def dense_metrics(
    corpus: DataFrame,
    queries: DataFrame,
    qrels: DataFrame,
    cutoffs: Cutoffs,
    dims: Sequence[int],
    computed: bool = False,
) -> DataFrame:
    """One row per truncation dimension of given vectors, in the order of ``dims``."""
    run = dense_rank(corpus, queries, cutoffs.max_k, dims, computed)
    averaged = run_metrics(run, queries, qrels, dims, cutoffs)
    order = F.array_position(F.array(*[F.lit(int(d)) for d in dims]), F.col("truncate_dim"))
    return averaged.withColumn("system", F.lit("cosine")).withColumn("seq", order.cast("int"))


def union_systems(parts: Sequence[DataFrame]) -> DataFrame:
    """Rows of several systems; a metric a system does not have is NULL."""
    return reduce(partial(DataFrame.unionByName, allowMissingColumns=True), parts)


def union_datasets(parts: Sequence[tuple[RetrievalSpec, DataFrame]]) -> DataFrame:
    """Results of several datasets, each under its name and the split it was read from.

    ``place`` is a dataset's number in the list: names may repeat.
    """
    return union_systems(
        [
            df.withColumns({"dataset": F.lit(spec.label), "split": F.lit(spec.split).cast("string"), "place": F.lit(i)})
            for i, (spec, df) in enumerate(parts)
        ]
    )


def evaluate_dense(
    data: RetrievalData,
    settings: EvalSettings,
    batch_size: int | None = None,
    run_bm25: bool = True,
) -> DataFrame:
    """Rank encoded texts at every truncation dimension, with the BM25 row first."""
    if settings.encoder is None:
        raise ValueError("an encoder is needed to rank texts by vectors")

    def encode(texts: DataFrame) -> DataFrame:
        if settings.max_tokens is not None:
            texts = texts.withColumn("text", max_tokens(F.col("text"), settings.max_tokens))
        return encode_texts(
            texts, "text", settings.encoder, batch_size=batch_size or settings.batch_size
        )

    dims = list(settings.truncate_dims)
    if not dims:
        dims = [settings.encoder()([""]).shape[1]]
    dense = dense_metrics(
        encode(data.corpus), encode(data.queries), data.qrels, settings.cutoffs, dims, computed=True
    )
    if not run_bm25:
        return dense
    return union_systems([bm25_metrics(data, settings.cutoffs, settings.index_dir), dense])


def _specs(specs: Sequence[RetrievalSpec], default: RetrievalSpec | None) -> list[RetrievalSpec]:
    specs = list(specs) or ([default] if default else [])
    if not specs:
        raise ValueError("no dataset to evaluate")
    return specs


def evaluate_bm25(
    specs: Sequence[RetrievalSpec],
    load: Loader,
    cutoffs: Cutoffs,
    default: RetrievalSpec | None = None,
    index_dir: str | None = None,
) -> DataFrame:
    """BM25 on every dataset, or on ``default`` if none is listed; one row each."""
    return union_datasets([(s, bm25_metrics(load(s), cutoffs, index_dir)) for s in _specs(specs, default)])


def evaluate_all(
    specs: Sequence[RetrievalSpec],
    load: Loader,
    settings: EvalSettings,
    default: RetrievalSpec | None = None,
    run_bm25: bool = True,
) -> DataFrame:
    """Dense evaluation and BM25 on every dataset, or on ``default`` if none is listed."""
    return union_datasets(
        [
            (s, evaluate_dense(load(s), settings, s.eval_batch_size, run_bm25))
            for s in _specs(specs, default)
        ]
    )
