"""Retrieval metrics at cutoffs, per query and averaged over queries."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RECALL_DEFAULT = (5, 10, 100)


@dataclass(frozen=True)
class Cutoffs:
    """Ranks at which metrics are taken."""

    top_k: Sequence[int] = (1, 3, 5, 10)
    recall_at_k: Sequence[int] = RECALL_DEFAULT
    map_at_k: int = 100
    recalls: Sequence[int] = field(init=False)

    def __post_init__(self):
        object.__setattr__(self, "recalls", tuple(self.recall_at_k) or RECALL_DEFAULT)

    @property
    def max_k(self) -> int:
        return max(max(self.top_k), self.map_at_k, *self.recalls)


# Each metric is an expression over two columns of a per-query row: ``hits``, the
# ascending ranks at which relevant documents were found, and ``n_rel``, the
# number of relevant documents.


def accuracy_at_k(k: int) -> Column:
    return F.expr(f"double(exists(hits, r -> r <= {k}))")


def precision_at_k(k: int) -> Column:
    """Hits over k, also when the ranked list is shorter than k."""
    return F.expr(f"size(filter(hits, r -> r <= {k})) / double({k})")


def recall_at_k(k: int) -> Column:
    return F.expr(f"size(filter(hits, r -> r <= {k})) / double(greatest(n_rel, 1))")


def mrr_at_k(k: int) -> Column:
    return F.expr(f"if(get(hits, 0) <= {k}, 1D / get(hits, 0), 0D)")


def ndcg_at_k(k: int) -> Column:
    gain = f"aggregate(filter(hits, r -> r <= {k}), 0D, (acc, r) -> acc + 1D / log2(r + 1D))"
    ideal = f"aggregate(sequence(1, int(least(n_rel, {k}))), 0D, (acc, r) -> acc + 1D / log2(r + 1D))"
    return F.expr(f"if(n_rel > 0, {gain} / {ideal}, 0D)")


def map_at_k(k: int) -> Column:
    precisions = f"transform(filter(hits, r -> r <= {k}), (r, i) -> (i + 1D) / r)"
    total = f"aggregate({precisions}, 0D, (acc, p) -> acc + p)"
    return F.expr(f"if(n_rel > 0, {total} / least(n_rel, {k}), 0D)")


def metric_columns(cutoffs: Cutoffs, with_precision: bool = True) -> dict[str, Column]:
    """Metric name to expression, in report order; nDCG and MRR are not taken at 1."""
    beyond_first = [k for k in cutoffs.top_k if k != 1]
    out = {f"accuracy_{k}": accuracy_at_k(k) for k in cutoffs.top_k}
    if with_precision:
        out |= {f"precision_{k}": precision_at_k(k) for k in cutoffs.top_k}
    out |= {f"ndcg_{k}": ndcg_at_k(k) for k in beyond_first}
    out |= {f"mrr_{k}": mrr_at_k(k) for k in beyond_first}
    out |= {f"recall_{k}": recall_at_k(k) for k in cutoffs.recalls}
    out[f"map_{cutoffs.map_at_k}"] = map_at_k(cutoffs.map_at_k)
    return out


def query_hits(
    run: DataFrame, queries: DataFrame, qrels: DataFrame, dims: Sequence[int]
) -> DataFrame:
    """One row per (truncate_dim, query): ``hits`` and ``n_rel``.

    Every query appears, also one without any ranked or relevant document. The
    hit list of a query is no longer than its ranked list.
    """
    relevant = qrels.where("score > 0").select("query_id", "doc_id")
    n_rel = relevant.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_rel"))
    found = (
        run.join(relevant, ["query_id", "doc_id"])
        .groupBy("truncate_dim", "query_id")
        .agg(F.sort_array(F.collect_list("rank")).alias("hits"))
    )
    every = queries.select(
        "query_id", F.explode(F.array(*[F.lit(int(d)) for d in dims])).alias("truncate_dim")
    )
    none = F.array().cast("array<int>")
    return (
        every.join(found, ["truncate_dim", "query_id"], "left")
        .join(n_rel, "query_id", "left")
        .select(
            "truncate_dim",
            "query_id",
            F.coalesce("hits", none).alias("hits"),
            F.coalesce("n_rel", F.lit(0)).alias("n_rel"),
        )
    )


def query_metrics(
    hits: DataFrame, cutoffs: Cutoffs, with_precision: bool = True
) -> DataFrame:
    """Metrics of each query as columns."""
    metrics = metric_columns(cutoffs, with_precision)
    return hits.select("truncate_dim", "query_id", *[c.alias(n) for n, c in metrics.items()])


def macro_average(per_query: DataFrame, by: Sequence[str] = ("truncate_dim",)) -> DataFrame:
    """Plain mean of every metric over all queries."""
    metrics = [c for c in per_query.columns if c not in (*by, "query_id")]
    return per_query.groupBy(*by).agg(*[F.avg(c).alias(c) for c in metrics])


def run_metrics(
    run: DataFrame,
    queries: DataFrame,
    qrels: DataFrame,
    dims: Sequence[int],
    cutoffs: Cutoffs,
    with_precision: bool = True,
) -> DataFrame:
    """One averaged row per truncation dimension of a run."""
    hits = query_hits(run, queries, qrels, dims)
    return macro_average(query_metrics(hits, cutoffs, with_precision))
