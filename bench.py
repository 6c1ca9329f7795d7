"""Time the headline queries and print one JSON line.

Each query is timed once. Before that, every query runs once on the smallest data
next to ``BENCH_SF_DIR``, so that no query pays for starting the JVM, its compiler
and the Python workers. ``BENCH_CPUS`` chooses the cores.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import functions as F

from checks import tables as t
from checks.queries import QUERIES
from qrelia.operators import bm25, dense
from qrelia.session import local_session


def bm25_top100(spark, d):
    """Passages against all documents: no loading rules, just the ranking."""
    corpus = t.table(spark, d, "documents").select(F.col("doc_id").cast("string"), "text")
    queries = t.table(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("query_id"), "text")
    return bm25.bm25_rank(corpus, queries, 100)


def dense_top100(spark, d):
    data = t.label_retrieval(spark, d)
    return dense.dense_rank(data.corpus, data.queries, 100)


HEADLINE = {
    "bm25_top100": bm25_top100,
    "dense_top100": dense_top100,
    **{
        name: QUERIES[name]
        for name in (
            "load_beir",
            "load_squad",
            "matryoshka_sweep",
            "macro_average",
            "evaluate_bm25",
            "evaluate_dense",
            "encode_texts",
            "split_by_query",
            "no_duplicate_batches",
            "in_batch_loss",
            "pool_vectors",
            "rank_topk",
            "early_stop",
        )
    },
}


def main() -> None:
    d = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")))
    spark.sparkContext.setLogLevel("ERROR")
    small = os.path.join(os.path.dirname(d.rstrip("/")), "sf0.001")
    for query in HEADLINE.values():
        query(spark, small if os.path.isdir(small) else d).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name, query in HEADLINE.items():
        began = time.perf_counter()
        query(spark, d).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - began, 3)
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(d.rstrip("/")).removeprefix("sf"),
            }
        ),
        flush=True,
    )
    spark.stop()


if __name__ == "__main__":
    main()
