"""Writing results: JSON, Markdown tables, a report, and a metric log.

Input is the results table of ``qrelia.plans.evaluate``: one row per dataset and
system with columns dataset, split, seq, system, truncate_dim and one column per
metric. It has a handful of rows per dataset.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from qrelia.operators.metrics import Cutoffs, metric_columns
from qrelia.session import durable

# Heading of each metric in the Markdown table, in table order.
HEADINGS = {
    "accuracy": "Accuracy",
    "ndcg": "NDCG",
    "mrr": "MRR",
    "recall": "Recall",
    "map": "MAP",
}

SYSTEMS = ("bm25", "cosine")


def safe_name(name: Column) -> Column:
    """Dataset name as a folder name."""
    return F.regexp_replace(name, "/", "_")


# --- JSON ------------------------------------------------------------------------


def _result_struct(df: DataFrame, cutoffs: Cutoffs) -> Column:
    """truncate_dim and ``{system}_{metric}@{k}``; fields of the other system are NULL."""
    fields = [F.col("truncate_dim")]
    for system in SYSTEMS:
        for name in metric_columns(cutoffs, with_precision=system != "bm25"):
            if name not in df.columns:
                continue
            label = f"{system}_{'@'.join(name.rsplit('_', 1))}"
            fields.append(F.when(F.col("system") == system, F.col(name)).alias(label))
    return F.struct(*fields)


def results_by_dataset(results: DataFrame, cutoffs: Cutoffs, model_path: str) -> DataFrame:
    """One row per dataset with its results as an ordered array."""
    if "place" not in results.columns:
        results = results.withColumn("place", F.lit(0))
    numbered = results.withColumn("_row", F.struct("seq", _result_struct(results, cutoffs).alias("r")))
    return numbered.groupBy("place", "dataset", "split").agg(
        F.transform(F.sort_array(F.collect_list("_row")), lambda x: x["r"]).alias("results")
    ).select(
        F.lit(model_path).alias("model_path"),
        "dataset",
        F.col("split").alias("eval_split"),
        "results",
        "place",
    )


def write_results_json(results: DataFrame, path: str, cutoffs: Cutoffs, model_path: str) -> None:
    """``path/datasets/folder=<name>/`` per dataset, ``path/combined/`` with all of them in the order of the list."""
    each = results_by_dataset(results, cutoffs, model_path)
    each.drop("place").withColumn("folder", safe_name(F.col("dataset"))).write.mode("overwrite").partitionBy(
        "folder"
    ).json(f"{path}/datasets")
    each.groupBy("model_path").agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("place", "dataset", "results"))),
            lambda x: F.struct(x["dataset"].alias("dataset"), x["results"].alias("results")),
        ).alias("datasets")
    ).coalesce(1).write.mode("overwrite").json(f"{path}/combined")


@F.pandas_udf(StringType())
def six_decimals(values: pd.Series) -> pd.Series:
    """The exact number rounded to six decimals, ties to even; the tables have a few rows."""
    return values.map(lambda x: None if pd.isna(x) else "%.6f" % x)


# --- Markdown ----------------------------------------------------------------------


def _table_metrics(cutoffs: Cutoffs) -> list[tuple[str, str]]:
    """(heading, metric column) of the table; recall cutoffs in ascending order."""
    ordered = Cutoffs(cutoffs.top_k, sorted(cutoffs.recalls), cutoffs.map_at_k)
    out = []
    for name in metric_columns(ordered, with_precision=False):
        kind, k = name.rsplit("_", 1)
        out.append((f"{HEADINGS[kind]}@{k}", name))
    return out


def results_markdown(results: DataFrame, cutoffs: Cutoffs) -> DataFrame:
    """Lines of one table per dataset: ``(dataset, line_no, line)``."""
    metrics = _table_metrics(cutoffs)
    heads = ["method", *[h for h, _ in metrics]]
    fixed = ["| " + " | ".join(heads) + " |", "|" + "|".join("---" for _ in heads) + "|"]
    cells = [
        six_decimals(F.coalesce(F.col(c).cast("double"), F.lit(0.0)))
        if c in results.columns
        else F.lit("0.000000")
        for _, c in metrics
    ]
    method = F.when(F.col("system") == "bm25", "BM25").otherwise(F.col("truncate_dim").cast("string"))
    row = F.concat(F.lit("| "), F.concat_ws(" | ", method, *cells), F.lit(" |"))
    body = results.select("dataset", (F.col("seq") + len(fixed)).cast("int").alias("line_no"), row.alias("line"))
    lines = F.array(*[F.lit(x) for x in fixed])
    head = results.select("dataset").distinct().select("dataset", F.posexplode(lines).alias("line_no", "line"))
    return head.unionByName(body)


def results_card(
    results: DataFrame,
    cutoffs: Cutoffs,
    title: str,
    dims: Sequence[int],
    datasets: Sequence[str],
    intro: str = "Retrieval evaluation.",
) -> DataFrame:
    """Lines of a report over several datasets: ``(section, line_no, line)``."""
    spark = results.sparkSession
    order = {name: i + 1 for i, name in enumerate(datasets)}
    opening = [f"# {title}", "", intro, "", "## Evaluation", "", f"- Truncate dims: `{list(dims)}`", ""]
    rows = [(0, i, text) for i, text in enumerate(opening)]
    rows += [(n, i - 2, text) for name, n in order.items() for i, text in enumerate((f"### {name}", ""))]
    frame = spark.createDataFrame(rows, "section int, line_no int, line string")
    number = F.create_map(*[F.lit(x) for pair in order.items() for x in pair])
    table = results_markdown(results, cutoffs).select(
        number[F.col("dataset")].alias("section"), "line_no", "line"
    )
    last = table.groupBy("section").agg((F.max("line_no") + 1).alias("line_no"))
    gap = last.withColumn("line", F.lit(""))
    return frame.unionByName(table).unionByName(gap)


def write_lines(lines: DataFrame, path: str, order_by: Sequence[str], column: str = "line") -> None:
    """Write a few ordered lines as one text file."""
    lines.orderBy(*order_by).select(column).coalesce(1).write.mode("overwrite").text(path)


def write_results_markdown(results: DataFrame, path: str, cutoffs: Cutoffs) -> None:
    """``path/folder=<name>/`` with the table of each dataset."""
    lines = results_markdown(results, cutoffs).withColumn("folder", safe_name(F.col("dataset")))
    ordered = lines.repartition("folder").sortWithinPartitions("folder", "line_no")
    ordered.select("folder", "line").write.mode("overwrite").partitionBy("folder").text(path)


def write_artifacts(
    results: DataFrame,
    path: str,
    cutoffs: Cutoffs,
    model_path: str,
    dims: Sequence[int],
    datasets: Sequence[str],
) -> None:
    """JSON and Markdown per dataset, combined JSON, and the report of a model."""
    results = durable(results)
    write_results_json(results, path, cutoffs, model_path)
    write_results_markdown(results, f"{path}/tables", cutoffs)
    title = model_path.rstrip("/").rsplit("/", 1)[-1]
    card = results_card(results, cutoffs, title, dims, datasets)
    write_lines(card, f"{path}/card", ["section", "line_no"])


# --- metric log ----------------------------------------------------------------------

METRIC_LOG_SCHEMA = "epoch double, steps long, validation_loss string"


def append_metric_log(rows: DataFrame, path: str, metric: str = "validation_loss") -> None:
    """Append (epoch, steps, metric with 6 decimals) to a CSV log; each file has its header."""
    rows.select(
        "epoch", "steps", six_decimals(F.col(metric).cast("double")).alias(metric)
    ).write.mode("append").option("header", True).csv(path)
