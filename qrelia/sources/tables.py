"""Reading tables with an explicit row order, and resolving column names."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qrelia.functions.text import normalize_text
from qrelia.session import spread

POS = "pos"

# Column names tried, in this order, when the named one is absent.
ID_ALIASES = ["_id", "id", "query_id", "qid", "corpus_id"]
TEXT_ALIASES = ["text", "question", "query", "sentence"]
QREL_QUERY_ALIASES = ["query-id", "query_id", "qid", "q_id"]
QREL_DOC_ALIASES = ["corpus-id", "corpus_id", "doc_id", "did", "document_id"]
SCORE_ALIASES = ["score", "relevance", "label"]


def resolve_col(columns: Sequence[str], preferred: str, aliases: Sequence[str], what: str) -> str:
    """``preferred`` if present, else the first alias present, else KeyError."""
    tried = [preferred, *aliases]
    for name in tried:
        if name in columns:
            return name
    raise KeyError(f"no column for {what}: tried {tried}, the table has {list(columns)}")


def with_order(df: DataFrame, order_by: Sequence[str] | None) -> DataFrame:
    """Add ``pos``: the caller's order columns, which must identify a row."""
    if not order_by:
        raise ValueError("order_by is needed: a Spark table has no row order of its own")
    if len(order_by) == 1:
        return df.withColumn(POS, F.col(order_by[0]))
    return df.withColumn(POS, F.struct(*order_by))


def read_table(
    spark: SparkSession,
    path: str | Sequence[str],
    fmt: str = "parquet",
    order_by: Sequence[str] | None = None,
    schema: str | None = None,
) -> DataFrame:
    """Read Parquet, JSON lines or CSV with a ``pos`` column giving row order.

    Without ``order_by``, Parquet rows are ordered by file and row number.
    JSON and CSV have no row number, so they need ``order_by``.
    """
    reader = spark.read.schema(schema) if schema else spark.read
    if fmt == "csv":
        reader = reader.option("header", True).option("multiLine", True).option("escape", '"')
    df = reader.format(fmt).load(path if isinstance(path, str) else list(path))
    if order_by:
        return spread(with_order(df, order_by), POS)
    if fmt != "parquet":
        raise ValueError(f"order_by is needed for {fmt}")
    row = F.struct(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")
    )
    return spread(df.select("*", row.alias(POS)), POS)


def trim_triplets(df: DataFrame, hard_negatives: bool = True) -> DataFrame:
    """Normalised query, positive and (with hard negatives) negative, plus ``pos``."""
    names = ["query", "positive"] + (["negative"] if hard_negatives else [])
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise KeyError(f"triplet columns missing: {missing}")
    trimmed = df.select(POS, *[normalize_text(F.col(n)).alias(n) for n in names])
    return trimmed.where("query IS NOT NULL")


def union_sources(parts: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """All rows of all parts in order; ``pos`` becomes (part number, own position)."""
    tagged = [
        df.withColumn("source", F.lit(name)).withColumn(
            POS, F.struct(F.lit(i).alias("part"), F.col(POS).alias("at"))
        )
        for i, (name, df) in enumerate(parts)
    ]
    return reduce(DataFrame.unionByName, tagged)


def load_triplets(
    spark: SparkSession,
    paths: str | Sequence[str],
    fmt: str = "parquet",
    hard_negatives: bool = True,
    order_by: Sequence[str] | None = None,
    split: str | None = None,
    config: str | None = None,
) -> DataFrame:
    """One or several triplet datasets as ``(pos, query, positive[, negative], source)``.

    A path is a table; with ``split`` it is a dataset with named splits (see ``splits``).
    """
    from qrelia.sources.splits import read_split

    def read(path: str) -> DataFrame:
        if split is None:
            return read_table(spark, path, fmt, order_by)
        return read_split(spark, path, config, split, fmt, "triplets", order_by)

    paths = [paths] if isinstance(paths, str) else list(paths)
    return union_sources([(p, trim_triplets(read(p), hard_negatives)) for p in paths])
