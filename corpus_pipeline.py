"""From raw documents to packed training sequences, in five stages.

Every stage takes ``(spark, docs, sf_dir)`` and works on all rows that the stage before kept; all but the
last return the columns of ``documents``. Null ids, null texts and repeated rows are treated as the stages'
operators say: repeated rows fall to one in the second stage, a null text is written back as an empty one by the third.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qrelia.llm.decontamination import decontaminate
from qrelia.llm.order_minhash import drop_near_duplicates
from qrelia.llm.packing import pack_documents
from qrelia.llm.quality_classifier import classify
from qrelia.llm.suffix_dedup import suffix_dedup
from qrelia.llm.tables import table
from qrelia.session import durable, ship_package

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
BATCH_ROWS = 1_000


def _prepare(spark: SparkSession) -> None:
    """Ship the package, and keep Arrow batches small: workers that are used again keep the memory of their largest."""
    ship_package(spark)
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(rows))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(rows, str(BATCH_ROWS))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    _prepare(spark)
    return classify(docs, table(spark, sf_dir, "labels")).where(F.col("predicted") == 1).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    _prepare(spark)
    return drop_near_duplicates(docs).select(*COLUMNS)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 400 bytes and more that occur elsewhere are cut; documents stay, with what is left of them."""
    _prepare(spark)
    return suffix_dedup(docs, keep=("doc_id", "lang", "source")).select(*COLUMNS)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    _prepare(spark)
    return decontaminate(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _prepare(spark)
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", quality),
    ("MinHash near-dedup", near_dedup),
    ("suffix-array dedup", suffix_array_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("packing", packing),
]

#: Training a model, sketches and tokenizers are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
