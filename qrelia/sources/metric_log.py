"""A metric log that several runs append to, safe against repeated appends.

Every append is a folder ``append=<number>`` of CSV files (run_id, epoch, steps, value with six decimals; each file has
its header). A folder counts once its write has been committed. The key is (run_id, steps): a row of a later append
replaces an earlier one, and an append with a number that exists replaces that append, so a retry changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qrelia.sources.report import six_decimals

LOG_SCHEMA = "run_id string, epoch double, steps long, value string"
_FOLDER = "append="


def _folder(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def appends(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the committed appends, ascending."""
    at, files = _folder(spark, path)
    if not files.exists(at):
        return []
    numbers = []
    for status in files.listStatus(at):
        name = status.getPath().getName()
        done, _ = _folder(spark, f"{path}/{name}/_SUCCESS")
        if name.startswith(_FOLDER) and files.exists(done):
            numbers.append(int(name.removeprefix(_FOLDER)))
    return sorted(numbers)


def append_metrics(rows: DataFrame, path: str, number: int | None = None) -> int:
    """Append ``rows(run_id, epoch, steps, value)``; returns the number of the append.

    Without a number the next free one is taken. A caller that may have to try again passes the number it got or chose.
    """
    if number is None:
        number = max(appends(rows.sparkSession, path), default=-1) + 1
    text = rows.select(
        F.col("run_id").cast("string").alias("run_id"),
        F.col("epoch").cast("double").alias("epoch"),
        F.col("steps").cast("long").alias("steps"),
        six_decimals(F.col("value").cast("double")).alias("value"),
    )
    text.write.mode("overwrite").option("header", True).csv(f"{path}/{_FOLDER}{number:09d}")
    return number


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """(run_id, step, epoch, value) with the latest row of each (run_id, steps): a run log for ``runlog``."""
    numbers = appends(spark, path)
    if not numbers:
        return spark.createDataFrame([], "run_id string, step long, epoch double, value double")
    # Partition discovery gives each row the number of its append.
    rows = spark.read.schema(f"{LOG_SCHEMA}, append int").option("header", True).option("basePath", path)
    rows = rows.csv([f"{path}/{_FOLDER}{n:09d}" for n in numbers])
    latest = F.max_by(F.struct("epoch", "value"), "append").alias("last")
    kept = rows.groupBy("run_id", F.col("steps").alias("step")).agg(latest)
    return kept.select("run_id", "step", "last.epoch", F.col("last.value").cast("double").alias("value"))
