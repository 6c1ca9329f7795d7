"""Reading the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from qrelia.session import ship_package


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fresh_names(df: DataFrame, *names: str) -> list[str]:
    """``names`` with a tail that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    tail = "_"
    while any((name + tail).lower() in taken for name in names):
        tail += "_"
    return [name + tail for name in names]
