"""Reading the tables of a directory, one parquet file or folder for each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table `name` of `folder`; filters and column choices on it reach the scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
