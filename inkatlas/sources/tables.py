"""Access to the Parquet tables of a data directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """The table ``name`` of ``directory``, a single Parquet file or a folder of them."""
    return spark.read.parquet(f"{directory.rstrip('/')}/{name}.parquet")
