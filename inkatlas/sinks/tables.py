"""Tables written in the order in which they are read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_sorted(df: DataFrame, path: str, by: list[str], partitions: int | None = None) -> None:
    """Parquet in ranges of ``by``, sorted within files, so that later readers skip what they do not ask for."""
    ranged = df.repartitionByRange(partitions, *by) if partitions else df.repartitionByRange(*by)
    ranged.sortWithinPartitions(*by).write.mode("overwrite").parquet(path)


def write_evaluation(df: DataFrame, path: str, slug: str) -> None:
    """Replace one run's part of the table of evaluations and leave the others."""
    df.withColumn("slug", F.lit(slug)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("slug").parquet(path)


def append_json(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("sep", "\t").option("header", True).option("emptyValue", "").csv(path)


def manifest(spark, path: str) -> DataFrame:
    """``(path, length, sha256)`` of files: what a bundle holds."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))
