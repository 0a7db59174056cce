"""Problem 4 over drawings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkatlas.functions.names import read_name, read_split
from inkatlas.llm.overlaps import cross_split_links, cross_split_pairs, overlapping_rows
from inkatlas.sources.tables import table


def _rows(spark: SparkSession, directory: str) -> DataFrame:
    record = F.concat_ws("/", "dataset", read_name(F.col("sample_id")))
    known = F.col("dataset").isNotNull() & F.col("sample_id").isNotNull()
    return table(spark, directory, "drawings").select("row_id", "dataset", read_split(F.col("split_name")).alias("split"), F.when(known, record).alias("record"), "strokes")


def p4_found(spark: SparkSession, directory: str) -> DataFrame:
    """Pairs of a training row and an evaluation row that are the same drawing."""
    pairs = cross_split_pairs(_rows(spark, directory).drop("dataset"))
    return pairs.select(F.least("train_row", "row_id").alias("row_a"), F.greatest("train_row", "row_id").alias("row_b"))


def p4_report(spark: SparkSession, directory: str) -> DataFrame:
    """Per evaluation split and dataset: rows, rows that also occur in the training split, by the surest kind of
    evidence, their share, and the mean coverage of those found by alignment."""
    rows = _rows(spark, directory).where("split <> 'train'").select("row_id", "split", "dataset")
    found = overlapping_rows(*cross_split_links(_rows(spark, directory).drop("dataset")))
    known = rows.join(found, "row_id", "left")
    near = F.col("kind") == "near"
    return known.groupBy(F.col("split").alias("split_name"), "dataset").agg(
        F.count(F.lit(1)).alias("rows"), F.count("kind").alias("overlapping"), (F.count("kind") / F.count(F.lit(1))).alias("share"),
        F.count_if(F.col("kind") == "record").alias("by_record"), F.count_if(F.col("kind") == "ink").alias("by_ink"), F.count_if(near).alias("by_alignment"),
        F.avg(F.when(near, F.col("coverage"))).alias("mean_coverage"),
    )


SQL: dict[str, str] = {}
QUERIES = {"p4_found": p4_found, "p4_report": p4_report}
