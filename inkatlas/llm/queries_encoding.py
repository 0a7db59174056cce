"""Problem 8 over documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkatlas.llm.encoding import garbled_ids, repair
from inkatlas.sources.tables import table


def p8_restored(spark: SparkSession, directory: str) -> DataFrame:
    """Garbled documents with their restored text, repaired passages, chains and characters lost."""
    return repair(table(spark, directory, "documents").select("doc_id", "text"), "doc_id", "text").withColumnRenamed("id", "doc_id")


def p8_found(spark: SparkSession, directory: str) -> DataFrame:
    """Documents of which a passage is garbled."""
    return garbled_ids(table(spark, directory, "documents").select("doc_id", "text"), "doc_id", "text").select(F.col("id").alias("doc_id"))


SQL: dict[str, str] = {}
QUERIES = {"p8_found": p8_found, "p8_restored": p8_restored}
