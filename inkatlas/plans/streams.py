"""The streaming query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkatlas.streaming.events import run_window_counts


def stream_window_counts(spark: SparkSession, directory: str) -> DataFrame:
    """Events per day and type, counted by a stream that reads all there is."""
    counts = run_window_counts(spark, f"{directory.rstrip('/')}/events.parquet")
    return counts.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "n", "total")


SQL = {"stream_window_counts": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2"}
QUERIES = {"stream_window_counts": stream_window_counts}
