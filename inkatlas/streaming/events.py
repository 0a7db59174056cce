"""Windowed counts of a stream of events, kept up to date as files arrive."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkatlas.storage import shared_folder


def window_counts(events: DataFrame, window: str = "1 day", late: str | None = "2 days") -> DataFrame:
    """``(window_start, event_type, n, total)`` per tumbling window; events later than ``late`` may be left out.

    With ``late`` None every event counts, and the state of all windows is kept.
    """
    timed = events.withColumn("at", F.col("ts").cast("timestamp"))
    timed = timed if late is None else timed.withWatermark("at", late)
    grouped = timed.groupBy(F.window("at", window).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return grouped.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def run_window_counts(spark: SparkSession, path: str, window: str = "1 day") -> DataFrame:
    """Run the stream over what lies at ``path`` until it is used up, and return the last state of every window.

    Stored files come in no order of time, so no event is too late.

    Each batch's changed windows are appended with the batch's number; a batch that is repeated after a failure writes
    the same rows again and the newest row of a window counts.
    """
    schema = spark.read.parquet(path).schema
    # Written as a pattern, the path may be a single file as well as a folder.
    pattern = re.sub(r"([^/])([^/]*)/*$", r"[\1]\2", path)
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 16).parquet(pattern)

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("append").parquet(f"{base}/rows")

    query = window_counts(source, window, None).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.schema("window_start timestamp, event_type string, n bigint, total double, batch bigint").parquet(f"{base}/rows")
    return rows.groupBy("window_start", "event_type").agg(F.max_by(F.struct("n", "total"), "batch").alias("s")).select("window_start", "event_type", "s.n", F.round("s.total", 4).alias("total"))
