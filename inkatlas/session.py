"""Local session for tests and benchmarks. Library code takes the caller's session and never sets a master."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", app: str = "inkatlas", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def name_local_folder(spark: SparkSession) -> None:
    """Set ``spark.checkpoint.dir`` for tests and benchmarks on one machine; a session that has one keeps it, and on a
    cluster it must be set by the cluster."""
    context = spark.sparkContext
    if not spark.conf.get("spark.checkpoint.dir", None) and not context._jsc.sc().getCheckpointDir().isDefined() and context.master.partition("[")[0] == "local":
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="inkatlas-"))
