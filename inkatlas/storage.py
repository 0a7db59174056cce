"""Written intermediate tables: the way iterative operators cut lineage so that lost executors cost no earlier round.

Tables go to the folder the cluster names in ``spark.checkpoint.dir``, which all executors share, or to the one the
caller has set as the context's checkpoint folder. There is no other.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: dict[str, list[Stored]] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables. Raises if none is named."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/") + "/inkatlas"
    set_by_caller = spark.sparkContext._jsc.sc().getCheckpointDir()
    if set_by_caller.isDefined():
        return set_by_caller.get().rstrip("/") + "/inkatlas"
    raise ValueError("set spark.checkpoint.dir to a folder that all executors share")


class Stored:
    """A DataFrame written to the shared folder, with its path, so that a superseded round can be removed."""

    def __init__(self, df: DataFrame, partitions: int | None = None):
        spark = df.sparkSession
        self.path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
        (df if partitions is None else df.coalesce(partitions)).write.parquet(self.path)
        self.df = spark.read.schema(df.schema).parquet(self.path)
        _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(self)

    def drop(self) -> None:
        spark = self.df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and return it as read from there."""
    return Stored(df).df


def clear(spark: SparkSession) -> None:
    """Delete every table this session has written to the shared folder; results not yet consumed can no longer be read."""
    for table in _WRITTEN.pop(spark.sparkContext.applicationId, []):
        table.drop()


#: Spark's setting (4.1 or later) that deletes an execution's shuffle files when it ends, instead of some time after.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def unshuffled(operator: Callable[..., object]) -> Callable[..., object]:
    """An operator of a DataFrame whose jobs leave no shuffle files behind: its written tables are all that stays."""

    @functools.wraps(operator)
    def run(df: DataFrame, *args, **named):
        spark = df.sparkSession
        before = spark.conf.get(_CLEANUP, None)
        spark.conf.set(_CLEANUP, "true")
        try:
            return operator(df, *args, **named)
        finally:
            if before is None:
                spark.conf.unset(_CLEANUP)
            else:
                spark.conf.set(_CLEANUP, before)

    return run
