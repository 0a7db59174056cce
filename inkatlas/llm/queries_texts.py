"""Problems 6 and 7 over documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkatlas.functions.names import read_name
from inkatlas.llm.mixing import capacities, mix
from inkatlas.llm.packing import CAPACITY, pack
from inkatlas.llm.tokens import with_tokens
from inkatlas.sources.tables import table
from inkatlas.storage import Stored


def p6_found(spark: SparkSession, directory: str) -> DataFrame:
    """Documents that the packing had to cut."""
    packed = pack(table(spark, directory, "documents"), "doc_id", "text")
    return packed.where(F.col("pieces") > 1).select(F.col("id").alias("doc_id")).distinct()


def p6_containers(spark: SparkSession, directory: str) -> DataFrame:
    """Every piece of every document with its container."""
    return pack(table(spark, directory, "documents"), "doc_id", "text").withColumnRenamed("id", "doc_id")


def p6_fill(spark: SparkSession, directory: str) -> DataFrame:
    """How full the containers are: containers, tokens, share of unused space, largest and smallest attention cost."""
    packed = p6_containers(spark, directory).where("container IS NOT NULL")
    held = packed.groupBy("container").agg(F.sum("tokens").alias("tokens"), F.sum(F.col("tokens") * F.col("tokens")).alias("squares"))
    return held.agg(
        F.count(F.lit(1)).alias("containers"), F.sum("tokens").alias("tokens"), (1 - F.sum("tokens") / (F.count(F.lit(1)) * CAPACITY)).alias("unused"),
        F.max("tokens").alias("fullest"), F.min("squares").alias("least_attention"), F.max("squares").alias("most_attention"),
    )


def _records(spark: SparkSession, directory: str) -> DataFrame:
    documents = table(spark, directory, "documents").select("doc_id", "text", read_name(F.col("source")).alias("source"))
    return Stored(with_tokens(documents, "doc_id", "text", ["source"])).df


def _targets(spark: SparkSession, directory: str) -> DataFrame:
    return table(spark, directory, "mix_targets").select(read_name(F.col("source")).alias("source"), F.col("source").alias("name"), "target_share", "max_repeats")


def p7_found(spark: SparkSession, directory: str) -> DataFrame:
    """Sources that cannot reach their share of a mix as large as all documents: in that mix they fall short although
    each of their records is used as often as allowed."""
    records, targets = _records(spark, directory), _targets(spark, directory)
    mixed = mix(records, targets).groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("mixed"))
    short = capacities(records, targets).join(mixed, "source", "left")
    wanted = F.col("target_share") * F.col("whole")
    at_most = F.coalesce("mixed", F.lit(0)) >= F.col("most")
    return short.where(at_most & (F.col("most") < wanted)).select(F.col("name").alias("source"))


def p7_mix(spark: SparkSession, directory: str) -> DataFrame:
    """The copies of every document of the target sources in a mix as large as all documents."""
    return mix(_records(spark, directory), _targets(spark, directory)).withColumnRenamed("id", "doc_id")


def p7_shares(spark: SparkSession, directory: str) -> DataFrame:
    """Shares reached, per source, in the mix as large as all documents and in the largest mix of exact shares."""
    records, targets = _records(spark, directory), _targets(spark, directory)

    def report(size: str) -> DataFrame:
        got = Stored(mix(records, targets, size).groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("mixed"), F.max("copies").alias("most_copies"))).df
        total = F.broadcast(got.agg(F.sum("mixed").alias("total")))  # one row
        return capacities(records, targets).join(got, "source", "left").join(total).select(
            F.lit(size).alias("mix"), F.col("name").alias("source"), "target_share", (F.coalesce("mixed", F.lit(0)) / F.col("total")).alias("share"),
            (F.coalesce("mixed", F.lit(0)) / F.col("whole")).alias("share_of_all"), F.col("tokens").alias("available"), F.coalesce("mixed", F.lit(0)).alias("mixed"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"), "max_repeats",
        )

    return report("whole").unionByName(report("exact"))


SQL: dict[str, str] = {}
QUERIES = {"p6_found": p6_found, "p6_containers": p6_containers, "p6_fill": p6_fill, "p7_found": p7_found, "p7_mix": p7_mix, "p7_shares": p7_shares}
