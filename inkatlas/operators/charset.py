"""Building a character set from a configuration, and readers of the documents that describe one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkatlas.functions.text import parse_code_point
from inkatlas.operators.lookups import first_match

CONFIG = "groups array<struct<name: string, blocks: array<string>>>, excluded_categories array<string>, excluded_scripts array<string>, include array<struct<code_point: string, group: string>>, exclude array<string>"


def read_config(spark: SparkSession, path: str) -> DataFrame:
    """The configuration of a character set, one row of JSON."""
    return spark.read.option("multiLine", True).schema(CONFIG).json(path)


def candidates(config: DataFrame, blocks: DataFrame) -> DataFrame:
    """``(code_point, group)``: all code points of the blocks of all groups. A later group takes over an earlier one's,
    an included code point takes its own group. Raises when read if a block is not among ``blocks`` ``(block_name,
    first, last)``. Excluded code points are absent. An empty configuration gives no row."""
    listed = config.select(F.posexplode("groups").alias("place", "g")).select("place", F.col("g.name").alias("group"), F.explode("g.blocks").alias("block_name"))
    met = listed.join(blocks, "block_name", "left")
    first = F.when(F.col("first").isNull(), F.raise_error(F.concat(F.lit("unknown block: "), "block_name")).cast("int")).otherwise(F.col("first"))
    ranged = met.select("place", "group", F.explode(F.sequence(first, F.col("last"))).alias("code_point"))
    own = config.select(F.explode("include").alias("i")).select(F.lit(1 << 30).alias("place"), F.col("i.group").alias("group"), parse_code_point(F.col("i.code_point")).cast("int").alias("code_point"))
    without = config.select(F.explode("exclude").alias("x")).select(parse_code_point(F.col("x")).cast("int").alias("code_point"))
    every = ranged.select("place", "group", F.col("code_point").cast("int").alias("code_point")).unionByName(own)
    return every.groupBy("code_point").agg(F.max_by("group", "place").alias("group")).join(without.distinct(), "code_point", "left_anti")


def build_charset(config: DataFrame, records: DataFrame, blocks: DataFrame) -> DataFrame:
    """``(code_point, group, reason)`` of every candidate with a record: the first rule that leaves it out (category,
    script), or ``kept``; included code points are kept whatever the rules."""
    rules = config.select("excluded_categories", "excluded_scripts", F.transform("include", lambda i: parse_code_point(i["code_point"]).cast("int")).alias("included"))  # one row
    known = candidates(config, blocks).join(records.select("code_point", "general_category", "script"), "code_point").join(F.broadcast(rules))
    reason = first_match([("kept", F.array_contains("included", F.col("code_point"))), ("category", F.array_contains("excluded_categories", F.col("general_category"))), ("script", F.array_contains("excluded_scripts", F.col("script")))], "kept")
    return known.select("code_point", "group", reason.alias("reason"))


def charset_document(charset: DataFrame) -> DataFrame:
    """One row for the document of a character set: counts by group and by reason, and the kept code points in order."""
    kept = F.col("reason") == "kept"
    groups = charset.where(kept).groupBy("group").agg(F.count(F.lit(1)).alias("n"))
    reasons = charset.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
    as_map = lambda df, key: df.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(key, "n")))).alias(f"by_{key}"))
    points = charset.agg(F.sort_array(F.collect_list(F.when(kept, F.col("code_point")))).alias("code_points"))  # a character set is bounded
    return points.join(as_map(groups, "group")).join(as_map(reasons, "reason"))


def read_charset(spark: SparkSession, path: str) -> DataFrame:
    """The kept code points of written charset documents."""
    return spark.read.schema("code_points array<int>").json(path).select(F.explode("code_points").alias("code_point"))


def read_prior(spark: SparkSession, path: str) -> DataFrame:
    """``(code_point, log_prior)`` of a prior document: a JSON object from hexadecimal code points to numbers."""
    rows = spark.read.option("multiLine", True).schema("log_prior map<string, double>").json(path)
    return rows.select(F.explode("log_prior").alias("k", "log_prior")).select(F.conv("k", 16, 10).cast("int").alias("code_point"), "log_prior")


def read_groups(spark: SparkSession, path: str) -> DataFrame:
    """``(group, code_point)`` of a document of look-alike groups, arrays of code points; a group is its smallest member."""
    rows = spark.read.option("multiLine", True).schema("groups array<array<int>>").json(path)
    return rows.select(F.explode("groups").alias("m")).select(F.array_min("m").alias("group"), F.explode("m").alias("code_point"))


def read_evaluations(spark: SparkSession, path: str, first: list[str]) -> DataFrame:
    """Saved evaluations in order of report: the slugs of ``first`` in their order, then the others by name."""
    place = F.array_position(F.array(*[F.lit(s) for s in first]), F.col("slug"))
    return spark.read.parquet(path).orderBy(F.when(place == 0, len(first) + 1).otherwise(place), "slug")


def within_budget(files: DataFrame, size: str, budget: int) -> DataFrame:
    """``(bytes, budget, within)``: whether all files together keep to a budget; no files weigh nothing."""
    total = F.coalesce(F.sum(size), F.lit(0)).cast("bigint")
    return files.agg(total.alias("bytes"), F.lit(budget).cast("bigint").alias("budget"), (total <= budget).alias("within"))
