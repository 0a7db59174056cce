"""Range lookups, precedence joins, routing and other dictionary-like joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Width of a bucket of the range join.
BUCKET = 256


def overlapping_ranges(ranges: DataFrame, first: str = "first", last: str = "last") -> DataFrame:
    """Ranges that begin before the one in front of them has ended, with that end as ``previous_last``."""
    before = F.lag(last).over(Window.orderBy(first, last))  # a dimension table: thousands of ranges at most
    return ranges.withColumn("previous_last", before).where(F.col(first) <= F.col("previous_last"))


def range_lookup(rows: DataFrame, key: str, ranges: DataFrame, value: str, default: str | None = None, bucket: int = BUCKET) -> DataFrame:
    """Left join of ``key`` to the range (``first`` to ``last``, both included) that holds it, as an equi-join on buckets.

    Ranges must not overlap. Keys outside every range, and null keys, get ``default``. A range covers few buckets, so the
    join stays a hash join whatever the number of rows or ranges.
    """
    spread = ranges.select(F.col("first").alias("_f"), F.col("last").alias("_l"), F.col(value).alias("_v"), F.explode(F.sequence(F.floor(F.col("first") / bucket), F.floor(F.col("last") / bucket))).alias("_b"))
    keyed = rows.withColumn("_b", F.floor(F.col(key) / bucket))
    joined = keyed.join(spread, (keyed["_b"] == spread["_b"]) & F.col(key).between(F.col("_f"), F.col("_l")), "left")
    found = F.col("_v") if default is None else F.coalesce("_v", F.lit(default))
    return joined.select(*[F.col(c) for c in rows.columns], found.alias(value))


def expand_ranges(ranges: DataFrame, alias: str = "code_point") -> DataFrame:
    """One row for each member of each range, with the ranges' other columns."""
    others = [c for c in ranges.columns if c not in ("first", "last")]
    return ranges.select(F.explode(F.sequence("first", "last")).alias(alias), *others)


def first_match(rules: Sequence[tuple[str, Column]], default: str | None = None) -> Column:
    """The name of the first rule that holds; a null condition does not hold."""
    out = F.lit(default)
    for name, holds in reversed(rules):
        out = F.when(holds, F.lit(name)).otherwise(out)
    return out


def cascade(rows: DataFrame, key: str, sources: Sequence[tuple[str, DataFrame]], value: str) -> DataFrame:
    """Look a key up in sources in order of precedence: ``value`` and the ``source`` it came from, ``unresolved`` if none.

    Each source has ``key`` and ``value``; a key with several different values in a source is not resolved by it.
    """
    offers = None
    for place, (name, source) in enumerate(sources):
        unique = source.where(F.col(value).isNotNull()).groupBy(key).agg(F.min(value).alias("lo"), F.max(value).alias("hi")).where("lo = hi")
        one = unique.select(key, F.struct(F.lit(place).alias("place"), F.lit(name).alias("source"), F.col("lo").alias(value)).alias("offer"))
        offers = one if offers is None else offers.unionByName(one)
    best = offers.groupBy(key).agg(F.min("offer").alias("offer"))
    return rows.join(best, key, "left").select(*rows.columns, F.col(f"offer.{value}").alias(value), F.coalesce("offer.source", F.lit("unresolved")).alias("source"))


def union_first(parts: Sequence[tuple[str, DataFrame]], keys: Sequence[str]) -> DataFrame:
    """Union of key sets; a key in several parts carries the name of the first: ``(keys, source)``."""
    rows = None
    for place, (name, part) in enumerate(parts):
        one = part.select(*keys, F.struct(F.lit(place).alias("place"), F.lit(name).alias("source")).alias("_s"))
        rows = one if rows is None else rows.unionByName(one)
    return rows.groupBy(*keys).agg(F.min("_s").alias("_s")).select(*keys, F.col("_s.source").alias("source"))


def first_per_key(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1, place: str = "place") -> DataFrame:
    """The first n rows of each key in the given order, with their place from 1. The order should be total."""
    return rows.withColumn(place, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(place) <= n)


def plan_chunks(files: DataFrame, count: int, chunk_bytes: int) -> DataFrame:
    """``(chunk, file_name, start, end)``: ``count`` byte ranges centred on evenly spaced points of the concatenated files.

    ``files``: ``(file_name, size)``, put in order of name. A range keeps within its file; a file smaller than a chunk is
    taken whole. Files of size 0 or null are never taken.
    """
    spark = files.sparkSession
    sized = files.where("size > 0").select("file_name", F.col("size").cast("bigint").alias("size"))
    before = F.coalesce(F.sum("size").over(Window.orderBy("file_name").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a list of files
    placed = sized.withColumn("offset", before)
    total = sized.agg(F.sum("size").alias("total"))
    points = spark.range(count).crossJoin(F.broadcast(total)).select(F.col("id").cast("int").alias("chunk"), F.floor((F.col("id") + 0.5) * F.col("total") / count).cast("bigint").alias("position"))
    inside = points.join(F.broadcast(placed), (F.col("position") >= F.col("offset")) & (F.col("position") < F.col("offset") + F.col("size")))
    start = F.greatest(F.lit(0), F.least(F.col("position") - F.col("offset") - F.lit(chunk_bytes // 2), F.col("size") - F.lit(chunk_bytes)))
    return inside.withColumn("start", start.cast("bigint")).select("chunk", "file_name", "start", F.least(F.col("size"), F.col("start") + chunk_bytes).alias("end"))


def counter_deltas(snapshots: DataFrame, keys: Sequence[str], at: str, counter: str) -> DataFrame:
    """Increase of a counter since the key's snapshot before; null for a key's first, and never below 0 (a restart)."""
    before = F.lag(counter).over(Window.partitionBy(*keys).orderBy(at))
    return snapshots.withColumn("delta", F.greatest(F.col(counter) - before, F.lit(0))).withColumn("delta", F.when(before.isNotNull(), F.col("delta")))
