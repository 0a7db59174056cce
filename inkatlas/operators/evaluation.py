"""Top-k accuracy of predictions, exact and over look-alike groups, overall and by slice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HITS = ("top1", "top5", "top1_conf", "top5_conf")


def hit_flags(predictions: DataFrame) -> DataFrame:
    """Add the four flags. ``predictions``: ``(label, label_group, predictions, prediction_groups)``, arrays in order;
    a padded prediction hits nothing."""
    five = F.slice("predictions", 1, 5)
    groups = F.slice("prediction_groups", 1, 5)
    no = F.lit(False)
    return predictions.withColumns({
        "top1": F.coalesce(F.get("predictions", F.lit(0)) == F.col("label"), no),
        "top5": F.coalesce(F.array_contains(five, F.col("label")), no),
        "top1_conf": F.coalesce(F.get("prediction_groups", F.lit(0)) == F.col("label_group"), no),
        "top5_conf": F.coalesce(F.array_contains(groups, F.col("label_group")), no),
    })


def rates() -> list[Column]:
    return [F.avg(F.col(h).cast("double")).alias(h) for h in HITS]


def micro(hits: DataFrame, *by: str) -> DataFrame:
    """Samples, characters and hit rates; one row (with null rates when empty) without ``by``."""
    return hits.groupBy(*by).agg(F.count(F.lit(1)).alias("samples"), F.countDistinct("label").alias("characters"), *rates())


def macro(hits: DataFrame) -> DataFrame:
    """The mean over characters of each character's hit rates."""
    per = hits.groupBy("label").agg(F.count(F.lit(1)).alias("n"), *rates())
    return per.agg(F.sum("n").alias("samples"), F.count(F.lit(1)).alias("characters"), *[F.avg(h).alias(h) for h in HITS])


def sliced(hits: DataFrame, slices: list[str]) -> DataFrame:
    """``(slice_kind, slice, ...)``: overall and every value of every slice from one pass; null values are ``?``."""
    filled = hits.withColumns({s: F.coalesce(F.col(s).cast("string"), F.lit("?")) for s in slices})
    kept = filled.select("label", *HITS, *slices)
    sets = F.array(F.struct(F.lit("overall").alias("slice_kind"), F.lit("all").alias("slice")), *[F.struct(F.lit(s).alias("slice_kind"), F.col(s).alias("slice")) for s in slices])
    # Flags are first counted by label and all slices at once, so the expansion sees few rows.
    counted = kept.groupBy("label", *slices).agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col(h).cast("int")).alias(h) for h in HITS])
    spread = counted.select("label", "n", *HITS, F.explode(sets).alias("s")).select("s.*", "label", "n", *HITS)
    return spread.groupBy("slice_kind", "slice").agg(F.sum("n").alias("samples"), F.countDistinct("label").alias("characters"), *[(F.sum(h) / F.sum("n")).alias(h) for h in HITS])


def best_setting(grid: DataFrame, setting: str, *measures: str) -> DataFrame:
    """The setting with the largest measures, compared one after another; the smallest setting wins a tie."""
    return grid.agg(F.min_by(setting, F.struct(*[(-F.col(m)).alias(f"m{i}") for i, m in enumerate(measures)], F.col(setting).alias("s"))).alias(setting))


def smallest_within(options: DataFrame, size: str, measure: str, tolerance: float) -> DataFrame:
    """The smallest option whose measure is within ``tolerance`` of the largest option's; one row, none for no options."""
    full = options.agg(F.max_by(measure, size).alias("_full"))  # one row
    return options.join(F.broadcast(full), F.col(measure) >= F.col("_full") - tolerance).drop("_full").orderBy(size).limit(1)


def hash_sample(rows: DataFrame, key: str, n: int, salt: str = "") -> DataFrame:
    """n rows in the order of a hash of their key: a sample that does not change with partitions or other rows' order."""
    return rows.orderBy(F.sha2(F.concat(F.lit(salt), F.col(key).cast("string")), 256), key).limit(n)
