"""Summaries of collections of drawings, and per-row measures of ink."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkatlas.functions.vectors import let


def summary_by(rows: DataFrame, by: str, writer: Column, test: Column, total: str = "all") -> DataFrame:
    """Samples, characters, writers, test samples and test writers per value of ``by`` and, named ``total``, overall
    (where the number of test writers stays null)."""
    marked = rows.select(F.coalesce(F.col(by).cast("string"), F.lit("?")).alias(by), "code_point", writer.alias("_w"), F.coalesce(test, F.lit(False)).alias("_t"))
    grouped = marked.rollup(by).agg(
        F.count(F.lit(1)).alias("samples"), F.countDistinct("code_point").alias("characters"), F.countDistinct("_w").alias("writers"),
        F.count_if("_t").alias("test_samples"), F.countDistinct(F.when(F.col("_t"), F.col("_w"))).alias("_tw"), F.grouping(by).alias("_g"),
    )
    return grouped.select(F.when(F.col("_g") == 1, total).otherwise(F.col(by)).alias(by), "samples", "characters", "writers", "test_samples", F.when(F.col("_g") == 0, F.col("_tw")).alias("test_writers"))


def bounds(strokes: Column) -> Column:
    """``(min_x, min_y, max_x, max_y)`` of ink; null without a point."""
    p = F.flatten(strokes)
    xs, ys = F.transform(p, lambda q: q["x"].cast("double")), F.transform(p, lambda q: q["y"].cast("double"))
    return F.when(F.size(p) > 0, F.struct(F.array_min(xs).alias("min_x"), F.array_min(ys).alias("min_y"), F.array_max(xs).alias("max_x"), F.array_max(ys).alias("max_y")))


def flat_ink(strokes: Column) -> list[Column]:
    """``xs``, ``ys`` and the strokes' lengths: ink in flat arrays, as Python functions receive it. Null points go."""
    clean = F.transform(F.filter(strokes, lambda s: s.isNotNull()), lambda s: F.filter(s, lambda p: p.isNotNull() & p["x"].isNotNull() & p["y"].isNotNull()))
    points = F.flatten(clean)
    return [F.transform(points, lambda p: p["x"].cast("double")).alias("xs"), F.transform(points, lambda p: p["y"].cast("double")).alias("ys"), F.transform(clean, F.size).alias("lens")]


#: The part of the image's side that a drawing's longer side fills.
CONTENT = 112 / 128


def fitted(strokes: Column, side: int = 64, content: float = CONTENT) -> Column:
    """Strokes scaled and moved into a square of ``side`` pixels, centred; ink without extent keeps its scale.

    Null for null ink and ink without a point; empty strokes vanish.
    """
    def placed(b: Column) -> Column:
        extent = F.greatest(b["max_x"] - b["min_x"], b["max_y"] - b["min_y"])
        frame = F.struct(F.when(extent > 0, F.lit(content * side) / extent).otherwise(F.lit(1.0)).alias("scale"), ((b["min_x"] + b["max_x"]) / 2).alias("x"), ((b["min_y"] + b["max_y"]) / 2).alias("y"))

        def moved(f: Column) -> Column:
            at = lambda p, c: ((p[c].cast("double") - f[c]) * f["scale"] + side / 2).alias(c)
            return F.transform(F.filter(strokes, lambda s: F.size(s) > 0), lambda s: F.transform(s, lambda p: F.struct(at(p, "x"), at(p, "y"))))

        return F.when(b.isNotNull(), let(frame, moved))

    return let(bounds(strokes), placed)


def segments(strokes: Column) -> Column:
    """All segments ``(ax, ay, bx, by)``; a lone point is a segment of no length."""
    def of(s: Column) -> Column:
        a, b = F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(1))), F.when(F.size(s) > 1, F.slice(s, 2, F.greatest(F.size(s) - 1, F.lit(0)))).otherwise(s)
        return F.zip_with(a, b, lambda p, q: F.struct(p["x"].cast("double").alias("ax"), p["y"].cast("double").alias("ay"), q["x"].cast("double").alias("bx"), q["y"].cast("double").alias("by")))

    return F.flatten(F.transform(F.filter(strokes, lambda s: F.size(s) > 0), of))


def ink_length(strokes: Column) -> Column:
    """The length of all strokes together, without the pen's way between them."""
    return F.aggregate(segments(strokes), F.lit(0.0), lambda n, s: n + F.hypot(s["bx"] - s["ax"], s["by"] - s["ay"]))


def arc_lengths(points: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Add the step from the point before (0 for a key's first) and the length so far. ``points`` has x and y."""
    w = Window.partitionBy(*keys).orderBy(order)
    step = F.coalesce(F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w)), F.lit(0.0))
    return points.withColumn("step", step).withColumn("so_far", F.sum("step").over(w.rowsBetween(Window.unboundedPreceding, 0)))
