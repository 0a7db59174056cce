"""Vector expressions over arrays, computed in double precision."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Norms below this count as this, so that a zero vector stays zero.
LEAST_NORM = 1e-8


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, although lambdas inside use it for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def dot(a: Column, b: Column) -> Column:
    """Dot product in order of the elements; null if an array is null or the lengths differ."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def l2_normalize(v: Column) -> Column:
    return let(F.greatest(norm(v), F.lit(LEAST_NORM)), lambda n: F.transform(v, lambda x: x.cast("double") / n))


def finite(v: Column, dims: int) -> Column:
    """True for ``dims`` finite elements of which one is not 0; false for null."""
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    return F.coalesce((F.size(v) == dims) & good, F.lit(False))


def quantize(v: Column) -> Column:
    """``(values ARRAY<TINYINT>, scale)``: largest magnitude / 127 is the step, halves round to even; a zero vector has scale 1."""
    top = F.array_max(F.transform(v, lambda x: F.abs(x.cast("double"))))

    def packed(scale: Column) -> Column:
        values = F.transform(v, lambda x: F.greatest(F.lit(-127.0), F.least(F.lit(127.0), F.rint(x.cast("double") / scale))).cast("tinyint"))
        return F.struct(values.alias("values"), scale.alias("scale"))

    return let(F.when(top > 0, top / 127).otherwise(F.lit(1.0)), packed)


def dequantize(q: Column) -> Column:
    return let(q, lambda p: F.transform(p["values"], lambda x: x.cast("double") * p["scale"]))


def mean_vectors(df: DataFrame, key: str, vector: str) -> DataFrame:
    """``(key, vector)``: the normalised sum of each key's vectors, element by element, so hot keys combine early.

    Rows with a null key or vector are left out; vectors of one key must have one length.
    """
    parts = df.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(key, F.posexplode(vector).alias("_i", "_x"))
    sums = parts.groupBy(key, "_i").agg(F.sum(F.col("_x").cast("double")).alias("_x"))
    ordered = sums.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_x"))), lambda e: e["_x"]).alias("_v"))  # one entry for each dimension
    return ordered.select(key, l2_normalize(F.col("_v")).alias(vector))
