"""Joins and per-key statistics that stay balanced when a few keys hold most rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkatlas.storage import Stored

#: A key is hot above this share of the rows; so there are fewer than HOT_PARTS hot keys whatever the data.
HOT_PARTS = 500
#: and above this many rows, below which one task takes a key's rows without delay.
HOT_ROWS = 100_000


def lookup(left: DataFrame, right: DataFrame, key: str, how: str = "left") -> DataFrame:
    """Join ``left`` to ``right``, in which ``key`` is unique, without gathering a hot key's rows in one task.

    Keys with more than 1/HOT_PARTS of the rows of ``left`` (fewer than HOT_PARTS of them) meet a broadcast of their
    rows of ``right``, at most one each; all others meet in a shuffled join. ``how`` is ``left`` or ``inner``.
    Null keys match nothing and stay null with ``left``. ``left`` is read twice, so pass a stored table; rows of
    ``right`` should be narrow, as up to HOT_PARTS of them are broadcast.
    """
    counts = left.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > HOT_ROWS)
    common = [(r[0], r["_n"]) for r in counts.orderBy(F.desc("_n")).limit(HOT_PARTS).collect()]
    if not common:
        return left.join(right, key, how)
    rows = left.count()
    hot = [k for k, n in common if n > rows / HOT_PARTS]
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    few = F.broadcast(right.where(F.col(key).isin(hot)))
    return left.where(is_hot).join(few, key, how).unionByName(left.where(~is_hot).join(right.where(~is_hot), key, how))


def value_frequencies(df: DataFrame, keys: Sequence[str], value: str, weight: str | None = None) -> DataFrame:
    """Compress ``df`` to one row per key and value with its frequency ``freq``: the step before any per-key result.

    A hot key's rows are summed where they lie and then spread over its values, so no task sees the key as a whole.
    Null values form a row of their own; ``weight`` sums frequencies that are already compressed.
    """
    return df.groupBy(*keys, value).agg((F.count(F.lit(1)) if weight is None else F.sum(weight)).cast("bigint").alias("freq"))


def distinct_and_mode(freqs: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Per key: ``rows`` (null values included), exact ``n_distinct`` and ``mode`` of the non-null values.

    The most frequent value wins, of equally frequent ones the smallest; a key with only nulls has 0 and null.
    """
    known = F.col(value).isNotNull()
    best = F.min(F.when(known, F.struct((-F.col("freq")).alias("f"), F.col(value).alias("v"))))
    return freqs.groupBy(*keys).agg(F.sum("freq").cast("bigint").alias("rows"), F.sum(F.when(known, 1).otherwise(0)).cast("bigint").alias("n_distinct"), best["v"].alias("mode"))


#: Ranges of percentiles are broadcast up to this number (some MB), joined by shuffle beyond it.
MOST_RANGES = 20_000
#: Cells a range is cut into, and distinct values up to which a cell is put in order by one task.
CELLS, CELL_VALUES = 1024, 1000
#: Rounds of cutting after which even the 2 ** 63 values of a bigint are told apart.
MOST_ROUNDS = 64


def weighted_percentiles(freqs: DataFrame, keys: Sequence[str], value: str, shares: dict[str, float | Callable[[Column], Column]]) -> DataFrame:
    """Per key the exact percentiles ``shares`` (name: share) of a numeric value from its frequencies.

    The percentile at share q is the smallest value v such that at least ceil(q * n) of the n non-null rows are <= v
    (the ``percentile_disc`` of SQL). Instead of a share, a function may give the rank, counted from 1, from n. Nulls
    count nowhere; a key without a value is missing from the result.

    Each percentile has a range of values that holds it, at first that of its key. In every round the ranges are cut
    into CELLS cells of equal width, whose frequencies are summed where they lie, and the cell with the wanted rank
    becomes the range; values outside all ranges fall away. A range with at most CELL_VALUES distinct values is put in
    order at once. So however the values are spread, no task sorts more than that, nor sums more than CELLS cells.
    """
    known = Stored(freqs.where(F.col(value).isNotNull()).select(F.struct(*keys).alias("_key"), F.col(value).alias("_v"), "freq"))
    v = F.col("_v").cast("double")
    totals = known.df.groupBy("_key").agg(F.min(v).alias("_lo"), F.max(v).alias("_hi"), F.sum("freq").alias("_n"), F.count(F.lit(1)).alias("_distinct"))
    ranks = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), (q(F.col("_n")) if callable(q) else F.ceil(F.col("_n") * F.lit(float(q)))).cast("bigint").alias("rank")) for name, q in shares.items()]))
    # ``_rank`` counts within the range.
    sought = Stored(totals.withColumn("_w", ranks).select("_key", F.col("_w.name").alias("_name"), F.greatest(F.col("_w.rank"), F.lit(1)).alias("_rank"), "_lo", "_hi", "_distinct"))
    found: list[DataFrame] = []
    rows = known
    for _ in range(MOST_ROUNDS):
        # One row for each key and range; the ranges of a key are few, so values meet them without gathering the key.
        inside = rows.df.join(F.broadcast(sought.df) if sought.df.count() <= MOST_RANGES else sought.df, "_key").where(v.between(F.col("_lo"), F.col("_hi")))
        few = (F.col("_distinct") <= CELL_VALUES) | (F.col("_lo") == F.col("_hi"))
        upto = F.sum("freq").over(Window.partitionBy("_key", "_name").orderBy("_v"))
        settled = inside.where(few).withColumn("_upto", upto).where(F.col("_upto") >= F.col("_rank")).groupBy("_key", "_name").agg(F.min("_v").alias("_v"))
        found.append(Stored(settled).df)
        # A cell's number; the last one holds the upper end.
        part = F.least(F.floor((v - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * CELLS), F.lit(CELLS - 1))
        cells = inside.where(~few).groupBy("_key", "_name", "_rank", part.alias("_cell")).agg(F.sum("freq").alias("_sum"), F.min(v).alias("_lo"), F.max(v).alias("_hi"), F.count(F.lit(1)).alias("_distinct"))
        before = F.coalesce(F.sum("_sum").over(Window.partitionBy("_key", "_name").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        narrowed = cells.withColumn("_before", before).where((F.col("_rank") > F.col("_before")) & (F.col("_rank") <= F.col("_before") + F.col("_sum")))
        sought = Stored(narrowed.select("_key", "_name", (F.col("_rank") - F.col("_before")).alias("_rank"), "_lo", "_hi", "_distinct"))
        if sought.df.limit(1).count() == 0:
            break
    every = found[0]
    for part_found in found[1:]:
        every = every.unionByName(part_found)
    return every.groupBy("_key").agg(*[F.max(F.when(F.col("_name") == name, F.col("_v"))).alias(name) for name in shares]).select("_key.*", *shares)


def any_of(conditions: Sequence[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out
