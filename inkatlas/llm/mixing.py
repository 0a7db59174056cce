"""Mixing sources to target weights (problem 7).

Each record of a source gets the same wanted number of copies, target / available. Its whole part is given outright; the
fractions are settled by pivotal rounding: two records' fractions exchange mass, weighted by size, until one of them is
0 or 1, the largest first, and what stays open among those of like size exchanges mass with all smaller ones of its cell.
So the source's total of tokens is kept to within one small record. Each cell leaves at most one unsettled record, and
these meet in a tree of ever fewer cells.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkatlas.operators.skew import lookup
from inkatlas.storage import Stored

#: Records of a source that meet in a cell of the first level, and unsettled records that meet in one of each later.
CELL_RECORDS, FAN_IN = 20_000, 4_096
#: A fraction this close to 0 or 1 is settled.
NEAR = 1e-9


def _draws(ids: np.ndarray, seed: int) -> np.ndarray:
    mixed = (ids.astype(np.uint64) + np.uint64(seed & 0xFFFFFFFF)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(31)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(29)
    return mixed.astype(np.float64) / 2.0**64


def _pair_off(p: np.ndarray, w: np.ndarray, open_: np.ndarray, ids: np.ndarray, seed: int) -> np.ndarray:
    """Pair the ``open_`` records in rounds, in place, until at most one is open; returns that one.

    Mass d moves either way, up to what settles one of the two, with the odds that keep each expectation.
    """
    turn = 0
    while True:
        open_ = open_[(p[open_] > NEAR) & (p[open_] < 1 - NEAR)]
        if len(open_) < 2:
            return open_
        turn += 1
        i, j = open_[0 : len(open_) - 1 : 2], open_[1::2]
        up, down = np.minimum(w[i] * (1 - p[i]), w[j] * p[j]), np.minimum(w[i] * p[i], w[j] * (1 - p[j]))  # mass to i, mass to j
        d = np.where(_draws(ids[j], seed + 7919 * turn) * (up + down) < down, up, -down)
        p[i] += d / w[i]
        p[j] -= d / w[j]


def _settle(p: np.ndarray, w: np.ndarray, k: int, rest: np.ndarray, draw: float) -> bool:
    """Settle record k against all smaller ones together, in place; False if they can neither make room nor replace it.

    What k takes or leaves is shared out such that every expectation is kept. Where one of the outcomes is beyond the
    smaller ones (k is larger than all they want together), the other one is taken.
    """
    q, ours, size = p[k], p[rest], w[rest]
    bear = np.minimum(ours / (1 - q), (1 - ours) / q)
    total = float((size * bear).sum())
    if w[k] <= total:
        take = draw < q
        p[rest] = np.clip(ours - bear * (w[k] / total) * ((1 - q) if take else -q), 0, 1)
        p[k] = float(take)
        return True
    mass = float((size * ours).sum())
    room = float(size.sum()) - mass
    up, down = w[k] * (1 - q) <= mass, w[k] * q <= room
    if not (up or down):
        return False
    take = up and (not down or draw < q)
    p[rest] = ours * (1 - w[k] * (1 - q) / mass) if take else ours + (1 - ours) * (w[k] * q / room)
    p[k] = float(take)
    return True


def pivotal(ids: np.ndarray, sizes: np.ndarray, shares: np.ndarray, seed: int) -> tuple[np.ndarray, int]:
    """Round fractions, keeping the size-weighted sum: ``(fractions, index of the unsettled one or -1)``.

    Records of like size (within a factor of two) exchange mass in pairs, the largest first. The one that stays open is
    settled against all smaller ones together, so that what is open at last is small. Draws come from the ids, so a
    repeated task repeats them.
    """
    order = np.lexsort((ids, -sizes))
    w, ids = sizes[order].astype(np.float64), ids[order]
    p = shares[order].astype(np.float64)
    draws = _draws(ids, seed)
    kind = np.floor(np.log2(np.maximum(w, 1)))
    ends = np.flatnonzero(np.r_[kind[1:] != kind[:-1], True]) + 1 if len(w) else np.zeros(0, np.int64)
    begin, carried = 0, np.zeros(0, np.int64)
    for end in ends:
        carried = _pair_off(p, w, np.r_[carried, np.arange(begin, end)], ids, seed)
        begin = end
        if len(carried) and end < len(w) and _settle(p, w, int(carried[0]), np.arange(end, len(w)), float(draws[carried[0]])):
            carried = carried[:0]
    settled = np.ones(len(p), bool)
    settled[carried] = False
    p[settled] = np.rint(p[settled])
    out = np.empty(len(p))
    out[order] = p
    return out, int(order[carried[0]]) if len(carried) else -1


def _round_cells(df: DataFrame, seed: int) -> DataFrame:
    """Round within each ``(source, cell)``: rows ``(source, id, size, share, open)``."""

    def rounded(pdf: pd.DataFrame) -> pd.DataFrame:
        p, left = pivotal(pdf["id"].to_numpy(), pdf["size"].to_numpy(), pdf["share"].to_numpy(), seed)
        pdf["share"], pdf["open"] = p, np.arange(len(pdf)) == left
        return pdf[["source", "id", "size", "share", "open"]]

    return df.groupBy("source", "cell").applyInPandas(rounded, "source string, id bigint, size bigint, share double, open boolean")


def round_shares(records: DataFrame, seed: int = 11) -> DataFrame:
    """Settle fractions ``share`` of ``(source, id, size, share)`` by a tree of pivotal rounding: ``(source, id, taken)``.

    ``id`` must be unique within a source and ``size`` positive. What is left at the root, one record for each source,
    is drawn by its own share.
    """
    cell = F.pmod(F.xxhash64("id"), F.greatest(F.ceil(F.col("_n") / CELL_RECORDS), F.lit(1)))
    stored = Stored(records).df
    counts = stored.groupBy("source").agg(F.count(F.lit(1)).alias("_n"))
    most = stored.groupBy("source").count().agg(F.max("count")).first()[0] or 0
    level = Stored(_round_cells(stored.join(counts, "source").select("source", cell.alias("cell"), "id", "size", "share"), seed))
    settled = [level.df.where("NOT open").select("source", "id", F.col("share").cast("int").alias("taken"))]
    cells = max(1, -(-most // CELL_RECORDS))
    while cells > 1:
        seed += 1
        cells = -(-cells // FAN_IN)
        up = level.df.where("open").select("source", F.pmod(F.xxhash64("id"), F.lit(cells)).alias("cell"), "id", "size", "share")
        level = Stored(_round_cells(up, seed))
        settled.append(level.df.where("NOT open").select("source", "id", F.col("share").cast("int").alias("taken")))
    draw = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
    settled.append(level.df.where("open").select("source", "id", (draw < F.col("share")).cast("int").alias("taken")))
    out = settled[0]
    for part in settled[1:]:
        out = out.unionByName(part)
    return out


def capacities(records: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target source what it can give: ``(source, name, target_share, max_repeats, tokens, most, whole)``.

    ``records``: ``(source, tokens)`` with source as read; ``targets``: ``(source, name, target_share, max_repeats)``.
    ``most`` is its tokens if every record is used max_repeats times, ``whole`` the tokens of all records of any source.
    """
    sums = records.groupBy("source").agg(F.sum("tokens").alias("tokens"))
    whole = records.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("whole"))  # one row
    joined = targets.join(sums, "source", "left").withColumn("tokens", F.coalesce("tokens", F.lit(0)))
    return joined.join(F.broadcast(whole)).withColumn("most", F.col("tokens") * F.greatest(F.col("max_repeats"), F.lit(0)))


def mix(records: DataFrame, targets: DataFrame, size: str = "whole", seed: int = 11) -> DataFrame:
    """Copies of each record: ``(source, id, tokens, copies)``, one row for each record of a target source.

    ``records``: ``(source, id, tokens)``; see ``capacities``. ``size`` is ``whole`` for a mix as large as all records
    together, in which a source that cannot reach its share gives all it may, or ``exact`` for the largest mix, up to
    that size, in which every source reaches its share. Records of 0 tokens get 0 copies, records of other sources and
    of a null source no row. A source with share 0 or no record gives nothing.
    """
    if size not in ("whole", "exact"):
        raise ValueError(f"size must be whole or exact, not {size}")
    bounds = capacities(records, targets).collect()  # one row for each target
    total = float(bounds[0]["whole"]) if bounds else 0.0
    if size == "exact":
        total = min([total, *(r["most"] / r["target_share"] for r in bounds if r["target_share"] > 0)])
    wanted = [(r["source"], min(r["target_share"] * total, float(r["most"])) / r["tokens"] if r["tokens"] else 0.0) for r in bounds]
    spark = records.sparkSession
    rates = F.broadcast(spark.createDataFrame(wanted, "source string, rate double"))
    rated = Stored(records.where("tokens > 0").join(rates, "source").select("source", "id", "tokens", F.floor(F.col("rate") + NEAR).cast("int").alias("base"), (F.col("rate") - F.floor(F.col("rate") + NEAR)).alias("share"))).df
    taken = round_shares(rated.where(F.col("share") > NEAR).select("source", "id", F.col("tokens").alias("size"), "share"), seed)
    none = records.where("tokens = 0").join(rates, "source", "left_semi").select("source", "id", "tokens", F.lit(0).alias("copies"))
    given = rated.join(taken.select("source", "id", "taken"), ["source", "id"], "left")
    return given.select("source", "id", "tokens", (F.col("base") + F.coalesce("taken", F.lit(0))).alias("copies")).unionByName(none)
