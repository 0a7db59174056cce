"""Candidate pairs of look-alikes, their similarity, and complete-linkage groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkatlas.storage import Stored

THRESHOLD = 0.85
#: Renders of a character that are compared where no font has both characters.
FEW_RENDERS = 8
SIDE = 32


def skeleton_pairs(characters: DataFrame, skeletons: DataFrame) -> DataFrame:
    """Ordered pairs ``(first, second)`` of characters with one skeleton.

    ``characters``: ``(code_point)``; ``skeletons``: ``(source, target ARRAY<INT>)``, a character without one is its own.
    """
    named = characters.select("code_point").distinct().join(skeletons.select(F.col("source").alias("code_point"), "target"), "code_point", "left")
    keyed = named.select("code_point", F.coalesce("target", F.array("code_point")).alias("skeleton"))
    a, b = keyed.withColumnRenamed("code_point", "first"), keyed.withColumnRenamed("code_point", "second")
    return a.join(b, "skeleton").where("first < second").select("first", "second")


def case_pairs(records: DataFrame) -> DataFrame:
    """Ordered pairs of a character and its upper or lower case, both among the records."""
    other = F.explode(F.array("simple_uppercase", "simple_lowercase"))
    pairs = records.select("code_point", other.alias("other")).where("other IS NOT NULL AND other <> code_point")
    known = pairs.join(records.select(F.col("code_point").alias("other")).distinct(), "other", "left_semi")
    return known.select(F.least("code_point", "other").alias("first"), F.greatest("code_point", "other").alias("second")).distinct()


def compatibility_bases(entries: DataFrame, tags: list[str]) -> DataFrame:
    """``(form, base)`` of characters that decompose to one other character with one of the ``tags``."""
    parts = F.split("decomposition", " ")
    one = entries.where(F.get(parts, F.lit(0)).isin(*tags) & (F.size(parts) == 2)).select(F.col("code_point").alias("form"), F.conv(F.get(parts, F.lit(1)), 16, 10).cast("int").alias("base"))
    return one.join(entries.select(F.col("code_point").alias("base")), "base", "left_semi").select("form", "base")


def _grids(masks: pd.Series) -> np.ndarray:
    """Bit masks as ``(n, 32, 32)`` booleans: 32 little-endian words, bit 0 leftmost."""
    flat = np.frombuffer(b"".join(bytes(m) for m in masks), np.uint8).reshape(len(masks), SIDE * 4)
    return np.unpackbits(flat, axis=1, bitorder="little").reshape(len(masks), SIDE, SIDE).astype(bool)


def _grown(grids: np.ndarray) -> np.ndarray:
    """Each inked cell spreads to its eight neighbours."""
    wide = grids.copy()
    wide[:, 1:] |= grids[:, :-1]
    wide[:, :-1] |= grids[:, 1:]
    out = wide.copy()
    out[:, :, 1:] |= wide[:, :, :-1]
    out[:, :, :-1] |= wide[:, :, 1:]
    return out


def mask_similarity(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smaller share of one mask's ink that lies on the other's grown ink; 0 if a mask is empty."""
    ink_a, ink_b = a.sum((1, 2)), b.sum((1, 2))
    of_a, of_b = (a & _grown(b)).sum((1, 2)), (b & _grown(a)).sum((1, 2))
    return np.where((ink_a > 0) & (ink_b > 0), np.minimum(of_a / np.maximum(ink_a, 1), of_b / np.maximum(ink_b, 1)), 0.0)


def pair_similarity(pairs: DataFrame, signatures: DataFrame) -> DataFrame:
    """``(first, second, similarity)``: the median over fonts that have both characters; where none has, over the pairs
    of their first eight renders; 0 where a character has no render.

    ``signatures``: ``(code_point, font_id, sig_id, mask_bits)``; rows with a null or misshapen mask are no renders, a
    null font is shared with none. Of several renders in a font the one of largest id counts.
    """
    good = signatures.where((F.length("mask_bits") == SIDE * 4) & F.col("code_point").isNotNull())
    per_font = good.where("font_id IS NOT NULL").groupBy("code_point", "font_id").agg(F.max_by("mask_bits", "sig_id").alias("mask"), F.max("sig_id").alias("sig_id"))
    wanted = pairs.select("first", "second").distinct()
    a = per_font.select(F.col("code_point").alias("first"), "font_id", F.col("mask").alias("mask_a"))
    b = per_font.select(F.col("code_point").alias("second"), "font_id", F.col("mask").alias("mask_b"))
    shared = wanted.join(a, "first").join(b, ["second", "font_id"]).select("first", "second", "mask_a", "mask_b")
    apart = wanted.join(shared.select("first", "second").distinct(), ["first", "second"], "left_anti")
    place = F.row_number().over(Window.partitionBy("code_point").orderBy("sig_id"))
    few = per_font.select("code_point", "sig_id", "mask").withColumn("_r", place).where(F.col("_r") <= FEW_RENDERS)
    crossed = apart.join(few.select(F.col("code_point").alias("first"), F.col("mask").alias("mask_a")), "first").join(few.select(F.col("code_point").alias("second"), F.col("mask").alias("mask_b")), "second").select("first", "second", "mask_a", "mask_b")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield pdf[["first", "second"]].assign(s=mask_similarity(_grids(pdf["mask_a"]), _grids(pdf["mask_b"])))

    compared = shared.unionByName(crossed).mapInPandas(compare, "first int, second int, s double")
    medians = compared.groupBy("first", "second").agg(F.percentile("s", F.lit(0.5)).alias("similarity"))
    return wanted.join(medians, ["first", "second"], "left").select("first", "second", F.coalesce("similarity", F.lit(0.0)).alias("similarity"))


def complete_linkage(pairs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``(member, cluster)`` for each end of a pair of at least ``threshold``; cluster is the smallest member.

    As if pairs were visited from most to least similar (of equal ones the larger pair first) and two clusters merged
    when all their cross pairs reach the threshold; a pair that is not listed does not. Pairs ``(first, second,
    similarity)`` may come in any direction and repeatedly (the largest similarity counts); nulls are no pairs.

    Every round merges all pairs of clusters that are the first to be visited for both: those visits touch no others,
    so their order does not matter. A pair of clusters with a missing cross pair can never merge again and is dropped.
    """
    known = pairs.where(F.col("similarity") >= threshold).where("first <> second")
    edges = known.groupBy(F.least("first", "second").alias("a"), F.greatest("first", "second").alias("b")).agg(F.max("similarity").alias("s"))
    links = Stored(edges.select("a", "b", F.lit(1).cast("bigint").alias("n"), F.struct("s", F.col("a").alias("x"), F.col("b").alias("y")).alias("key")))
    members = Stored(links.df.select(F.explode(F.array("a", "b")).alias("member")).distinct().select("member", F.col("member").alias("cluster")))
    sizes = Stored(members.df.select("cluster", F.lit(1).cast("bigint").alias("size")))
    while True:
        la, lb = sizes.df.select(F.col("cluster").alias("a"), F.col("size").alias("na")), sizes.df.select(F.col("cluster").alias("b"), F.col("size").alias("nb"))
        whole = Stored(links.df.join(la, "a").join(lb, "b").where(F.col("n") == F.col("na") * F.col("nb")).select("a", "b", "n", "key"))
        links.drop()
        links = whole
        first = links.df.select(F.explode(F.array("a", "b")).alias("c"), "key").groupBy("c").agg(F.max("key").alias("best"))
        fa, fb = first.select(F.col("c").alias("a"), F.col("best").alias("ka")), first.select(F.col("c").alias("b"), F.col("best").alias("kb"))
        merges = Stored(links.df.join(fa, "a").join(fb, "b").where((F.col("key") == F.col("ka")) & (F.col("key") == F.col("kb"))).select(F.col("b").alias("cluster"), F.col("a").alias("into")))
        if merges.df.limit(1).count() == 0:
            return members.df.select("member", "cluster")
        moved = Stored(members.df.join(merges.df, "cluster", "left").select("member", F.coalesce("into", "cluster").alias("cluster")))
        resized = Stored(sizes.df.join(merges.df, "cluster", "left").groupBy(F.coalesce("into", "cluster").alias("cluster")).agg(F.sum("size").alias("size")))
        to = merges.df
        renamed = links.df.join(to.select(F.col("cluster").alias("a"), F.col("into").alias("ia")), "a", "left").join(to.select(F.col("cluster").alias("b"), F.col("into").alias("ib")), "b", "left")
        ends = renamed.select(F.coalesce("ia", "a").alias("p"), F.coalesce("ib", "b").alias("q"), "n", "key").where("p <> q")
        relinked = Stored(ends.groupBy(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).agg(F.sum("n").alias("n"), F.max("key").alias("key")))
        for old in (members, sizes, links, merges):
            old.drop()
        members, sizes, links = moved, resized, relinked


def attach_to_groups(groups: DataFrame, joiners: DataFrame, candidates: DataFrame, similarities: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``(member, cluster)`` with joiners added to the group of their most similar partner.

    ``candidates``: ``(place, first, second)``; ``similarities``: ``(first, second, similarity)`` with first < second. A
    joiner takes the partner outside the joiners with the largest similarity of at least the threshold, of equal ones the
    first candidate, and is placed if it also looks like that group's smallest member. A partner without a group starts
    one.
    """
    j = joiners.select(F.col("member").alias("joiner")).distinct()
    sides = candidates.select("place", F.explode(F.array(F.struct(F.col("first").alias("joiner"), F.col("second").alias("partner")), F.struct(F.col("second").alias("joiner"), F.col("first").alias("partner")))).alias("s")).select("place", "s.*")
    open_ = sides.join(j, "joiner", "left_semi").join(j.withColumnRenamed("joiner", "partner"), "partner", "left_anti")
    table = similarities.select(F.col("first").alias("lo"), F.col("second").alias("hi"), "similarity")

    def alike(df: DataFrame, x: str, y: str) -> DataFrame:
        keyed = df.withColumns({"lo": F.least(x, y), "hi": F.greatest(x, y)})
        scored = keyed.join(table, ["lo", "hi"], "left").drop("lo", "hi")
        return scored.withColumn("similarity", F.when(F.col(x) == F.col(y), 1.0).otherwise(F.col("similarity"))).where(F.col("similarity") >= threshold)

    best = alike(open_, "joiner", "partner").groupBy("joiner").agg(F.max(F.struct("similarity", (-F.col("place")).alias("p"), "partner")).alias("b")).select("joiner", F.col("b.partner").alias("partner"))
    placed = best.join(groups.select(F.col("member").alias("partner"), "cluster"), "partner", "left").withColumn("started", F.col("cluster").isNull()).withColumn("cluster", F.coalesce("cluster", "partner"))
    joined = alike(placed, "joiner", "cluster")
    started = joined.where("started").select(F.col("partner").alias("member"), "cluster")
    return groups.select("member", "cluster").unionByName(joined.select(F.col("joiner").alias("member"), "cluster")).unionByName(started).distinct()
