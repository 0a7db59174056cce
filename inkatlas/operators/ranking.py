"""Batch recognition: best characters and look-alike tiles for many query vectors.

A character's similarity to a query is that of its most similar vector. The index is dealt out row by row, so no
character, however common, fills a task; each task keeps each query's n best keys, and a narrow window picks the winners
(one of the n best overall is among the n best where its most similar vector lies). Queries are dealt out in chunks to
all parts of the index, and neither side needs to fit in one task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkatlas.storage import Stored

#: Vectors of the index, and queries, that meet in one task.
PART_VECTORS, CHUNK_QUERIES = 20_000, 4_096
#: Weight of the log prior in the score.
PRIOR_WEIGHT = 0.002


def _meetings(queries: DataFrame, index: DataFrame) -> DataFrame:
    """Both sides dealt out so that every query meets every part of the index: ``(part, chunk, q, code_point, key, bonus,
    vector)``, of which rows of the index have no q.

    Parts come from the number of vectors, which is counted on what was read, before anything is joined to it.
    """
    spark = index.sparkSession
    held_rows, asked_rows = Stored(index), Stored(queries)
    rows, asked = held_rows.df.count(), asked_rows.df.count()  # the footers of written tables tell
    parts, chunks = max(1, -(-rows // PART_VECTORS), min(spark.sparkContext.defaultParallelism, rows // 500)), max(1, -(-asked // CHUNK_QUERIES))
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    held = held_rows.df.select(F.pmod(F.xxhash64("code_point", "vector"), F.lit(parts)).cast("int").alias("part"), every(chunks).alias("chunk"), F.lit(None).cast("bigint").alias("q"), F.col("code_point").cast("int").alias("code_point"), F.col("key").cast("bigint").alias("key"), F.col("bonus").cast("double").alias("bonus"), F.col("vector").cast("array<double>").alias("vector"))
    asks = asked_rows.df.select(every(parts).alias("part"), F.pmod(F.xxhash64("q"), F.lit(chunks)).cast("int").alias("chunk"), F.col("q").cast("bigint").alias("q"), F.lit(None).cast("int").alias("code_point"), F.lit(None).cast("bigint").alias("key"), F.lit(None).cast("double").alias("bonus"), F.col("vector").cast("array<double>").alias("vector"))
    return held.unionByName(asks)


def best_by_weight(queries: DataFrame, index: DataFrame, weights: list[float]) -> DataFrame:
    """``(q, weight, code_point)``: each query's best character for every weight of ``bonus``, from one pass over the
    similarities. Ties go to the smaller code point."""

    def score(pdf: pd.DataFrame) -> pd.DataFrame:
        ask = pdf["code_point"].isna().to_numpy()
        parts = []
        if ask.any() and not ask.all():
            own, asked = pdf[~ask].sort_values("code_point", kind="stable"), pdf[ask]
            cps, bonus = own["code_point"].to_numpy(dtype=np.int64), own["bonus"].to_numpy(dtype=float)
            v, w, q = np.stack(own["vector"].to_numpy()), np.stack(asked["vector"].to_numpy()), asked["q"].to_numpy(dtype=np.int64)
            for i in range(0, len(w), 256):
                sim = w[i : i + 256] @ v.T
                for weight in weights:
                    total = sim + weight * bonus
                    best = total.argmax(1)
                    parts.append(pd.DataFrame({"q": q[i : i + 256], "weight": weight, "code_point": cps[best].astype(np.int32), "score": total[np.arange(len(best)), best]}))
        return pd.concat(parts, ignore_index=True) if parts else pd.DataFrame({"q": np.zeros(0, np.int64), "weight": np.zeros(0), "code_point": np.zeros(0, np.int32), "score": np.zeros(0)})

    found = _meetings(queries, index).groupBy("part", "chunk").applyInPandas(score, "q bigint, weight double, code_point int, score double")
    return found.groupBy("q", "weight").agg(F.min_by("code_point", F.struct((-F.col("score")).alias("s"), "code_point")).alias("code_point"))


def best_matches(queries: DataFrame, index: DataFrame, n: int) -> DataFrame:
    """``(q, rank, key, code_point, similarity, score)``: the n best keys of each query.

    ``queries``: ``(q, vector)``; ``index``: ``(code_point, key, bonus, vector)``, key being what is ranked (the
    character itself or its group) and bonus what is added to similarity. All vectors have one length and no null. A
    key's place is that of its best character, ties go to the smaller code point. A query against an empty index has no
    row. Rows of one query id are one query: its best over all its vectors.
    """

    def score(pdf: pd.DataFrame) -> pd.DataFrame:
        ask = pdf["code_point"].isna().to_numpy()
        out = pd.DataFrame({"q": np.zeros(0, np.int64), "key": np.zeros(0, np.int64), "code_point": np.zeros(0, np.int32), "similarity": np.zeros(0), "score": np.zeros(0)})
        if ask.all() or not ask.any():
            return out
        own = pdf[~ask].sort_values(["code_point"], kind="stable")
        cps, first = np.unique(own["code_point"].to_numpy(dtype=np.int64), return_index=True)
        keys, bonus = own["key"].to_numpy(dtype=np.int64)[first], own["bonus"].to_numpy(dtype=float)[first]
        v = np.stack(own["vector"].to_numpy())
        qs = pdf[ask].sort_values("q", kind="stable")
        ids, qfirst = np.unique(qs["q"].to_numpy(dtype=np.int64), return_index=True)
        w = np.stack(qs["vector"].to_numpy())
        in_keys = np.lexsort((cps, keys))
        key_starts = np.flatnonzero(np.r_[True, keys[in_keys][1:] != keys[in_keys][:-1]])
        results = []
        starts = np.r_[qfirst, len(w)]
        for i in range(0, len(ids), 256):
            j = min(i + 256, len(ids))
            sim = np.maximum.reduceat(w[starts[i] : starts[j]] @ v.T, first, axis=1)
            sim = np.maximum.reduceat(sim, qfirst[i:j] - qfirst[i], axis=0)
            total = sim + bonus[None]
            # Places of keys: characters stand in order of keys, so a key's best is a maximum over a run.
            by_key = np.maximum.reduceat(total[:, in_keys], key_starts, axis=1)
            m = min(n, by_key.shape[1])
            edge = np.partition(by_key, by_key.shape[1] - m, axis=1)[:, by_key.shape[1] - m]
            r, g = np.nonzero(by_key >= edge[:, None])  # ties at the edge are put in order below
            ends = np.r_[key_starts, len(in_keys)]
            lens = (ends[1:] - ends[:-1])[g]
            at = np.arange(lens.sum()) - np.repeat(np.cumsum(lens) - lens, lens) + np.repeat(key_starts[g], lens)
            rr, c = np.repeat(r, lens), in_keys[at]
            best = total[rr, c] == np.repeat(by_key[r, g], lens)
            rr, c, kk = rr[best], c[best], np.repeat(g, lens)[best]
            first_of = np.r_[True, (rr[1:] != rr[:-1]) | (kk[1:] != kk[:-1])]  # the smallest code point of equal ones
            rr, c = rr[first_of], c[first_of]
            order = np.lexsort((cps[c], -total[rr, c], rr))
            rr, c = rr[order], c[order]
            new = np.flatnonzero(np.r_[True, rr[1:] != rr[:-1]])
            keep = np.arange(len(rr)) - np.repeat(new, np.diff(np.r_[new, len(rr)])) < n
            rr, c = rr[keep], c[keep]
            results.append(pd.DataFrame({"q": ids[i + rr], "key": keys[c], "code_point": cps[c].astype(np.int32), "similarity": sim[rr, c], "score": total[rr, c]}))
        return pd.concat(results, ignore_index=True) if results else out

    found = _meetings(queries, index).groupBy("part", "chunk").applyInPandas(score, "q bigint, key bigint, code_point int, similarity double, score double")
    per_key = Window.partitionBy("q", "key").orderBy(F.desc("score"), "code_point")
    best = found.withColumn("_k", F.row_number().over(per_key)).where("_k = 1")
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "code_point"))
    return best.withColumn("rank", place).where(F.col("rank") <= n).select("q", "rank", "key", "code_point", "similarity", "score")


def with_bonus(index: DataFrame, prior: DataFrame | None, weight: float = PRIOR_WEIGHT) -> DataFrame:
    """Add ``bonus``, the weighted log prior; a character without one gets the smallest, and 0 if there is no prior."""
    if prior is None:
        return index.withColumn("bonus", F.lit(0.0))
    least = prior.agg(F.coalesce(F.min("log_prior"), F.lit(0.0)).alias("_least"))  # one row
    joined = index.join(prior.select("code_point", "log_prior"), "code_point", "left").join(F.broadcast(least))
    return joined.withColumn("bonus", F.lit(weight) * F.coalesce("log_prior", "_least")).drop("log_prior", "_least")


def restrict(index: DataFrame, accept: Column | DataFrame) -> DataFrame:
    """Only accepted characters take part, before anything is ranked: a predicate, or a table of code points."""
    return index.where(accept) if isinstance(accept, Column) else index.join(accept.select("code_point").distinct(), "code_point", "left_semi")


def on_every_keyboard(script: Column, category: Column) -> Column:
    """Characters of no particular script that are no letters can be typed everywhere."""
    return F.coalesce(script.isin("Common", "Inherited") & ~F.startswith(category, F.lit("L")), F.lit(False))


def typed(script: Column, category: Column, keyboards: list[str]) -> Column:
    return on_every_keyboard(script, category) | F.coalesce(script.isin(*keyboards), F.lit(False))


def chooser(characters: DataFrame, keyboards: list[str]) -> DataFrame:
    """``(group, representative, members)``: each group's members in order of choice: typed on the keyboards first, then
    by log prior (missing: smallest) from large to small, then by code point.

    ``characters``: ``(group, code_point, script, general_category, log_prior)``.
    """
    order = F.struct((~typed(F.col("script"), F.col("general_category"), keyboards)).alias("a"), (-F.coalesce("log_prior", F.lit(-1e9))).alias("b"), F.col("code_point").alias("cp"))
    return characters.groupBy("group").agg(F.transform(F.sort_array(F.collect_list(order)), lambda e: e["cp"]).alias("members")).select("group", F.col("members")[0].alias("representative"), "members")


def padded(ranking: DataFrame, n: int, value: str = "code_point") -> DataFrame:
    """``(q, predictions)``: n predictions in order of rank, -1 where there are fewer."""
    listed = ranking.where(F.col("rank") <= n).groupBy("q").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", F.col(value).alias("v")))), lambda e: e["v"]).alias("p"))
    return listed.select("q", filled(F.col("p"), n).cast(listed.schema["p"].dataType).alias("predictions"))


def filled(values: Column, n: int) -> Column:
    """An array with -1 behind its values up to n."""
    return F.concat(values, F.array_repeat(F.lit(-1), F.lit(n) - F.size(values)))


def priority_pick(rows: DataFrame, key: str, choices: DataFrame, choice: str, rank: str) -> DataFrame:
    """For each key the available choice that comes first in a preference list: ``(key, choice)``; none, no row."""
    return rows.join(F.broadcast(choices.select(choice, rank)), choice).groupBy(key).agg(F.min_by(choice, rank).alias(choice))
