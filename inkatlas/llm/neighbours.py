"""The most similar vectors for every vector (problem 2): inverted lists with an adaptive dimension scan.

All vectors are scaled to length one and rotated by one random rotation, after which every block of dimensions carries
the same expected part of a squared distance. Each vector lies in the list of its nearest centre and asks the lists of
its nearest few. Within a list a scan adds up one block of dimensions at a time; after each block a hypothesis test asks
whether the full distance can still beat the asker's bound, and only the surviving candidates see the next block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkatlas.operators.skew import lookup
from inkatlas.storage import Stored

#: The centres are fitted on at most this many vectors (SAMPLE_PER_LIST for each list); every vector is indexed. Lists
#: grow with the square root of the vectors up to MOST_LISTS, that is to 4 billion vectors.
LARGEST_SAMPLE = 262_144
SAMPLE_PER_LIST = 48
MOST_LISTS = 65_536
#: The lists each vector asks are so many that, among HELD_OUT vectors of the sample searched by brute force, this part
#: of the wanted neighbours lies in them; at least FEWEST.
RECALL, HELD_OUT, FEWEST = 0.98, 512, 8
#: Width of a block of dimensions.
BLOCK = 12
#: Strictness of the hypothesis test: larger abandons less.
EPSILON = 2.1
#: A cell compares at most about this many stored with that many asking vectors; longer lists are cut into cells.
CELL_STORED, CELL_ASKING = 4_096, 16_384


def usable(embedding: Column, dims: int) -> Column:
    """True for ``dims`` finite values that are not all zero; false for null and all else."""
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(embedding) == dims) & finite & F.exists(embedding, lambda x: x != 0), F.lit(False))


def _rotation(dims: int, seed: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, dims)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


def _unit(rows: np.ndarray) -> np.ndarray:
    rows = rows.astype(np.float64)
    rows /= np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _k_means(sample: np.ndarray, lists: int, rng: np.random.Generator, turns: int) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means: centres and each vector's; an emptied centre restarts at the vector farthest from its centre."""
    centres = sample[rng.choice(len(sample), lists, replace=False)]
    for turn in range(turns + 1):
        nearest, close = [], []
        for i in range(0, len(sample), 8192):
            s = sample[i : i + 8192] @ centres.T
            nearest.append(s.argmax(1))
            close.append(s.max(1))
        of, near = np.concatenate(nearest), np.concatenate(close)
        if turn == turns:
            break
        sums = np.zeros_like(centres)
        np.add.at(sums, of, sample)
        empty = np.flatnonzero(np.bincount(of, minlength=lists) == 0)
        sums[empty] = sample[np.argsort(near)[: len(empty)]]
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norms > 1e-12, sums / np.maximum(norms, 1e-12), centres).astype(np.float32)
    return centres, of


def _centres(sample: np.ndarray, lists: int, seed: int, turns: int = 8) -> np.ndarray:
    """Centres in two levels, so that many can be fitted: about sqrt(lists) coarse ones, each cut in proportion to its
    vectors."""
    rng = np.random.default_rng(seed)
    _, of = _k_means(sample, max(1, round(lists**0.5)), rng, turns)
    parts = []
    for c in np.unique(of):
        own = sample[of == c]
        parts.append(_k_means(own, min(len(own), max(1, round(lists * len(own) / len(sample)))), rng, turns)[0])
    return np.concatenate(parts)


def probes_for(sample: np.ndarray, centres: np.ndarray, k: int, min_similarity: float, recall: float = RECALL) -> int:
    """How many lists to ask: measured on HELD_OUT vectors of the sample against brute force over the sample.

    The nearest vectors of the whole table are nearer than those of the sample, so they lie in fewer lists.
    """
    asked = sample[:: max(1, len(sample) // HELD_OUT)]
    wanted = []
    for i in range(0, len(asked), 64):
        q = asked[i : i + 64]
        s = q @ sample.T
        s[s > 1 - 1e-6] = -2  # itself and its copies
        top = np.argpartition(-s, min(k, s.shape[1]) - 1, axis=1)[:, :k]
        far = np.take_along_axis(s, top, 1)
        lists = (sample[top.ravel()] @ centres.T).argmax(1).reshape(top.shape)
        own = q @ centres.T
        rank = (own[:, None, :] > np.take_along_axis(own, lists, 1)[:, :, None]).sum(2)
        wanted.append(rank[(far >= min_similarity) & (far > -2)])
    ranks = np.sort(np.concatenate(wanted)) if wanted else np.zeros(0, int)
    enough = int(ranks[min(len(ranks) - 1, int(np.ceil(recall * len(ranks))))]) + 1 if len(ranks) else FEWEST
    return min(len(centres), max(FEWEST, enough))


def scan_cell(stored_ids: np.ndarray, stored: np.ndarray, asking_ids: np.ndarray, asking: np.ndarray, k: int, bound: float, rotation: np.ndarray, block: int = BLOCK, epsilon: float = EPSILON) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Adaptive dimension scan of one cell: ``(asking id, stored id, similarity)``, at most k rows for each asker.

    Vectors are as stored; they are scanned at length one and rotated, in single precision, and the distances of those
    that survive all blocks are computed again in double precision before they are compared. ``bound`` is the largest
    squared distance of interest. An asker's own bound shrinks to its k-th best distance as slices of the cell are
    scanned. Equal distances prefer the smaller stored id.
    """
    dims = stored.shape[1]
    order = np.argsort(stored_ids, kind="stable")
    stored_ids, stored_exact, asking_exact = stored_ids[order], _unit(stored[order]), _unit(asking)
    stored, asking = (x.astype(np.float32) @ rotation for x in (stored_exact, asking_exact))
    best_d = np.full((len(asking), k), np.inf)
    best_i = np.full((len(asking), k), -1, np.int64)
    limit = np.full(len(asking), bound, np.float32)
    step = 1024
    for q0 in range(0, len(asking), 2048):
        q1 = min(q0 + 2048, len(asking))
        q = asking[q0:q1]
        for s0 in range(0, len(stored), step):
            s = stored[s0 : s0 + step]
            part = (q[:, :block] ** 2).sum(1)[:, None] + (s[:, :block] ** 2).sum(1)[None] - 2 * (q[:, :block] @ s[:, :block].T)
            test = limit[q0:q1] * np.float32((1 + epsilon / block**0.5) ** 2 * block / dims)
            qi, si = np.nonzero(part <= test[:, None])
            d = part[qi, si]
            done = block
            while done < dims and len(qi):
                upto = min(done + block, dims)
                d = d + ((q[qi, done:upto] - s[si, done:upto]) ** 2).sum(1)
                done = upto
                slack = 1.0 if done == dims else (1 + epsilon / done**0.5) ** 2 * done / dims
                alive = d <= limit[q0:q1][qi] * np.float32(slack) + np.float32(1e-6)
                qi, si, d = qi[alive], si[alive], d[alive]
            other = asking_ids[q0:q1][qi] != stored_ids[s0 : s0 + step][si]
            qi, si, d = qi[other], si[other], d[other]
            if not len(qi):
                continue
            d = 2 - 2 * np.einsum("ij,ij->i", asking_exact[q0:q1][qi], stored_exact[s0 : s0 + step][si])
            ids = stored_ids[s0 : s0 + step][si]
            rows = np.unique(qi)
            old = best_i[q0:q1][rows]
            oq, oc = np.nonzero(old >= 0)
            aq, ad, ai = np.concatenate([rows[oq], qi]), np.concatenate([best_d[q0:q1][rows][oq, oc], d]), np.concatenate([old[oq, oc], ids])
            o = np.lexsort((ai, ad, aq))
            aq, ad, ai = aq[o], ad[o], ai[o]
            first = np.r_[0, np.flatnonzero(np.diff(aq)) + 1]
            rank = np.arange(len(aq)) - np.repeat(first, np.diff(np.r_[first, len(aq)]))
            keep = rank < k
            best_d[q0 + aq[keep], rank[keep]] = ad[keep]
            best_i[q0 + aq[keep], rank[keep]] = ai[keep]
            full = rows[best_i[q0 + rows, k - 1] >= 0]
            limit[q0 + full] = np.minimum(bound, best_d[q0 + full, k - 1])
    a, j = np.nonzero(best_i >= 0)
    return asking_ids[a], best_i[a, j], 1 - best_d[a, j] / 2


def distinct_vectors(vectors: DataFrame, id_col: str, vector_col: str, dims: int) -> tuple[DataFrame, DataFrame]:
    """Collapse exact copies: members ``(id, rep)`` and representatives ``(rep, vector)``, rep being the smallest id."""
    rows = Stored(vectors.where(usable(F.col(vector_col), dims)).select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<float>").alias("vector"))).df
    spread = F.concat_ws(":", F.xxhash64("vector", F.lit(1)), F.xxhash64(F.reverse("vector"), F.lit(2)), F.hash("vector"))
    keyed = Stored(rows.select("id", spread.alias("key"))).df
    reps = keyed.groupBy("key").agg(F.min("id").alias("rep"))
    members = Stored(lookup(keyed, reps, "key", "inner").select("id", "rep")).df
    chosen = rows.join(members.where("id = rep").select("id"), "id", "left_semi").select(F.col("id").alias("rep"), "vector")
    return members, chosen


def most_similar(vectors: DataFrame, id_col: str, vector_col: str, dims: int, k: int = 5, min_similarity: float = -1.0, queries: Column | None = None, probes: int | None = None, lists: int | None = None, seed: int = 7) -> DataFrame:
    """For each usable vector its ``k`` most similar others: ``(id, rank, neighbour, similarity)``.

    Similarity is the cosine; ties go to the smaller id; neighbours below ``min_similarity`` are left out. Vectors that
    are null, of another length, not finite or all zero neither ask nor answer. Exact copies are compared once and
    share their result. ``probes`` is the number of lists asked, by default what ``probes_for`` measures. ``queries`` is a predicate on the column ``id`` that restricts who asks, never who answers.
    An empty table gives an empty result; extra columns are ignored.
    """
    spark = vectors.sparkSession
    members, reps = distinct_vectors(vectors, id_col, vector_col, dims)
    reps = Stored(reps).df
    n = reps.count()
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    lists = lists or int(min(MOST_LISTS, max(1, round(n**0.5))))
    sample_rows = reps.orderBy(F.xxhash64("rep")).limit(min(LARGEST_SAMPLE, SAMPLE_PER_LIST * lists)).select("vector").toPandas()
    rotation = _rotation(dims, seed)
    if len(sample_rows):
        sample = _unit(np.stack(sample_rows["vector"].to_numpy())).astype(np.float32)
        centres = _centres(sample, min(lists, len(sample)), seed)
        probes = probes or probes_for(sample, centres, k, min_similarity)
    else:
        centres = np.zeros((1, dims), np.float32)
    probes = min(probes or 1, len(centres))
    shared = spark.sparkContext.broadcast((rotation, centres))  # at most MOST_LISTS + dims rows: 13 MB at 48 dimensions

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        centres = shared.value[1]
        for pdf in batches:
            for i in range(0, len(pdf), 8192):
                raw = np.stack(pdf["vector"].to_numpy()[i : i + 8192]).astype(np.float32)
                s = _unit(raw).astype(np.float32) @ centres.T
                top = np.argpartition(-s, probes - 1, axis=1)[:, :probes]
                top = np.take_along_axis(top, np.argsort(-np.take_along_axis(s, top, 1), axis=1, kind="stable"), 1)
                yield pd.DataFrame({"rep": pdf["rep"].to_numpy()[i : i + 8192], "unit": [r.tobytes() for r in raw], "near": list(top.astype(np.int32))})

    placed = Stored(reps.repartition(tasks).mapInPandas(assign, "rep bigint, unit binary, near array<int>")).df
    asks = placed
    if queries is not None:
        asking = members.where(queries).select("rep").distinct()
        asks = Stored(placed.join(asking, "rep", "left_semi")).df
    held = {r[0]: r[1] for r in placed.groupBy(F.col("near")[0]).count().collect()}  # at most MOST_LISTS rows
    wanted = {r[0]: r[1] for r in asks.select(F.explode("near").alias("l")).groupBy("l").count().collect()}
    cells = spark.createDataFrame([(i, -(-held.get(i, 0) // CELL_STORED) or 1, -(-wanted.get(i, 0) // CELL_ASKING) or 1) for i in range(len(centres))], "list int, blocks int, chunks int")
    cells = F.broadcast(cells)

    def spread(count: str) -> Column:
        return F.pmod(F.xxhash64("rep"), F.col(count)).cast("int")

    every = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    stored_side = placed.select("rep", "unit", F.col("near")[0].alias("list")).join(cells, "list").select("list", spread("blocks").alias("block"), every("chunks").alias("chunk"), F.lit(True).alias("held"), "rep", "unit")
    asking_side = asks.select("rep", "unit", F.explode("near").alias("list")).join(cells, "list").select("list", every("blocks").alias("block"), spread("chunks").alias("chunk"), F.lit(False).alias("held"), "rep", "unit")
    bound = float(2 - 2 * min_similarity) + 1e-6

    def scan(pdf: pd.DataFrame) -> pd.DataFrame:
        held = pdf["held"].to_numpy(dtype=bool)
        if held.all() or not held.any():
            return pd.DataFrame({"rep": np.zeros(0, np.int64), "other": np.zeros(0, np.int64), "similarity": np.zeros(0, np.float64)})
        x, ids = np.frombuffer(b"".join(pdf["unit"]), np.float32).reshape(len(pdf), dims), pdf["rep"].to_numpy(dtype=np.int64)
        a, b, s = scan_cell(ids[held], x[held], ids[~held], x[~held], k, bound, shared.value[0])
        return pd.DataFrame({"rep": a, "other": b, "similarity": s.astype(np.float64)})

    both = stored_side.unionByName(asking_side).repartition(max(tasks, min(len(centres), 4 * tasks)), "list", "block", "chunk")
    found = both.groupBy("list", "block", "chunk").applyInPandas(scan, "rep bigint, other bigint, similarity double")
    best = Window.partitionBy("rep").orderBy(F.desc("similarity"), "other")
    near = Stored(found.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k).select("rep", "other", "similarity")).df
    near = near.where(F.col("similarity") >= min_similarity)
    # Copies: k + 1 members of a representative are enough for any asker, itself included.
    few = members.withColumn("_r", F.row_number().over(Window.partitionBy("rep").orderBy("id"))).where(F.col("_r") <= k + 1).groupBy("rep").agg(F.collect_list("id").alias("ids"))
    few = Stored(few).df
    own = few.where(F.size("ids") > 1).select("rep", F.lit(1.0).alias("similarity"), "ids")
    theirs = near.join(few.withColumnRenamed("rep", "other"), "other").select("rep", "similarity", "ids")
    listed = (
        own.unionByName(theirs)
        .select("rep", F.transform("ids", lambda i: F.struct((-F.col("similarity")).alias("d"), i.alias("i"))).alias("c"))
        .groupBy("rep")
        .agg(F.sort_array(F.flatten(F.collect_list("c"))).alias("c"))  # at most (k + 1) ** 2 entries
    )
    askers = members if queries is None else members.where(queries)
    joined = lookup(askers, Stored(listed).df, "rep", "inner")
    others = F.slice(F.filter("c", lambda e: e["i"] != F.col("id")), 1, k)
    return joined.select("id", F.posexplode(others).alias("p", "e")).select("id", (F.col("p") + 1).alias("rank"), F.col("e.i").alias("neighbour"), (-F.col("e.d")).alias("similarity"))
