"""Filling fixed-capacity containers with texts (problem 6).

Cost-balanced packing: a text of n tokens costs n + n * n / QUADRATIC, the linear and the attention part of a training
step. Texts in descending size go to the container of lowest cost that has room. Containers are filled shard by shard;
a shard holds sizes only, a bounded number of them.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkatlas.llm.tokens import with_tokens
from inkatlas.storage import Stored

CAPACITY = 2_048
#: The size at which the attention part of the cost equals the linear part.
QUADRATIC = 4_096
#: About so many pieces are packed together; one container of each shard may stay partly empty.
SHARD_PIECES = 50_000


def pack_sizes(sizes: np.ndarray, capacity: int = CAPACITY, quadratic: float = QUADRATIC) -> np.ndarray:
    """The container number of each size (all at most ``capacity``).

    Starts with as many containers as the sum of sizes needs. In descending order (equal sizes in given order) each size
    goes to the container of lowest cost with room; a container without room is set aside until sizes fit again. If no
    container has room, a new one is opened.
    """
    where = np.full(len(sizes), -1, np.int64)
    count = max(1, -(-int(sizes.sum()) // capacity))
    room = [capacity] * count
    open_ = [(0.0, c) for c in range(count)]  # cost, container: already a heap
    aside: dict[int, list[tuple[float, int]]] = defaultdict(list)
    rooms: list[int] = []  # the rooms in ``aside``, largest first
    for i in np.argsort(-sizes, kind="stable"):
        size = int(sizes[i])
        while rooms and -rooms[0] >= size:
            for entry in aside.pop(-heapq.heappop(rooms), []):
                heapq.heappush(open_, entry)
        while open_ and room[open_[0][1]] < size:
            entry = heapq.heappop(open_)
            r = room[entry[1]]
            if r:
                if r not in aside:
                    heapq.heappush(rooms, -r)
                aside[r].append(entry)
        cost, c = heapq.heappop(open_) if open_ else (0.0, len(room))
        if c == len(room):
            room.append(capacity)
        room[c] -= size
        where[i] = c
        heapq.heappush(open_, (cost + size + size * size / quadratic, c))
    return where


def offsets_in(where: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each piece's place in its container, from 0, and the tokens in front of it; pieces lie there in given order."""
    order = np.argsort(where, kind="stable")
    first = np.r_[True, where[order][1:] != where[order][:-1]] if len(order) else np.zeros(0, bool)
    begin = np.flatnonzero(first)
    lens = np.diff(np.r_[begin, len(order)])
    before = np.r_[0, np.cumsum(sizes[order])][:-1]
    place, offset = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
    place[order] = np.arange(len(order)) - np.repeat(begin, lens)
    offset[order] = before - np.repeat(before[begin], lens)
    return place, offset


def pack(documents: DataFrame, id_col: str, text_col: str, capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """``(id, piece, first_token, tokens, pieces, container, place, offset)``: every text's pieces with their containers.

    A text of at most ``capacity`` tokens is one piece; a longer one is cut into full pieces and a rest. ``place`` is the
    piece's order in its container and ``offset`` the tokens in front of it. Null and empty texts are one piece of 0
    tokens without a container. Rows are separate texts even if their ids repeat. Containers are named ``shard:number``
    or, if one full piece fills them, ``full:row:piece``, and hold at most ``capacity`` tokens. Nothing is dropped; an
    empty table gives an empty result.
    """
    sizes = Stored(with_tokens(documents, id_col, text_col, path=tokenizer).withColumn("_row", F.monotonically_increasing_id())).df
    pieces = F.greatest(F.ceil(F.col("tokens") / capacity), F.lit(1))
    cut = sizes.withColumn("pieces", pieces.cast("int")).select("_row", "id", "pieces", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"), F.col("tokens").alias("_all"))
    cut = cut.select("_row", "id", "piece", (F.col("piece").cast("bigint") * capacity).alias("first_token"), F.least(F.col("_all") - F.col("piece").cast("bigint") * capacity, F.lit(capacity)).alias("tokens"), "pieces")
    full = F.col("tokens") == capacity
    count = cut.where(~full & (F.col("tokens") > 0)).count()
    shards = max(1, round(count / SHARD_PIECES))
    # Full pieces and empty texts need no search.
    none = F.when(full, F.lit(0).cast("bigint"))
    settled = cut.where(full | (F.col("tokens") == 0)).select("id", "piece", "first_token", "tokens", "pieces", F.when(full, F.concat_ws(":", F.lit("full"), "_row", "piece")).alias("container"), none.alias("place"), none.alias("offset"))
    open_ = cut.where(~full & (F.col("tokens") > 0)).repartition(shards, F.xxhash64("_row", "piece"))

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        held = [b for b in batches if len(b)]  # numbers only, about SHARD_PIECES rows
        if held:
            pdf = pd.concat(held, ignore_index=True).sort_values(["id", "piece", "tokens"], kind="stable").drop(columns="_row")
            where = pack_sizes(pdf["tokens"].to_numpy(), capacity)
            pdf["container"] = [f"{shard}:{c}" for c in where]
            pdf["place"], pdf["offset"] = offsets_in(where, pdf["tokens"].to_numpy())
            yield pdf

    schema = "id bigint, piece int, first_token bigint, tokens bigint, pieces int, container string, place bigint, offset bigint"
    return settled.unionByName(open_.mapInPandas(fill, schema))
