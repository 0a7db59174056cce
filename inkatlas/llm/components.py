"""Groups of records linked directly or through others (problem 1)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkatlas.operators.skew import lookup
from inkatlas.storage import Stored

#: A forest or edge list is never deeper than this many rounds; far above the logarithm of any number of records.
MOST_ROUNDS = 64


def _jump(parents: Stored) -> Stored:
    """Pointer jumping: every node's label becomes its label's label, until no label changes."""
    for _ in range(MOST_ROUNDS):
        tops = parents.df.where("node <> label").select(F.col("node").alias("label"), F.col("label").alias("top"))
        # A node whose label is a root finds no row here and keeps its label.
        jumped = Stored(lookup(parents.df.select("node", "label"), tops, "label").select("node", F.coalesce("top", "label").alias("label"), F.col("top").isNotNull().alias("moved")))
        parents.drop()
        parents = jumped
        if parents.df.where("moved").limit(1).count() == 0:
            return parents
    raise RuntimeError("labels did not settle")


def connected_components(edges: DataFrame, first: str = "first", second: str = "second") -> DataFrame:
    """One row ``(node, component)`` for each node of at least one edge; ``component`` is the group's smallest node.

    Edges may come in either direction and repeatedly. Edges with a null end and edges from a node to itself link
    nothing, and a node that has only such edges is absent; no edges give an empty result. Extra columns are ignored.

    Each round (1) propagates the minimum label across edges, (2) jumps pointers until every label is a root, (3) moves
    the edges to the labels, where repeated edges and edges within a label vanish. Every round is written to the
    shared folder. Without edges no label can change any more; then the rounds' labels are read through, last to first.
    A hub's edges are reduced to a minimum before the shuffle and its label is looked up by broadcast.
    """
    a, b = F.col(first), F.col(second)
    known = edges.where(a.isNotNull() & b.isNotNull() & (a != b))
    current = Stored(known.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    rounds: list[Stored] = []
    while current.df.limit(1).count():
        if len(rounds) == MOST_ROUNDS:
            raise RuntimeError("components did not settle")
        ends = F.explode(F.array(F.struct(F.col("u").alias("node"), F.col("v").alias("near")), F.struct(F.col("v").alias("node"), F.col("u").alias("near"))))
        hooked = current.df.select(ends.alias("e")).select("e.*").groupBy("node").agg(F.min("near").alias("near"))
        labels = _jump(Stored(hooked.select("node", F.least("node", "near").alias("label"))))
        rounds.append(labels)
        label = labels.df.select("node", "label")
        half = Stored(lookup(current.df, label.withColumnsRenamed({"node": "u", "label": "lu"}), "u", "inner").select("v", "lu"))
        moved = lookup(half.df, label.withColumnsRenamed({"node": "v", "label": "lv"}), "v", "inner").where("lu <> lv")
        contracted = Stored(moved.select(F.greatest("lu", "lv").alias("u"), F.least("lu", "lv").alias("v")).distinct())
        half.drop()
        current.drop()
        current = contracted
    current.drop()
    if not rounds:
        return known.select(a.alias("node"), b.alias("component")).limit(0)
    settled = rounds.pop()
    while rounds:
        earlier = rounds.pop()
        tops = settled.df.select(F.col("node").alias("label"), F.col("label").alias("top"))
        through = Stored(lookup(earlier.df.select("node", "label"), tops, "label").select("node", F.coalesce("top", "label").alias("label")))
        earlier.drop()
        settled.drop()
        settled = through
    return settled.df.select("node", F.col("label").alias("component"))
