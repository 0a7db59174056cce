"""Problem 3 over writers and drawings."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkatlas.functions.names import read_name, read_person
from inkatlas.llm.splits import extend_stored_ledger, shared_key_links
from inkatlas.operators.skew import lookup
from inkatlas.sources.tables import table
from inkatlas.storage import Stored, shared_folder


def _writer_links(writers: DataFrame) -> DataFrame:
    """Links between writer rows: same dataset and writers that read the same, or the same person."""
    same_writer = F.concat_ws("/", "dataset", read_name(F.col("writer")))
    return shared_key_links(writers, "writer_key", [F.when(F.col("dataset").isNotNull() & F.col("writer").isNotNull(), same_writer), read_person(F.col("person_code"))])


def _ledger_path(spark: SparkSession) -> str:
    """A ledger that no other run shares: queries start from none, so that a run repeats another's result."""
    return f"{shared_folder(spark)}/ledger-{uuid.uuid4().hex}"


def _writer_sizes(writers: DataFrame) -> DataFrame:
    return writers.select(F.col("writer_key").alias("node"), F.lit(1).alias("size"))


def p3_found(spark: SparkSession, directory: str) -> DataFrame:
    """Writer rows that belong together with another, with the smallest writer_key of their group, from the ledger."""
    writers = table(spark, directory, "writers")
    ledger = extend_stored_ledger(_ledger_path(spark), _writer_links(writers), _writer_sizes(writers), table(spark, directory, "split_targets"))
    several = ledger.where("node <> component").select("component").distinct()
    return ledger.join(several, "component", "left_semi").select(F.col("node").alias("writer_key"), F.col("component").alias("group_key"))


#: Writers first seen before this day come in the first of two batches.
SECOND_BATCH = "2024-07-01"


def _two_batches(spark: SparkSession, directory: str) -> tuple[DataFrame, DataFrame]:
    """The ledger after the writers seen before SECOND_BATCH (or at no known time), and after all of them."""
    writers, targets, path = table(spark, directory, "writers"), table(spark, directory, "split_targets"), _ledger_path(spark)
    late = F.coalesce(F.col("first_seen") >= F.lit(SECOND_BATCH).cast("timestamp_ntz"), F.lit(False))
    early, rest = writers.where(~late), writers.where(late)
    first = extend_stored_ledger(path, _writer_links(early), _writer_sizes(early), targets)
    return first, extend_stored_ledger(path, _writer_links(writers), _writer_sizes(rest), targets)


def p3_batches(spark: SparkSession, directory: str) -> DataFrame:
    """Every writer row after two batches: its group, and how many groups of the first batch that joins (0: a new one)."""
    first, second = _two_batches(spark, directory)
    was = first.select("node", F.col("component").alias("was"))
    old = second.join(was, "node").groupBy("component").agg(F.countDistinct("was").alias("old_groups"))
    return second.join(old, "component", "left").select(F.col("node").alias("writer_key"), F.col("component").alias("group_key"), F.coalesce("old_groups", F.lit(0)).alias("old_groups"))


def p3_ledger(spark: SparkSession, directory: str) -> DataFrame:
    """What became of the rows of the second batch's ledger: rows and groups by status, split and split before."""
    second = _two_batches(spark, directory)[1]
    return second.groupBy("status", F.col("split").alias("split_name"), F.col("old_split").alias("split_before")).agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("component").alias("groups"))


def _drawing_nodes(spark: SparkSession, directory: str) -> DataFrame:
    """Each drawing's record: its writer row, or the negative row_id for a null writer, who is related to nobody.

    Drawings of a writer missing from the table writers share the record of the smallest row_id.
    """
    who = F.when(F.col("writer").isNotNull(), F.concat_ws("/", F.coalesce("dataset", F.lit("")), read_name(F.col("writer"))))
    drawings = Stored(table(spark, directory, "drawings").select("row_id", who.alias("who"))).df
    listed = table(spark, directory, "writers").select(who.alias("who"), F.col("writer_key")).where("who IS NOT NULL").groupBy("who").agg(F.min("writer_key").alias("key"))
    unlisted = drawings.where("who IS NOT NULL").groupBy("who").agg(F.min("row_id").alias("first"))
    keys = unlisted.join(listed, "who", "left").select("who", F.coalesce("key", -F.col("first")).alias("node"))
    return Stored(lookup(drawings, Stored(keys).df, "who").select("row_id", F.coalesce("node", -F.col("row_id")).alias("node"))).df


def p3_assignment(spark: SparkSession, directory: str) -> DataFrame:
    """Every drawing with its group and split, all drawings of a writer or person in one split."""
    nodes = _drawing_nodes(spark, directory)
    writers = table(spark, directory, "writers")
    sizes = nodes.select("node", F.lit(1).alias("size")).unionByName(writers.select(F.col("writer_key").alias("node"), F.lit(0).alias("size")))
    ledger = extend_stored_ledger(_ledger_path(spark), _writer_links(writers), sizes.groupBy("node").agg(F.sum("size").alias("size")), table(spark, directory, "split_targets"))
    return lookup(nodes, ledger.select("node", "component", "split"), "node").select("row_id", F.col("component").alias("group_key"), F.col("split").alias("split_name"))


def p3_shares(spark: SparkSession, directory: str) -> DataFrame:
    """Per split: target share, drawings and share reached, groups, and groups that lie in more than one split (0)."""
    given = Stored(p3_assignment(spark, directory)).df
    per_group = given.groupBy("group_key", "split_name").agg(F.count(F.lit(1)).alias("n"))
    splits = per_group.groupBy("group_key").agg(F.count(F.lit(1)).alias("splits"), F.min("split_name").alias("split_name"))
    torn = splits.groupBy("split_name").agg(F.sum(F.when(F.col("splits") > 1, 1).otherwise(0)).alias("torn_groups"))
    reached = per_group.groupBy("split_name").agg(F.sum("n").alias("drawings"), F.count(F.lit(1)).alias("groups"))
    total = reached.agg(F.sum("drawings").alias("total"))
    targets = table(spark, directory, "split_targets")
    return (
        targets.join(reached, "split_name", "left").join(torn, "split_name", "left").join(F.broadcast(total))
        .select("split_name", "target_share", F.coalesce("drawings", F.lit(0)).alias("drawings"), (F.coalesce("drawings", F.lit(0)) / F.col("total")).alias("share"), F.coalesce("groups", F.lit(0)).alias("groups"), F.coalesce("torn_groups", F.lit(0)).alias("torn_groups"))
    )


_DIGITS = "translate({}, '０１２３４５６７８９', '0123456789')"


def _read(column: str) -> str:
    return f"replace(regexp_replace(regexp_replace(upper({_DIGITS.format(column)}), '[^\\p{{L}}\\p{{M}}0-9]+', '|', 'g'), '0*([0-9]+)', '#\\1#', 'g'), '|', '')"


def _reach(name: str, where: str = "true") -> str:
    return f"""w_{name} AS (SELECT writer_key, dataset || '/' || {_read('writer')} AS k1, {_read('person_code')} AS p FROM writers WHERE {where}),
keyed_{name} AS (SELECT writer_key, 'w:' || k1 AS k FROM w_{name} WHERE k1 IS NOT NULL
UNION ALL SELECT writer_key, 'p:' || p FROM w_{name} WHERE p NOT IN ('', 'NA', 'NONE', 'UNKNOWN', 'ANONYMOUS')),
star_{name} AS (SELECT DISTINCT writer_key AS a, min(writer_key) OVER (PARTITION BY k) AS b FROM keyed_{name}),
twoway_{name} AS (SELECT a, b FROM star_{name} WHERE a <> b UNION SELECT b, a FROM star_{name} WHERE a <> b),
reach_{name} AS (SELECT a, a AS r FROM twoway_{name} UNION SELECT x.a, y.b FROM reach_{name} x JOIN twoway_{name} y ON x.r = y.a)"""


_EARLY = f"coalesce(first_seen < TIMESTAMP '{SECOND_BATCH}', true)"

SQL = {
    "p3_found": f"WITH RECURSIVE {_reach('all')} SELECT a AS writer_key, min(r) AS group_key FROM reach_all GROUP BY a",
    "p3_batches": f"""WITH RECURSIVE {_reach('all')}, {_reach('early', _EARLY)},
g AS (SELECT w.writer_key, coalesce(min(r), w.writer_key) AS group_key FROM writers w LEFT JOIN reach_all ON a = w.writer_key GROUP BY w.writer_key),
e AS (SELECT w.writer_key, coalesce(min(r), w.writer_key) AS was FROM writers w LEFT JOIN reach_early ON a = w.writer_key WHERE {_EARLY} GROUP BY w.writer_key),
o AS (SELECT group_key, count(DISTINCT was) AS old_groups FROM g JOIN e USING (writer_key) GROUP BY 1)
SELECT writer_key, g.group_key, coalesce(old_groups, 0) AS old_groups FROM g LEFT JOIN o ON g.group_key = o.group_key""",
}
QUERIES = {"p3_found": p3_found, "p3_batches": p3_batches, "p3_ledger": p3_ledger, "p3_assignment": p3_assignment, "p3_shares": p3_shares}
