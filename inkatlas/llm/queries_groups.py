"""Problem 1 over match_pairs and signatures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkatlas.llm.components import connected_components
from inkatlas.operators.skew import lookup
from inkatlas.sources.tables import table
from inkatlas.storage import Stored


def p1_found(spark: SparkSession, directory: str) -> DataFrame:
    """The group of every signature with a kept link; group_id is the smallest sig_id of the group."""
    kept = table(spark, directory, "match_pairs").where("kept").select("first_sig", "second_sig")
    groups = connected_components(kept, "first_sig", "second_sig")
    return groups.select(F.col("node").alias("sig_id"), F.col("component").alias("group_id"))


def p1_all_groups(spark: SparkSession, directory: str) -> DataFrame:
    """Every signature with its group (itself if it has no kept link), its group's size and whether the group's
    signatures stand for more than one character."""
    signatures = Stored(table(spark, directory, "signatures").select("sig_id", "code_point")).df
    known = Stored(lookup(signatures, p1_found(spark, directory), "sig_id").select("sig_id", "code_point", F.coalesce("group_id", "sig_id").alias("group_id"))).df
    sizes = known.groupBy("group_id").agg(F.count(F.lit(1)).alias("group_size"), (F.min("code_point") < F.max("code_point")).alias("mixed"))
    return lookup(known, Stored(sizes).df, "group_id").select("sig_id", "group_id", "group_size", F.coalesce("mixed", F.lit(False)).alias("mixed"))


_REACH = """
WITH RECURSIVE link AS (SELECT DISTINCT first_sig AS a, second_sig AS b FROM match_pairs WHERE kept AND first_sig <> second_sig),
twoway AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (SELECT a, a AS r FROM twoway UNION SELECT reach.a, twoway.b FROM reach JOIN twoway ON reach.r = twoway.a)"""

SQL = {
    "p1_found": f"{_REACH} SELECT a AS sig_id, min(r) AS group_id FROM reach GROUP BY a",
    "p1_all_groups": f"""{_REACH}, g AS (SELECT a AS sig_id, min(r) AS group_id FROM reach GROUP BY a),
k AS (SELECT s.sig_id, s.code_point, coalesce(g.group_id, s.sig_id) AS group_id FROM signatures s LEFT JOIN g ON s.sig_id = g.sig_id)
SELECT sig_id, group_id, count(*) OVER (PARTITION BY group_id) AS group_size,
coalesce(min(code_point) OVER (PARTITION BY group_id) < max(code_point) OVER (PARTITION BY group_id), false) AS mixed FROM k""",
}
QUERIES = {"p1_found": p1_found, "p1_all_groups": p1_all_groups}
