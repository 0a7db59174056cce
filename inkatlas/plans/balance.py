"""Problem 5: results per character and per label over drawings although a few keys hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkatlas.operators.skew import distinct_and_mode, value_frequencies, weighted_percentiles
from inkatlas.sources.tables import table

KEYS = ["key_field", "key_value"]
#: A key holds much if it has at least this share of all rows.
LARGE_SHARE = 0.025


def keyed(drawings: DataFrame, *values) -> DataFrame:
    """Two rows for each drawing, one keyed by its code point and one by its label, with the columns ``values``."""
    both = F.array(
        F.struct(F.lit("code_point").alias("key_field"), F.col("code_point").cast("string").alias("key_value")),
        F.struct(F.lit("label").alias("key_field"), F.col("label").alias("key_value")),
    )
    return drawings.select(F.explode(both).alias("_k"), *values).select("_k.*", *[v for v in _names(drawings, values)])


def _names(df: DataFrame, values) -> list[str]:
    return df.select(*values).columns if values else []


def p5_key_stats(spark: SparkSession, directory: str) -> DataFrame:
    """Per key field and value (null is a key of its own): rows, distinct writers, most frequent dataset, and the
    median and 90th percentile of the number of points, exact, from value frequencies.

    Drawings without strokes count as rows but have no number of points; an empty table gives an empty result.
    """
    drawings = table(spark, directory, "drawings")
    writer = F.when(F.col("writer").isNotNull(), F.struct("dataset", "writer")).alias("who")
    points = F.expr("aggregate(strokes, 0, (n, s) -> n + coalesce(size(s), 0))").alias("points")
    who = distinct_and_mode(value_frequencies(keyed(drawings, writer), KEYS, "who"), KEYS, "who")
    datasets = distinct_and_mode(value_frequencies(keyed(drawings, F.col("dataset")), KEYS, "dataset"), KEYS, "dataset")
    sizes = weighted_percentiles(value_frequencies(keyed(drawings, points), KEYS, "points"), KEYS, "points", {"median_points": 0.5, "p90_points": 0.9})
    a, b, c = who.alias("a"), datasets.alias("b"), sizes.alias("c")

    def same(x: str, y: str):
        return (F.col(f"{x}.key_field") == F.col(f"{y}.key_field")) & F.col(f"{x}.key_value").eqNullSafe(F.col(f"{y}.key_value"))

    return a.join(b, same("a", "b")).join(c, same("a", "c"), "left").select(
        "a.key_field", "a.key_value", "a.rows", F.col("a.n_distinct").alias("writers"), F.col("b.mode").alias("main_dataset"), "c.median_points", "c.p90_points"
    )


def p5_found(spark: SparkSession, directory: str) -> DataFrame:
    """Keys with at least 2.5 % of all rows of drawings, from the value frequencies of both keys."""
    drawings = table(spark, directory, "drawings")
    freqs = value_frequencies(keyed(drawings, F.col("dataset")), KEYS, "dataset")
    stats = distinct_and_mode(freqs, KEYS, "dataset")
    total = stats.where("key_field = 'label'").agg(F.sum("rows").alias("total"))  # one row
    return stats.join(F.broadcast(total), (F.col("rows") >= F.col("total") * LARGE_SHARE) & F.col("key_value").isNotNull()).select(*KEYS)


_KEYED_SQL = """
  SELECT 'code_point' AS key_field, CAST(code_point AS VARCHAR) AS key_value, dataset, writer, strokes FROM drawings
  UNION ALL SELECT 'label', label, dataset, writer, strokes FROM drawings"""

SQL = {
    "p5_found": f"""
WITH k AS ({_KEYED_SQL})
SELECT key_field, key_value FROM k WHERE key_value IS NOT NULL GROUP BY 1, 2
HAVING count(*) >= 0.025 * (SELECT count(*) FROM drawings)""",
    "p5_key_stats": f"""
WITH k AS ({_KEYED_SQL}),
sized AS (SELECT key_field, key_value, list_sum(list_transform(strokes, lambda s: len(s))) AS points FROM k WHERE strokes IS NOT NULL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY key_field, key_value ORDER BY points) AS rn, count(*) OVER (PARTITION BY key_field, key_value) AS n FROM sized),
pct AS (SELECT key_field, key_value, min(CASE WHEN rn >= ceil(n * 0.5) THEN points END) AS median_points, min(CASE WHEN rn >= ceil(n * 0.9) THEN points END) AS p90_points FROM ranked GROUP BY 1, 2),
freq AS (SELECT key_field, key_value, dataset, count(*) AS f FROM k GROUP BY 1, 2, 3),
mode AS (SELECT key_field, key_value, dataset AS main_dataset FROM (SELECT *, row_number() OVER (PARTITION BY key_field, key_value ORDER BY f DESC, dataset) AS r FROM freq WHERE dataset IS NOT NULL) WHERE r = 1),
base AS (SELECT key_field, key_value, CAST(count(*) AS BIGINT) AS rows, CAST(count(DISTINCT CASE WHEN writer IS NOT NULL THEN {{'d': dataset, 'w': writer}} END) AS BIGINT) AS writers FROM k GROUP BY 1, 2)
SELECT b.key_field, b.key_value, b.rows, b.writers, m.main_dataset, CAST(p.median_points AS INTEGER) AS median_points, CAST(p.p90_points AS INTEGER) AS p90_points
FROM base b LEFT JOIN mode m ON b.key_field = m.key_field AND b.key_value IS NOT DISTINCT FROM m.key_value
LEFT JOIN pct p ON b.key_field = p.key_field AND b.key_value IS NOT DISTINCT FROM p.key_value""",
}

QUERIES = {"p5_found": p5_found, "p5_key_stats": p5_key_stats}
