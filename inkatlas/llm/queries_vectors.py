"""Problem 2 over glyph_vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkatlas.llm.neighbours import most_similar
from inkatlas.sources.tables import table

DIMS, NEIGHBOURS, SIMILAR = 48, 5, 0.9
#: Searches ask for every row whose id is divisible by this, against all rows.
ASKED = 50


def p2_found(spark: SparkSession, directory: str) -> DataFrame:
    """Pairs of which one is among the other's five most similar, with a cosine of at least 0.9."""
    vectors = table(spark, directory, "glyph_vectors")
    near = most_similar(vectors, "vec_id", "embedding", DIMS, NEIGHBOURS, SIMILAR)
    return near.select(F.least("id", "neighbour").alias("vec_a"), F.greatest("id", "neighbour").alias("vec_b")).distinct()


def p2_neighbours(spark: SparkSession, directory: str) -> DataFrame:
    """The five most similar vectors, however similar, of every vector whose id is divisible by 50."""
    vectors = table(spark, directory, "glyph_vectors")
    return most_similar(vectors, "vec_id", "embedding", DIMS, NEIGHBOURS, queries=F.col("id") % ASKED == 0)


SQL: dict[str, str] = {}
QUERIES = {"p2_found": p2_found, "p2_neighbours": p2_neighbours}
