"""Queries that build a character set, route fonts and format values, and the recogniser from strokes to tiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkatlas.functions import hashing as H
from inkatlas.functions.vectors import mean_vectors
from inkatlas.operators import charset as C
from inkatlas.operators import ranking as R
from inkatlas.operators.lookups import first_match
from inkatlas.operators.raster import image_features, rasterize
from inkatlas.plans.recognition import prior_of
from inkatlas.sources.tables import table

#: Keyboards by language; a language that is not listed has the Latin one.
LANGUAGE_SCRIPTS = {"ru": ["Cyrillic"], "el": ["Latin", "Greek"]}
#: The configuration of the example set.
CONFIG = ([("letters", ["Latin Extended-A", "Greek and Coptic"]), ("signs", ["Arrows", "Mathematical Operators"]), ("greek", ["Greek and Coptic"])], ["Mn"], ["Coptic"], [("U+2192", "arrow")], ["U+2200"])


def _blocks(spark: SparkSession, directory: str) -> DataFrame:
    return table(spark, directory, "char_records").where("block_name IS NOT NULL").groupBy("block_name").agg(F.min("code_point").alias("first"), F.max("code_point").alias("last"))


def _config(spark: SparkSession, directory: str) -> DataFrame:
    """The example configuration, of those of its blocks that the table has."""
    have = {r[0] for r in _blocks(spark, directory).select("block_name").collect()}  # a list of blocks
    groups = [(name, [b for b in blocks if b in have]) for name, blocks in CONFIG[0]]
    return spark.createDataFrame([(groups, *CONFIG[1:])], C.CONFIG)


def charset_build(spark: SparkSession, directory: str) -> DataFrame:
    """Candidates of the example set with their group and what becomes of them."""
    return C.build_charset(_config(spark, directory), table(spark, directory, "char_records"), _blocks(spark, directory))


def charset_counts(spark: SparkSession, directory: str) -> DataFrame:
    """The counts of the set's document, as rows."""
    doc = C.charset_document(charset_build(spark, directory))
    return doc.select(F.explode("by_group").alias("name", "n")).withColumn("kind", F.lit("group")).unionByName(doc.select(F.explode("by_reason").alias("name", "n")).withColumn("kind", F.lit("reason")))


def composite_key_join(spark: SparkSession, directory: str) -> DataFrame:
    """Drawings of writers listed under exactly their dataset and spelling: a join on two keys."""
    writers = table(spark, directory, "writers").select("dataset", "writer", "writer_key")
    return table(spark, directory, "drawings").select("row_id", "dataset", "writer").join(writers, ["dataset", "writer"]).select("row_id", "writer_key")


def font_rejections(spark: SparkSession, directory: str) -> DataFrame:
    """Renders by font and the first reason that rejects them: blank, without a font, or of a character whose block the
    font (here by its style) is not wanted for."""
    wanted = F.when(F.col("font_id").contains("serif"), F.array(F.lit("Arrows"), F.lit("Mathematical Operators"))).otherwise(F.array("block_name"))
    known = table(spark, directory, "signatures").join(table(spark, directory, "char_records").select("code_point", "block_name"), "code_point", "left")
    reason = first_match([("no font", F.col("font_id").isNull()), ("no image", F.col("mask_bits").isNull()), ("blank", F.col("ink_pixels") == 0), ("unknown character", F.col("block_name").isNull()), ("block not wanted", ~F.array_contains(wanted, F.col("block_name")))], "kept")
    return known.groupBy("font_id", reason.alias("reason")).agg(F.count(F.lit(1)).alias("renders"))


def ranked_characters(spark: SparkSession, directory: str) -> DataFrame:
    """The 40 most drawn characters with their place in the report."""
    from pyspark.sql import Window

    top = table(spark, directory, "drawings").where("code_point IS NOT NULL").groupBy("code_point").agg(F.count(F.lit(1)).alias("drawings")).orderBy(F.desc("drawings"), "code_point").limit(40)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("drawings"), "code_point")))  # 40 rows


def iso_time(at: Column) -> Column:
    """A time as ISO 8601 text in seconds."""
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss")


def duration(seconds: Column) -> Column:
    """``1:02:03``, ``2:03`` below an hour; null stays null."""
    whole = F.floor(seconds)
    minutes, rest = F.lpad((F.floor(whole / 60) % 60).cast("string"), 2, "0"), F.lpad((whole % 60).cast("string"), 2, "0")
    return F.when(whole >= 3600, F.concat_ws(":", F.floor(whole / 3600).cast("string"), minutes, rest)).otherwise(F.concat_ws(":", F.floor(whole / 60).cast("string"), rest))


def formatted_times(spark: SparkSession, directory: str) -> DataFrame:
    """When each dataset's drawings begin, and how long they took to arrive at most, as text."""
    rows = table(spark, directory, "drawings").where("drawn_at IS NOT NULL AND ingested_at >= drawn_at")
    late = F.unix_seconds(F.col("ingested_at").cast("timestamp")) - F.unix_seconds(F.col("drawn_at").cast("timestamp"))
    return rows.groupBy("dataset").agg(iso_time(F.min("drawn_at")).alias("first"), duration(F.max(late)).alias("longest"), duration(F.min(late)).alias("shortest"))


def scripts_for(language: Column) -> Column:
    """The scripts of a language's keyboard, Latin for any other; a lookup in a map with a default."""
    entries = F.map_from_arrays(F.array(*[F.lit(k) for k in LANGUAGE_SCRIPTS]), F.array(*[F.array(*[F.lit(s) for s in v]) for v in LANGUAGE_SCRIPTS.values()]))
    return F.coalesce(F.try_element_at(entries, language), F.array(F.lit("Latin")))


def language_keyboards(spark: SparkSession, directory: str) -> DataFrame:
    """Documents by language (lower case) and its keyboard."""
    lang = F.lower(F.trim("lang"))
    return table(spark, directory, "documents").where("lang IS NOT NULL").groupBy(lang.alias("lang")).agg(F.count(F.lit(1)).alias("documents")).select("lang", F.array_join(scripts_for(F.col("lang")), "+").alias("scripts"), "documents")


def index_budget(spark: SparkSession, directory: str) -> DataFrame:
    """Whether an index of one byte a value would keep to 300 kB."""
    sizes = table(spark, directory, "glyph_vectors").where("embedding IS NOT NULL").select((F.size("embedding") + 4).alias("bytes"))
    return C.within_budget(sizes, "bytes", 300_000)


def learning_rate(step: Column, warm: int, total: int, top: float) -> Column:
    """Linear warm-up to ``top``, then half a cosine down to 0 at ``total``."""
    part = F.least(F.greatest((step - warm) / (total - warm), F.lit(0.0)), F.lit(1.0))
    return F.when(step < warm, F.lit(top) * (step + 1) / warm).otherwise(F.lit(top / 2) * (1 + F.cos(F.lit(3.141592653589793) * part)))


def learning_rates(spark: SparkSession, directory: str) -> DataFrame:
    """The schedule at every 100th of 1,000 steps."""
    return spark.range(0, 1001, 100).select(F.col("id").alias("step"), F.round(learning_rate(F.col("id"), 200, 1000, 0.01), 8).alias("rate"))


def recognize(drawings: DataFrame, index: DataFrame, groups: DataFrame, prior: DataFrame | None = None, language: str = "en", tiles: int = 5, characters: int = 10, accept: Column | None = None, features: str = "pooled") -> DataFrame:
    """From strokes to answers: ``(q, kind, rank, group, code_point, score)``, kind being ``character`` or ``tile``.

    ``drawings``: ``(q, strokes)``; ``index``: ``(code_point, vector)`` of the same ``features``; ``groups``:
    ``(code_point, group, script, general_category)``. Drawings without a point have no row. A tile shows the character
    of its group that the language's keyboard cannot type last. ``accept`` restricts characters before ranking.
    """
    asks = image_features(rasterize(drawings, "q", "strokes"), "q", features)
    known = index.join(groups.select("code_point", "group"), "code_point", "left").select("code_point", "vector", F.coalesce("group", "code_point").alias("group"))
    known = R.with_bonus(known if accept is None else R.restrict(known, accept), prior)
    single = R.best_matches(asks, known.withColumn("key", F.col("code_point")), characters)
    tiled = R.best_matches(asks, known.withColumn("key", F.col("group")), tiles)
    members = groups if prior is None else groups.join(prior.select("code_point", "log_prior"), "code_point", "left")
    members = members if "log_prior" in members.columns else members.withColumn("log_prior", F.lit(None).cast("double"))
    menu = R.chooser(members, LANGUAGE_SCRIPTS.get(language, ["Latin"])).select(F.col("group").cast("bigint").alias("key"), "representative")
    shown = tiled.join(menu, "key", "left").select("q", F.lit("tile").alias("kind"), "rank", F.col("key").alias("group"), F.coalesce("representative", "code_point").alias("code_point"), "score")
    return single.select("q", F.lit("character").alias("kind"), "rank", F.lit(None).cast("bigint").alias("group"), "code_point", "score").unionByName(shown)


def recognize_drawings(spark: SparkSession, directory: str) -> DataFrame:
    """Drawings of held-out writers, recognised from their strokes against the mean image of each character that the
    other writers drew."""
    drawings = table(spark, directory, "drawings").where("strokes IS NOT NULL AND code_point IS NOT NULL")
    test = F.coalesce(H.held_out(F.col("dataset"), F.col("writer")), F.lit(False))
    known = image_features(rasterize(drawings.where(~test), "row_id", "strokes"), "row_id", "pooled").join(drawings.select("row_id", "code_point"), "row_id")
    index = mean_vectors(known, "code_point", "vector")
    records = table(spark, directory, "char_records").select("code_point", F.coalesce("simple_lowercase", "code_point").alias("group"), F.coalesce("script", F.lit("Unknown")).alias("script"), "general_category")
    return recognize(drawings.where(test).select(F.col("row_id").alias("q"), "strokes"), index, records, prior_of(spark, directory), "en", 5, 10)


_NAMED = "(SELECT block_name, min(code_point) AS first, max(code_point) AS last FROM char_records WHERE block_name IS NOT NULL GROUP BY 1)"
_BUILD = f"""cfg AS (SELECT * FROM (VALUES (0, 'letters', 'Latin Extended-A'), (0, 'letters', 'Greek and Coptic'), (1, 'signs', 'Arrows'), (1, 'signs', 'Mathematical Operators'), (2, 'greek', 'Greek and Coptic')) v(place, grp, block_name)),
cand AS (SELECT place, grp, unnest(range(first, last + 1)) AS code_point FROM cfg JOIN {_NAMED} b USING (block_name) UNION ALL SELECT 99, 'arrow', 8594),
one AS (SELECT code_point, arg_max(grp, place) AS grp FROM cand WHERE code_point <> 8704 GROUP BY 1),
built AS (SELECT c.code_point, grp AS "group", CASE WHEN c.code_point = 8594 THEN 'kept' WHEN general_category = 'Mn' THEN 'category' WHEN script = 'Coptic' THEN 'script' ELSE 'kept' END AS reason FROM one JOIN char_records c ON c.code_point = one.code_point)"""
_CLOCK = "CASE WHEN {0} >= 3600 THEN CAST({0} // 3600 AS VARCHAR) || ':' || lpad(CAST({0} // 60 % 60 AS VARCHAR), 2, '0') ELSE CAST({0} // 60 AS VARCHAR) END || ':' || lpad(CAST({0} % 60 AS VARCHAR), 2, '0')"

SQL = {
    "charset_build": f"WITH {_BUILD} SELECT * FROM built",
    "charset_counts": f"WITH {_BUILD} SELECT 'group' AS kind, \"group\" AS name, count(*) AS n FROM built WHERE reason = 'kept' GROUP BY 2 UNION ALL SELECT 'reason', reason, count(*) FROM built GROUP BY 2",
    "composite_key_join": "SELECT row_id, writer_key FROM drawings d JOIN writers w ON d.dataset = w.dataset AND d.writer = w.writer",
    "font_rejections": """SELECT font_id, CASE WHEN font_id IS NULL THEN 'no font' WHEN mask_bits IS NULL THEN 'no image' WHEN ink_pixels = 0 THEN 'blank' WHEN block_name IS NULL THEN 'unknown character'
 WHEN font_id LIKE '%serif%' AND block_name NOT IN ('Arrows', 'Mathematical Operators') THEN 'block not wanted' ELSE 'kept' END AS reason, count(*) AS renders
FROM signatures s LEFT JOIN (SELECT code_point AS cp, block_name FROM char_records) c ON c.cp = s.code_point GROUP BY 1, 2""",
    "ranked_characters": "SELECT code_point, count(*) AS drawings, row_number() OVER (ORDER BY count(*) DESC, code_point) AS rank FROM drawings WHERE code_point IS NOT NULL GROUP BY 1 ORDER BY rank LIMIT 40",
    "formatted_times": f"""WITH l AS (SELECT dataset, drawn_at, CAST(floor(epoch(ingested_at)) - floor(epoch(drawn_at)) AS BIGINT) AS s FROM drawings WHERE drawn_at IS NOT NULL AND ingested_at >= drawn_at),
g AS (SELECT dataset, min(drawn_at) AS f, max(s) AS a, min(s) AS b FROM l GROUP BY 1) SELECT dataset, strftime(f, '%Y-%m-%dT%H:%M:%S') AS first, {_CLOCK.format('a')} AS longest, {_CLOCK.format('b')} AS shortest FROM g""",
    "language_keyboards": "SELECT lower(trim(lang)) AS lang, CASE lower(trim(lang)) WHEN 'ru' THEN 'Cyrillic' WHEN 'el' THEN 'Latin+Greek' ELSE 'Latin' END AS scripts, count(*) AS documents FROM documents WHERE lang IS NOT NULL GROUP BY 1, 2",
    "index_budget": "SELECT CAST(sum(len(embedding) + 4) AS BIGINT) AS bytes, CAST(300000 AS BIGINT) AS budget, sum(len(embedding) + 4) <= 300000 AS within FROM glyph_vectors WHERE embedding IS NOT NULL",
    "learning_rates": "SELECT step, round(CASE WHEN step < 200 THEN 0.01 * (step + 1) / 200 ELSE 0.005 * (1 + cos(pi() * (step - 200) / 800.0)) END, 8) AS rate FROM range(0, 1001, 100) r(step)",
}
QUERIES = {f.__name__: f for f in (charset_build, charset_counts, composite_key_join, font_rejections, ranked_characters, formatted_times, language_keyboards, index_budget, learning_rates, recognize_drawings)}
