"""Queries over drawings: splits, summaries, ink measures, images, links and percentiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkatlas.functions import hashing as H
from inkatlas.functions import links
from inkatlas.functions import text as T
from inkatlas.functions.names import read_split
from inkatlas.operators import datasets as D
from inkatlas.operators import lookups as L
from inkatlas.operators.augment import synthesize
from inkatlas.operators.raster import image_features, rasterize
from inkatlas.operators.skew import value_frequencies, weighted_percentiles
from inkatlas.sources.tables import table


def _drawings(spark: SparkSession, directory: str) -> DataFrame:
    return table(spark, directory, "drawings")


def stable_split(spark: SparkSession, directory: str) -> DataFrame:
    """Drawings held out for testing by their writer's hash, counted per dataset; a null writer is never held out."""
    test = F.coalesce(H.held_out(F.col("dataset"), F.col("writer")), F.lit(False))
    return _drawings(spark, directory).groupBy("dataset", test.alias("held_out")).agg(F.count(F.lit(1)).alias("drawings"), F.countDistinct("writer").alias("writers"))


def training_mask(spark: SparkSession, directory: str) -> DataFrame:
    """Rows to train on: neither their writer held out nor their character kept unseen."""
    test, unseen = F.coalesce(H.held_out(F.col("dataset"), F.col("writer")), F.lit(False)), F.coalesce(H.zero_shot(F.col("code_point")), F.lit(False))
    return _drawings(spark, directory).select("row_id", test.alias("held_out"), unseen.alias("zero_shot"), (~test & ~unseen).alias("training"))


def split_names(spark: SparkSession, directory: str) -> DataFrame:
    """The older assignment as read."""
    return _drawings(spark, directory).groupBy(read_split(F.col("split_name")).alias("split_name")).agg(F.count(F.lit(1)).alias("drawings"))


def writer_days(spark: SparkSession, directory: str) -> DataFrame:
    """Stand-in writers by the day of drawing."""
    ms = F.unix_millis(F.col("drawn_at").cast("timestamp"))
    return _drawings(spark, directory).groupBy(T.pseudo_writer(ms).alias("writer")).agg(F.count(F.lit(1)).alias("drawings"))


def dataset_summary(spark: SparkSession, directory: str) -> DataFrame:
    writer = F.when(F.col("writer").isNotNull(), F.struct("dataset", "writer"))
    return D.summary_by(_drawings(spark, directory), "dataset", writer, H.held_out(F.col("dataset"), F.col("writer")))


def samples_by_block(spark: SparkSession, directory: str) -> DataFrame:
    """Drawings per block of their character, unknown characters as ``?``."""
    blocks = table(spark, directory, "char_records").select("code_point", "block_name")
    known = _drawings(spark, directory).select("code_point", "dataset", "writer").join(blocks, "code_point", "left")
    return known.groupBy(F.coalesce("block_name", F.lit("?")).alias("block_name")).agg(F.count(F.lit(1)).alias("samples"), F.countDistinct("code_point").alias("characters"), F.count_if(H.held_out(F.col("dataset"), F.col("writer"))).alias("test_samples"))


def ink_bounds(spark: SparkSession, directory: str) -> DataFrame:
    """The box of every drawing's ink; without ink no row."""
    return _drawings(spark, directory).select("row_id", D.bounds(F.col("strokes")).alias("b")).where("b IS NOT NULL").select("row_id", "b.*")


def fitted_points(spark: SparkSession, directory: str) -> DataFrame:
    """Every drawing put into a 64-pixel square: sums over its points."""
    fit = _drawings(spark, directory).select("row_id", D.fitted(F.col("strokes")).alias("s")).where("s IS NOT NULL")
    points = F.flatten("s")
    total = lambda c: F.round(F.aggregate(F.transform(points, lambda p: p[c]), F.lit(0.0), lambda n, v: n + v), 4)
    return fit.select("row_id", F.size(points).alias("points"), total("x").alias("sum_x"), total("y").alias("sum_y"))


def ink_lengths(spark: SparkSession, directory: str) -> DataFrame:
    """Segments and length of every drawing's ink."""
    inked = _drawings(spark, directory).where("strokes IS NOT NULL")
    return inked.select("row_id", F.size(D.segments(F.col("strokes"))).alias("segments"), F.round(D.ink_length(F.col("strokes")), 4).alias("length"))


def arc_length(spark: SparkSession, directory: str) -> DataFrame:
    """The length so far at every point of the first stroke of each drawing."""
    first = _drawings(spark, directory).where("strokes IS NOT NULL").select("row_id", F.posexplode(F.get("strokes", F.lit(0))).alias("i", "p")).select("row_id", "i", F.col("p.x").cast("double").alias("x"), F.col("p.y").cast("double").alias("y"))
    return D.arc_lengths(first, ["row_id"], "i").select("row_id", "i", F.round("so_far", 4).alias("so_far"))


def lateness_percentiles(spark: SparkSession, directory: str) -> DataFrame:
    """Median, 90th and 95th percentile of the delay between drawing and arrival in microseconds, per dataset: the
    element at floor(n * q) of the sorted delays, at floor((n - 1) * q) for the 90th, from value frequencies."""
    late = _drawings(spark, directory).where("drawn_at IS NOT NULL").select("dataset", (F.unix_micros(F.col("ingested_at").cast("timestamp")) - F.unix_micros(F.col("drawn_at").cast("timestamp"))).alias("ms"))
    ranks = {"median": lambda n: F.least(F.floor(n * 0.5) + 1, n), "p90": lambda n: F.floor((n - 1) * 0.9) + 1, "p95": lambda n: F.least(F.floor(n * 0.95) + 1, n)}
    return weighted_percentiles(value_frequencies(late, ["dataset"], "ms"), ["dataset"], "ms", ranks)


def first_n_per_key(spark: SparkSession, directory: str) -> DataFrame:
    """The first three drawings of every character in order of arrival."""
    rows = _drawings(spark, directory).where("code_point IS NOT NULL").select("code_point", "row_id", "ingested_at")
    return L.first_per_key(rows, ["code_point"], [F.col("ingested_at"), F.col("row_id")], 3).select("code_point", "place", "row_id")


def first_row_per_key(spark: SparkSession, directory: str) -> DataFrame:
    """Each writer's first drawing."""
    rows = _drawings(spark, directory).where("writer IS NOT NULL")
    return rows.groupBy("dataset", "writer").agg(F.min_by(F.struct("row_id", "code_point"), F.struct("ingested_at", "row_id")).alias("f")).select("dataset", "writer", "f.row_id", "f.code_point")


def label_histogram(spark: SparkSession, directory: str) -> DataFrame:
    """Characters by number of drawings, with a running total from few to many."""
    from pyspark.sql import Window

    per = _drawings(spark, directory).where("code_point IS NOT NULL").groupBy("code_point").agg(F.count(F.lit(1)).alias("drawings"))
    counts = per.groupBy("drawings").agg(F.count(F.lit(1)).alias("characters"))
    return counts.withColumn("so_far", F.sum("characters").over(Window.orderBy("drawings").rowsBetween(Window.unboundedPreceding, 0)))  # one row for each distinct count


def json_strokes(spark: SparkSession, directory: str) -> DataFrame:
    """Ink written as JSON and read back: points and sum of x."""
    text = _drawings(spark, directory).where("strokes IS NOT NULL").select("row_id", F.to_json("strokes").alias("j"))
    back = text.select("row_id", F.flatten(F.from_json("j", "array<array<struct<x: float, y: float>>>")).alias("p"))
    return back.select("row_id", F.size("p").alias("points"), F.round(F.aggregate(F.transform("p", lambda q: q["x"].cast("double")), F.lit(0.0), lambda n, v: n + v), 3).alias("sum_x"))


def drawing_links(spark: SparkSession, directory: str) -> DataFrame:
    """Every drawing as a link's value, read back: whether all points agree to a tenth."""
    coded = _drawings(spark, directory).where("strokes IS NOT NULL").select("row_id", "strokes", links.encode_drawing(F.col("strokes")).alias("link"))
    back = coded.select("row_id", "link", F.flatten("strokes").alias("a"), F.flatten(links.decode_drawing(F.col("link"))).alias("b"))
    gap = F.array_max(F.zip_with("a", "b", lambda p, q: F.greatest(F.abs(p["x"] - q["x"]), F.abs(p["y"] - q["y"]))))
    return back.select("row_id", "link", (F.coalesce(gap, F.lit(9.0)) <= 0.0501).alias("agrees"))


def drawing_images(spark: SparkSession, directory: str) -> DataFrame:
    """Every drawing as a 64-pixel image: its number of inked pixels and digest."""
    images = rasterize(_drawings(spark, directory), "row_id", "strokes")
    return images.where("image IS NOT NULL").select("row_id", F.length("image").alias("bytes"), F.sha2("image", 256).alias("digest"))


def drawing_gradients(spark: SparkSession, directory: str) -> DataFrame:
    """Gradient histograms of every drawing: dimensions and largest value."""
    features = image_features(rasterize(_drawings(spark, directory), "row_id", "strokes"), "row_id")
    return features.select("row_id", F.size("vector").alias("dims"), F.round(F.array_max("vector"), 6).alias("largest"))


def synthetic_drawings(spark: SparkSession, directory: str) -> DataFrame:
    """Two hand-drawn-looking variants of every drawing: points and box."""
    made = synthesize(_drawings(spark, directory), "row_id", "strokes", 2)
    return made.select(F.col("id").alias("row_id"), "variant", F.size(F.flatten("strokes")).alias("points"), D.bounds(F.col("strokes")).alias("b")).select("row_id", "variant", "points", "b.*")


_FRACTION = "CAST(CAST('0x' || substr(sha256({}), 1, 16) AS UBIGINT) AS DOUBLE) / 18446744073709551616.0"
_HELD = f"coalesce({_FRACTION.format(chr(39) + 'test-split:' + chr(39) + ' || dataset || ' + chr(39) + ':' + chr(39) + ' || writer')} < 0.2, false)"
_UNSEEN = f"coalesce({_FRACTION.format(chr(39) + 'zero-shot:' + chr(39) + ' || upper(to_hex(code_point))')} < 0.1, false)"
_POINTS = "p AS (SELECT row_id, flatten(strokes) AS p FROM drawings WHERE strokes IS NOT NULL)"
_BOX = "x AS (SELECT row_id, p, list_min(list_transform(p, lambda q: CAST(q.x AS DOUBLE))) AS min_x, list_min(list_transform(p, lambda q: CAST(q.y AS DOUBLE))) AS min_y, list_max(list_transform(p, lambda q: CAST(q.x AS DOUBLE))) AS max_x, list_max(list_transform(p, lambda q: CAST(q.y AS DOUBLE))) AS max_y FROM p WHERE len(p) > 0)"

SQL = {
    "stable_split": f"SELECT dataset, {_HELD} AS held_out, count(*) AS drawings, count(DISTINCT writer) AS writers FROM drawings GROUP BY 1, 2",
    "training_mask": f"SELECT row_id, {_HELD} AS held_out, {_UNSEEN} AS zero_shot, NOT {_HELD} AND NOT {_UNSEEN} AS training FROM drawings",
    "split_names": """SELECT CASE WHEN s IN ('TRAIN', 'TRAINING') THEN 'train' WHEN s IN ('VALIDATION', 'VALID', 'VAL') THEN 'validation' WHEN s IN ('TEST', 'TESTSET') THEN 'test' END AS split_name, count(*) AS drawings
FROM (SELECT upper(regexp_replace(split_name, '[^A-Za-z]', '', 'g')) AS s FROM drawings) GROUP BY 1""",
    "writer_days": "SELECT coalesce('day-' || strftime(drawn_at, '%Y-%m-%d'), 'day-unknown') AS writer, count(*) AS drawings FROM drawings GROUP BY 1",
    "dataset_summary": f"""WITH d AS (SELECT coalesce(dataset, '?') AS dataset, code_point, CASE WHEN writer IS NOT NULL THEN {{'a': dataset, 'b': writer}} END AS w, {_HELD} AS t FROM drawings)
SELECT dataset, count(*) AS samples, count(DISTINCT code_point) AS characters, count(DISTINCT w) AS writers, count(*) FILTER (t) AS test_samples, count(DISTINCT w) FILTER (t) AS test_writers FROM d GROUP BY 1
UNION ALL SELECT 'all', count(*), count(DISTINCT code_point), count(DISTINCT w), count(*) FILTER (t), NULL FROM d""",
    "samples_by_block": f"SELECT coalesce(block_name, '?') AS block_name, count(*) AS samples, count(DISTINCT d.code_point) AS characters, count(*) FILTER ({_HELD}) AS test_samples FROM drawings d LEFT JOIN (SELECT code_point AS cp, block_name FROM char_records) c ON c.cp = d.code_point GROUP BY 1",
    "ink_bounds": f"WITH {_POINTS}, {_BOX} SELECT row_id, min_x, min_y, max_x, max_y FROM x",
    "fitted_points": f"""WITH {_POINTS}, {_BOX}, f AS (SELECT *, greatest(max_x - min_x, max_y - min_y) AS e FROM x), g AS (SELECT *, CASE WHEN e > 0 THEN {D.CONTENT * 64} / e ELSE 1 END AS s FROM f)
SELECT row_id, CAST(len(p) AS INTEGER) AS points, round(list_sum(list_transform(p, lambda q: (CAST(q.x AS DOUBLE) - (min_x + max_x) / 2) * s + 32)), 4) AS sum_x, round(list_sum(list_transform(p, lambda q: (CAST(q.y AS DOUBLE) - (min_y + max_y) / 2) * s + 32)), 4) AS sum_y FROM g""",
    "ink_lengths": """WITH s AS (SELECT row_id, unnest(strokes) AS k FROM drawings WHERE strokes IS NOT NULL), l AS (SELECT row_id, greatest(len(k) - 1, 1) AS n,
coalesce(list_sum(list_transform(range(1, len(k)), lambda i: sqrt(power(CAST(k[i + 1].x AS DOUBLE) - k[i].x, 2) + power(CAST(k[i + 1].y AS DOUBLE) - k[i].y, 2)))), 0) AS d FROM s WHERE len(k) > 0)
SELECT row_id, CAST(sum(n) AS INTEGER) AS segments, round(sum(d), 4) AS length FROM l GROUP BY 1""",
    "arc_length": """WITH f AS (SELECT row_id, strokes[1] AS k FROM drawings WHERE strokes IS NOT NULL), p AS (SELECT row_id, generate_subscripts(k, 1) - 1 AS i, unnest(k) AS q FROM f),
s AS (SELECT row_id, i, coalesce(sqrt(power(CAST(q.x AS DOUBLE) - lag(CAST(q.x AS DOUBLE)) OVER w, 2) + power(CAST(q.y AS DOUBLE) - lag(CAST(q.y AS DOUBLE)) OVER w, 2)), 0) AS step FROM p WINDOW w AS (PARTITION BY row_id ORDER BY i))
SELECT row_id, CAST(i AS INTEGER) AS i, round(sum(step) OVER (PARTITION BY row_id ORDER BY i), 4) AS so_far FROM s""",
    "lateness_percentiles": """WITH l AS (SELECT dataset, epoch_us(ingested_at) - epoch_us(drawn_at) AS ms FROM drawings WHERE drawn_at IS NOT NULL), g AS (SELECT dataset, list_sort(list(ms)) AS v FROM l GROUP BY 1)
SELECT dataset, v[1 + CAST(floor(len(v) * 0.5) AS INTEGER)] AS median, v[1 + CAST(floor((len(v) - 1) * 0.9) AS INTEGER)] AS p90, v[1 + CAST(floor(len(v) * 0.95) AS INTEGER)] AS p95 FROM g""",
    "first_n_per_key": "WITH r AS (SELECT code_point, row_id, row_number() OVER (PARTITION BY code_point ORDER BY ingested_at, row_id) AS place FROM drawings WHERE code_point IS NOT NULL) SELECT code_point, place, row_id FROM r WHERE place <= 3",
    "first_row_per_key": "WITH r AS (SELECT dataset, writer, row_id, code_point, row_number() OVER (PARTITION BY dataset, writer ORDER BY ingested_at, row_id) AS k FROM drawings WHERE writer IS NOT NULL) SELECT dataset, writer, row_id, code_point FROM r WHERE k = 1",
    "label_histogram": "WITH p AS (SELECT code_point, count(*) AS drawings FROM drawings WHERE code_point IS NOT NULL GROUP BY 1), h AS (SELECT drawings, count(*) AS characters FROM p GROUP BY 1) SELECT drawings, characters, CAST(sum(characters) OVER (ORDER BY drawings) AS BIGINT) AS so_far FROM h",
    "json_strokes": f"WITH {_POINTS} SELECT row_id, CAST(len(p) AS INTEGER) AS points, round(list_sum(list_transform(p, lambda q: CAST(q.x AS DOUBLE))), 3) AS sum_x FROM p",
}
QUERIES = {f.__name__: f for f in (
    stable_split, training_mask, split_names, writer_days, dataset_summary, samples_by_block, ink_bounds, fitted_points, ink_lengths, arc_length, lateness_percentiles, first_n_per_key,
    first_row_per_key, label_histogram, json_strokes, drawing_links, drawing_images, drawing_gradients, synthetic_drawings,
)}
