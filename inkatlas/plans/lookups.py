"""Lookup, routing, pairing and set queries over the dimension and fact tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkatlas.functions import text as T
from inkatlas.functions.names import read_name
from inkatlas.operators import confusables as C
from inkatlas.operators import lookups as L
from inkatlas.operators.ranking import on_every_keyboard, priority_pick
from inkatlas.sources.tables import table

#: Fixed value: the fonts a character is shown in, most wanted first.
FONTS = ("quillsans-regular", "quillserif-regular", "halyard-symbols", "larkspur-regular", "fennel-hand")


def _records(spark: SparkSession, directory: str) -> DataFrame:
    return table(spark, directory, "char_records")


def _blocks(spark: SparkSession, directory: str) -> DataFrame:
    return _records(spark, directory).where("block_name IS NOT NULL").groupBy("block_name").agg(F.min("code_point").alias("first"), F.max("code_point").alias("last"))


def block_range_join(spark: SparkSession, directory: str) -> DataFrame:
    """Documents per block of the character they are about, found by range; outside all blocks: ``?``."""
    subjects = table(spark, directory, "documents").select("subject_cp")
    return L.range_lookup(subjects, "subject_cp", _blocks(spark, directory), "block_name", "?").groupBy("block_name").agg(F.count(F.lit(1)).alias("documents"))


def range_overlap_check(spark: SparkSession, directory: str) -> DataFrame:
    """Blocks widened by 100 code points overlap their predecessors; the check lists them."""
    wide = _blocks(spark, directory).select("block_name", (F.col("first") - 100).alias("first"), (F.col("last") + 100).alias("last"))
    return L.overlapping_ranges(wide)


def range_expand(spark: SparkSession, directory: str) -> DataFrame:
    """Members of every block's range that have no record: how many code points are uncovered."""
    members = L.expand_ranges(_blocks(spark, directory))
    missing = members.join(_records(spark, directory).select("code_point"), "code_point", "left_anti")
    return missing.groupBy("block_name").agg(F.count(F.lit(1)).alias("missing"), F.min("code_point").alias("first_missing"))


def exclusion_counts(spark: SparkSession, directory: str) -> DataFrame:
    """Characters by the first rule that excludes them, or kept."""
    rules = [("category", F.col("general_category").isin("Sc", "Sk", "Nd")), ("unnamed", F.col("char_name").isNull()), ("script", F.col("script").isin("Coptic")), ("no script", F.col("script").isNull())]
    return _records(spark, directory).groupBy(L.first_match(rules, "kept").alias("reason")).agg(F.count(F.lit(1)).alias("characters"))


def character_kinds(spark: SparkSession, directory: str) -> DataFrame:
    """Characters by kind, script keyboards and how they are shown."""
    kinds = [("mark", F.startswith("general_category", F.lit("M"))), ("letter", F.startswith("general_category", F.lit("L"))), ("arrow", F.contains("block_name", F.lit("Arrows"))), ("mathematical", F.col("general_category") == "Sm"), ("shape", F.col("charset_group") == "shapes")]
    shown = T.display_text(T.char_of(F.col("code_point")), F.col("general_category"))
    return _records(spark, directory).select("code_point", T.format_code_point(F.col("code_point")).alias("notation"), shown.alias("shown"), L.first_match(kinds, "other").alias("kind"), on_every_keyboard(F.col("script"), F.col("general_category")).alias("everywhere"), T.parse_code_point(T.format_code_point(F.col("code_point"))).alias("parsed"))


def case_pair_list(spark: SparkSession, directory: str) -> DataFrame:
    return C.case_pairs(_records(spark, directory))


def _skeletons(spark: SparkSession, directory: str) -> DataFrame:
    """Stand-in for a skeleton table: the target is the lower-case form."""
    return _records(spark, directory).where("simple_lowercase IS NOT NULL").select(F.col("code_point").alias("source"), F.array("simple_lowercase").alias("target"))


def skeleton_pair_list(spark: SparkSession, directory: str) -> DataFrame:
    return C.skeleton_pairs(_records(spark, directory), _skeletons(spark, directory))


def pair_union_first(spark: SparkSession, directory: str) -> DataFrame:
    """Case and skeleton pairs with the source that comes first, counted."""
    parts = [("confusables", skeleton_pair_list(spark, directory)), ("case", case_pair_list(spark, directory))]
    return L.union_first(parts, ["first", "second"]).groupBy("source").agg(F.count(F.lit(1)).alias("pairs"))


def pair_source_report(spark: SparkSession, directory: str) -> DataFrame:
    """Pairs by source: all, kept, rejected, undecided, and their mean similarity."""
    pairs = table(spark, directory, "match_pairs")
    return pairs.groupBy("pair_source").agg(F.count(F.lit(1)).alias("pairs"), F.count_if("kept").alias("kept"), F.count_if(~F.col("kept")).alias("rejected"), F.count_if(F.col("kept").isNull()).alias("undecided"), F.round(F.avg("similarity"), 6).alias("similarity"))


def name_cascade(spark: SparkSession, directory: str) -> DataFrame:
    """The character of each drawing label: by the labels' own majority-free mapping, else by name, else unresolved."""
    drawings = table(spark, directory, "drawings")
    labels = drawings.where("label IS NOT NULL").select("label").distinct()
    own = drawings.where("label IS NOT NULL AND code_point IS NOT NULL").select("label", "code_point").distinct()
    single = _records(spark, directory).select(T.char_of(F.col("code_point")).alias("label"), "code_point")
    return L.cascade(labels, "label", [("drawn", own), ("character", single)], "code_point")


def status_routing(spark: SparkSession, directory: str) -> DataFrame:
    """Drawings by what becomes of them: rows, distinct labels and writers."""
    drawings = table(spark, directory, "drawings").select("label", "dataset", "writer", "code_point", F.coalesce(F.size("strokes") > 0, F.lit(False)).alias("inked"))
    allowed = _records(spark, directory).where("charset_group <> 'technical'").select("code_point", F.lit(True).alias("allowed"))
    routed = drawings.join(allowed, "code_point", "left")
    status = L.first_match([("no mapping", F.col("code_point").isNull()), ("outside set", F.col("allowed").isNull()), ("no strokes", ~F.col("inked"))], "kept")
    return routed.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("samples"), F.countDistinct("label").alias("labels"), F.countDistinct("dataset", "writer").alias("writers"))


def semi_allowed(spark: SparkSession, directory: str) -> DataFrame:
    """Vectors of characters that someone has drawn."""
    # Distinct first, so that a hot character is one row where it meets the other side.
    drawn = table(spark, directory, "drawings").select("code_point").distinct()
    return table(spark, directory, "glyph_vectors").select("vec_id", "code_point").join(drawn, "code_point", "left_semi")


def anti_dropped(spark: SparkSession, directory: str) -> DataFrame:
    """Characters without any vector."""
    seen = table(spark, directory, "glyph_vectors").where("code_point IS NOT NULL").select("code_point").distinct()
    return _records(spark, directory).select("code_point", "block_name").join(seen, "code_point", "left_anti")


def priority_join(spark: SparkSession, directory: str) -> DataFrame:
    """The most wanted font that has each character."""
    have = table(spark, directory, "glyph_vectors").where("code_point IS NOT NULL AND font_id IS NOT NULL").select("code_point", "font_id").distinct()
    wanted = spark.createDataFrame(list(enumerate(FONTS)), "wish int, font_id string")
    return priority_pick(have, "code_point", wanted, "font_id", "wish")


def chunk_plan(spark: SparkSession, directory: str) -> DataFrame:
    """Twelve ranges of 500 characters spread evenly over the texts of all sources, laid end to end."""
    files = table(spark, directory, "documents").where("source IS NOT NULL").groupBy(read_name(F.col("source")).alias("file_name")).agg(F.sum(F.length("text")).alias("size"))
    return L.plan_chunks(files, 12, 500)


def coverage_by_block(spark: SparkSession, directory: str) -> DataFrame:
    """Per block: characters, those with a vector, those in at least three fonts, the median number of fonts, the rest."""
    fonts = table(spark, directory, "glyph_vectors").where("origin = 'glyph'").groupBy("code_point").agg(F.countDistinct("font_id").alias("fonts"))
    known = _records(spark, directory).join(fonts, "code_point", "left")
    return known.groupBy("block_name").agg(
        F.count(F.lit(1)).alias("characters"), F.count("fonts").alias("covered"), F.count_if(F.col("fonts") >= 3).alias("three_fonts"),
        F.percentile("fonts", F.lit(0.5)).cast("int").alias("median_fonts"), F.count_if(F.col("fonts").isNull()).alias("dropped"),
    )


def fonts_by_character(spark: SparkSession, directory: str) -> DataFrame:
    """The fonts of each character in order, the first three of them, as rows."""
    rows = table(spark, directory, "glyph_vectors").where("font_id IS NOT NULL AND code_point IS NOT NULL").select("code_point", "font_id").distinct()
    return L.first_per_key(rows, ["code_point"], [F.col("font_id")], 3)


def set_operations(spark: SparkSession, directory: str) -> DataFrame:
    """Characters drawn, rendered and written about: sizes of union, intersection and differences."""
    drawn = table(spark, directory, "drawings").where("code_point IS NOT NULL").select("code_point").distinct()
    rendered = table(spark, directory, "glyph_vectors").where("code_point IS NOT NULL").select("code_point").distinct()
    written = table(spark, directory, "documents").where("subject_cp IS NOT NULL").select(F.col("subject_cp").alias("code_point")).distinct()
    parts = {"union": drawn.union(rendered).union(written).distinct(), "intersection": drawn.intersect(rendered).intersect(written), "drawn only": drawn.subtract(rendered).subtract(written), "rendered only": rendered.subtract(drawn).subtract(written)}
    out = None
    for name, df in parts.items():
        one = df.agg(F.count(F.lit(1)).alias("characters"), F.min("code_point").alias("smallest")).select(F.lit(name).alias("part"), "characters", "smallest")
        out = one if out is None else out.unionByName(one)
    return out


def denormalized_dimension(spark: SparkSession, directory: str) -> DataFrame:
    """Every character with its block's size, its group, its number of drawings and documents."""
    records = _records(spark, directory)
    sizes = records.groupBy("block_name").agg(F.count(F.lit(1)).alias("block_size"))
    drawn = table(spark, directory, "drawings").groupBy("code_point").agg(F.count(F.lit(1)).alias("drawings"))
    about = table(spark, directory, "documents").groupBy(F.col("subject_cp").alias("code_point")).agg(F.count(F.lit(1)).alias("documents"))
    return records.join(sizes, "block_name", "left").join(drawn, "code_point", "left").join(about, "code_point", "left").select(
        "code_point", "char_name", "block_name", "block_size", F.coalesce("simple_lowercase", "code_point").alias("group"), F.coalesce("drawings", F.lit(0)).alias("drawings"), F.coalesce("documents", F.lit(0)).alias("documents")
    )


def snapshot_delta(spark: SparkSession, directory: str) -> DataFrame:
    """Each user's events in order: increase of the value since the event before."""
    events = table(spark, directory, "events").select("event_id", "user_id", "ts", F.round(F.col("value") * 100).cast("bigint").alias("cents"))
    return L.counter_deltas(events.withColumn("at", F.struct("ts", "event_id")), ["user_id"], "at", "cents").select("event_id", "user_id", "delta")


def signature_similarity(spark: SparkSession, directory: str) -> DataFrame:
    """Similarity of the shapes of all case pairs, by the median over fonts."""
    return C.pair_similarity(case_pair_list(spark, directory), table(spark, directory, "signatures"))


def linked_signatures(spark: SparkSession, directory: str) -> DataFrame:
    """Complete-linkage groups of signatures over the similarities on record."""
    pairs = table(spark, directory, "match_pairs").select(F.col("first_sig").alias("first"), F.col("second_sig").alias("second"), "similarity")
    return C.complete_linkage(pairs.where("first IS NOT NULL AND second IS NOT NULL"))


_BLOCKS = "b AS (SELECT block_name, min(code_point) AS first, max(code_point) AS last FROM char_records WHERE block_name IS NOT NULL GROUP BY 1)"
_CASE = "cp AS (SELECT DISTINCT least(code_point, o) AS first, greatest(code_point, o) AS second FROM (SELECT code_point, unnest([simple_uppercase, simple_lowercase]) AS o FROM char_records) WHERE o <> code_point AND o IN (SELECT code_point FROM char_records))"
_SKEL = "sk AS (SELECT code_point, coalesce(simple_lowercase, code_point) AS s FROM char_records), sp AS (SELECT a.code_point AS first, b.code_point AS second FROM sk a JOIN sk b ON a.s = b.s AND a.code_point < b.code_point)"
_VEC = "SELECT DISTINCT code_point, font_id FROM glyph_vectors WHERE code_point IS NOT NULL AND font_id IS NOT NULL"

SQL = {
    "block_range_join": f"WITH {_BLOCKS} SELECT coalesce(b.block_name, '?') AS block_name, count(*) AS documents FROM documents d LEFT JOIN b ON d.subject_cp BETWEEN b.first AND b.last GROUP BY 1",
    "range_overlap_check": f"WITH {_BLOCKS}, w AS (SELECT block_name, first - 100 AS first, last + 100 AS last, lag(last + 100) OVER (ORDER BY first - 100, last + 100) AS previous_last FROM b) SELECT * FROM w WHERE first <= previous_last",
    "range_expand": f"WITH {_BLOCKS}, m AS (SELECT block_name, unnest(range(first, last + 1)) AS code_point FROM b) SELECT block_name, count(*) AS missing, CAST(min(code_point) AS INTEGER) AS first_missing FROM m WHERE code_point NOT IN (SELECT code_point FROM char_records) GROUP BY 1",
    "exclusion_counts": "SELECT CASE WHEN general_category IN ('Sc', 'Sk', 'Nd') THEN 'category' WHEN char_name IS NULL THEN 'unnamed' WHEN script = 'Coptic' THEN 'script' WHEN script IS NULL THEN 'no script' ELSE 'kept' END AS reason, count(*) AS characters FROM char_records GROUP BY 1",
    "character_kinds": """SELECT code_point, 'U+' || CASE WHEN code_point < 65536 THEN lpad(upper(to_hex(code_point)), 4, '0') ELSE upper(to_hex(code_point)) END AS notation,
CASE WHEN general_category LIKE 'M%' THEN '◌' || chr(code_point) ELSE chr(code_point) END AS shown,
CASE WHEN general_category LIKE 'M%' THEN 'mark' WHEN general_category LIKE 'L%' THEN 'letter' WHEN contains(block_name, 'Arrows') THEN 'arrow' WHEN general_category = 'Sm' THEN 'mathematical' WHEN charset_group = 'shapes' THEN 'shape' ELSE 'other' END AS kind,
coalesce(script IN ('Common', 'Inherited') AND general_category NOT LIKE 'L%', false) AS everywhere, code_point AS parsed FROM char_records""",
    "case_pair_list": f"WITH {_CASE} SELECT * FROM cp",
    "skeleton_pair_list": f"WITH {_SKEL} SELECT * FROM sp",
    "pair_union_first": f"WITH {_CASE}, {_SKEL}, u AS (SELECT first, second, 'confusables' AS source FROM sp UNION ALL SELECT first, second, 'case' FROM cp WHERE NOT EXISTS (SELECT 1 FROM sp WHERE sp.first = cp.first AND sp.second = cp.second)) SELECT source, count(*) AS pairs FROM u GROUP BY 1",
    "pair_source_report": "SELECT pair_source, count(*) AS pairs, count(*) FILTER (kept) AS kept, count(*) FILTER (NOT kept) AS rejected, count(*) FILTER (kept IS NULL) AS undecided, round(avg(similarity), 6) AS similarity FROM match_pairs GROUP BY 1",
    "name_cascade": """WITH l AS (SELECT DISTINCT label FROM drawings WHERE label IS NOT NULL), o AS (SELECT label, min(code_point) AS c FROM drawings WHERE label IS NOT NULL AND code_point IS NOT NULL GROUP BY 1 HAVING min(code_point) = max(code_point)),
k AS (SELECT chr(code_point) AS label, code_point AS c FROM char_records)
SELECT l.label, coalesce(o.c, k.c) AS code_point, CASE WHEN o.c IS NOT NULL THEN 'drawn' WHEN k.c IS NOT NULL THEN 'character' ELSE 'unresolved' END AS source FROM l LEFT JOIN o ON o.label = l.label LEFT JOIN k ON k.label = l.label""",
    "status_routing": """SELECT CASE WHEN d.code_point IS NULL THEN 'no mapping' WHEN c.code_point IS NULL THEN 'outside set' WHEN NOT coalesce(len(d.strokes) > 0, false) THEN 'no strokes' ELSE 'kept' END AS status,
count(*) AS samples, count(DISTINCT d.label) AS labels, count(DISTINCT CASE WHEN d.dataset IS NOT NULL AND d.writer IS NOT NULL THEN {'a': d.dataset, 'b': d.writer} END) AS writers
FROM drawings d LEFT JOIN (SELECT code_point FROM char_records WHERE charset_group <> 'technical') c ON c.code_point = d.code_point GROUP BY 1""",
    "semi_allowed": "SELECT vec_id, code_point FROM glyph_vectors WHERE code_point IN (SELECT code_point FROM drawings WHERE code_point IS NOT NULL)",
    "anti_dropped": "SELECT code_point, block_name FROM char_records WHERE code_point NOT IN (SELECT code_point FROM glyph_vectors WHERE code_point IS NOT NULL)",
    "priority_join": f"WITH v AS ({_VEC}), w AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{f}')" for i, f in enumerate(FONTS)) + ") t(wish, font_id)) SELECT code_point, arg_min(v.font_id, wish) AS font_id FROM v JOIN w ON v.font_id = w.font_id GROUP BY 1",
    "chunk_plan": """WITH f AS (SELECT upper(trim(source)) AS file_name, CAST(sum(length(text)) AS BIGINT) AS size FROM documents WHERE source IS NOT NULL GROUP BY 1),
o AS (SELECT *, coalesce(sum(size) OVER (ORDER BY file_name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off, sum(size) OVER () AS total FROM f WHERE size > 0),
p AS (SELECT i, CAST(floor((i + 0.5) * (SELECT max(total) FROM o) / 12) AS BIGINT) AS pos FROM range(12) t(i)),
s AS (SELECT i, file_name, size, greatest(0, least(pos - off - 250, size - 500)) AS start FROM p JOIN o ON pos >= off AND pos < off + size)
SELECT CAST(i AS INTEGER) AS chunk, file_name, CAST(start AS BIGINT) AS start, CAST(least(size, start + 500) AS BIGINT) AS "end" FROM s""",
    "coverage_by_block": """WITH f AS (SELECT code_point, count(DISTINCT font_id) AS fonts FROM glyph_vectors WHERE origin = 'glyph' GROUP BY 1)
SELECT block_name, count(*) AS characters, count(fonts) AS covered, count(*) FILTER (fonts >= 3) AS three_fonts, CAST(trunc(quantile_cont(fonts, 0.5)) AS INTEGER) AS median_fonts, count(*) FILTER (fonts IS NULL) AS dropped FROM char_records c LEFT JOIN f ON f.code_point = c.code_point GROUP BY 1""",
    "fonts_by_character": f"WITH v AS ({_VEC}), r AS (SELECT *, row_number() OVER (PARTITION BY code_point ORDER BY font_id) AS place FROM v) SELECT * FROM r WHERE place <= 3",
    "set_operations": """WITH d AS (SELECT code_point FROM drawings WHERE code_point IS NOT NULL), r AS (SELECT code_point FROM glyph_vectors WHERE code_point IS NOT NULL), w AS (SELECT subject_cp AS code_point FROM documents WHERE subject_cp IS NOT NULL)
SELECT 'union' AS part, count(*) AS characters, min(code_point) AS smallest FROM (SELECT * FROM d UNION SELECT * FROM r UNION SELECT * FROM w)
UNION ALL SELECT 'intersection', count(*), min(code_point) FROM (SELECT * FROM d INTERSECT SELECT * FROM r INTERSECT SELECT * FROM w)
UNION ALL SELECT 'drawn only', count(*), min(code_point) FROM (SELECT * FROM d EXCEPT SELECT * FROM r EXCEPT SELECT * FROM w)
UNION ALL SELECT 'rendered only', count(*), min(code_point) FROM (SELECT * FROM r EXCEPT SELECT * FROM d EXCEPT SELECT * FROM w)""",
    "denormalized_dimension": """WITH s AS (SELECT block_name, count(*) AS block_size FROM char_records GROUP BY 1), d AS (SELECT code_point, count(*) AS n FROM drawings GROUP BY 1), a AS (SELECT subject_cp AS code_point, count(*) AS n FROM documents GROUP BY 1)
SELECT c.code_point, char_name, c.block_name, block_size, coalesce(simple_lowercase, c.code_point) AS "group", coalesce(d.n, 0) AS drawings, coalesce(a.n, 0) AS documents FROM char_records c LEFT JOIN s ON s.block_name = c.block_name LEFT JOIN d ON d.code_point = c.code_point LEFT JOIN a ON a.code_point = c.code_point""",
    "snapshot_delta": "WITH e AS (SELECT event_id, user_id, ts, CAST(round(value * 100) AS BIGINT) AS cents FROM events) SELECT event_id, user_id, greatest(cents - lag(cents) OVER (PARTITION BY user_id ORDER BY ts, event_id), CASE WHEN lag(cents) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL THEN NULL ELSE 0 END) AS delta FROM e",
}
QUERIES = {f.__name__: f for f in (
    block_range_join, range_overlap_check, range_expand, exclusion_counts, character_kinds, case_pair_list, skeleton_pair_list, pair_union_first, pair_source_report, name_cascade, status_routing,
    semi_allowed, anti_dropped, priority_join, chunk_plan, coverage_by_block, fonts_by_character, set_operations, denormalized_dimension, snapshot_delta, signature_similarity, linked_signatures,
)}
