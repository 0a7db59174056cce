"""Recognition, prior and evaluation queries over glyph_vectors, char_records and documents.

Parity drawings (origin ``fixture``) are the queries, glyph renders the index. A character's look-alike group is that of
its lower-case form.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkatlas.functions import vectors as V
from inkatlas.functions.names import read_name
from inkatlas.operators import evaluation as E
from inkatlas.operators import prior as P
from inkatlas.operators import ranking as R
from inkatlas.sources.tables import table

DIMS = 48
KEYBOARDS = {"latin": ["Latin"], "greek": ["Latin", "Greek"], "cyrillic": ["Cyrillic"]}


def _group(cp="code_point", lower="simple_lowercase"):
    return F.coalesce(F.col(lower), F.col(cp)).alias("group")


def _groups(spark: SparkSession, directory: str) -> DataFrame:
    return table(spark, directory, "char_records").select("code_point", _group())


def _vectors(spark: SparkSession, directory: str) -> DataFrame:
    usable = table(spark, directory, "glyph_vectors").where(V.finite(F.col("embedding"), DIMS) & F.col("code_point").isNotNull())
    return usable.select("vec_id", "origin", "code_point", "font_id", V.l2_normalize(F.col("embedding")).alias("vector"))


def _queries(spark: SparkSession, directory: str) -> DataFrame:
    return _vectors(spark, directory).where("origin = 'fixture'").select(F.col("vec_id").alias("q"), "vector", F.col("code_point").alias("label"))


def _index(spark: SparkSession, directory: str, by_group: bool = False) -> DataFrame:
    glyphs = _vectors(spark, directory).where("origin = 'glyph'").select("code_point", "vector")
    if not by_group:
        return glyphs.withColumn("key", F.col("code_point"))
    return glyphs.join(_groups(spark, directory), "code_point", "left").select("code_point", "vector", F.coalesce("group", "code_point").alias("key"))


def prior_of(spark: SparkSession, directory: str) -> DataFrame:
    documents = table(spark, directory, "documents").select(read_name(F.col("lang")).alias("language"), "text")
    return P.log_prior(P.character_counts(documents, "language", "text"), table(spark, directory, "char_records"))


def char_counts_by_lang(spark: SparkSession, directory: str) -> DataFrame:
    """Occurrences of each character per language (languages as read; a null language counts nowhere)."""
    documents = table(spark, directory, "documents").select(read_name(F.col("lang")).alias("language"), "text")
    return P.character_counts(documents, "language", "text")


def char_log_prior(spark: SparkSession, directory: str) -> DataFrame:
    return prior_of(spark, directory).select("code_point", "total", F.round("log_prior", 6).alias("log_prior"))


def _floored(spark: SparkSession, directory: str) -> DataFrame:
    flat = table(spark, directory, "char_records").where("charset_group = 'shapes'")
    return P.raise_to_floor(prior_of(spark, directory), flat)


def char_prior_floor(spark: SparkSession, directory: str) -> DataFrame:
    return _floored(spark, directory).select("code_point", "total", "flat", F.round("log_prior", 6).alias("log_prior"))


def prior_top40(spark: SparkSession, directory: str) -> DataFrame:
    """The 40 most frequent characters of a report."""
    top = prior_of(spark, directory).orderBy(F.desc("total"), "code_point").limit(40)
    names = table(spark, directory, "char_records").select("code_point", "char_name")
    return top.join(names, "code_point").select("code_point", "char_name", "total")


def prior_strided_sample(spark: SparkSession, directory: str) -> DataFrame:
    seen = prior_of(spark, directory).where("total > 0").select("code_point", "total")
    return P.strided_sample(seen, [F.desc("total"), F.col("code_point")])


def knn_best_match_topk(spark: SparkSession, directory: str) -> DataFrame:
    """The 10 most similar characters of every query drawing."""
    found = R.best_matches(_queries(spark, directory), R.with_bonus(_index(spark, directory), None), 10)
    return found.select("q", "rank", "code_point", F.round("similarity", 6).alias("similarity"))


def knn_with_prior(spark: SparkSession, directory: str) -> DataFrame:
    """The 5 characters of highest score: similarity and weighted log prior."""
    found = R.best_matches(_queries(spark, directory), R.with_bonus(_index(spark, directory), prior_of(spark, directory)), 5)
    return found.select("q", "rank", "code_point", F.round("similarity", 6).alias("similarity"), F.round("score", 6).alias("score"))


def _tiles(spark: SparkSession, directory: str, n: int) -> DataFrame:
    return R.best_matches(_queries(spark, directory), R.with_bonus(_index(spark, directory, True), prior_of(spark, directory)), n)


def knn_tiles(spark: SparkSession, directory: str) -> DataFrame:
    """The 5 best look-alike groups of every query, each at the place of its best character."""
    return _tiles(spark, directory, 5).select("q", "rank", F.col("key").alias("group"), "code_point", F.round("score", 6).alias("score"))


def _chooser(spark: SparkSession, directory: str, keyboards: list[str]) -> DataFrame:
    records = table(spark, directory, "char_records").select("code_point", F.coalesce("script", F.lit("Unknown")).alias("script"), "general_category", _group())
    prior = prior_of(spark, directory).select("code_point", F.round("log_prior", 6).alias("log_prior"))
    return R.chooser(records.join(prior, "code_point", "left"), keyboards)


def knn_tiles_members(spark: SparkSession, directory: str) -> DataFrame:
    """Three tiles of every query with all members in order of choice on a Latin keyboard."""
    tiles, menu = _tiles(spark, directory, 3), _chooser(spark, directory, KEYBOARDS["latin"])
    shown = tiles.join(menu, tiles["key"] == menu["group"], "left")
    return shown.select("q", "rank", F.coalesce("representative", "code_point").alias("representative"), F.explode(F.coalesce("members", F.array("code_point"))).alias("member"))


def chooser_by_keyboard(spark: SparkSession, directory: str) -> DataFrame:
    """The representative of every group on three keyboards."""
    parts = [_chooser(spark, directory, k).select(F.lit(name).alias("keyboard"), "group", "representative", F.size("members").alias("members")) for name, k in KEYBOARDS.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def knn_restricted(spark: SparkSession, directory: str) -> DataFrame:
    """Ranking against mathematical symbols only (a table of allowed characters)."""
    allowed = table(spark, directory, "char_records").where("general_category = 'Sm'")
    index = R.with_bonus(R.restrict(_index(spark, directory), allowed), None)
    return R.best_matches(_queries(spark, directory), index, 5).select("q", "rank", "code_point", F.round("similarity", 6).alias("similarity"))


def knn_accept_filter(spark: SparkSession, directory: str) -> DataFrame:
    """Tiles of accepted characters only (a predicate): code points of the basic plane below U+2600."""
    index = R.with_bonus(R.restrict(_index(spark, directory, True), F.col("code_point") < 0x2600), None)
    return R.best_matches(_queries(spark, directory), index, 3).select("q", "rank", F.col("key").alias("group"), "code_point", F.round("similarity", 6).alias("similarity"))


def mean_vector_index(spark: SparkSession, directory: str) -> DataFrame:
    """The normalised mean vector of each character, as rows."""
    mean = V.mean_vectors(_vectors(spark, directory).where("origin = 'glyph'"), "code_point", "vector")
    return mean.select("code_point", F.posexplode("vector").alias("i", "x")).select("code_point", "i", F.round("x", 6).alias("x"))


def nearest_other_group(spark: SparkSession, directory: str) -> DataFrame:
    """For each character's mean vector the 3 most similar characters of other groups."""
    groups = _groups(spark, directory)
    mean = V.mean_vectors(_vectors(spark, directory).where("origin = 'glyph'"), "code_point", "vector").join(groups, "code_point")
    asks = mean.select(F.col("code_point").alias("q"), "vector")
    # A query's own group takes at most its members' places, so asking for that many more loses none.
    widest = groups.groupBy("group").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    near = R.best_matches(asks, mean.select("code_point", "vector", F.col("code_point").alias("key"), F.lit(0.0).alias("bonus")), 3 + (widest or 0))
    own, other = groups.select(F.col("code_point").alias("q"), F.col("group").alias("own")), groups.select("code_point", F.col("group").alias("other"))
    return P_rank(near.join(own, "q").join(other, "code_point").where("own <> other"), 3).select(F.col("q").cast("int").alias("code_point"), "place", F.col("code_point").alias("neighbour"), F.round("similarity", 6).alias("similarity"))


def P_rank(df: DataFrame, n: int) -> DataFrame:
    from pyspark.sql import Window

    return df.withColumn("place", F.row_number().over(Window.partitionBy("q").orderBy("rank"))).where(F.col("place") <= n)


def quantize_roundtrip(spark: SparkSession, directory: str) -> DataFrame:
    """Vectors as bytes and back: step and largest error of each usable vector."""
    q = _vectors(spark, directory).select("vec_id", "vector", V.quantize(F.col("vector")).alias("b"))
    error = F.array_max(F.zip_with(V.dequantize(F.col("b")), "vector", lambda a, b: F.abs(a - b)))
    total = F.aggregate("b.values", F.lit(0).cast("bigint"), lambda s, x: s + x)
    return q.select("vec_id", F.round("b.scale", 8).alias("scale"), total.alias("byte_sum"), F.round(error, 8).alias("error"))


def pca_projection(spark: SparkSession, directory: str) -> DataFrame:
    """The index on its first 8 principal directions (signs are arbitrary), normalised again."""
    from inkatlas.operators.pca import principal_directions, project

    index = _vectors(spark, directory).where("origin = 'glyph'").select("vec_id", "vector")
    return project(index, "vector", principal_directions(index, "vector", 8)).select("vec_id", F.col("vector").alias("projected"))


def _hits(spark: SparkSession, directory: str) -> DataFrame:
    ranking = R.best_matches(_queries(spark, directory), R.with_bonus(_index(spark, directory), prior_of(spark, directory)), 5)
    records = table(spark, directory, "char_records").select("code_point", _group(), "block_name", F.coalesce("script", F.lit("Unknown")).alias("script"), "charset_group")
    of = records.select(F.col("code_point").alias("pc"), F.col("group").alias("pg"))
    marked = ranking.join(of, ranking["code_point"] == of["pc"], "left").select("q", "rank", F.struct("code_point", F.coalesce("pg", "code_point").alias("pg")).alias("p"))
    listed = marked.groupBy("q").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "p"))), lambda e: e["p"]).alias("p"))  # five entries
    preds = listed.select("q", R.filled(F.col("p")["code_point"], 5).alias("predictions"), R.filled(F.col("p")["pg"], 5).alias("prediction_groups"))
    labelled = _queries(spark, directory).select("q", "label").join(records.withColumnRenamed("code_point", "label"), "label", "left")
    return E.hit_flags(labelled.join(preds, "q", "left").withColumn("label_group", F.coalesce("group", "label")))


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({h: F.round(h, 6) for h in E.HITS})


def eval_micro(spark: SparkSession, directory: str) -> DataFrame:
    return _rounded(E.micro(_hits(spark, directory)))


def eval_macro(spark: SparkSession, directory: str) -> DataFrame:
    return _rounded(E.macro(_hits(spark, directory)))


def eval_slices(spark: SparkSession, directory: str) -> DataFrame:
    return _rounded(E.sliced(_hits(spark, directory), ["block_name", "script", "charset_group"]))


def eval_weakest_blocks(spark: SparkSession, directory: str) -> DataFrame:
    """The 3 weakest and the 3 strongest blocks of at least 2 drawings."""
    blocks = E.sliced(_hits(spark, directory), ["block_name"]).where("slice_kind = 'block_name' AND samples >= 2").select("slice", "samples", F.round("top5_conf", 6).alias("top5_conf"))
    weak = blocks.orderBy("top5_conf", "slice").limit(3).withColumn("end", F.lit("weakest"))
    return weak.unionByName(blocks.orderBy(F.desc("top5_conf"), "slice").limit(3).withColumn("end", F.lit("strongest")))


def eval_weight_grid(spark: SparkSession, directory: str) -> DataFrame:
    """Top-1 accuracy for several weights of the prior, and the best weight."""
    weights = [0.0, 0.001, 0.002, 0.004, 0.01]
    index, queries = R.with_bonus(_index(spark, directory), prior_of(spark, directory), 1.0), _queries(spark, directory)
    top = R.best_by_weight(queries.select("q", "vector"), index, weights)
    each = queries.select("q", "label", F.explode(F.array(*[F.lit(w) for w in weights])).alias("weight"))
    hit = F.coalesce(F.col("code_point") == F.col("label"), F.lit(False)).cast("double")
    grid = each.join(top, ["q", "weight"], "left").groupBy("weight").agg(F.avg(hit).alias("top1"))
    best = E.best_setting(grid, "weight", "top1").select(F.col("weight").alias("best_weight"))
    return grid.join(F.broadcast(best)).select("weight", F.round("top1", 6).alias("top1"), (F.col("weight") == F.col("best_weight")).alias("best"))


_U = """
u AS (SELECT vec_id, origin, code_point, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM glyph_vectors
  WHERE len(embedding) = 48 AND code_point IS NOT NULL AND list_sum(list_transform(embedding, lambda x: CASE WHEN x IS NULL OR isnan(x) OR isinf(x) THEN 1 ELSE 0 END)) = 0
  AND list_max(list_transform(embedding, lambda x: abs(x))) > 0),
v AS (SELECT vec_id, origin, code_point, list_transform(e, lambda x: x / greatest(sqrt(list_dot_product(e, e)), 1e-8)) AS vector FROM u),
qs AS (SELECT vec_id AS q, vector, code_point AS label FROM v WHERE origin = 'fixture'),
ix AS (SELECT code_point, vector FROM v WHERE origin = 'glyph'),
grp AS (SELECT code_point, coalesce(simple_lowercase, code_point) AS g FROM char_records),
sim AS (SELECT q, label, ix.code_point, max(list_dot_product(qs.vector, ix.vector)) AS similarity FROM qs, ix GROUP BY 1, 2, 3)"""
_LANG = "upper(trim(lang))"
_COUNTS = f"""
chars AS (SELECT {_LANG} AS language, unnest(string_split(text, '')) AS ch FROM documents WHERE lang IS NOT NULL AND text <> ''),
counts AS (SELECT language, unicode(ch) AS code_point, count(*) AS n FROM chars WHERE ch <> '' AND NOT (unicode(ch) BETWEEN 9 AND 13 OR unicode(ch) BETWEEN 28 AND 32 OR unicode(ch) IN (133, 160, 5760, 8232, 8233, 8239, 8287, 12288) OR unicode(ch) BETWEEN 8192 AND 8202) GROUP BY 1, 2)"""
_PRIOR = f"""{_COUNTS},
inside AS (SELECT * FROM counts WHERE code_point IN (SELECT code_point FROM char_records)),
tot AS (SELECT language, sum(n) AS t FROM inside GROUP BY 1), size AS (SELECT count(DISTINCT code_point) AS k FROM char_records),
grid AS (SELECT c.code_point, t.language, t.t, coalesce(i.n, 0) AS n FROM char_records c CROSS JOIN tot t LEFT JOIN inside i ON i.code_point = c.code_point AND i.language = t.language),
prior AS (SELECT code_point, CAST(sum(n) AS BIGINT) AS total, ln(avg((n + 0.5) / (t + 0.5 * (SELECT k FROM size)))) AS log_prior FROM grid GROUP BY 1)"""
_SCORED = """
scored AS (SELECT s.*, coalesce(grp.g, s.code_point) AS g, similarity + 0.002 * coalesce(p.log_prior, (SELECT min(log_prior) FROM prior)) AS score FROM sim s LEFT JOIN prior p ON p.code_point = s.code_point LEFT JOIN grp ON grp.code_point = s.code_point)"""


def _ranked(by: str, score: str, source: str, where: str = "true") -> str:
    return f"""one AS (SELECT *, row_number() OVER (PARTITION BY q, {by} ORDER BY {score} DESC, code_point) AS k FROM {source} WHERE {where}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY {score} DESC, code_point) AS rank FROM one WHERE k = 1)"""


_HITS = f"""WITH {_U}, {_PRIOR}, {_SCORED}, {_ranked('code_point', 'score', 'scored')},
flags AS (SELECT qs.q, qs.label, coalesce(bool_or(r.code_point = qs.label AND r.rank = 1), false) AS top1, coalesce(bool_or(r.code_point = qs.label), false) AS top5,
 coalesce(bool_or(r.g = coalesce(lg.g, qs.label) AND r.rank = 1), false) AS top1_conf, coalesce(bool_or(r.g = coalesce(lg.g, qs.label)), false) AS top5_conf
 FROM qs LEFT JOIN ranked r ON r.q = qs.q AND r.rank <= 5 LEFT JOIN grp lg ON lg.code_point = qs.label GROUP BY 1, 2),
hits AS (SELECT f.*, coalesce(c.block_name, '?') AS block_name, CASE WHEN c.code_point IS NULL THEN '?' ELSE coalesce(c.script, 'Unknown') END AS script, coalesce(c.charset_group, '?') AS charset_group FROM flags f LEFT JOIN char_records c ON c.code_point = f.label)"""
_RATES = ", ".join(f"round(avg(CAST({h} AS DOUBLE)), 6) AS {h}" for h in E.HITS)


def _menu(scripts: str) -> str:
    return f"""SELECT coalesce(c.simple_lowercase, c.code_point) AS g, c.code_point, row_number() OVER (PARTITION BY coalesce(c.simple_lowercase, c.code_point) ORDER BY
 NOT coalesce(c.script IN ({scripts}) OR (c.script IN ('Common', 'Inherited') AND c.general_category NOT LIKE 'L%'), false), round(p.log_prior, 6) DESC, c.code_point) AS place FROM char_records c LEFT JOIN prior p ON p.code_point = c.code_point"""


SQL = {
    "char_counts_by_lang": f"WITH {_COUNTS} SELECT language, code_point, CAST(n AS BIGINT) AS n FROM counts",
    "char_log_prior": f"WITH {_PRIOR} SELECT code_point, total, round(log_prior, 6) AS log_prior FROM prior",
    "char_prior_floor": f"""WITH {_PRIOR}, m AS (SELECT p.*, c.charset_group = 'shapes' AS flat FROM prior p JOIN char_records c USING (code_point)),
lvl AS (SELECT coalesce(quantile_cont(log_prior, 0.5) FILTER (NOT flat AND total >= 100), min(log_prior)) AS l FROM m)
SELECT code_point, total, flat, round(CASE WHEN flat THEN greatest(log_prior, (SELECT l FROM lvl)) ELSE log_prior END, 6) AS log_prior FROM m""",
    "prior_top40": f"WITH {_PRIOR} SELECT p.code_point, c.char_name, p.total FROM prior p JOIN char_records c USING (code_point) ORDER BY total DESC, code_point LIMIT 40",
    "prior_strided_sample": f"""WITH {_PRIOR}, r AS (SELECT code_point, total, row_number() OVER (ORDER BY total DESC, code_point) - 1 AS rn, count(*) OVER () AS n FROM prior WHERE total > 0)
SELECT code_point, total FROM r WHERE rn % greatest(1, n // 60) = 0 ORDER BY rn LIMIT 60""",
    "knn_best_match_topk": f"WITH {_U}, {_ranked('code_point', 'similarity', 'sim')} SELECT q, rank, code_point, round(similarity, 6) AS similarity FROM ranked WHERE rank <= 10",
    "knn_with_prior": f"WITH {_U}, {_PRIOR}, {_SCORED}, {_ranked('code_point', 'score', 'scored')} SELECT q, rank, code_point, round(similarity, 6) AS similarity, round(score, 6) AS score FROM ranked WHERE rank <= 5",
    "knn_tiles": f"WITH {_U}, {_PRIOR}, {_SCORED}, {_ranked('g', 'score', 'scored')} SELECT q, rank, CAST(g AS BIGINT) AS \"group\", code_point, round(score, 6) AS score FROM ranked WHERE rank <= 5",
    "knn_tiles_members": f"""WITH {_U}, {_PRIOR}, {_SCORED}, {_ranked('g', 'score', 'scored')}, menu AS ({_menu("'Latin'")}), first AS (SELECT g, code_point AS representative FROM menu WHERE place = 1)
SELECT r.q, r.rank, coalesce(f.representative, r.code_point) AS representative, coalesce(m.code_point, r.code_point) AS member FROM ranked r LEFT JOIN first f ON f.g = r.g LEFT JOIN menu m ON m.g = r.g WHERE r.rank <= 3""",
    "chooser_by_keyboard": f"WITH {_PRIOR}, " + ", ".join(f"m_{k} AS ({_menu(', '.join(repr(x) for x in s))})" for k, s in KEYBOARDS.items()) + " " + " UNION ALL ".join(f"SELECT '{k}' AS keyboard, g AS \"group\", max(CASE WHEN place = 1 THEN code_point END) AS representative, CAST(count(*) AS INTEGER) AS members FROM m_{k} GROUP BY g" for k in KEYBOARDS),
    "knn_restricted": f"WITH {_U}, {_ranked('code_point', 'similarity', 'sim', 'code_point IN (SELECT code_point FROM char_records WHERE general_category = chr(83) || chr(109))')} SELECT q, rank, code_point, round(similarity, 6) AS similarity FROM ranked WHERE rank <= 5",
    "knn_accept_filter": f"WITH {_U}, s AS (SELECT sim.*, coalesce(grp.g, sim.code_point) AS g FROM sim LEFT JOIN grp USING (code_point)), {_ranked('g', 'similarity', 's', 'code_point < 9728')} SELECT q, rank, CAST(g AS BIGINT) AS \"group\", code_point, round(similarity, 6) AS similarity FROM ranked WHERE rank <= 3",
    "mean_vector_index": f"""WITH {_U}, parts AS (SELECT code_point, unnest(vector) AS x, generate_subscripts(vector, 1) - 1 AS i FROM ix), sums AS (SELECT code_point, i, sum(x) AS x FROM parts GROUP BY 1, 2)
SELECT code_point, CAST(i AS INTEGER) AS i, round(x / greatest(sqrt(sum(x * x) OVER (PARTITION BY code_point)), 1e-8), 6) AS x FROM sums""",
    "nearest_other_group": f"""WITH {_U}, parts AS (SELECT code_point, unnest(vector) AS x, generate_subscripts(vector, 1) - 1 AS i FROM ix), sums AS (SELECT code_point, i, sum(x) AS x FROM parts GROUP BY 1, 2),
mean AS (SELECT code_point, list(x ORDER BY i) AS s FROM sums GROUP BY 1), unit AS (SELECT code_point, g, list_transform(s, lambda x: x / greatest(sqrt(list_dot_product(s, s)), 1e-8)) AS v FROM mean JOIN grp USING (code_point)),
near AS (SELECT a.code_point, b.code_point AS neighbour, list_dot_product(a.v, b.v) AS similarity FROM unit a JOIN unit b ON a.g <> b.g),
r AS (SELECT *, row_number() OVER (PARTITION BY code_point ORDER BY similarity DESC, neighbour) AS place FROM near) SELECT code_point, place, neighbour, round(similarity, 6) AS similarity FROM r WHERE place <= 3""",
    "quantize_roundtrip": f"""WITH {_U}, s AS (SELECT vec_id, vector, list_max(list_transform(vector, lambda x: abs(x))) / 127 AS scale FROM v),
b AS (SELECT vec_id, vector, scale, list_transform(vector, lambda x: round_even(x / scale, 0)) AS w FROM s)
SELECT vec_id, round(scale, 8) AS scale, CAST(list_sum(w) AS BIGINT) AS byte_sum, round(list_max(list_transform(list_zip(w, vector), lambda p: abs(p[1] * scale - p[2]))), 8) AS error FROM b""",
    "eval_micro": f"{_HITS} SELECT count(*) AS samples, count(DISTINCT label) AS characters, {_RATES} FROM hits",
    "eval_macro": f"{_HITS}, per AS (SELECT label, count(*) AS n, " + ", ".join(f"avg(CAST({h} AS DOUBLE)) AS {h}" for h in E.HITS) + ") SELECT 1".replace(") SELECT 1", " FROM hits GROUP BY label)") + " SELECT CAST(sum(n) AS BIGINT) AS samples, count(*) AS characters, " + ", ".join(f"round(avg({h}), 6) AS {h}" for h in E.HITS) + " FROM per",
    "eval_slices": f"{_HITS}, s AS (SELECT 'overall' AS slice_kind, 'all' AS slice, * FROM hits UNION ALL SELECT 'block_name', block_name, * FROM hits UNION ALL SELECT 'script', script, * FROM hits UNION ALL SELECT 'charset_group', charset_group, * FROM hits) SELECT slice_kind, slice, count(*) AS samples, count(DISTINCT label) AS characters, {_RATES} FROM s GROUP BY 1, 2",
    "eval_weakest_blocks": f"""{_HITS}, b AS (SELECT block_name AS slice, count(*) AS samples, round(avg(CAST(top5_conf AS DOUBLE)), 6) AS top5_conf FROM hits GROUP BY 1 HAVING count(*) >= 2)
SELECT * FROM (SELECT *, 'weakest' AS "end" FROM b ORDER BY top5_conf, slice LIMIT 3) UNION ALL SELECT * FROM (SELECT *, 'strongest' AS "end" FROM b ORDER BY top5_conf DESC, slice LIMIT 3)""",
    "eval_weight_grid": f"""WITH {_U}, {_PRIOR}, w AS (SELECT unnest([0.0::DOUBLE, 0.001, 0.002, 0.004, 0.01]) AS weight),
sc AS (SELECT w.weight, q, label, s.code_point, similarity + w.weight * coalesce(p.log_prior, (SELECT min(log_prior) FROM prior)) AS score FROM sim s CROSS JOIN w LEFT JOIN prior p ON p.code_point = s.code_point),
r AS (SELECT *, row_number() OVER (PARTITION BY weight, q ORDER BY score DESC, code_point) AS k FROM sc), g AS (SELECT weight, avg(CAST(code_point = label AS DOUBLE)) AS top1 FROM r WHERE k = 1 GROUP BY 1)
SELECT weight, round(top1, 6) AS top1, weight = first_value(weight) OVER (ORDER BY top1 DESC, weight) AS best FROM g""",
}
QUERIES = {f.__name__: f for f in (
    char_counts_by_lang, char_log_prior, char_prior_floor, prior_top40, prior_strided_sample, knn_best_match_topk, knn_with_prior, knn_tiles, knn_tiles_members, chooser_by_keyboard,
    knn_restricted, knn_accept_filter, mean_vector_index, nearest_other_group, quantize_roundtrip, pca_projection, eval_micro, eval_macro, eval_slices, eval_weakest_blocks, eval_weight_grid,
)}
