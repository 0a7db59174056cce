import json

import pytest
from pyspark.sql import functions as F

from inkatlas.operators import charset as C
from inkatlas.plans import charsets as P

BLOCKS = [("One", 65, 67), ("Two", 70, 71)]


def config(spark, groups, include=(), exclude=()):
    return spark.createDataFrame([([(g, b) for g, b in groups], ["Mn"], ["Coptic"], list(include), list(exclude))], C.CONFIG)


def test_later_groups_and_overrides_win(spark, rows):
    blocks = spark.createDataFrame(BLOCKS, "block_name string, first int, last int")
    got = C.candidates(config(spark, [("a", ["One", "Two"]), ("b", ["Two"])], [("U+0042", "own"), ("0x100", "own")], ["U+46"]), blocks)
    assert rows(got) == [(256, "own"), (65, "a"), (66, "own"), (67, "a"), (71, "b")]
    assert C.candidates(config(spark, []), blocks).count() == 0


def test_unknown_blocks_are_rejected(spark):
    blocks = spark.createDataFrame(BLOCKS, "block_name string, first int, last int")
    with pytest.raises(Exception, match="unknown block: Three"):
        C.candidates(config(spark, [("a", ["One", "Three"])]), blocks).collect()


def test_documents_are_read_back(spark, tmp_path, rows):
    blocks = spark.createDataFrame(BLOCKS, "block_name string, first int, last int")
    records = spark.createDataFrame([(65, "Lu", "Latin"), (66, "Mn", None), (67, "Lu", "Coptic"), (70, "Lu", None)], "code_point int, general_category string, script string")
    built = C.build_charset(config(spark, [("a", ["One", "Two"])], [("U+43", "own")]), records, blocks)
    assert rows(built) == [(65, "a", "kept"), (66, "a", "category"), (67, "own", "kept"), (70, "a", "kept")]
    C.charset_document(built).write.json(f"{tmp_path}/set")
    assert rows(C.read_charset(spark, f"{tmp_path}/set")) == [(65,), (67,), (70,)]
    (tmp_path / "prior.json").write_text(json.dumps({"log_prior": {"41": -1.5, "1F600": -9.0}}))
    assert rows(C.read_prior(spark, f"{tmp_path}/prior.json")) == [(128512, -9.0), (65, -1.5)]
    (tmp_path / "groups.json").write_text(json.dumps({"groups": [[9, 4], [7]]}))
    assert rows(C.read_groups(spark, f"{tmp_path}/groups.json")) == [(4, 4), (4, 9), (7, 7)]
    spark.createDataFrame([("b", 1), ("tiles", 2), ("a", 3), ("ranked", 4)], "slug string, n int").write.parquet(f"{tmp_path}/evals")
    assert [r["slug"] for r in C.read_evaluations(spark, f"{tmp_path}/evals", ["tiles", "ranked"]).collect()] == ["tiles", "ranked", "a", "b"]


def test_budget_and_durations(spark, rows):
    sizes = spark.createDataFrame([(5,), (6,), (None,)], "n int")
    assert rows(C.within_budget(sizes, "n", 11)) == [(11, 11, True)] and rows(C.within_budget(sizes.limit(0), "n", 0)) == [(0, 0, True)]
    df = spark.createDataFrame([(5,), (125,), (3723,), (None,)], "s int")
    assert {r[0] for r in df.select(P.duration(F.col("s"))).collect()} - {None, ""} == {"0:05", "2:05", "1:02:03"}


def test_strokes_are_recognised(spark):
    shapes = {72: [[(0, 0), (100, 0)], [(50, 0), (50, 100)]], 104: [[(0, 0), (0, 100), (100, 100)]], 937: [[(0, 0), (100, 100)], [(0, 100), (100, 0)]]}
    ink = lambda s, by=0: [[{"x": float(x + by), "y": float(y)} for x, y in k] for k in s]
    schema = "q long, strokes array<array<struct<x: double, y: double>>>"
    from inkatlas.operators.raster import image_features, rasterize

    drawn = spark.createDataFrame([(cp, ink(s)) for cp, s in shapes.items()], schema)
    index = image_features(rasterize(drawn, "q", "strokes"), "q", "pooled").select(F.col("q").cast("int").alias("code_point"), "vector")
    groups = spark.createDataFrame([(72, 104, "Latin", "Lu"), (104, 104, "Latin", "Ll"), (937, 937, "Greek", "Lu")], "code_point int, group int, script string, general_category string")
    asks = spark.createDataFrame([(1, ink(shapes[72], 30)), (2, ink(shapes[937])), (3, None), (4, [])], schema)
    got = {(r["q"], r["kind"], r["rank"]): r["code_point"] for r in P.recognize(asks, index, groups).collect()}
    assert got[1, "character", 1] == 72 and got[1, "tile", 1] == 72 and got[2, "character", 1] == 937 and {q for q, _, _ in got} == {1, 2}
    only = {(r["q"], r["rank"]): r["code_point"] for r in P.recognize(asks, index, groups, accept=F.col("code_point") < 100).where("kind = 'character'").collect()}
    assert set(only.values()) == {72}
