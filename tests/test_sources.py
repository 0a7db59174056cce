import bz2
import gzip
import json
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkatlas.functions import links
from inkatlas.functions import text as T
from inkatlas.functions import vectors as V
from inkatlas.operators.latex import formula_characters
from inkatlas.sinks.reports import cell, markdown
from inkatlas.sinks.tables import append_json, manifest, write_evaluation, write_sorted, write_tsv
from inkatlas.sources import inks, ucd, vector_files, wiki


@pytest.fixture
def ucd_dir(tmp_path):
    files = {
        "UnicodeData.txt": "0000;<control>;Cc;0;BN;;;;;N;NULL;;;;\n0041;LATIN CAPITAL LETTER A;Lu;0;L;;;;;N;;;;0061;\n0061;LATIN SMALL LETTER A;Ll;0;L;;;;;N;;;0041;;0041\nshort;line\n00B7;MIDDLE DOT;Po;0;ON;;;;;N;;;;;\n231A;WATCH;So;0;ON;;;;;N;;;;;\n"
        "4E00;<CJK Ideograph, First>;Lo;0;L;;;;;N;;;;;\n4E02;<CJK Ideograph, Last>;Lo;0;L;;;;;N;;;;;\nAC00;<Hangul Syllable, First>;Lo;0;L;;;;;N;;;;;\nAC1C;<Hangul Syllable, Last>;Lo;0;L;;;;;N;;;;;\nE000;<Private Use, First>;Co;0;L;;;;;N;;;;;\nE001;<Private Use, Last>;Co;0;L;;;;;N;;;;;\nFF21;WIDE A;Lu;0;L;<wide> 0041;;;;N;;;;;\n",
        "Blocks.txt": "# Blocks\n0000..007F; Basic Latin\n0080..00FF; Latin-1 Supplement\n2300..23FF; Miscellaneous Technical\n4E00..9FFF; CJK Unified Ideographs\nAC00..D7AF; Hangul Syllables\n",
        "Scripts.txt": "0041 ; Latin # L& A\n0061 ; Latin\n00B7 ; Common\n4E00..4E02 ; Han\n",
        "DerivedAge.txt": "0000..00FF ; 1.1\n",
        "ScriptExtensions.txt": "00B7 ; Grek Latn #Po MIDDLE DOT\n",
        "PropertyValueAliases.txt": "sc ; Grek ; Greek\nsc ; Latn ; Latin\nsc ; Zinh ; Inherited ; Qaai\ngc ; Lu ; Uppercase_Letter\n",
        "PropList.txt": "0061 ; Deprecated\n",
        "emoji/emoji-data.txt": "﻿# emoji\n231A..231B ; Emoji_Presentation # watch\n",
    }
    (tmp_path / "emoji").mkdir()
    for name, content in files.items():
        (tmp_path / name).write_text(content, encoding="utf-8")
    return tmp_path


def test_unicode_data_expands_ranges_and_names_members(spark, ucd_dir):
    names = {r["code_point"]: r for r in ucd.unicode_data(spark, str(ucd_dir / "UnicodeData.txt")).collect()}
    assert names[0]["name"] == "<control-0000>"
    assert names[0x4E01]["name"] == "CJK UNIFIED IDEOGRAPH-4E01"
    assert names[0xAC01]["name"] == "HANGUL SYLLABLE GAG" and names[0xAC1C]["name"] == "HANGUL SYLLABLE GAE"
    assert names[0xE001]["name"] == "<private use-E001>"
    assert names[0x41]["simple_lowercase"] == 0x61 and names[0x41]["simple_uppercase"] is None
    assert names[0xFF21]["decomposition"] == "<wide> 0041"


def test_range_end_without_start_raises(spark, tmp_path):
    (tmp_path / "u.txt").write_text("0041;A;Lu;0;L;;;;;N;;;;;\n4E02;<CJK Ideograph, Last>;Lo;0;L;;;;;N;;;;;\n")
    with pytest.raises(Exception, match="range end without start at U\\+4E02"):
        ucd.unicode_data(spark, str(tmp_path / "u.txt")).collect()


def test_database_joins_ranges_with_defaults(spark, ucd_dir):
    db = {r["code_point"]: r for r in ucd.database(spark, str(ucd_dir)).collect()}
    assert db[0xB7]["script_extensions"] == ["Greek", "Latin"] and db[0x41]["script_extensions"] == ["Latin"]
    assert db[0x231A]["script"] == "Unknown" and db[0x231A]["emoji_presentation"] and not db[0x41]["emoji_presentation"]
    assert db[0x61]["deprecated"] and db[0x4E00]["block"] == "CJK Unified Ideographs" and db[0xE000]["block"] is None


def test_overlapping_ranges_raise(spark, tmp_path):
    (tmp_path / "r.txt").write_text("0000..0010; a\n0010..0020; b\n")
    with pytest.raises(ValueError, match="overlapping ranges at U\\+0010"):
        ucd.checked(ucd.range_file(spark, str(tmp_path / "r.txt")))


def test_confusables_and_aliases(spark, ucd_dir, tmp_path, rows):
    (tmp_path / "c.txt").write_text("﻿0430 ; 0061 ; MA # a\n2A74 ; 003A 003A 003D ; MA\n\n# end\n")
    assert rows(ucd.confusables(spark, str(tmp_path / "c.txt"))) == [(0x430, [0x61]), (0x2A74, [0x3A, 0x3A, 0x3D])]
    assert ("Qaai", "Inherited") in rows(ucd.script_aliases(spark, str(ucd_dir / "PropertyValueAliases.txt")))


DUMP = "junk\nCOPY samples (id, key, strokes) FROM stdin;\n1\talpha\t[[[10,20,1500000000123],[12,25,1500000000140]],[],[[30,40,1500000000990]]]\n2\tbeta\t[]\n3\talpha\t[[[5,5]]]\n\\.\n4\tno\t[[[1,2,3]]]\n"


@pytest.mark.parametrize("zipped", [True, False])
def test_copy_block_of_a_dump(spark, tmp_path, zipped):
    path = tmp_path / ("d.sql.gz" if zipped else "d.sql")
    (gzip.open(path, "wt") if zipped else open(path, "w")).write(DUMP)
    got = {r["sample_id"]: r for r in inks.dump_drawings(spark, str(path)).collect()}
    assert sorted(got) == [1, 2, 3]
    assert [[(p["x"], p["y"]) for p in s] for s in got[1]["strokes"]] == [[(10, 20), (12, 25)], [(30, 40)]]
    assert got[1]["first_ms"] == 1500000000123 and got[2]["first_ms"] is None and got[3]["first_ms"] is None
    writers = [r[0] for r in inks.dump_drawings(spark, str(path)).orderBy("sample_id").select(T.pseudo_writer(F.col("first_ms"))).collect()]
    assert writers == ["day-2017-07-14", "day-unknown", "day-unknown"]


def test_stroke_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("s/Greek/character01/0394_07.txt", "START\n1.5,-2,0\r\n3,-4,10\nBREAK\n5,-6,20\nBREAK\n")
        z.writestr("s/Greek/readme.md", "x")
    (r,) = inks.archive_drawings(spark, str(tmp_path / "*.zip")).collect()
    assert (r["writer"], r["label"], r["number"], r["sample_id"]) == ("Greek/drawer07", "Greek/character01", 1, "0394_07")
    assert [[(p["x"], p["y"]) for p in s] for s in r["strokes"]] == [[(1.5, 2), (3, 4)], [(5, 6)]]


def test_pen_words(spark, tmp_path):
    text = "// head\r\nWORD a trn_UJI_W01-01\r\n  NUMSTROKES 2\r\n  POINTS 2 # 1 2 3 4\r\n  POINTS 1 # 5 6\r\nWORD ñ tst_UPV_W18-02\r\n  NUMSTROKES 1\r\n  POINTS 1 # 7 8\r\n"
    (tmp_path / "u.txt").write_bytes(text.encode())
    got = sorted((r["sample_id"], r["label"], [[(p["x"], p["y"]) for p in s] for s in r["strokes"]]) for r in inks.pen_drawings(spark, str(tmp_path / "u.txt")).collect())
    assert got == [("UJI_W01-a-1", "a", [[(1, 2), (3, 4)], [(5, 6)]]), ("UPV_W18-ñ-2", "ñ", [[(7, 8)]])]
    with pytest.raises(ValueError):
        list(inks.pen_words("WORD a t_S_W1-1\n NUMSTROKES 1\n POINTS 2 # 1 2\n"))


def test_tsv_mapping_pads_and_skips_comments(spark, tmp_path, rows):
    (tmp_path / "m.tsv").write_text("# c\n\na\t\\alpha\tU+03B1\nb\n")
    assert rows(inks.tsv_mapping(spark, str(tmp_path / "m.tsv"), ["key", "command", "cp"])) == [("a", "\\alpha", "U+03B1"), ("b", "", "")]


def test_whole_streams_skip_ragged_ends(spark, rows):
    parts = [bz2.compress(f"<page>{i}</page>".encode() * 50) for i in range(5)]
    data = b"".join(parts)
    cut = data[len(parts[0]) // 2 : len(data) - len(parts[4]) // 2]
    assert [s[:7] for s in wiki.whole_streams(cut)] == [b"<page>1", b"<page>2", b"<page>3"]
    df = spark.createDataFrame([(1, bytearray(cut)), (2, None), (3, bytearray(b"BZh91AY&SY junk"))], "id int, data binary")
    assert [(r["id"], r["xml"][:7]) for r in wiki.stream_texts(df, "data", ["id"]).collect()] == [(1, "<page>1"), (1, "<page>2"), (1, "<page>3")]


def test_articles_only(spark):
    page = lambda text, ns=0, extra="": f'<page><title>t</title><ns>{ns}</ns>{extra}<revision><text bytes="1">{text}</text></revision></page>'
    xml = page("one &amp;lt; two") + page("talk", 1) + page("#R", 0, '<redirect title="A" />')
    assert [r["text"] for r in wiki.article_texts(spark.createDataFrame([(xml,), (None,)], "xml string"), "xml").collect()] == ["one &lt; two"]


def test_dump_files_prefer_the_single_file(spark, tmp_path):
    parts = ["x-multistream10.xml-p9p10.bz2", "x-multistream2.xml-p3p4.bz2", "x-multistream-index2.txt-p3p4.bz2"]

    def status(names, state="done"):
        (tmp_path / "s.json").write_text(json.dumps({"jobs": {"articlesmultistreamdump": {"status": state, "files": {n: {"size": 10, "sha1": "x"} for n in names}}}}))
        return wiki.dump_files(spark, str(tmp_path / "s.json"))

    assert [r["file_name"] for r in status(parts).orderBy("part").collect()] == parts[1::-1]
    assert [r["file_name"] for r in status(["x-multistream.xml.bz2", *parts]).collect()] == ["x-multistream.xml.bz2"]
    with pytest.raises(Exception, match="dump not finished"):
        status(parts, "waiting").collect()


WIKI = "'''Bold''' [[Link|shown]] {{cite|title=x|url=y}} [https://a.org site] <ref>note</ref><!-- hidden --> see https://example.org/a <math>\\int_0^1 x\\,dx \\le 2</math> café&nbsp;<syntaxhighlight lang=c>int main();</syntaxhighlight>\n== Head ==\n* item"


def test_cleaning_keeps_visible_text(spark):
    df = spark.createDataFrame([(WIKI,), (None,), ("",)], "w string")
    got = df.select(T.visible_text(F.col("w")).alias("a"), T.visible_text(F.col("w"), True).alias("b"), T.math_of(F.col("w")).alias("m")).collect()
    for text in (got[0]["a"], got[0]["b"]):
        assert all(x in text for x in ("Bold", "shown", "note", "café ", "site", "Head", " item"))
        assert not any(x in text for x in ("'''", "[", "{{", "hidden", "https", "main", "<", "=", "title", "*"))
    assert got[0]["m"] == ["\\int_0^1 x\\,dx \\le 2"]
    assert got[1]["a"] is None and got[2]["a"] == ""


def test_formulas_draw_characters(spark):
    commands = spark.createDataFrame([("\\int", ord("∫")), ("\\le", ord("≤")), ("\\alpha", ord("α"))], "command string, code_point int")
    df = spark.createDataFrame([(1, "\\int_0^1 x - y' \\le \\mathbb{R} \\alpha{} \\mathrm{d} \\% \\nothing"), (2, None)], "id int, f string")
    got = "".join(chr(r["code_point"]) for r in formula_characters(df, "id", "f", commands).orderBy("place").collect())
    assert got == "∫01x−y′≤ℝαd%"


def test_vector_index_round_trip(spark, tmp_path):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(7, 5))
    cps = [66, 65, 66, 128512, 65, 67, 67]
    df = spark.createDataFrame([(c, [float(x) for x in r]) for c, r in zip(cps, v)], "code_point int, vector array<double>")
    data = vector_files.index_bytes(df)
    (tmp_path / "i.bin").write_bytes(data)
    got = vector_files.read_index(spark, str(tmp_path / "i.bin")).toPandas().sort_values("vec_no")
    order = np.argsort(cps, kind="stable")
    assert got["code_point"].tolist() == [cps[i] for i in order]
    assert np.abs(np.stack(got["vector"]) - v[order]).max() <= np.abs(v).max() / 254 + 1e-6
    for bad in (b"NOPE" + data[4:], data + b"x", data[:4] + b"\x09\x00" + data[6:]):
        with pytest.raises(ValueError):
            vector_files.unpack_index(bad)


def test_links_round_trip(spark):
    strokes = [[{"x": 1.24, "y": -3.0}, {"x": 500.0, "y": 7.06}], [{"x": 0.0, "y": 0.0}]]
    df = spark.createDataFrame([(1, strokes), (2, None)], "id int, s array<array<struct<x: double, y: double>>>")
    got = df.select("id", links.encode_drawing(F.col("s")).alias("l")).withColumn("back", links.decode_drawing(F.col("l"))).orderBy("id").collect()
    assert [[(p["x"], p["y"]) for p in s] for s in got[0]["back"]] == [[(1.2, -3.0), (500.0, 7.1)], [(0.0, 0.0)]]
    assert got[1]["l"] is None and got[1]["back"] is None
    assert links.unpack_strokes("2AA") is None and links.unpack_strokes("1!") is None and links.unpack_strokes("1") is None and links.unpack_strokes(got[0]["l"][:-2]) is None


def test_sinks(spark, tmp_path, rows):
    df = spark.createDataFrame([(3, "c"), (1, "a|b"), (2, None)], "n int, s string")
    write_sorted(df, str(tmp_path / "t"), ["n"], 2)
    assert rows(spark.read.parquet(str(tmp_path / "t"))) == rows(df)
    for slug in ("one", "two", "one"):
        write_evaluation(df.limit(1), str(tmp_path / "e"), slug)
    assert rows(spark.read.parquet(str(tmp_path / "e")).groupBy("slug").count()) == [("one", 1), ("two", 1)]
    append_json(df, str(tmp_path / "j"))
    append_json(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 6
    write_tsv(df, str(tmp_path / "v"))
    assert manifest(spark, str(tmp_path / "v")).where("length(sha256) = 64").count() >= 1
    assert "| 1 | a\\|b |" in markdown(df, title="T") and cell(None) == "–" and cell(0.5, True) == "50.0" and cell(float("nan")) == "–"


def test_code_points(spark):
    df = spark.createDataFrame([("U+00E9",), ("0xe9",), (" E9 ",), ("zz",), (None,), ("1F600",)], "t string")
    got = df.select(T.parse_code_point(F.col("t")).alias("p")).withColumn("f", T.format_code_point(F.col("p"))).withColumn("c", T.char_of(F.col("p"))).withColumn("o", T.code_point_of(F.col("c"))).collect()
    assert [r["p"] for r in got] == [233, 233, 233, None, None, 0x1F600] and got[5]["f"] == "U+1F600" and got[5]["o"] == 0x1F600 and got[0]["f"] == "U+00E9"
    spaces = [c for c in map(chr, range(0xD800)) if c.isspace()]
    every = spark.createDataFrame([(c,) for c in map(chr, range(1, 0x3100))], "c string")
    assert sorted(r["c"] for r in every.where(T.is_space(F.col("c"))).collect()) == spaces


def test_vectors(spark):
    df = spark.createDataFrame([(1, [3.0, 4.0]), (1, [0.0, 5.0]), (2, [0.0, 0.0]), (3, None), (None, [1.0, 1.0])], "k int, v array<double>")
    got = {r["k"]: r["v"] for r in V.mean_vectors(df, "k", "v").collect()}
    assert got[1] == pytest.approx([3 / 90**0.5, 9 / 90**0.5]) and got[2] == [0.0, 0.0] and set(got) == {1, 2}
    q = df.where("k = 1 AND v[0] = 3").select(V.quantize(F.col("v")).alias("q")).select("q", V.dequantize(F.col("q")).alias("d")).first()
    assert q["q"]["values"] == [95, 127] and q["d"] == pytest.approx([95 * 4 / 127, 4.0])
    assert [r[0] for r in spark.createDataFrame([([1.0, float("nan")],), ([0.0, 0.0],), ([1.0],), ([1.0, None],), (None,), ([1.0, 2.0],)], "v array<double>").select(V.finite(F.col("v"), 2)).collect()] == [False] * 5 + [True]
