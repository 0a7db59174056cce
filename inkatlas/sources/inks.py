"""Readers of three public formats of handwriting; all give strokes as arrays of points with y downwards."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STROKES = "array<array<struct<x: float, y: float>>>"


def copy_block(spark: SparkSession, path: str, table: str, columns: list[str]) -> DataFrame:
    """Rows of the block ``COPY table (columns) FROM stdin`` of a database dump, plain or compressed, as strings.

    Lines keep their order by split and line, so the block's ends are found wherever the file is split.
    """
    head = f"COPY {table} ({', '.join(columns)})"
    lines = spark.read.text(path).select("value", F.struct(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i")).alias("at"))
    begin = lines.where(F.startswith("value", F.lit(head))).groupBy(F.col("at.f").alias("f")).agg(F.min("at").alias("begin"))
    inside = lines.join(F.broadcast(begin), lines["at.f"] == begin["f"]).where(F.col("at") > F.col("begin"))
    end = inside.where(F.startswith("value", F.lit("\\."))).groupBy("f").agg(F.min("at").alias("end"))
    kept = inside.join(F.broadcast(end), "f", "left").where(F.col("end").isNull() | (F.col("at") < F.col("end")))
    fields = F.split("value", "\t")
    return kept.select(*[F.get(fields, F.lit(i)).alias(c) for i, c in enumerate(columns)])


def dump_drawings(spark: SparkSession, path: str) -> DataFrame:
    """``(sample_id, key, strokes, first_ms)`` from the block ``samples (id, key, strokes)``: strokes are JSON
    ``[[[x, y, ms], ...], ...]``; empty strokes go, ``first_ms`` is the time of the first point of the first stroke."""
    rows = copy_block(spark, path, "samples", ["id", "key", "strokes"])
    parsed = rows.select(F.col("id").cast("bigint").alias("sample_id"), "key", F.from_json("strokes", "array<array<array<double>>>").alias("s"))
    strokes = F.transform(F.filter("s", lambda k: F.size(k) > 0), lambda k: F.transform(k, lambda p: F.struct(p[0].cast("float").alias("x"), p[1].cast("float").alias("y"))))
    return parsed.select("sample_id", "key", strokes.alias("strokes"), F.get(F.get(F.get("s", F.lit(0)), F.lit(0)), F.lit(2)).cast("bigint").alias("first_ms"))


def tsv_mapping(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A tab-separated mapping: comment and empty lines are skipped, missing fields are empty strings."""
    rows = spark.read.text(path).where((F.col("value") != "") & ~F.startswith("value", F.lit("#"))).select(F.split("value", "\t").alias("f"))
    return rows.select(*[F.coalesce(F.get("f", F.lit(i)), F.lit("")).alias(c) for i, c in enumerate(columns)])


#: Fixed value: members of the archive that hold strokes: alphabet, number of the character, drawing, drawer.
MEMBER = r"^[^/]+/([^/]+)/character(\d+)/(\d+)_(\d+)\.txt$"


def archive_members(spark: SparkSession, path: str) -> DataFrame:
    """``(member, text)`` of every file in zip archives; one archive is one task, so keep archives small or many."""

    def unzip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for content in pdf["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    for name in sorted(archive.namelist()):
                        if not name.endswith("/"):
                            yield pd.DataFrame({"member": [name], "text": [archive.read(name).decode("utf-8")]})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(unzip, "member string, text string")


def stroke_file(text):
    """Strokes of ``START``, ``x,y,t`` and ``BREAK`` lines; y is turned downwards, empty strokes go."""
    lines = F.transform(F.split(text, r"\r\n|\r|\n"), lambda x: F.trim(x))
    blocks = F.split(F.array_join(F.transform(lines, lambda s: F.when(s.isin("START", "BREAK", ""), F.lit("|")).otherwise(s)), ";"), r"\|")
    kept = F.filter(F.transform(blocks, lambda b: F.filter(F.split(b, ";"), lambda p: p != "")), lambda k: F.size(k) > 0)
    point = lambda p: F.struct(F.split(p, ",")[0].cast("float").alias("x"), (-F.split(p, ",")[1].cast("float")).alias("y"))
    return F.transform(kept, lambda k: F.transform(k, point))


def archive_drawings(spark: SparkSession, path: str) -> DataFrame:
    """``(sample_id, alphabet, number, drawer, writer, label, strokes)`` of archives of stroke files."""
    part = lambda i: F.regexp_extract("member", MEMBER, i)
    rows = archive_members(spark, path).where(F.col("member").rlike(MEMBER))
    stem = F.regexp_extract("member", r"([^/]+)\.txt$", 1)
    return rows.select(stem.alias("sample_id"), part(1).alias("alphabet"), part(2).cast("int").alias("number"), part(4).alias("drawer"), F.concat(part(1), F.lit("/drawer"), part(4)).alias("writer"), F.concat(part(1), F.lit("/character"), part(2)).alias("label"), stroke_file(F.col("text")).alias("strokes")).where(F.size("strokes") > 0)


#: The head of a block (character, site, writer, repetition), its number of strokes, and a stroke.
WORD_HEAD = re.compile(r"WORD (\S+) [^_\s]*_([^_\s]*)_([^-\s]*)-(\d+)")
WORD_COUNT, WORD_STROKE = re.compile(r"NUMSTROKES\s+(\d+)"), re.compile(r"POINTS\s+(\d+)\s*#([^\r\n]*)")


def pen_words(text: str) -> Iterator[tuple[str, str, int, list[list[dict[str, float]]]]]:
    """``(character, writer, repetition, strokes)`` of WORD blocks; raises if a block's strokes or a stroke's points do
    not match their counts."""
    heads = list(WORD_HEAD.finditer(text))
    for head, end in zip(heads, [h.start() for h in heads[1:]] + [len(text)]):
        block = text[head.end() : end]
        count, drawn = WORD_COUNT.search(block), WORD_STROKE.findall(block)
        strokes = [np.array(numbers.split(), float) for _, numbers in drawn]
        if count is None or int(count.group(1)) != len(drawn) or any(2 * int(n) != len(s) for (n, _), s in zip(drawn, strokes)):
            raise ValueError(f"wrong number of coordinates or strokes in {head.group()}")
        character, site, writer, repetition = head.groups()
        yield character, f"{site}_{writer}", int(repetition), [[{"x": x, "y": y} for x, y in s.reshape(-1, 2).tolist()] for s in strokes]


def pen_drawings(spark: SparkSession, path: str) -> DataFrame:
    """``(sample_id, writer, label, repetition, strokes)`` of text files of WORD blocks, one file a task."""
    point = pa.struct([("x", pa.float32()), ("y", pa.float32())])
    kinds = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.list_(pa.list_(point))]
    names = ["sample_id", "writer", "label", "repetition", "strokes"]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows = [(f"{w}-{c}-{r}", w, c, r, s) for c, w, r, s in pen_words(content.as_py().decode("utf-8"))]
                yield pa.RecordBatch.from_arrays([pa.array(list(v), k) for v, k in zip(zip(*rows) if rows else [()] * 5, kinds)], names=names)

    rows = spark.read.format("binaryFile").load(path).select("content").mapInArrow(parse, f"sample_id string, writer string, label string, repetition int, strokes {STROKES}")
    return rows.where(F.size("strokes") > 0)


def labelled_drawings(spark: SparkSession, path: str) -> DataFrame:
    """Drawings saved as JSON lines: ``(label, strokes, candidates, saved_at)``."""
    rows = spark.read.schema("label string, strokes array<array<array<double>>>, candidates array<string>, savedAt string").json(path)
    strokes = F.transform("strokes", lambda k: F.transform(k, lambda p: F.struct(p[0].cast("float").alias("x"), p[1].cast("float").alias("y"))))
    return rows.select("label", strokes.alias("strokes"), "candidates", F.col("savedAt").alias("saved_at"))
