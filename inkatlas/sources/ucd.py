"""Readers of the Unicode Character Database's text files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkatlas.operators.lookups import expand_ranges, overlapping_ranges, range_lookup

#: Names of ranges whose members are named by a prefix and their code point.
NUMBERED = {"CJK Ideograph": "CJK UNIFIED IDEOGRAPH-", "Tangut Ideograph": "TANGUT IDEOGRAPH-", "Jurchen Character": "JURCHEN CHARACTER-", "Seal Character": "SEAL CHARACTER-"}
#: Short names of the leading, middle and trailing parts of Hangul syllables.
LEADING = ("G", "GG", "N", "D", "DD", "R", "M", "B", "BB", "S", "SS", "", "J", "JJ", "C", "K", "T", "P", "H")
MIDDLE = ("A", "AE", "YA", "YAE", "EO", "E", "YEO", "YE", "O", "WA", "WAE", "OE", "YO", "U", "WEO", "WE", "WI", "YU", "EU", "YI", "I")
TRAILING = ("", "G", "GG", "GS", "N", "NJ", "NH", "D", "L", "LG", "LM", "LB", "LS", "LT", "LP", "LH", "M", "B", "BS", "S", "SS", "NG", "J", "C", "K", "T", "P", "H")
FIRST_SYLLABLE = 0xAC00


def data_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(value)``: lines without comments, outer white space and a byte order mark; empty ones are left out."""
    bare = F.regexp_replace(F.substring_index("value", "#", 1), r"^\s*\x{feff}?\s*|\s+$", "")
    return spark.read.text(path).select(bare.alias("value")).where("value <> ''")


def _field(i: int) -> Column:
    return F.trim(F.get(F.split("value", ";"), F.lit(i)))


def _hex(c: Column) -> Column:
    return F.conv(F.when(F.trim(c) != "", F.trim(c)), 16, 10).cast("int")


def hangul_name(cp: Column) -> Column:
    i = cp - FIRST_SYLLABLE
    pick = lambda names, at: F.get(F.array(*[F.lit(n) for n in names]), at.cast("int"))
    per_lead, per_middle = len(MIDDLE) * len(TRAILING), len(TRAILING)
    return F.concat(F.lit("HANGUL SYLLABLE "), pick(LEADING, F.floor(i / per_lead)), pick(MIDDLE, F.floor(F.pmod(i, F.lit(per_lead)) / per_middle)), pick(TRAILING, F.pmod(i, F.lit(per_middle))))


def padded_hex(cp: Column) -> Column:
    return F.when(F.length(F.hex(cp)) < 4, F.lpad(F.hex(cp), 4, "0")).otherwise(F.hex(cp))


def range_file(spark: SparkSession, path: str) -> DataFrame:
    """``(first, last, value)`` of a file of ``XXXX..YYYY ; value`` or ``XXXX ; value``."""
    ends = F.split(_field(0), r"\.\.")
    return data_lines(spark, path).select(_hex(F.get(ends, F.lit(0))).alias("first"), F.coalesce(_hex(F.get(ends, F.lit(1))), _hex(F.get(ends, F.lit(0)))).alias("last"), _field(1).alias("value"))


def checked(ranges: DataFrame) -> DataFrame:
    """The same ranges; raises ValueError if two of them overlap."""
    clash = overlapping_ranges(ranges).limit(1).collect()
    if clash:
        raise ValueError(f"overlapping ranges at U+{clash[0]['first']:04X}")
    return ranges


def unicode_data(spark: SparkSession, path: str) -> DataFrame:
    """``(code_point, name, general_category, decomposition, simple_uppercase, simple_lowercase)``.

    Lines of fewer than 15 fields are skipped; a pair of First and Last lines becomes all its members, and a Last line
    without its First raises when read; control characters are named by their code point.
    """
    raw = spark.read.text(path).where(F.size(F.split("value", ";")) >= 15)
    cut = raw.select(_hex(_field(0)).alias("code_point"), _field(1).alias("name"), _field(2).alias("general_category"), _field(5).alias("decomposition"), _hex(_field(12)).alias("simple_uppercase"), _hex(_field(13)).alias("simple_lowercase"))
    order = Window.orderBy("code_point")  # one file of some ten thousand lines
    paired = cut.withColumns({"from": F.lag("code_point").over(order), "from_name": F.lag("name").over(order)})
    starts, ends = F.endswith("name", F.lit(", First>")), F.endswith("name", F.lit(", Last>"))
    label = F.regexp_extract("from_name", r"^<(.*), First>$", 1)
    numbered = F.lit(None).cast("string")
    for start, prefix in NUMBERED.items():
        numbered = F.when(F.startswith("label", F.lit(start)), F.concat(F.lit(prefix), padded_hex(F.col("code_point")))).otherwise(numbered)
    member_name = F.when(F.col("label") == "Hangul Syllable", hangul_name(F.col("code_point"))).otherwise(F.coalesce(numbered, F.concat(F.lit("<"), F.lower("label"), F.lit("-"), padded_hex(F.col("code_point")), F.lit(">"))))
    first = F.when(F.endswith("from_name", F.lit(", First>")), F.col("from")).otherwise(F.raise_error(F.concat(F.lit("range end without start at U+"), padded_hex(F.col("code_point")))).cast("int"))
    members = paired.where(ends).select(F.explode(F.sequence(first, F.col("code_point"))).alias("code_point"), label.alias("label"), "general_category")
    expanded = members.select("code_point", member_name.alias("name"), "general_category", F.lit("").alias("decomposition"), F.lit(None).cast("int").alias("simple_uppercase"), F.lit(None).cast("int").alias("simple_lowercase"))
    name = F.when(F.col("name") == "<control>", F.concat(F.lit("<control-"), padded_hex(F.col("code_point")), F.lit(">"))).otherwise(F.col("name"))
    return cut.where(~starts & ~ends).withColumn("name", name).unionByName(expanded)


def script_aliases(spark: SparkSession, path: str) -> DataFrame:
    """``(alias, script)``: every short, long and extra name of a script with its long name."""
    fields = F.transform(F.split("value", ";"), lambda x: F.trim(x))
    rows = data_lines(spark, path).select(fields.alias("f")).where(F.get("f", F.lit(0)) == "sc")
    return rows.select(F.explode(F.array_distinct(F.slice("f", F.lit(2), F.size("f") - 1))).alias("alias"), F.get("f", F.lit(2)).alias("script"))


def script_extensions(spark: SparkSession, path: str, aliases: DataFrame) -> DataFrame:
    """``(code_point, scripts)``: the sorted long names of the scripts that use a character."""
    listed = range_file(spark, path).select("first", "last", F.explode(F.split("value", r"\s+")).alias("alias"))
    named = listed.join(F.broadcast(aliases), "alias").groupBy("first", "last").agg(F.sort_array(F.collect_list("script")).alias("scripts"))
    return expand_ranges(named)


def code_points_with(spark: SparkSession, path: str, prop: str) -> DataFrame:
    """``(code_point)`` of all characters listed with a property."""
    return expand_ranges(range_file(spark, path).where(F.col("value") == prop).select("first", "last")).distinct()


def confusables(spark: SparkSession, path: str) -> DataFrame:
    """``(source, target)``: a character and the sequence it looks like."""
    return data_lines(spark, path).select(_hex(_field(0)).alias("source"), F.transform(F.split(_field(1), r"\s+"), lambda x: F.conv(x, 16, 10).cast("int")).alias("target"))


def database(spark: SparkSession, directory: str) -> DataFrame:
    """One row for each assigned character with block, script (``Unknown`` without one), age, script extensions (its own
    script without any) and the flags ``deprecated`` and ``emoji_presentation``."""
    at = lambda name: f"{directory}/{name}"
    rows = unicode_data(spark, at("UnicodeData.txt"))
    for column, name, default in (("block", "Blocks.txt", None), ("script", "Scripts.txt", "Unknown"), ("age", "DerivedAge.txt", None)):
        ranges = checked(range_file(spark, at(name))).withColumnRenamed("value", column)
        rows = range_lookup(rows, "code_point", ranges, column, default)
    extensions = script_extensions(spark, at("ScriptExtensions.txt"), script_aliases(spark, at("PropertyValueAliases.txt")))
    for column, name, prop in (("deprecated", "PropList.txt", "Deprecated"), ("emoji_presentation", "emoji/emoji-data.txt", "Emoji_Presentation")):
        flagged = code_points_with(spark, at(name), prop).withColumn(column, F.lit(True))
        rows = rows.join(F.broadcast(flagged), "code_point", "left").withColumn(column, F.coalesce(column, F.lit(False)))
    return rows.join(extensions, "code_point", "left").withColumn("script_extensions", F.coalesce("scripts", F.array("script"))).drop("scripts")


def command_table(spark: SparkSession, path: str) -> DataFrame:
    """``(command, code_point, preferred)`` of an XML list of characters with their names in formulas.

    Elements ``latex``, ``varlatex``, ``mathlatex``, ``AMS`` and ``IEEE`` name a character; ``preferred`` marks a
    ``mathlatex`` of the set ``unicode-math``. Entries of several code points and empty names are skipped; white space
    within a command is dropped.
    """
    named = "array<struct<_VALUE: string, _set: string>>"
    schema = f"_id string, latex {named}, varlatex {named}, mathlatex {named}, AMS {named}, IEEE {named}"
    rows = spark.read.format("xml").option("rowTag", "character").schema(schema).load(path).where(F.col("_id").rlike("^U[0-9A-Fa-f]+$"))
    entry = lambda c: F.transform(F.coalesce(c, F.array().cast(named)), lambda e: F.struct(e["_VALUE"].alias("command"), (F.lit(c == "mathlatex") & F.coalesce(e["_set"] == "unicode-math", F.lit(False))).alias("preferred")))
    every = F.concat(*[entry(c) for c in ("latex", "varlatex", "mathlatex", "AMS", "IEEE")])
    flat = rows.select(_hex(F.substring("_id", 2, 6)).alias("code_point"), F.explode(every).alias("e"))
    return flat.select(F.regexp_replace("e.command", r"\s+", "").alias("command"), "code_point", "e.preferred").where("command <> ''").groupBy("command", "code_point").agg(F.max("preferred").alias("preferred"))
