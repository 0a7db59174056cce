"""Characters that formulas draw."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkatlas.functions.text import code_point_of, latex_tokens

#: Signs that are syntax, signs that stand for another character, and escapes that are drawn.
SYNTAX = "{}^_&$~\\"
DRAWN_AS = {"-": 0x2212, "'": 0x2032}
ESCAPED = "{}%#&$_"


#: The word in a styled letter's name, and the commands of its alphabet.
ALPHABETS = {"DOUBLE-STRUCK": ("mathbb",), "SCRIPT": ("mathcal", "mathscr"), "FRAKTUR": ("mathfrak",), "BLACK-LETTER": ("mathfrak",)}


def _styled_letters() -> list[tuple[str, str, int]]:
    """``(command, letter, code point)`` of styled letters: the characters that decompose to a letter or digit in another
    font, by the style their names tell. Where a letter has two, the one among the mathematical alphabets counts."""
    import unicodedata

    found = {}
    for cp in range(0x2100, 0x1D800):
        font, _, base = unicodedata.decomposition(chr(cp)).partition("<font> ")
        words = set(unicodedata.name(chr(cp), "").split())
        letter = chr(int(base, 16)) if base else ""
        if font or not letter.isascii() or not letter.isalnum() or words & {"BOLD", "ITALIC"}:
            continue
        found |= {(command, letter): cp for style, commands in ALPHABETS.items() if style in words for command in commands}
    return [(command, letter, cp) for (command, letter), cp in found.items()]


def formula_characters(formulas: DataFrame, id_col: str, formula_col: str, commands: DataFrame) -> DataFrame:
    """``(id, place, code_point)`` for each character a formula draws.

    ``commands``: ``(command, code_point)`` with names such as ``\\alpha`` or ``\\mathbb{R}``. A command with a braced
    letter is looked up whole, then as a styled letter, then both apart; unknown commands draw nothing; syntax draws
    nothing. Null formulas give no row.
    """
    spark = formulas.sparkSession
    known = F.broadcast(commands.groupBy("command").agg(F.min("code_point").alias("cp")))  # the language's commands, some thousands
    styled = F.broadcast(spark.createDataFrame([(rf"\{c}{{{a}}}", cp) for c, a, cp in _styled_letters()], "styled string, styled_cp int"))
    tokens = formulas.select(F.col(id_col), F.posexplode(latex_tokens(F.col(formula_col))).alias("place", "t")).select(id_col, "place", "t.*")
    name = F.concat(F.lit("\\"), F.col("name"))
    whole = F.when(F.col("argument") != "", F.concat(name, F.lit("{"), F.col("argument"), F.lit("}")))
    keyed = tokens.withColumns({"whole": whole, "alone": F.when(F.col("name") != "", name)})
    joined = (
        keyed.join(known.select(F.col("command").alias("whole"), F.col("cp").alias("whole_cp")), "whole", "left")
        .join(styled, F.col("whole") == F.col("styled"), "left")
        .join(known.select(F.col("command").alias("alone"), F.col("cp").alias("alone_cp")), "alone", "left")
    )
    of = lambda c: F.when(F.col(c) != "", code_point_of(F.col(c)))
    swaps = F.lit(None).cast("int")
    for sign, cp in DRAWN_AS.items():
        swaps = F.when(F.col("sign") == sign, F.lit(cp)).otherwise(swaps)
    plain = F.when((F.col("sign") != "") & ~F.col("sign").isin(*SYNTAX), F.coalesce(swaps, of("sign")))
    drawn = (
        F.when(F.col("name") != "", F.when(F.coalesce("whole_cp", "styled_cp").isNotNull(), F.array(F.coalesce("whole_cp", "styled_cp"))).otherwise(F.array(F.col("alone_cp"), of("argument"))))
        .when(F.col("escaped") != "", F.array(F.when(F.col("escaped").isin(*ESCAPED), of("escaped"))))
        .otherwise(F.array(plain))
    )
    return joined.select(id_col, "place", F.explode(drawn).alias("code_point")).where("code_point IS NOT NULL")
