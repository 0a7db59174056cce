"""Characters, code points and the cleaning of wiki text."""

from __future__ import annotations

import html
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: matches exactly the characters that count as white space in Python.
SPACE = r"^([\x1c-\x1f]|(?U)\s)$"


def is_space(char: Column) -> Column:
    return char.rlike(SPACE)


def parse_code_point(text: Column) -> Column:
    """``U+00E9``, ``0xe9`` and ``e9`` are 233; null for null or what is no hexadecimal number."""
    bare = F.regexp_replace(F.upper(F.trim(text)), r"^(U\+|0X)", "")
    return F.when(bare.rlike("^[0-9A-F]{1,6}$"), F.conv(bare, 16, 10).cast("int"))


def format_code_point(cp: Column) -> Column:
    digits = F.hex(cp)
    return F.concat(F.lit("U+"), F.when(F.length(digits) < 4, F.lpad(digits, 4, "0")).otherwise(digits))


def char_of(cp: Column) -> Column:
    """The character of a code point (surrogates excluded)."""
    return F.decode(F.unhex(F.lpad(F.hex(cp), 8, "0")), "UTF-32")


def code_point_of(char: Column) -> Column:
    return F.ascii(char)


def characters(text: Column) -> Column:
    """The characters of a text, an empty array for null and empty texts."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), ""), lambda c: c != "")


#: Elements whose contents are no visible text.
HIDDEN = "syntaxhighlight|source|pre|code|score|timeline|graph|mapframe|chem|ce"
#: Patterns of markup in the order of their removal, and what takes their place.
MARKUP = (
    (r"(?s)<!--.*?-->", ""),
    (r"(?si)<math\b[^>]*>.*?</math>", " "),
    (rf"(?si)<({HIDDEN})\b[^>]*>.*?</\1>", " "),
    (r"</?[A-Za-z][^<>]*/?>", ""),
    (r"https?://[^\s\]|}<>]+", ""),
    (r"__[A-Z]+__", ""),
    (r"(?U)\|\s*[\w-]+\s*=", " "),
)
#: Tokens of markup in the order of their removal; those that separate become a space.
TOKENS = ("'''", "''", "{{", "}}", "[[", "]]", "[", "]", "{|", "|}", "|-", "|+", "|", "!!")
SEPARATORS = ("|", "!!", "|-", "|+")
#: Fixed value: marks of lists and headings at the ends of lines.
LINE_MARKS = r"(?md)^[*#:;]+|^=+|=+\s*$"
#: Entities that are replaced, the ampersand last.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", "\u00a0"), ("&amp;", "&"))


def unescape_basic(text: Column) -> Column:
    return reduce(lambda c, e: F.replace(c, F.lit(e[0]), F.lit(e[1])), ENTITIES, text)


def _unescape_all(texts: pd.Series) -> pd.Series:
    return texts.map(html.unescape, na_action="ignore")


def unescape(text: Column) -> Column:
    """Every HTML entity replaced, in a vectorised Python function; null for null."""
    return F.pandas_udf(_unescape_all, "string")(text)


def marked_down(wikitext: Column) -> Column:
    """Wiki text without comments, math, code, tags, addresses, parameters' names and markup; entities stay."""
    text = reduce(lambda c, m: F.regexp_replace(c, m[0], m[1]), MARKUP, wikitext)
    text = reduce(lambda c, t: F.replace(c, F.lit(t), F.lit(" " if t in SEPARATORS else "")), TOKENS, text)
    return F.regexp_replace(text, LINE_MARKS, "")


def visible_text(wikitext: Column, every_entity: bool = False) -> Column:
    """What a reader sees of wiki text; ``every_entity`` replaces all entities instead of the common six."""
    text = marked_down(wikitext)
    return unescape(text) if every_entity else unescape_basic(text)


def math_of(wikitext: Column) -> Column:
    """The contents of all math elements, in order."""
    return F.transform(F.regexp_extract_all(F.regexp_replace(wikitext, r"(?s)<!--.*?-->", ""), F.lit(r"(?si)<math\b[^>]*>(.*?)</math>"), F.lit(1)), unescape_basic)


#: Fixed value: a command with or without one braced letter, an escaped sign, or one other sign.
LATEX_TOKEN = r"\\([A-Za-z]+)(?:\s*\{\s*([A-Za-z0-9])\s*\})?|\\(.)|(\S)"


def latex_tokens(formula: Column) -> Column:
    """Tokens ``(name, argument, escaped, sign)`` of a formula in order, empty where a part is absent."""
    part = lambda i: F.regexp_extract_all(formula, F.lit(LATEX_TOKEN), F.lit(i))
    return F.arrays_zip(part(1).alias("name"), part(2).alias("argument"), part(3).alias("escaped"), part(4).alias("sign"))


def pseudo_writer(epoch_ms: Column) -> Column:
    """``day-YYYY-MM-DD`` (UTC) of a time in milliseconds, ``day-unknown`` for null."""
    day = F.date_format(F.timestamp_millis(epoch_ms.cast("bigint")), "yyyy-MM-dd")
    return F.coalesce(F.concat(F.lit("day-"), day), F.lit("day-unknown"))


def display_text(char: Column, general_category: Column) -> Column:
    """A combining mark is shown on a dotted circle."""
    return F.when(F.startswith(general_category, F.lit("M")), F.concat(F.lit("◌"), char)).otherwise(char)
