"""How typed names are read: letters regardless of case and values of numbers, in order; nothing else counts."""

from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkatlas.functions.vectors import let


def _foldings() -> tuple[str, str]:
    """One-to-one compatibility foldings of letters and digits to ASCII, derived from the Unicode database."""
    source, target = [], []
    for cp in range(0x80, sys.maxunicode + 1):
        ch = chr(cp)
        category = unicodedata.category(ch)
        if category == "Nd":
            to = str(unicodedata.decimal(ch))
        elif category[0] in "LN":
            to = unicodedata.normalize("NFKC", ch)
        else:
            continue
        if len(to) == 1 and to != ch and to.isascii() and to.isalnum():
            source.append(ch)
            target.append(to)
    return "".join(source), "".join(target)


_SOURCE, _TARGET = _foldings()


def read_name(column: Column) -> Column:
    """The reading of a name: ``" Session_0000672"`` and ``"session-672"`` both read ``SESSION#672#``.

    Letters are upper-cased, each run of digits becomes ``#value#`` without leading zeros, everything else is dropped.
    Null stays null; a name without letters or digits reads as the empty string.
    """
    plain = F.when(F.octet_length(column) == F.length(column), column).otherwise(F.translate(column, _SOURCE, _TARGET))
    kept = F.regexp_replace(F.upper(plain), r"[^\p{L}\p{M}0-9]+", "|")
    numbered = F.regexp_replace(kept, r"0*([0-9]+)", "#$1#")
    return F.replace(numbered, F.lit("|"), F.lit(""))


#: Readings of person codes that name nobody.
NOBODY = ("", "NA", "NAN", "NONE", "NULL", "NIL", "NOBODY", "UNKNOWN", "UNK", "ANONYMOUS", "ANON", "UNNAMED", "NOTAVAILABLE", "NOTGIVEN", "UNSPECIFIED", "MISSING", "TBD", "X", "XX", "XXX")


def read_person(column: Column) -> Column:
    """The reading of a person code, null where the entry names nobody (see ``NOBODY``)."""
    return let(read_name(column), lambda reading: F.when(~reading.isin(*NOBODY), reading))


#: Readings of split names and the split they mean.
SPLITS = {
    "train": ("TRAIN", "TRAINING", "TRAINSET", "TRAININGSET"),
    "validation": ("VALIDATION", "VALID", "VAL", "VALIDATIONSET", "VALSET", "VALIDSET", "DEV", "DEVSET"),
    "test": ("TEST", "TESTING", "TESTSET"),
}


def read_split(column: Column) -> Column:
    """``train``, ``validation`` or ``test``; null for null and for any other entry."""

    def named(reading: Column) -> Column:
        out = F.lit(None).cast("string")
        for split, readings in SPLITS.items():
            out = F.when(reading.isin(*readings), split).otherwise(out)
        return out

    return let(read_name(column), named)
