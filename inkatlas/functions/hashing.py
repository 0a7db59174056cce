"""Splits that depend on a key only, through SHA-256."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_64 = float(1 << 64)


def stable_fraction(text: Column) -> Column:
    """The first 8 bytes of SHA-256, big-endian, as a fraction of 2**64; null for null."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 16), 16, 10).cast("decimal(20,0)").cast("double") / F.lit(TWO_64)


def held_out(dataset: Column, writer: Column, share: float = 0.2) -> Column:
    """True for writers whose drawings are for testing."""
    return stable_fraction(F.concat(F.lit("test-split:"), dataset, F.lit(":"), writer)) < share


def zero_shot(code_point: Column, share: float = 0.1) -> Column:
    """True for characters of which no real drawing is trained on."""
    return stable_fraction(F.concat(F.lit("zero-shot:"), F.hex(code_point))) < share
