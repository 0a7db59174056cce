"""Drawings as the value of a link's parameter: base64url of zigzag varints of differences, in tenths."""

from __future__ import annotations

import base64
import binascii
import json
import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from inkatlas.operators.datasets import flat_ink

#: Fixed value: the format's mark in front of the encoded bytes.
MARK = "1"
STROKES = "array<array<struct<x: double, y: double>>>"


def pack_strokes(strokes) -> str | None:
    """None for null ink; points are rounded to tenths, halves up."""
    if strokes is None:
        return None
    numbers, last = [], (0, 0)
    for stroke in strokes:
        numbers.append(len(stroke))
        for p in stroke:
            here = tuple(math.floor(float(p[c]) * 10 + 0.5) for c in ("x", "y"))
            numbers += [2 * d if d >= 0 else -2 * d - 1 for d in (here[0] - last[0], here[1] - last[1])]
            last = here
    data = bytearray()
    for n in numbers:
        while n > 127:
            data.append(n & 127 | 128)
            n >>= 7
        data.append(n)
    return MARK + base64.urlsafe_b64encode(bytes(data)).decode().rstrip("=")


def unpack_strokes(value: str | None):
    """The strokes, or None for null and for a value that is no whole drawing of this format."""
    if not value or not value.startswith(MARK):
        return None
    body = value[len(MARK) :]
    try:
        data = base64.b64decode(body + "=" * (-len(body) % 4), altchars=b"-_", validate=True)
    except (binascii.Error, ValueError):
        return None
    numbers, n, shift = [], 0, 0
    for byte in data:
        n |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            numbers.append(n)
            n, shift = 0, 0
    if shift or not numbers:
        return None
    signed = [n // 2 if n % 2 == 0 else -(n + 1) // 2 for n in numbers]
    strokes, at, x, y = [], 0, 0, 0
    while at < len(numbers):
        count = numbers[at]
        if not count or at + 1 + 2 * count > len(numbers):
            return None
        stroke = []
        for i in range(at + 1, at + 1 + 2 * count, 2):
            x, y = x + signed[i], y + signed[i + 1]
            stroke.append({"x": x / 10, "y": y / 10})
        strokes.append(stroke)
        at += 1 + 2 * count
    return strokes


def _pack_all(xs: pd.Series, ys: pd.Series, lens: pd.Series) -> pd.Series:
    def one(x, y, counts):
        if x is None:
            return None
        points = iter(zip(x, y))
        return pack_strokes([[dict(zip("xy", next(points))) for _ in range(n)] for n in counts])

    return pd.Series([one(*row) for row in zip(xs, ys, lens)], dtype=object)


def _unpack_all(values: pd.Series) -> pd.Series:
    found = (unpack_strokes(v if isinstance(v, str) else None) for v in values)
    return pd.Series([None if s is None else json.dumps(s) for s in found], dtype=object)


def encode_drawing(strokes: Column) -> Column:
    """The link's value of ink; null for null."""
    return F.pandas_udf(_pack_all, "string")(*flat_ink(strokes))


def decode_drawing(value: Column) -> Column:
    """The ink of a link's value; null if it is no whole drawing."""
    return F.from_json(F.pandas_udf(_unpack_all, "string")(value), STROKES)
