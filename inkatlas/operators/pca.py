"""Principal directions of vectors and the projection onto them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def principal_directions(df: DataFrame, vector: str, k: int) -> np.ndarray:
    """The k directions of largest variance, as rows; each has a positive largest element.

    Sums and products of each partition (one square matrix of the vectors' length) are added in 16 tasks before they
    leave the executors.
    """

    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, total, square = 0, None, None
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf[vector].to_numpy()).astype(float)
                n += len(x)
                total = x.sum(0) if total is None else total + x.sum(0)
                square = x.T @ x if square is None else square + x.T @ x
        if n:
            yield pd.DataFrame({"n": [n], "total": [total], "square": [square.ravel()]})

    def added(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, total, square = 0, 0.0, 0.0
        for pdf in batches:
            for a, b, c in zip(pdf["n"], pdf["total"], pdf["square"]):
                n, total, square = n + a, total + np.asarray(b), square + np.asarray(c)
        if n:
            yield pd.DataFrame({"n": [n], "total": [total], "square": [square]})

    schema = "n bigint, total array<double>, square array<double>"
    rows = df.select(vector).mapInPandas(moments, schema).repartition(16).mapInPandas(added, schema).collect()  # at most 16 rows
    if not rows:
        return np.zeros((0, 0))
    n, total = sum(r["n"] for r in rows), np.sum([r["total"] for r in rows], axis=0)
    d = len(total)
    cov = np.sum([r["square"] for r in rows], axis=0).reshape(d, d) / n - np.outer(total, total) / n**2
    _, directions = np.linalg.eigh(cov)
    top = directions[:, ::-1][:, :k].T
    return top * np.sign(top[np.arange(len(top)), np.abs(top).argmax(1)])[:, None]


def project(df: DataFrame, vector: str, directions: np.ndarray) -> DataFrame:
    """Replace the vectors by their normalised projections."""
    rows = directions.tolist()
    others = [c for c in df.columns if c != vector]
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name != vector], f"`{vector}` array<double>"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        basis = np.array(rows)
        for pdf in batches:
            if len(pdf):
                p = np.stack(pdf[vector].to_numpy()).astype(float) @ basis.T
                p /= np.maximum(np.linalg.norm(p, axis=1, keepdims=True), 1e-12)
                yield pdf[others].assign(**{vector: list(p)})

    return df.mapInPandas(run, schema)
