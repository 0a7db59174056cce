"""The binary vector index: read into rows, written from rows."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

#: The file's first bytes, its version, and its header: version, dimensions, characters, vectors.
MAGIC, VERSION, HEADER = b"GSKI", 1, "<HHII"
#: A file is written by one process; an index beyond this many vectors belongs in Parquet.
MOST_VECTORS = 2_000_000


def unpack_index(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(code point, bytes, scale)`` of every vector; raises for another format, version or length."""
    if data[:4] != MAGIC:
        raise ValueError("not a vector index")
    version, dims, characters, vectors = struct.unpack_from(HEADER, data, 4)
    if version != VERSION:
        raise ValueError(f"unknown version {version} of the vector index")
    at = 4 + struct.calcsize(HEADER)
    if len(data) != at + 8 * characters + (4 + dims) * vectors:
        raise ValueError("the vector index has another length than its header tells")
    cps = np.frombuffer(data, "<u4", characters, at).astype(np.int64)
    starts = np.frombuffer(data, "<u4", characters, at + 4 * characters).astype(np.int64)
    scales = np.frombuffer(data, "<f4", vectors, at + 8 * characters)
    values = np.frombuffer(data, "i1", vectors * dims, at + 8 * characters + 4 * vectors).reshape(vectors, dims)
    return np.repeat(cps, np.diff(np.r_[starts, vectors])), values, scales


def pack_index(code_points: np.ndarray, values: np.ndarray, scales: np.ndarray) -> bytes:
    order = np.argsort(code_points, kind="stable")
    cps, starts = np.unique(code_points[order], return_index=True)
    header = struct.pack(HEADER, VERSION, values.shape[1] if len(values) else 0, len(cps), len(values))
    return MAGIC + header + cps.astype("<u4").tobytes() + starts.astype("<u4").tobytes() + scales[order].astype("<f4").tobytes() + values[order].astype("i1").tobytes()


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """``(code_point, vec_no, vector)`` of index files, one file a task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for content in pdf["content"]:
                cps, values, scales = unpack_index(bytes(content))
                for i in range(0, len(cps), 8192):
                    part = slice(i, i + 8192)
                    yield pd.DataFrame({"code_point": cps[part].astype(np.int32), "vec_no": np.arange(len(cps))[part], "vector": list(values[part].astype(np.float32) * scales[part, None])})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "code_point int, vec_no bigint, vector array<float>")


def index_bytes(rows: DataFrame) -> bytes:
    """The file of ``(code_point, vector)``, vectors as bytes with a step each. Raises beyond MOST_VECTORS."""
    if rows.count() > MOST_VECTORS:
        raise ValueError("the index is too large for one file; write it as Parquet")
    pdf = rows.select("code_point", "vector").toPandas()
    v = np.stack(pdf["vector"].to_numpy()).astype(np.float64) if len(pdf) else np.zeros((0, 0))
    top = np.abs(v).max(1) / 127 if len(v) else np.zeros(0)
    scales = np.where(top > 0, top, 1.0)
    return pack_index(pdf["code_point"].to_numpy(np.int64), np.clip(np.rint(v / scales[:, None]), -127, 127).astype(np.int8) if len(v) else np.zeros((0, 0), np.int8), scales)
