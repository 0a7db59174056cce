"""A convolutional encoder from a file of byte weights, applied to images in batches."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: The file's first bytes and version, and the numbers of the kinds of layers.
MAGIC, VERSION = b"GSKM", 1
CONV, SAVE, ADD, MEAN, LINEAR, UNIT = range(1, 7)


@dataclass(frozen=True)
class Layer:
    kind: int
    weight: np.ndarray | None = None
    bias: np.ndarray | None = None
    stride: int = 1
    groups: int = 1
    clipped: bool = False


def read_network(data: bytes) -> tuple[list[Layer], int]:
    """The layers and the side of the input image; raises for another format, version or length."""
    if data[:4] != MAGIC:
        raise ValueError("not a network file")
    version, side, _, count = struct.unpack_from("<HHHH", data, 4)
    if version != VERSION:
        raise ValueError(f"unknown version {version} of the network file")
    at, layers = 12, []

    def weights(at: int, shape: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, int]:
        at += -at % 4
        n = int(np.prod(shape))
        values = np.frombuffer(data, "i1", n, at).reshape(shape[0], -1).astype(np.float32)
        at += n + -(at + n) % 4
        scale, bias = np.frombuffer(data, "<f4", shape[0], at), np.frombuffer(data, "<f4", shape[0], at + 4 * shape[0])
        return (values * scale[:, None]).reshape(shape), bias, at + 8 * shape[0]

    for _ in range(count):
        kind = data[at]
        at += 1
        if kind == CONV:
            inputs, outputs, kernel, stride, groups, clipped = struct.unpack_from("<HHBBHB", data, at)
            w, b, at = weights(at + 9, (outputs, inputs // groups, kernel, kernel))
            layers.append(Layer(CONV, w, b, stride, groups, bool(clipped)))
        elif kind == LINEAR:
            inputs, outputs = struct.unpack_from("<HH", data, at)
            w, b, at = weights(at + 4, (outputs, inputs))
            layers.append(Layer(LINEAR, w, b))
        elif kind in (SAVE, ADD, MEAN, UNIT):
            layers.append(Layer(kind))
        else:
            raise ValueError(f"unknown kind {kind} of layer")
    if at != len(data):
        raise ValueError("the network file goes on after its last layer")
    return layers, side


def write_network(layers: list[Layer], side: int) -> bytes:
    """The file of layers, weights as bytes with a step for each output."""
    out = bytearray(MAGIC + struct.pack("<HHHH", VERSION, side, [len(la.bias) for la in layers if la.kind == LINEAR][-1], len(layers)))
    for la in layers:
        out.append(la.kind)
        if la.kind == CONV:
            outputs, per, kernel, _ = la.weight.shape
            out += struct.pack("<HHBBHB", per * la.groups, outputs, kernel, la.stride, la.groups, la.clipped)
        elif la.kind == LINEAR:
            out += struct.pack("<HH", *la.weight.shape[::-1])
        if la.weight is not None:
            out += bytes(-len(out) % 4)
            flat = la.weight.reshape(len(la.weight), -1)
            top = np.abs(flat).max(1) / 127
            scale = np.where(top > 0, top, 1).astype(np.float32)
            out += np.clip(np.rint(flat / scale[:, None]), -127, 127).astype("i1").tobytes()
            out += bytes(-len(out) % 4) + scale.astype("<f4").tobytes() + la.bias.astype("<f4").tobytes()
    return bytes(out)


def _convolved(x: np.ndarray, la: Layer) -> np.ndarray:
    kernel = la.weight.shape[2]
    pad = kernel // 2
    windows = np.lib.stride_tricks.sliding_window_view(np.pad(x, ((0, 0), (0, 0), (pad, pad), (pad, pad))), (kernel, kernel), axis=(2, 3))[:, :, :: la.stride, :: la.stride]
    n, channels, h, w = windows.shape[:4]
    per, each = channels // la.groups, len(la.weight) // la.groups
    split = windows.reshape(n, la.groups, per, h, w, kernel, kernel)
    out = np.einsum("ngchwij,gocij->ngohw", split, la.weight.reshape(la.groups, each, per, kernel, kernel), optimize=True).reshape(n, -1, h, w)
    out = out + la.bias[:, None, None]
    return np.clip(out, 0, 6) if la.clipped else out


def encode(layers: list[Layer], images: np.ndarray) -> np.ndarray:
    """Vectors of images ``(n, side, side)`` with ink 1.0."""
    x, saved = images[:, None].astype(np.float32), []
    for la in layers:
        if la.kind == CONV:
            x = _convolved(x, la)
        elif la.kind == SAVE:
            saved.append(x)
        elif la.kind == ADD:
            x = x + saved.pop()
        elif la.kind == MEAN:
            x = x.mean((2, 3))
        elif la.kind == LINEAR:
            x = x @ la.weight.T + la.bias
        else:
            x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    return x.astype(np.float32)


def embed(images: DataFrame, id_col: str, network: bytes, batch: int = 64) -> DataFrame:
    """``(id, vector)`` of images of bytes; the network (some hundred kilobytes) is sent to every executor once."""
    sent = images.sparkSession.sparkContext.broadcast(network)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        layers, side = read_network(sent.value)
        for pdf in batches:
            for i in range(0, len(pdf), batch):
                part = pdf.iloc[i : i + batch]
                pixels = np.frombuffer(b"".join(part["image"]), np.uint8).reshape(len(part), side, side) / 255.0
                yield pd.DataFrame({id_col: part[id_col].to_numpy(), "vector": list(encode(layers, pixels))})

    return images.where("image IS NOT NULL").select(id_col, "image").mapInPandas(run, f"`{id_col}` {images.schema[id_col].dataType.simpleString()}, vector array<float>")
