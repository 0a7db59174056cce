"""The same or nearly the same drawings across splits (problem 4).

Ink is read as one polyline of its points, pen lifts included. A window of K segments becomes a seed: a rolling hash of
the segments' directions and length ratios, in coarse bins, joined to where the window lies in the drawing's box; moved
and scaled copies have the same seeds. The hash rolls in both reading directions and the smaller value counts, so a
window read backwards is the same window. Winnowing keeps the smallest hash of every WINNOW windows in a row. Seeds of
evaluation rows meet seeds of training rows; the seeds of a pair that lie on one line are chained, and the pair is
aligned from its best chain over all points. The coverage of both drawings decides.

Ink with little shape of its own (at most K points, or on a straight line) is like any other of its kind once it may be
moved and scaled. It is compared as recorded: in its place and size.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkatlas.functions.vectors import let
from inkatlas.operators.parallel import spread
from inkatlas.operators.skew import lookup
from inkatlas.storage import Stored, unshuffled

#: Segments of a window, winnowing width, direction bins, position cells along the longer side.
K, WINNOW, DIRECTIONS, CELLS = 4, 3, 20, 12
#: Bins of the logarithm (base 2) of a segment's length over that of the one before, and their width; the outer are open.
RATIOS, RATIO_WIDTH = 6, 0.7
#: A value this close to the edge of its bin (as a part of the bin) is also read as its neighbour by evaluation rows.
EDGE = 0.14
#: Points agree within TOLERANCE units plus PART of the drawing's size, after scaling and shifting; but within MOST of
#: the size, as anything small resembles anything else.
TOLERANCE, PART, MOST = 3.0, 0.006, 0.08
#: Both drawings must be covered by agreeing points to this share.
COVERED = 0.85
#: Side of the cells in which the corners of plain ink's box are looked up, in units.
CORNER = 12.0
#: Place of the seed of a drawing compared as recorded.
RECORDED = -1

SEEDS = "rep bigint, hash bigint, turned boolean, at int, of int, look bigint, bends bigint"
#: Bits of ``look``, the smallest value and that of one step: where the window lies in the box, its middle and last point
#: as seen from its first in parts of its length, the logarithms of its length and of that over the box's longer side.
LOOK = {"u": (6, 0.0, 1 / 63), "v": (6, 0.0, 1 / 63), **dict.fromkeys(("px", "py", "qx", "qy"), (10, -1.0, 2 / 1023)), "span": (6, 0.0, 1 / 4), "part": (6, -5.0, 1 / 8)}
#: Bits of ``bends``, likewise: the window's points between those.
BENDS = dict.fromkeys(("ax", "ay", "bx", "by"), (10, -1.0, 2 / 1023))
#: Seeds meet in rounds of the hash's values, of which there are up to ROUNDS, one for each ROUND_INKS drawings.
ROUNDS, ROUND_INKS = 3, 100_000
#: Pairs, and pairs for each drawing, that are aligned in one batch.
BATCH_LEAST, BATCH_PAIRS = 100_000, 2
#: Seeds that meet agree in place to SLACK + STEP / points, as an extreme point may be missing, at most one step of the pen,
SLACK, STEP = 0.05, 1.5
#: and their windows in shape, to a part DRIFT of their length and a shift of JITTER units on either side.
DRIFT, JITTER = 0.012, 3.0
#: Rows of a class that are paired in one task; larger classes are cut.
BLOCK_ROWS = 1_000

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def packed_ink(rows: DataFrame, keep: list[str]) -> DataFrame:
    """``(*keep, points, lens, inked)``: ink as bytes, which the JVM hashes, stores and sends without looking inside.

    ``points`` holds x and y of every point, ``lens`` the number of points of each stroke; both are null for null ink.
    Ink whose coordinates are all whole numbers of 16 bits is held in these, with a further one at its end, so that it
    has an odd number of them; any other ink in single precision. Null strokes have no points, null coordinates become
    NaN. ``inked`` tells whether some point is a pair of finite numbers. Rows whose first kept column is null are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(batch.column(keep[0]).is_valid())
            strokes = batch.column("strokes")
            inner = strokes.flatten()
            lens = inner.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int32)
            points = np.stack([c.to_numpy(zero_copy_only=False).astype(np.float32) for c in inner.flatten().flatten()], 1)
            first = np.r_[0, np.cumsum(strokes.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))].astype(np.int64)
            begin = np.r_[0, np.cumsum(lens)].astype(np.int64)[first]
            with np.errstate(invalid="ignore"):
                good = np.r_[0, np.cumsum((np.abs(points) < 1e9).all(1))]
                short = ((points == np.rint(points)) & (np.abs(points) < 1 << 15)).all(1)
            known = strokes.is_valid()
            counts = np.diff(begin)
            whole = (_kept(short, counts) == counts) & (counts > 0)
            units = np.r_[0, np.cumsum(np.where(whole, 2 * counts + 1, 4 * counts))]
            packed, of_whole = np.zeros(units[-1], np.int16), np.repeat(whole, counts)
            packed[_ranges(units[:-1][whole], 2 * counts[whole])] = points[of_whole].astype(np.int16).ravel()
            packed[_ranges(units[:-1][~whole], 4 * counts[~whole])] = points[~of_whole].view(np.int16).ravel()

            def blobs(values: np.ndarray, ends: np.ndarray) -> pa.Array:
                whole = pa.LargeBinaryArray.from_buffers(pa.large_binary(), batch.num_rows, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(values))])
                return pc.if_else(known, whole, pa.scalar(None, pa.large_binary())).cast(pa.binary())

            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in keep], blobs(packed, 2 * units), blobs(lens, 4 * first), pa.array(good[begin[1:]] > good[begin[:-1]])], names=[*keep, "points", "lens", "inked"])

    kept = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    flat = rows.select(*keep, F.col("strokes").cast("array<array<struct<x: float, y: float>>>").alias("strokes"))
    return flat.mapInArrow(run, f"{kept}, points binary, lens binary, inked boolean")


def _kept(ok: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """How many of each drawing's points are left."""
    total = np.r_[0, np.cumsum(ok)]
    return np.diff(total[np.r_[0, np.cumsum(counts)].astype(np.int64)])


def _clean(x: np.ndarray, y: np.ndarray, counts: np.ndarray, *more: np.ndarray) -> tuple[np.ndarray, ...]:
    """Points without those that are no finite numbers below 1e9 and those that repeat the one before in their drawing,
    which carry no direction; ``more`` are values of the points."""
    with np.errstate(invalid="ignore"):
        ok = (np.abs(x) < 1e9) & (np.abs(y) < 1e9)
    if not ok.all():
        x, y, counts, more = x[ok], y[ok], _kept(ok, counts), tuple(m[ok] for m in more)
    moved = np.ones(len(x), bool)
    moved[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
    moved[np.r_[0, np.cumsum(counts)[:-1]].astype(np.int64)[counts > 0]] = True
    return x[moved], y[moved], _kept(moved, counts), *[m[moved] for m in more]


def _ranges(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The indices of many ranges, one after another."""
    ends = np.cumsum(lens)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - np.r_[0, ends[:-1]], lens)


def _values(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """All values of a column of bytes without nulls, and how many each row has."""
    size = np.dtype(kind).itemsize
    lens = pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    data = column.buffers()[2]
    begin = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + 1]
    return np.frombuffer(data, np.uint8)[int(begin[0]) : int(begin[0]) + int(lens.sum())].view(kind) if len(column) and data is not None else np.zeros(0, kind), lens // size


def _points(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``x``, ``y`` and the number of points of each row of a column of packed points."""
    values, units = _values(column, np.int16)
    whole, start = units % 2 == 1, np.cumsum(units) - units
    counts = np.where(whole, units // 2, units // 4)
    of_whole, points = np.repeat(whole, counts), np.zeros((counts.sum(), 2))
    points[of_whole] = values[_ranges(start[whole], 2 * counts[whole])].reshape(-1, 2)
    points[~of_whole] = values[_ranges(start[~whole], 4 * counts[~whole])].view(np.float32).reshape(-1, 2)
    return points[:, 0].copy(), points[:, 1].copy(), counts


def _batch(columns: dict[str, tuple[np.ndarray, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in columns.values()], names=list(columns))


def _mix(h: np.ndarray) -> np.ndarray:
    h = h.astype(np.uint64)
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _power(base: int, n: int) -> np.uint64:
    return np.uint64(pow(base, n, 1 << 64))


def rolled(values: np.ndarray, width: int, base: int, inverse: int) -> np.ndarray:
    """The rolling hash of every run of ``width`` values: the sum of value j times base ** j, modulo 2 ** 64, each taken
    from the difference of two running sums."""
    n = len(values)
    if n < width:
        return np.zeros(0, np.uint64)
    up, down = (np.cumprod(np.r_[np.uint64(1), np.full(n, b, np.uint64)], dtype=np.uint64)[:n] for b in (base, inverse))
    total = np.r_[np.uint64(0), np.cumsum(values.astype(np.uint64) * up, dtype=np.uint64)]
    return (total[width:] - total[: n - width + 1]) * down[: n - width + 1]


def winnowed(hashes: np.ndarray, run: np.ndarray, width: int = WINNOW) -> np.ndarray:
    """Indices of the hashes that are the smallest of some ``width`` neighbours in their run (of all in a shorter run)."""
    n = len(hashes)
    if not n:
        return np.zeros(0, np.int64)
    begin = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
    sizes = np.diff(np.r_[begin, n])
    at, end, first = np.arange(n), np.repeat(begin + sizes, sizes), np.repeat(begin, sizes)
    most = np.iinfo(np.uint64).max
    near = sliding_window_view(np.r_[hashes, np.full(width, most, np.uint64)], width)[:n]
    least = np.where(at[:, None] + np.arange(width) < end[:, None], near, most).argmin(1) + at
    return np.unique(least[(at + width <= end) | (at == first)])


def _frames(x: np.ndarray, y: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each drawing's box ``(x0, y0, x1, y1)`` and the largest distance of its points from its principal axis."""
    begin = np.r_[0, np.cumsum(counts)[:-1]].astype(np.int64)
    box = np.stack([f.reduceat(v, begin) for f in (np.minimum, np.maximum) for v in (x, y)], 1)
    row = np.repeat(np.arange(len(counts)), counts)
    cx, cy = (x - (np.add.reduceat(x, begin) / counts)[row], y - (np.add.reduceat(y, begin) / counts)[row])
    xx, yy, xy = (np.add.reduceat(v, begin) for v in (cx * cx, cy * cy, cx * cy))
    axis = np.arctan2(2 * xy, xx - yy) / 2
    return box, np.maximum.reduceat(np.abs(cy * np.cos(axis)[row] - cx * np.sin(axis)[row]), begin)


def _has_shape(points: np.ndarray, off_axis: np.ndarray, slack: float = 1.0) -> np.ndarray:
    """Drawings with enough shape of their own to be told when moved and scaled."""
    return (points > K) & (off_axis > slack * TOLERANCE)


def _pack(values: dict[str, np.ndarray], layout: dict[str, tuple[int, float, float]]) -> np.ndarray:
    out = np.zeros(len(next(iter(values.values()))), np.uint64)
    for name, (bits, least, step) in layout.items():
        code = np.clip(np.rint((values[name] - least) / step), 0, (1 << bits) - 1).astype(np.uint64)
        out = (out << np.uint64(bits)) | code
    return out.view(np.int64)


def _unpacked(packed: Column, layout: dict[str, tuple[int, float, float]]) -> dict[str, Column]:
    """The values of ``look`` or ``bends``, each less its smallest."""
    out, shift = {}, sum(bits for bits, _, _ in layout.values())
    for name, (bits, _, step) in layout.items():
        shift -= bits
        out[name] = F.shiftrightunsigned(packed, shift).bitwiseAND((1 << bits) - 1) * F.lit(step)
    return out


def _corner_seeds(box: np.ndarray, probing: bool) -> tuple[np.ndarray, np.ndarray]:
    """``(index, hash)`` of the cells that hold the corners of boxes; probing also gives cells within TOLERANCE."""
    which, cells = np.arange(len(box)), np.floor(box / CORNER).astype(np.int64)
    for c in range(4) if probing else ():
        part = box[which, c] - cells[:, c] * CORNER
        moved = []
        for step, near in ((-1, part < TOLERANCE), (1, part > CORNER - TOLERANCE)):
            other = cells[near].copy()
            other[:, c] += step
            moved.append((which[near], other))
        # The part within a cell stays that of the box itself, so each corner moves at most once.
        which = np.concatenate([which, *[w for w, _ in moved]])
        cells = np.concatenate([cells, *[o for _, o in moved]])
        keep = np.abs(box[which, c] - (cells[:, c] + 0.5) * CORNER) <= CORNER / 2 + TOLERANCE
        which, cells = which[keep], cells[keep]
    h = np.full(len(which), 7, np.uint64)
    for c in range(4):
        h = _mix(h * np.uint64(31) + cells[:, c].astype(np.uint64))
    return which, h


def seeds_of(rep: np.ndarray, x: np.ndarray, y: np.ndarray, counts: np.ndarray, stroke: np.ndarray, probing: bool, turn: int = 0, rounds: int = 1) -> pd.DataFrame:
    """Winnowed seeds of drawings: all clean points one after another, ``counts`` of them for each (at least one), with
    the number of each point's stroke.

    Windows within a stroke are winnowed apart from those across a lift of the pen, so that the same ones are kept when
    the strokes come in another order. Training rows give each kept window's hash; probing (evaluation) rows also the hashes of kept windows of which one
    value, close to the edge of its bin, lies in the next bin. Ink without shape of its own gives the seed of its box as
    recorded; ink that could be taken for it after losing a point or a little jitter gives both kinds. Of the ``rounds``
    parts into which hashes fall only the seeds of part ``turn`` are given.
    """

    def due(h: np.ndarray) -> np.ndarray:
        return np.flatnonzero((h >> np.uint64(32)) % np.uint64(rounds) == turn)

    begin = np.r_[0, np.cumsum(counts)[:-1]].astype(np.int64)
    row = np.repeat(np.arange(len(counts)), counts)
    box, off_axis = _frames(x, y, counts)
    plain = np.flatnonzero((counts <= K + 2) | ~_has_shape(counts, off_axis, 3.0))
    which, h = _corner_seeds(box[plain], probing)
    which, h = which[due(h)], h[due(h)]
    out = [{"rep": rep[plain][which], "hash": h, "turned": np.zeros(len(h), bool), "at": np.full(len(h), RECORDED), "of": counts[plain][which], "look": np.zeros(len(h), np.int64), "bends": np.zeros(len(h), np.int64)}]

    dx, dy = np.diff(x), np.diff(y)
    n = max(len(dx) - K + 1, 0)
    start = np.flatnonzero(row[:n] == row[K : n + K])  # K + 1 points of one drawing
    start = start[_has_shape(counts, off_axis)[row[start]]]
    if len(start):
        length = np.maximum(np.hypot(dx, dy), 1e-3)
        angle = np.mod(np.arctan2(dy, dx) * (DIRECTIONS / (2 * np.pi)), DIRECTIONS)
        ratio = np.clip(np.log2(length[1:] / length[:-1]) / RATIO_WIDTH + RATIOS / 2, 0.01, RATIOS - 0.01)
        direction, part = np.floor(angle).astype(np.int64) % DIRECTIONS, np.floor(ratio).astype(np.int64)
        back, rest = (direction + DIRECTIONS // 2) % DIRECTIONS, RATIOS - 1 - part  # the same, read backwards
        b2, i2 = pow(_BASE, 2, 1 << 64), pow(_INVERSE, 2, 1 << 64)
        base = np.uint64(_BASE)
        forth = rolled(direction + 1, K, b2, i2)[start] + base * rolled(part + 1, K - 1, b2, i2)[start]
        over = rolled(back + 1, K, i2, b2)[start] * _power(b2, K - 1) + base * rolled(rest + 1, K - 1, i2, b2)[start] * _power(b2, K - 2)
        r = row[start]
        wx, wy = sliding_window_view(x, K + 1)[start], sliding_window_view(y, K + 1)[start]
        side = np.maximum((box[:, 2:] - box[:, :2]).max(1), 1e-3)[r]
        u = (wx.mean(1) - (box[r, 0] + box[r, 2]) / 2) / side + 0.5
        v = (wy.mean(1) - (box[r, 1] + box[r, 3]) / 2) / side + 0.5
        pu, pv = u * CELLS, v * CELLS
        cu, cv = np.floor(pu).astype(np.int64), np.floor(pv).astype(np.int64)

        def final(f: np.ndarray, g: np.ndarray, cu: np.ndarray, cv: np.ndarray) -> np.ndarray:
            return _mix(_mix(np.minimum(f, g)) + (cu * 64 + cv).astype(np.uint64))

        first, last = stroke[start], stroke[start + K]
        across = first != last
        new = np.r_[True, (r[1:] != r[:-1]) | (across[1:] != across[:-1]) | (~across[1:] & (first[1:] != first[:-1]))]
        kept = winnowed(final(forth, over, cu, cv), np.cumsum(new))
        every = np.arange(len(start)) if probing else kept
        parts = [(every, forth[every], over[every], cu[every], cv[every])]
        if probing:
            s, f, g = start[kept], forth[kept], over[kept]
            for j in range(K):
                within = angle[s + j] % 1.0
                for step, near in ((-1, within < EDGE), (1, within > 1 - EDGE)):
                    old, turned = direction[s[near] + j], back[s[near] + j]
                    f2 = f[near] + ((old + step) % DIRECTIONS - old).astype(np.uint64) * _power(b2, j)
                    g2 = g[near] + ((turned + step) % DIRECTIONS - turned).astype(np.uint64) * _power(b2, K - 1 - j)
                    parts.append((kept[near], f2, g2, cu[kept[near]], cv[kept[near]]))
            for j in range(K - 1):
                value = ratio[s + j]
                within = value % 1.0
                for step, near in ((-1, (within < EDGE) & (value >= 1)), (1, (within > 1 - EDGE) & (value < RATIOS - 1))):
                    change = base * np.full(near.sum(), step).astype(np.uint64)
                    parts.append((kept[near], f[near] + change * _power(b2, j), g[near] - change * _power(b2, K - 2 - j), cu[kept[near]], cv[kept[near]]))
            for value, mu, mv in ((pu, 1, 0), (pv, 0, 1)):
                within = value[kept] % 1.0
                for step, near in ((-1, within < EDGE / 2), (1, within > 1 - EDGE / 2)):
                    parts.append((kept[near], f[near], g[near], cu[kept[near]] + step * mu, cv[kept[near]] + step * mv))
        for w, f, g, cu2, cv2 in parts:
            h = final(f, g, cu2, cv2)
            here = due(h)
            w, h, turned = w[here], h[here], (g < f)[here]
            span = length[start[w][:, None] + np.arange(K)].sum(1)
            x0, y0 = np.where(turned, wx[w, K], wx[w, 0]), np.where(turned, wy[w, K], wy[w, 0])
            x1, y1 = np.where(turned, wx[w, 0], wx[w, K]), np.where(turned, wy[w, 0], wy[w, K])
            second, fourth = np.where(turned, K - 1, 1), np.where(turned, 1, K - 1)
            look = {"u": u[w], "v": v[w], "px": (wx[w, K // 2] - x0) / span, "py": (wy[w, K // 2] - y0) / span, "qx": (x1 - x0) / span, "qy": (y1 - y0) / span, "span": np.log2(1 + span), "part": np.log2(span / side[w])}
            bends = {"ax": (wx[w, second] - x0) / span, "ay": (wy[w, second] - y0) / span, "bx": (wx[w, fourth] - x0) / span, "by": (wy[w, fourth] - y0) / span}
            out.append({"rep": rep[r[w]], "hash": h, "turned": turned, "at": start[w] - begin[r[w]], "of": counts[r[w]], "look": _pack(look, LOOK), "bends": _pack(bends, BENDS)})
    columns = {c: np.concatenate([o[c] for o in out]) for c in out[0]}
    return pd.DataFrame(columns | {"hash": columns["hash"].view(np.int64), "at": columns["at"].astype(np.int32), "of": columns["of"].astype(np.int32)})


def _gaps(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distances of a's points to b's nearest, which those are, and distances of b's points to a's nearest, for padded
    pairs. Distances beyond ``reach`` may come as infinite: a long pair is swept in blocks along x, so that neither its
    memory nor, for ink that is spread out, its time grows with the product of its points."""
    if a.shape[0] > 1 or a.shape[1] * b.shape[1] <= 4_000_000:
        both = (np.arange(a.shape[1]) < na[:, None])[:, :, None] & (np.arange(b.shape[1]) < nb[:, None])[:, None, :]
        gap = (a.real[:, :, None] - b.real[:, None, :]) ** 2  # squares, as roots are wanted of the smallest only
        gap += (a.imag[:, :, None] - b.imag[:, None, :]) ** 2
        gap[~both] = np.inf
        near = gap.argmin(2)
        return np.sqrt(np.take_along_axis(gap, near[:, :, None], 2)[:, :, 0]), near, np.sqrt(gap.min(1))
    to_b, near, to_a = np.full(a.shape[1], np.inf), np.zeros(a.shape[1], np.int64), np.full(b.shape[1], np.inf)
    order_a, order_b = np.argsort(a[0].real, kind="stable"), np.argsort(b[0].real, kind="stable")
    along = b[0].real[order_b]
    for i in range(0, len(order_a), 512):
        block = order_a[i : i + 512]
        p = a[0][block]
        lo, hi = np.searchsorted(along, p[0].real - reach), np.searchsorted(along, p[-1].real + reach, side="right")
        for j in range(lo, hi, 4096):
            other = order_b[j : min(j + 4096, hi)]
            gap = np.abs(p[:, None] - b[0][other][None])
            best = gap.argmin(1)
            least = gap[np.arange(len(block)), best]
            closer = least < to_b[block]
            to_b[block[closer]], near[block[closer]] = least[closer], other[best[closer]]
            to_a[other] = np.minimum(to_a[other], gap.min(0))
    return to_b[None], near[None], to_a[None]


def covered(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, start: tuple[np.ndarray, np.ndarray, np.ndarray], fitting: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Extend pairs from a first scale and shift to all points: coverage of a by b and of b by a.

    ``a`` and ``b`` are padded complex points, ``na`` and ``nb`` their numbers, ``start`` (scale, shift, size) such that
    a is about scale * b + shift. The fit is renewed over the points that agree, then agreement is counted. Without
    ``fitting`` the first scale and shift stand, and points agree within the tolerance however small the ink is.
    """
    scale, shift, size = start
    inside = np.arange(b.shape[1])[None] < nb[:, None]
    tol = TOLERANCE + PART * size
    if fitting:
        tol = np.minimum(tol, MOST * size)
    for slack in (4.0, 1.5, 1.0) if fitting else (1.0,):
        reach = slack * tol
        to_b, near, to_a = _gaps(a, scale[:, None] * b + shift[:, None], na, nb, float(reach.max()))
        hit = to_b <= reach[:, None]
        if slack == 1.0:
            break
        w = hit.astype(np.float64)
        total = np.maximum(w.sum(1), 1)
        q = np.take_along_axis(b, near, 1)
        am, qm = (w * a).sum(1) / total, (w * q).sum(1) / total
        da, dq = np.where(hit, a - am[:, None], 0), np.where(hit, q - qm[:, None], 0)
        power = (np.abs(dq) ** 2).sum(1)
        fitted = (np.conj(dq) * da).sum(1).real / np.maximum(power, 1e-9)
        good = (w.sum(1) >= 2) & (power > 1e-6) & (fitted > 0)
        scale = np.where(good, fitted, scale)
        shift = np.where(good, am - fitted * qm, shift)
    return hit.sum(1) / na, ((to_a <= tol[:, None]) & inside).sum(1) / nb


class _Inks:
    """One side's points of a batch of pairs, without repeated ones."""

    def __init__(self, batch: pa.RecordBatch, side: str):
        self.x, self.y, self.counts = _clean(*_points(batch.column(f"points_{side}")))
        self.begin = np.r_[0, np.cumsum(self.counts)[:-1]].astype(np.int64)
        box, off_axis = _frames(self.x, self.y, self.counts)
        self.size = np.hypot(*(box[:, 2:] - box[:, :2]).T)
        self.shaped = _has_shape(self.counts, off_axis)

    def padded(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = self.counts[rows]
        at = _ranges(self.begin[rows], n)
        out = np.zeros((len(rows), int(n.max())), complex)
        out[np.repeat(np.arange(len(rows)), n), _ranges(np.zeros(len(rows), np.int64), n)] = self.x[at] + 1j * self.y[at]
        return out, n


def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Align candidate pairs ``(rep_a, rep_b, seeds, at_a, at_b, to_a, to_b, turned, points_a, points_b)``.

    ``at`` and ``to`` are the places of a chain's first and last window on both sides; ink of which one side has no
    shape of its own is aligned as recorded. The result has both coverages.
    """
    for whole in batches:
        if not whole.num_rows:
            continue
        col = {c: whole.column(c).to_numpy(zero_copy_only=False) for c in ("rep_a", "rep_b", "seeds", "at_a", "at_b", "to_a", "to_b", "turned")}
        side_a, side_b = _Inks(whole, "a"), _Inks(whole, "b")
        longest = np.maximum(side_a.counts, side_b.counts)
        fitting = side_a.shaped & side_b.shaped & (col["at_a"] != RECORDED)
        order = np.lexsort((longest, fitting))
        i = 0
        while i < len(order):  # pairs of like length share a padded block of bounded size
            j = min(len(order), i + 1000)
            while j > i + 1 and ((j - i) * longest[order[j - 1]] ** 2 > 4e6 or fitting[order[j - 1]] != fitting[order[i]]):
                j = i + (j - i) // 2
            rows = order[i:j]
            i = j
            (a, na), (b, nb) = side_a.padded(rows), side_b.padded(rows)  # seeds only come from drawings with sound points
            scale, shift = np.ones(len(rows)), np.zeros(len(rows), complex)
            if fitting[rows[0]]:
                step = np.arange(K + 1)
                turned = col["turned"][rows].astype(bool)[:, None]
                place = {c: col[c][rows].astype(np.int64)[:, None] for c in ("at_a", "at_b", "to_a", "to_b")}
                ia = np.concatenate([place["at_a"] + step, place["to_a"] + step], 1)
                ib = np.concatenate([place[c] + np.where(turned, K - step, step) for c in ("at_b", "to_b")], 1)
                wa, wb = np.take_along_axis(a, ia, 1), np.take_along_axis(b, ib, 1)
                am, bm = wa.mean(1), wb.mean(1)
                power = (np.abs(wb - bm[:, None]) ** 2).sum(1)
                scale = (np.conj(wb - bm[:, None]) * (wa - am[:, None])).sum(1).real / np.maximum(power, 1e-9)
                scale = np.where((power > 1e-6) & (scale > 0), scale, 1.0)
                shift = am - scale * bm
            of_a, of_b = covered(a, b, na, nb, (scale, shift, side_a.size[rows]), bool(fitting[rows[0]]))
            yield _batch({"rep_a": (col["rep_a"][rows], pa.int64()), "rep_b": (col["rep_b"][rows], pa.int64()), "covered_a": (of_a, pa.float64()), "covered_b": (of_b, pa.float64()), "seeds": (col["seeds"][rows], pa.int64())})


def _seeded(probing: bool, turn: int, rounds: int):
    kinds = {"rep": pa.int64(), "hash": pa.int64(), "turned": pa.bool_(), "at": pa.int32(), "of": pa.int32(), "look": pa.int64(), "bends": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 5000):
                part = batch.slice(i, 5000)
                lens = _values(part.column("lens"), np.int32)[0]
                x, y, counts, stroke = _clean(*_points(part.column("points")), np.repeat(np.arange(len(lens)), lens))
                some = counts > 0
                if some.any():
                    found = seeds_of(part.column("rep").to_numpy()[some], x, y, counts[some], stroke, probing, turn, rounds)
                    yield _batch({c: (found[c].to_numpy(), t) for c, t in kinds.items()})

    return run


def _meets(shapes: DataFrame, turn: int, rounds: int) -> DataFrame:
    """Seeds of both sides that meet in one of the rounds: ``(rep_a, rep_b, at_a, at_b, turned)``.

    Seeds go straight into the shuffle of their join; a hash that very many windows share makes a large partition, which
    the adaptive skew join splits over tasks by its map outputs.
    """
    told, asked = (spread(shapes.where(F.col("train") == train).select("rep", "points", "lens")).mapInArrow(_seeded(not train, turn, rounds), SEEDS) for train in (True, False))
    l, r = told.alias("l"), asked.alias("r")
    # Drawings differ by a few points at most when 85 % of both agree.
    like = (F.col("l.of") >= COVERED * F.col("r.of") - 1) & (F.col("r.of") >= COVERED * F.col("l.of") - 1)
    ours, theirs = (_unpacked(F.col(f"{s}.look"), LOOK) | _unpacked(F.col(f"{s}.bends"), BENDS) for s in "lr")
    slack = F.lit(SLACK) + F.lit(STEP) / F.least("l.of", "r.of")
    shift = F.lit(2 * JITTER) / F.greatest(F.pow(F.lit(2.0), F.least(ours["span"], theirs["span"])) - 1, F.lit(1.0))
    drift = F.lit(DRIFT) + shift
    # The greatest difference is held against a bound, as a join's condition would work out a bound for each anew.
    for names, most in ((("qx", "qy", "px", "py", *BENDS), drift), (("u", "v"), slack)):
        like = like & (F.greatest(*[F.abs(ours[c] - theirs[c]) for c in names]) <= most)
    # A box that lost an extreme point is smaller by no more than the slack on either side.
    like = like & (F.abs(ours["part"] - theirs["part"]) <= F.lit(LOOK["part"][2]) + F.log2(1 + 2 * slack) + 1.5 * shift)
    return l.join(r, (F.col("l.hash") == F.col("r.hash")) & ((F.col("l.at") < 0) == (F.col("r.at") < 0)) & like).select(
        F.col("l.rep").alias("rep_a"), F.col("r.rep").alias("rep_b"), F.col("l.at").alias("at_a"), F.col("r.at").alias("at_b"), (F.col("l.turned") != F.col("r.turned")).alias("turned")
    )


def _chains(meets: DataFrame) -> DataFrame:
    """Pairs of representatives whose seeds meet, with their best chain."""
    # Seeds of a pair on one line: equal differences of places, equal sums where one side is read backwards.
    line = F.when(F.col("turned"), F.col("at_a") + F.col("at_b")).otherwise(F.col("at_a") - F.col("at_b"))
    place = F.struct("at_a", "at_b")
    chains = meets.repartition("rep_a", "rep_b").groupBy("rep_a", "rep_b", "turned", line.alias("line")).agg(F.count(F.lit(1)).alias("seeds"), F.min(place).alias("at"), F.max(place).alias("to"))
    # A chain of windows tells more than the box.
    best = chains.groupBy("rep_a", "rep_b").agg(F.max(F.struct((F.col("at.at_a") >= 0).alias("w"), "seeds", "at", "to", "turned")).alias("c"))
    return best.select("rep_a", "rep_b", F.col("c.seeds").alias("seeds"), "c.at.at_a", "c.at.at_b", F.col("c.to.at_a").alias("to_a"), F.col("c.to.at_b").alias("to_b"), "c.turned")


def _near(shapes: DataFrame, same: DataFrame) -> list[Stored]:
    """Pairs of representatives that are aligned and covered, ``same`` pairs left out: ``(rep_a, rep_b, coverage)``.

    Seeds take several times the room of their ink, and drawings of one character meet the more often the more there
    are of them. So seeds meet in rounds of their hashes, and pairs are chained and aligned in batches of evaluation
    rows; each round and batch leaves nothing but its table.
    """
    inks = shapes.count()
    rounds = min(ROUNDS, 1 + inks // ROUND_INKS)
    told = [Stored(_meets(shapes, turn, rounds)) for turn in range(rounds)]
    meets = functools.reduce(DataFrame.unionByName, [t.df for t in told])
    pairs_met = meets.agg(F.approx_count_distinct(F.xxhash64("rep_a", "rep_b"))).first()[0]
    batches = 1 + pairs_met // max(BATCH_LEAST, BATCH_PAIRS * inks)
    found = []
    for i in range(batches):
        def part(df: DataFrame, i: int = i) -> DataFrame:
            return df.where(F.pmod(F.xxhash64("rep_b"), F.lit(batches)) == i) if batches > 1 else df

        pairs = Stored(_chains(part(meets)).join(part(same), ["rep_a", "rep_b"], "left_anti"))
        ink_a = shapes.where("train").select(F.col("rep").alias("rep_a"), F.col("points").alias("points_a"))
        ink_b = part(shapes.where("NOT train").select(F.col("rep").alias("rep_b"), F.col("points").alias("points_b")))
        full = pairs.df.join(ink_a, "rep_a").join(ink_b, "rep_b").select("rep_a", "rep_b", "seeds", "at_a", "at_b", "to_a", "to_b", "turned", "points_a", "points_b")
        checked = full.mapInArrow(align, "rep_a bigint, rep_b bigint, covered_a double, covered_b double, seeds bigint")
        found.append(Stored(checked.where((F.col("covered_a") >= COVERED) & (F.col("covered_b") >= COVERED)).select("rep_a", "rep_b", F.least("covered_a", "covered_b").alias("coverage"))))
        pairs.drop()
    for t in told:
        t.drop()
    return found


@unshuffled
def cross_split_links(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Classes of drawings of evaluation splits that also occur in the training split: ``(links, members)``.

    ``rows``: ``(row_id, split, record, strokes)``, split being train, validation, test or null (in no split), record
    the record's identity within its source or null, strokes null for unknown ink. ``members`` ``(by, train, rep,
    row_id)`` tells the class of each row on its side: ``by`` is ``record`` (same identity, only where both sides have
    it) or ``ink`` (same points), ``rep`` the class's smallest row. ``links`` ``(by, rep_a, rep_b, kind, coverage)``
    links a class of the training side to one of the evaluation side: ``kind`` is ``record``, ``ink`` (same points) or
    ``near`` (aligned within tolerance, both drawings covered to COVERED); coverage is the smaller of both drawings'
    coverages, 1 for the first two kinds. Ink without points is like no other ink. Copies are never expanded here.
    """
    # A filter on the split would read its name a second time, so rows in no split are left out where ink is packed.
    side = let(F.col("split"), lambda s: F.when(s.isin("train", "validation", "test"), s == "train"))
    inks_of = Stored(packed_ink(spread(rows.withColumn("train", side)), ["train", "row_id", "record"]))
    code = F.concat_ws(":", F.xxhash64("points"), F.crc32("points"), F.length("points"))
    base = Stored(inks_of.df.select("row_id", "train", "record", F.when(F.col("inked"), code).alias("ink")))

    def classes(by: str) -> tuple[Stored, Stored]:
        """The classes of a key, one row ``(key, rep_a, rep_b)`` for each, and the members ``(row_id, train, rep)``."""
        keyed = base.df.where(F.col(by).isNotNull()).select("row_id", "train", F.col(by).alias("key"))
        first = lambda train: F.min(F.when(F.col("train") == train, F.col("row_id")))
        reps = keyed.groupBy("key").agg(first(True).alias("rep_a"), first(False).alias("rep_b"))
        reps = Stored(reps if by == "ink" else reps.where("rep_a IS NOT NULL AND rep_b IS NOT NULL"))
        members = lookup(keyed, reps.df, "key", "inner").select("row_id", "train", F.when(F.col("train"), F.col("rep_a")).otherwise(F.col("rep_b")).alias("rep"))
        return reps, Stored(members)

    records, of_record = classes("record")
    inks, of_ink = classes("ink")
    base.drop()
    sides = inks.df.select(F.explode(F.array("rep_a", "rep_b")).alias("row_id")).where("row_id IS NOT NULL")
    shapes = Stored(inks_of.df.join(sides, "row_id", "left_semi").select(F.col("row_id").alias("rep"), "train", "points", "lens"))
    inks_of.drop()
    same = inks.df.where("rep_a IS NOT NULL AND rep_b IS NOT NULL").select("rep_a", "rep_b")
    near = _near(shapes.df, same)
    one = F.lit(1.0)
    links = Stored(
        functools.reduce(DataFrame.unionByName, [t.df for t in near]).select(F.lit("ink").alias("by"), "rep_a", "rep_b", F.lit("near").alias("kind"), "coverage")
        .unionByName(same.select(F.lit("ink").alias("by"), "rep_a", "rep_b", F.lit("ink").alias("kind"), one.alias("coverage")))
        .unionByName(records.df.select(F.lit("record").alias("by"), "rep_a", "rep_b", F.lit("record").alias("kind"), one.alias("coverage")))
    )
    for table in (*near, shapes, inks, records):
        table.drop()
    members = [table.df.select(F.lit(by).alias("by"), "train", "rep", "row_id") for by, table in (("record", of_record), ("ink", of_ink))]
    return links.df, members[0].unionByName(members[1])


#: The kinds of evidence, surest first.
_SURENESS = ("record", "ink", "near")


def _rank(kind: str) -> Column:
    return F.array_position(F.array(*[F.lit(k) for k in _SURENESS]), F.col(kind))


def _best(k: Column) -> list[Column]:
    return [F.element_at(F.array(*[F.lit(s) for s in _SURENESS]), k["k"].cast("int")).alias("kind"), (-k["c"]).alias("coverage")]


def overlapping_rows(links: DataFrame, members: DataFrame) -> DataFrame:
    """Each evaluation row that also occurs in training, with its surest evidence: ``(row_id, kind, coverage)``.

    Classes are reduced to their best link before they meet their members, so nothing is expanded into pairs.
    """
    best = F.min(F.struct(_rank("kind").alias("k"), (-F.col("coverage")).alias("c"))).alias("b")
    of_class = links.groupBy("by", "rep_b").agg(best)
    found = members.where("NOT train").join(of_class.withColumnRenamed("rep_b", "rep"), ["by", "rep"])
    return found.groupBy("row_id").agg(F.min("b").alias("b")).select("row_id", *_best(F.col("b")))


@unshuffled
def cross_split_pairs(rows: DataFrame) -> DataFrame:
    """Every pair of a training and an evaluation row that are the same drawing: ``(train_row, row_id, kind, coverage)``.

    The links of ``cross_split_links``, expanded; a pair comes once, with its surest kind. A class of more than
    BLOCK_ROWS rows is cut into blocks, and the blocks of a link meet in tasks of their own.
    """
    links, members = cross_split_links(rows)
    sizes = members.groupBy("by", "train", "rep").agg(F.count(F.lit(1)).alias("n"))
    blocks = Stored(sizes.select("by", "train", "rep", F.ceil(F.col("n") / BLOCK_ROWS).cast("int").alias("blocks"))).df
    # Only classes of several blocks need the number of blocks beside their members.
    large = blocks.where("blocks > 1").select(F.concat_ws(":", "by", "train", "rep").alias("class"), "blocks")
    placed = lookup(Stored(members.withColumn("class", F.concat_ws(":", "by", "train", "rep"))).df, large, "class").select("by", "train", "rep", "row_id", F.pmod(F.xxhash64("row_id"), F.coalesce("blocks", F.lit(1))).cast("int").alias("block"))
    out = links
    for side, train in (("a", True), ("b", False)):
        of = blocks.where(F.col("train") == train).select("by", F.col("rep").alias(f"rep_{side}"), "blocks")
        out = out.join(of, ["by", f"rep_{side}"]).withColumn(f"block_{side}", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    for side, train, name in (("a", True, "train_row"), ("b", False, "row_id")):
        rows_of = placed.where(F.col("train") == train).select("by", F.col("rep").alias(f"rep_{side}"), F.col("block").alias(f"block_{side}"), F.col("row_id").alias(name))
        out = out.join(rows_of, ["by", f"rep_{side}", f"block_{side}"])
    first = out.groupBy("train_row", "row_id").agg(F.min(F.struct(_rank("kind").alias("k"), (-F.col("coverage")).alias("c"))).alias("b"))
    return first.select("train_row", "row_id", *_best(F.col("b")))
