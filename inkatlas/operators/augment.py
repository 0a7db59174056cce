"""Hand-drawn-looking variants of clean strokes, the same for the same key on every run.

A stroke is an array of complex numbers, so that turning and scaling is a product. Every variant draws its numbers from
a generator seeded by its key; the order of rows and partitions does not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkatlas.operators.datasets import flat_ink
from inkatlas.operators.parallel import spread

#: Sizes of the changes, in units of the drawing's longer side (angles in degrees, scales as logarithms).
SPACING = 0.012
SHIFT, TURN, GROW = 0.025, 5.0, 0.08
END, OPENED = 0.04, 0.6
WAVE, WAVE_LENGTHS = 0.008, (0.15, 0.6)
SOFT = (0.0, 0.025)
BEND, BEND_RATES, BENDS = 0.035, (0.4, 1.6), 3
WHOLE_TURN, SHEAR, ASPECT = 9.0, 0.22, 0.22


def normalised(strokes: list[np.ndarray]) -> list[np.ndarray]:
    """Complex strokes about the origin, the longer side of their box being 1 (or 0)."""
    z = [np.asarray(s, float) @ np.array([1, 1j]) for s in strokes if len(s)]
    every = np.concatenate(z)
    lo, hi = every.real.min() + 1j * every.imag.min(), every.real.max() + 1j * every.imag.max()
    side = max((hi - lo).real, (hi - lo).imag)
    return [(s - (lo + hi) / 2) / (side or 1.0) for s in z]


def evened(z: np.ndarray) -> np.ndarray:
    """Points at equal steps along the stroke, both ends kept; a stroke without length is one point."""
    total = np.abs(np.diff(z)).sum()
    return z[:1] if total == 0 else _along(z, 0.0, total) if not _looped(z) else np.r_[_along(z, 0.0, total)[:-1], z[-1]]


def _looped(z: np.ndarray) -> bool:
    return len(z) > 3 and abs(z[0] - z[-1]) < 2 * SPACING


def _along(z: np.ndarray, begin: float, end: float) -> np.ndarray:
    """The stroke from ``begin`` to ``end`` in lengths of its way, at steps of about SPACING; beyond its ends it goes
    straight on, or, if it is a loop, around once more."""
    way = np.r_[0.0, np.cumsum(np.abs(np.diff(z)))]
    total = way[-1]
    at = np.linspace(begin, end, max(2, int(np.ceil((end - begin) / SPACING)) + 1))
    if _looped(z):
        inside, beyond = np.mod(at, total), 0.0
    else:
        inside = np.clip(at, 0, total)
        first, last = z[1] - z[0], z[-1] - z[-2]
        ahead = np.where(at < 0, first / max(abs(first), 1e-9), last / max(abs(last), 1e-9))
        beyond = (at - inside) * ahead
    return np.interp(inside, way, z.real) + 1j * np.interp(inside, way, z.imag) + beyond


def _waves(rng: np.random.Generator, at: np.ndarray, rates: np.ndarray) -> np.ndarray:
    """A smooth random function of ``at`` with values about -1 to 1: sines of the given rates with random phases."""
    return np.sin(2 * np.pi * at[:, None] * rates + rng.uniform(0, 2 * np.pi, len(rates))).mean(1)


class _Hand:
    """What one variant does to a drawing. Every change is a shift of points, and all shifts of a stroke are added up
    from where the stroke is drawn first, so their order does not matter."""

    def __init__(self, seed: list[int]):
        self.rng = rng = np.random.default_rng(seed)
        # The whole: the logarithm of a matrix that turns, shears and stretches.
        turn, shear, stretch = np.radians(self.swing(WHOLE_TURN)), self.swing(SHEAR) / 2, self.swing(ASPECT) / 2
        change = np.array([[stretch, shear - turn], [shear + turn, -stretch]])
        self.matrix = np.eye(2) + change + change @ change / 2
        # The field: a shift that varies slowly over the page, from a coarse grid of random shifts.
        angle = rng.uniform(0, np.pi, BENDS)
        self.axes = np.stack([np.cos(angle), np.sin(angle)]) * rng.uniform(*BEND_RATES, BENDS)
        self.pulls = rng.normal(size=(BENDS, 2)) * BEND / BENDS**0.5
        self.phases = rng.uniform(0, 1, BENDS)
        self.soft = rng.uniform(*SOFT)

    def swing(self, most: float) -> float:
        return self.rng.uniform(-most, most)

    def _page(self, z: np.ndarray) -> np.ndarray:
        """The shifts of points by the field and by the whole."""
        xy = np.stack([z.real, z.imag], 1)
        field = np.sin(2 * np.pi * (xy @ self.axes + self.phases)) @ self.pulls
        moved = xy @ (self.matrix - np.eye(2)).T + field
        return moved[:, 0] + 1j * moved[:, 1]

    def _drawn(self, z: np.ndarray) -> np.ndarray:
        """Where the pen begins and ends: a loop begins anywhere and may miss or pass its start, other strokes end a bit
        early or late on either side."""
        total = np.abs(np.diff(z)).sum()
        if not _looped(z):
            return _along(z, min(self.swing(END), total / 3), total - min(self.swing(END), total / 3))
        begin = self.rng.uniform(0, total)
        return _along(z, begin, begin + total + (self.swing(END) if self.rng.random() < OPENED else 0.0))

    def stroke(self, z: np.ndarray) -> np.ndarray:
        own = self.swing(SHIFT) + 1j * self.swing(SHIFT)
        if len(z) == 1 or np.abs(np.diff(z)).sum() == 0:
            return z[:1] + own + self._page(z[:1])
        z = self._rounded(self._drawn(z))
        at = np.r_[0.0, np.cumsum(np.abs(np.diff(z)))]
        across = 1j * np.exp(1j * np.angle(np.gradient(z)))
        tremble = _waves(self.rng, at, 1 / self.rng.uniform(*WAVE_LENGTHS, 2)) * self.rng.uniform(0, WAVE) * across
        resize = (np.exp(self.swing(GROW) + 1j * np.radians(self.swing(TURN))) - 1) * (z - z.mean())
        return z + own + tremble + resize + self._page(z)

    def _rounded(self, z: np.ndarray) -> np.ndarray:
        """Corners cut off: the mean of the way over a stretch about each point, which shrinks to nothing at the ends."""
        reach = int(round(self.soft / SPACING * 1.5))
        if reach < 1 or len(z) < 5:
            return z
        place = np.arange(len(z))
        half = np.minimum(reach, np.minimum(place, place[::-1]))
        total = np.r_[0, np.cumsum(z)]
        return (total[place + half + 1] - total[place - half]) / (2 * half + 1)


def variant(strokes: list[np.ndarray], seed: list[int]) -> list[np.ndarray]:
    """One variant of strokes of points; the result's points are real pairs again."""
    hand = _Hand(seed)
    return [np.column_stack([z.real, z.imag]) for z in map(hand.stroke, normalised(strokes))]


def synthesize(drawings: DataFrame, id_col: str, strokes_col: str, variants: int, seed: int = 0) -> DataFrame:
    """``(id, variant, strokes)``: ``variants`` variants of each drawing with a point. ``id`` is a whole number."""

    point = pa.struct([("x", pa.float64()), ("y", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            xs, ys, lens = (batch.column(c).to_pylist() for c in ("xs", "ys", "lens"))
            points, strokes, drawings = [], [], []
            for i, (key, v) in enumerate(zip(batch.column("id").to_pylist(), batch.column("variant").to_pylist())):
                lines = np.split(np.column_stack([xs[i], ys[i]]), np.cumsum(lens[i])[:-1])
                made = variant(lines, [seed, key & (2**63 - 1), v])
                points += made
                strokes += [len(s) for s in made]
                drawings.append(len(made))
            flat = np.round(np.vstack(points), 5) if points else np.zeros((0, 2))
            values = pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], fields=list(point))
            ends = lambda n: pa.array(np.r_[0, np.cumsum(n)].astype(np.int32))
            nested = pa.ListArray.from_arrays(ends(drawings), pa.ListArray.from_arrays(ends(strokes), values))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("variant"), nested], names=["id", "variant", "strokes"])

    flat = drawings.select(F.col(id_col).cast("bigint").alias("id"), *flat_ink(F.col(strokes_col))).where("size(xs) > 0")
    each = flat.withColumn("variant", F.explode(F.sequence(F.lit(0), F.lit(variants - 1))))
    return spread(each).mapInArrow(run, "id bigint, variant int, strokes array<array<struct<x: double, y: double>>>")
