import math
import random
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from inkatlas.llm import overlaps as O

SCHEMA = "row_id long, split string, record string, strokes array<array<struct<x: float, y: float>>>"


def ink(rng, strokes=3):
    out = []
    for _ in range(strokes):
        x, y, way, k = rng.uniform(100, 900), rng.uniform(100, 900), rng.uniform(0, 6.28), []
        for _ in range(rng.randint(6, 10)):
            k.append((round(x), round(y)))
            way += rng.gauss(0, 0.6)
            step = rng.uniform(40, 130)
            x, y = x + step * math.cos(way), y + step * math.sin(way)
        out.append(k)
    return out


def jitter(rng, s, by=1):
    return [[(x + rng.randint(-by, by), y + rng.randint(-by, by)) for x, y in k] for k in s]


def drop(rng, s):
    s = [list(k) for k in s]
    k = rng.randrange(len(s))
    s[k].pop(rng.randrange(1, len(s[k]) - 1))
    return s


CHANGES = {
    "same": lambda rng, s: s,
    "jittered": jitter,
    "moved": lambda rng, s: [[(x - 61, y + 40) for x, y in k] for k in s],
    "scaled": lambda rng, s: [[(round(500 + 0.8 * (x - 500)), round(500 + 0.8 * (y - 500))) for x, y in k] for k in s],
    "dropped": lambda rng, s: jitter(rng, drop(rng, s)),
    "split": lambda rng, s: [s[0][:3], s[0][3:], *s[1:]],
    "turned": lambda rng, s: [k[::-1] for k in s[::-1]],
    "turned within": lambda rng, s: [k[::-1] for k in s],
    "reordered": lambda rng, s: s[::-1],
    "other": lambda rng, s: jitter(rng, s, 40),
}


def row(i, split, s, record=None):
    return (i, split, record, None if s is None else [k and [p and {"x": float(p[0]), "y": float(p[1])} for p in k] for k in s])


@pytest.fixture(scope="module")
def found(spark):
    rng = random.Random(4)
    rows, want, kinds = [], set(), {}
    for n, (name, change) in enumerate(CHANGES.items()):
        for j in range(12):
            i = 1000 * n + 10 * j
            s = ink(rng, 1 + (j + n) % 4 if name not in ("reordered",) else 2 + j % 3)
            if len(s) == 1:
                s = [s[0] + ink(rng, 1)[0]]
            rows += [row(i, "train", s), row(i + 1, "test" if j % 2 else "validation", change(rng, s)), row(i + 2, None, s)]
            kinds[i] = name
            if name != "other":
                want.add((i, i + 1))
    rows += [row(50001, "train", None, "d/A#1#"), row(50002, "test", [[]], "d/A#1#"), row(50003, "test", [], None), row(50004, "validation", [[(5, 5)]], None), row(50005, "train", [[(6, 7)]], None), row(50006, "train", [[(3, 4), (3, 4)]], "d/A#2#"), row(50007, "train", [[(9, 30)]], None)]
    want |= {(50001, 50002), (50005, 50004), (50006, 50004)}
    copies = ink(rng)
    rows += [row(60000 + i, "train" if i % 2 else "test", copies) for i in range(30)]
    want |= {(a, b) for a in range(60001, 60030, 2) for b in range(60000, 60030, 2)}
    dirty = ink(rng)
    rows += [row(70000, "train", dirty), row(70001, "test", [[None, *dirty[0]], None, [*dirty[1], (float("nan"), 5.0)], *dirty[2:]]), row(70002, "test", [[None]]), row(70003, "train", [[None]])]
    want.add((70000, 70001))
    df = spark.createDataFrame(rows, SCHEMA).withColumn("rep", F.lit("clash"))
    got = {(r["train_row"], r["row_id"]): (r["kind"], r["coverage"]) for r in O.cross_split_pairs(df.select("row_id", "split", "record", "strokes", "rep")).collect()}
    return got, want, kinds


def test_changed_copies_are_found_and_others_are_not(found):
    got, want, kinds = found
    missed = sorted(kinds.get(a, a) for a, b in want - set(got))
    assert len(missed) <= 2 and not set(got) - want, (missed, set(got) - want)


def test_kinds_and_coverage(found):
    got, _, kinds = found
    assert got[50001, 50002][0] == "record" and got[60001, 60000] == ("ink", 1.0)
    for (a, _), (kind, coverage) in got.items():
        if kinds.get(a) in ("jittered", "moved", "scaled", "dropped", "split"):
            assert kind in ("near", "ink") and coverage >= O.COVERED


def test_empty_tables(spark):
    assert O.cross_split_pairs(spark.createDataFrame([], SCHEMA)).count() == 0
    assert O.cross_split_pairs(spark.createDataFrame([row(1, "train", None), row(2, "test", None)], SCHEMA)).count() == 0


def test_coverage_after_scale_and_shift():
    rng = random.Random(1)
    s = np.array([p for k in ink(rng) for p in k], float)
    a = (s[:, 0] + 1j * s[:, 1])[None]
    b = (a - (30 + 5j)) / 1.3
    n = np.array([a.shape[1]])
    of_a, of_b = O.covered(a, b, n, n, (np.array([1.3]), np.array([30 + 5j]), np.array([900.0])))
    assert of_a[0] == of_b[0] == 1
    of_a, _ = O.covered(a, b, n, n, (np.array([0.5]), np.array([30 + 5j]), np.array([900.0])))
    assert of_a[0] < 1


def pairs_of(spark, rows):
    return {(r["train_row"], r["row_id"]) for r in O.cross_split_pairs(spark.createDataFrame(rows, SCHEMA)).collect()}


def near_as_recorded(a, b):
    """Brute force: every point of either lies within the tolerance of one of the other."""
    a, b = (np.array([p for k in s for p in k], float) for s in (a, b))
    tol = O.TOLERANCE + O.PART * np.hypot(*(a.max(0) - a.min(0)))
    gap = np.hypot(*(a[:, None] - b[None]).transpose(2, 0, 1))
    return (gap.min(1) <= tol).mean() >= O.COVERED and (gap.min(0) <= tol).mean() >= O.COVERED


def test_plain_ink_is_compared_as_recorded(spark):
    rng = random.Random(8)
    dots = [[[(rng.uniform(0, 100), rng.uniform(0, 100))]] for _ in range(100)]
    bars = [[[(x, y), (x + rng.uniform(290, 690), y + rng.uniform(-4, 4))]] for x, y in ((rng.uniform(0, 60), rng.uniform(0, 60)) for _ in range(100))]
    level = []  # many points on one line are a bar too
    for _ in range(30):
        x, y, k = rng.uniform(0, 40), rng.uniform(0, 40), rng.uniform(300, 600)
        level.append([[(x + k * i / 11, y + rng.uniform(-1, 1)) for i in range(12)]])
    short = [ink(rng, 1) for _ in range(20)]
    short = [[s[0][:5]] for s in short]
    short += [[[(x + rng.uniform(-1, 1), y + rng.uniform(-1, 1)) for x, y in s[0]]] for s in short]
    every = [("dot", s) for s in dots] + [("bar", s) for s in bars] + [("level", s) for s in level] + [("short", s) for s in short]
    rows = [row(i, "train" if i % 2 else "test", s) for i, (_, s) in enumerate(every)]
    # The 60 : 40 dots and bars of different places and lengths make no pairs but those that lie within tolerance.
    got = pairs_of(spark, rows)
    want = {(i, j) for i, (k, a) in enumerate(every) for j, (m, b) in enumerate(every) if i % 2 and not j % 2 and k == m and k != "short" and near_as_recorded(a, b)}
    assert len(want) < 100
    assert {p for p in got if every[p[0]][0] != "short"} == want
    rows = [row(i, "train" if i < 20 else "test", s) for i, s in enumerate(short)]
    assert pairs_of(spark, rows) >= {(i, i + 20) for i in range(20)}


def test_very_long_ink_and_its_copy(spark):
    rng = random.Random(3)
    way, x, y, long = 0.0, 500.0, 500.0, []
    for _ in range(70_000):
        way += rng.gauss(0, 0.3)
        x, y = min(max(x + 3 * math.cos(way), 0), 1000), min(max(y + 3 * math.sin(way), 0), 1000)
        long.append((x, y))
    copy = [(0.9 * x + 40, 0.9 * y + 7) for x, y in long]
    other = [(1000 - x, y) for x, y in long[:35_000]]
    assert pairs_of(spark, [row(1, "train", [long]), row(2, "test", [copy]), row(3, "test", [other])]) == {(1, 2)}


def test_copies_are_not_expanded_before_the_pairs_are_asked_for(spark):
    rng = random.Random(9)
    one, two = ink(rng), ink(rng)
    rows = [row(i, "train" if i % 2 else "test", one) for i in range(10_000)] + [row(20_000 + i, "train", jitter(rng, one)) for i in range(3)] + [row(30_000, "test", two)]
    links, members = O.cross_split_links(spark.createDataFrame(rows, SCHEMA))
    assert links.count() == 4 and members.count() == len(rows)
    found = {r["row_id"]: r["kind"] for r in O.overlapping_rows(links, members).collect()}
    assert found == {i: "ink" for i in range(0, 10_000, 2)}


def test_blocks_of_large_classes_make_every_pair_once(spark, monkeypatch):
    monkeypatch.setattr(O, "BLOCK_ROWS", 3)
    s = ink(random.Random(2))
    rows = [row(i, "train" if i % 3 else "test", s, "d/A#1#" if i < 9 else None) for i in range(30)]
    got = [(r["train_row"], r["row_id"]) for r in O.cross_split_pairs(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert len(got) == len(set(got)) == 20 * 10


def test_rolling_hash_and_winnowing_equal_their_definitions():
    rng = np.random.default_rng(0)
    v = rng.integers(0, 20, 40)
    b, i = O._BASE, O._INVERSE
    want = [sum(int(v[s + j]) * pow(b, j, 1 << 64) for j in range(4)) % (1 << 64) for s in range(37)]
    assert O.rolled(v, 4, b, i).tolist() == want and len(O.rolled(v[:3], 4, b, i)) == 0
    h, run = rng.integers(0, 1000, 60).astype(np.uint64), np.repeat([0, 1, 2, 3], [2, 30, 1, 27])
    kept = set()
    for r in range(4):
        at = np.flatnonzero(run == r)
        kept |= {int(at[w + int(h[at[w : w + 3]].argmin())]) for w in range(max(1, len(at) - 2))}
    assert O.winnowed(h, run, 3).tolist() == sorted(kept)


def test_long_pairs_are_swept_to_the_same_distances():
    rng = np.random.default_rng(1)
    a, b = (rng.uniform(0, 1000, (1, 2500)) + 1j * rng.uniform(0, 1000, (1, 2500)) for _ in range(2))
    n = np.array([2500])
    to_b, near, to_a = O._gaps(a, b, n, n, 60.0)
    gap = np.abs(a[0][:, None] - b[0][None])
    assert np.allclose(np.minimum(to_b[0], 60), np.minimum(gap.min(1), 60)) and np.allclose(np.minimum(to_a[0], 60), np.minimum(gap.min(0), 60))
    assert (near[0] == gap.argmin(1))[gap.min(1) <= 60].all()


def test_whole_coordinates_take_two_bytes_and_come_back(spark):
    rng = random.Random(5)
    whole, parts = ink(rng), [[(x + 0.25, y) for x, y in k] for k in ink(rng)]
    far = [[(x + 40_000, y) for x, y in k] for k in whole]
    inks = [whole, parts, [[]], None, far, [[(1.0, float("nan"))]], [[(-32767.0, 32767.0), (0.0, -0.0)]]]
    got = O.packed_ink(spark.createDataFrame([row(i, "train", s) for i, s in enumerate(inks)], SCHEMA).coalesce(1), ["row_id"]).orderBy("row_id").collect()
    n = [sum(map(len, s or [])) for s in inks]
    assert [None if r["points"] is None else len(r["points"]) for r in got] == [4 * n[0] + 2, 8 * n[1], 0, None, 8 * n[4], 8, 10]
    known = [i for i, s in enumerate(inks) if s]
    x, y, counts = O._points(pa.array([bytes(got[i]["points"]) for i in known], pa.binary()))
    assert counts.tolist() == [n[i] for i in known]
    want = np.array([p for i in known for k in inks[i] for p in k], np.float32)
    assert np.array_equal(np.stack([x, y], 1), want, equal_nan=True)


def test_rounds_and_batches_give_the_same_links(spark, monkeypatch):
    rng = random.Random(12)
    rows = []
    for i in range(60):
        s = ink(rng, 2)
        rows += [row(2 * i, "train", s), row(2 * i + 1, "test", jitter(rng, s))]
    dots = [row(1000 + i, "train" if i % 2 else "test", [[(rng.uniform(0, 40), rng.uniform(0, 40))]]) for i in range(40)]
    df = spark.createDataFrame(rows + dots, SCHEMA)
    links = lambda: sorted(tuple(r) for r in O.cross_split_links(df)[0].collect())
    once, stored = links(), []
    monkeypatch.setattr(O, "ROUND_INKS", 40)
    monkeypatch.setattr(O, "BATCH_LEAST", 20)
    monkeypatch.setattr(O, "BATCH_PAIRS", 0)
    kept = O.Stored
    monkeypatch.setattr(O, "Stored", lambda d: stored.append(d.columns) or kept(d))
    assert links() == once and len(once) > 60
    assert stored.count(["rep_a", "rep_b", "at_a", "at_b", "turned"]) == 3
    assert stored.count(["rep_a", "rep_b", "coverage"]) > 1


def test_no_shuffle_files_are_left_behind(spark):
    rng = random.Random(13)
    inks = [ink(rng) for _ in range(20)]
    df = spark.createDataFrame([row(2 * i + j, ("train", "test")[j], s) for i, s in enumerate(inks) for j in range(2)], SCHEMA)
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffles():
        files = disk.getAllFiles()
        return {name for i in range(files.size()) if (name := files.apply(i).getName()).startswith("shuffle_")}

    before, setting = shuffles(), spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None)
    O.cross_split_links(df)
    for _ in range(50):
        if not (left := shuffles() - before):
            break
        time.sleep(0.1)
    assert not left
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) == setting
