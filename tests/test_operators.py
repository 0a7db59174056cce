import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkatlas.functions.names import read_name, read_person, read_split
from inkatlas.functions.hashing import held_out, stable_fraction
from inkatlas.operators import confusables as C
from inkatlas.operators import evaluation as E
from inkatlas.operators import lookups as L
from inkatlas.operators import prior as P
from inkatlas.operators import ranking as R
from inkatlas.operators import raster
from inkatlas.operators import skew as S
from inkatlas.operators.datasets import fitted, ink_length, segments, summary_by
from inkatlas.operators.pca import principal_directions


def test_names_read(spark):
    names = [" Session_0000672\t", "session-672", "SITE３ w０００1\xa0", "site3-W1", "1-2", "12", "00", "?", "", None]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = [r[0] for r in df.select(read_name(F.col("n"))).collect()]
    assert got == ["SESSION#672#", "SESSION#672#", "SITE#3#W#1#", "SITE#3#W#1#", "#1##2#", "#12#", "#0#", "", "", None]
    assert [r[0] for r in df.select(read_person(F.lit("N/A"))).limit(1).collect()] == [None]
    splits = spark.createDataFrame([(s,) for s in ("Train ", "training", "valid", " validation", "TEST", "test-set", "other", None)], "s string")
    assert [r[0] for r in splits.select(read_split(F.col("s"))).collect()] == ["train", "train", "validation", "validation", "test", "test", None, None]


def test_log_prior_of_two_languages(spark):
    counts = spark.createDataFrame([("x", 1, 3), ("x", 2, 1), ("y", 3, 4), ("y", 9, 100)], "language string, code_point int, n long")
    chars = spark.createDataFrame([(1,), (2,), (3,)], "code_point int")
    got = {r["code_point"]: r["log_prior"] for r in P.log_prior(counts, chars, 0.5).collect()}
    assert got[1] == pytest.approx(math.log((3.5 / 5.5 + 0.5 / 5.5) / 2))
    assert sum(map(math.exp, got.values())) == pytest.approx(1.0)
    assert P.log_prior(counts.limit(0), chars).count() == 0


def test_floor_is_the_median_of_regular_characters(spark):
    rows = [(1, 500, -3.0), (2, 500, -5.0), (3, 500, -9.0), (4, 500, -20.0), (5, 500, -2.0), (6, 99, -19.0)]
    prior = spark.createDataFrame(rows, "code_point int, total long, log_prior double")
    flat = spark.createDataFrame([(4,), (5,)], "code_point int")
    got = {r["code_point"]: r["log_prior"] for r in P.raise_to_floor(prior, flat).collect()}
    assert got[4] == -5.0 and got[5] == -2.0 and got[6] == -19.0
    few = {r["code_point"]: r["log_prior"] for r in P.raise_to_floor(prior, flat, 1000).collect()}
    assert few[4] == -20.0


def test_counts_drop_white_space_after_counting(spark, rows):
    df = spark.createDataFrame([("en", "ab a\n"), ("en", None), (None, "zz"), ("en", "")], "lang string, text string")
    assert rows(P.character_counts(df, "lang", "text")) == [("en", 97, 2), ("en", 98, 1)]


def brute_ranking(queries, index, n):
    out = {}
    for q, v in queries:
        best = {}
        for cp, key, bonus, w in index:
            s = float(np.dot(v, w))
            best[cp] = max(best.get(cp, (-9, key, bonus)), (s, key, bonus))
        per = {}
        for cp, (s, key, bonus) in sorted(best.items()):
            if key not in per or s + bonus > per[key][0]:
                per[key] = (s + bonus, cp)
        out[q] = [(k, cp) for k, (sc, cp) in sorted(per.items(), key=lambda e: (-e[1][0], e[1][1]))[:n]]
    return out


@pytest.mark.parametrize("part", [5, 20_000])
def test_best_matches_equal_brute_force(spark, monkeypatch, part):
    monkeypatch.setattr(R, "PART_VECTORS", part)
    monkeypatch.setattr(R, "CHUNK_QUERIES", 3)
    rng = np.random.default_rng(1)
    index = [(int(rng.integers(20)), 0, 0.0, [float(x) for x in rng.integers(-2, 3, 4)]) for _ in range(120)]
    index = [(cp, cp // 3, -0.1 * (cp % 4), v) for cp, _, _, v in index]
    queries = [(q, [float(x) for x in rng.integers(-2, 3, 4)]) for q in range(7)]
    q = spark.createDataFrame(queries, "q long, vector array<double>")
    i = spark.createDataFrame(index, "code_point int, key long, bonus double, vector array<double>")
    got = {}
    for r in sorted(R.best_matches(q, i, 4).collect(), key=lambda r: (r["q"], r["rank"])):
        got.setdefault(r["q"], []).append((r["key"], r["code_point"]))
    assert got == brute_ranking(queries, index, 4)
    assert R.best_matches(q, i.limit(0), 4).count() == 0 and R.best_matches(q.limit(0), i, 4).count() == 0


def test_chooser_prefers_what_can_be_typed(spark):
    rows = [(1, 65, "Latin", "Lu", -3.0), (1, 0x391, "Greek", "Lu", -2.0), (1, 0x410, "Cyrillic", "Lu", -4.0), (2, 0x2A01, "Common", "Sm", None), (2, 0x2A02, "Latin", "Lu", -9.0)]
    df = spark.createDataFrame(rows, "group int, code_point int, script string, general_category string, log_prior double")
    pick = lambda keys: {r["group"]: r["members"] for r in R.chooser(df, keys).collect()}
    assert pick(["Latin"])[1] == [65, 0x391, 0x410] and pick(["Greek"])[1] == [0x391, 65, 0x410] and pick(["Hebrew"])[1] == [0x391, 65, 0x410]
    assert pick(["Latin"])[2] == [0x2A02, 0x2A01] and pick(["Greek"])[2] == [0x2A01, 0x2A02]


def test_padding(spark):
    df = spark.createDataFrame([(1, 1, 7), (1, 2, 8), (2, 1, 9)], "q long, rank int, code_point int")
    assert {r["q"]: r["predictions"] for r in R.padded(df, 3).collect()} == {1: [7, 8, -1], 2: [9, -1, -1]}


def test_metrics(spark):
    rows = [(1, 1, [1, 2], [1, 2], "d"), (1, 1, [1, 9], [1, 9], "d"), (1, 1, [5, 1], [5, 1], None), (2, 2, [3, -1], [2, -1], "e")]
    hits = E.hit_flags(spark.createDataFrame(rows, "label int, label_group int, predictions array<int>, prediction_groups array<int>, ds string"))
    m = E.micro(hits).first()
    assert (m["samples"], m["characters"], m["top1"], m["top5"], m["top1_conf"]) == (4, 2, 0.5, 0.75, 0.75)
    assert E.macro(hits).first()["top5"] == 0.5
    s = {(r["slice_kind"], r["slice"]): r["top1"] for r in E.sliced(hits, ["ds"]).collect()}
    assert s == {("overall", "all"): 0.5, ("ds", "d"): 1.0, ("ds", "?"): 0.0, ("ds", "e"): 0.0}
    empty = E.micro(hits.limit(0)).first()
    assert empty["samples"] == 0 and empty["top1"] is None


def test_range_lookup_and_cascade(spark, rows):
    ranges = spark.createDataFrame([(0, 127, "a"), (300, 2000, "b")], "first int, last int, block string")
    keys = spark.createDataFrame([(0,), (127,), (128,), (1999,), (2001,), (None,)], "cp int")
    assert rows(L.range_lookup(keys, "cp", ranges, "block", "?")) == sorted([(0, "a"), (127, "a"), (128, "?"), (1999, "b"), (2001, "?"), (None, "?")], key=repr)
    one = spark.createDataFrame([("k", 1), ("k", 2), ("l", 3)], "key string, cp int")
    two = spark.createDataFrame([("k", 9), ("m", None)], "key string, cp int")
    assert rows(L.cascade(spark.createDataFrame([("k",), ("l",), ("m",)], "key string"), "key", [("one", one), ("two", two)], "cp")) == [("k", 9, "two"), ("l", 3, "one"), ("m", None, "unresolved")]


def test_chunks_keep_inside_files(spark):
    files = spark.createDataFrame([("a", 1000), ("b", 3000), ("c", 0), ("d", None)], "file_name string, size long")
    got = sorted(L.plan_chunks(files, 4, 200).collect())
    assert [r["file_name"] for r in got] == ["a", "b", "b", "b"] and all(r["end"] - r["start"] == 200 for r in got)


def brute_linkage(pairs, threshold):
    sim = {}
    for a, b, s in pairs:
        if s is not None and a != b:
            sim[min(a, b), max(a, b)] = max(s, sim.get((min(a, b), max(a, b)), -1))
    of, members = {}, {}
    for s, a, b in sorted(((s, a, b) for (a, b), s in sim.items()), reverse=True):
        if s < threshold:
            break
        for x in (a, b):
            if x not in of:
                of[x], members[x] = x, [x]
        p, q = sorted((of[a], of[b]))
        if p != q and all(sim.get((min(x, y), max(x, y)), -1) >= threshold for x in members[p] for y in members[q]):
            for x in members.pop(q):
                of[x] = p
                members[p].append(x)
    return {x: min(members[c]) for x, c in of.items()}


@pytest.mark.parametrize("seed", range(4))
def test_complete_linkage_equals_the_ordered_visit(spark, seed):
    rng = random.Random(seed)
    pairs = [(a, b, rng.choice([0.8, 0.86, 0.9, 0.95, 1.0, None])) for a, b in itertools.combinations(range(14), 2) if rng.random() < 0.75]
    pairs += [(b, a, s) for a, b, s in pairs[:5]] + [(3, 3, 1.0)]
    df = spark.createDataFrame(pairs, "first int, second int, similarity double")
    assert {r["member"]: r["cluster"] for r in C.complete_linkage(df).collect()} == brute_linkage(pairs, 0.85)


def test_no_chains_and_joiners(spark):
    df = spark.createDataFrame([(1, 2, 0.95), (2, 3, 0.9), (1, 3, 0.5), (4, 5, 0.99)], "first int, second int, similarity double")
    groups = C.complete_linkage(df)
    assert {r["member"]: r["cluster"] for r in groups.collect()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 4}
    joiners = spark.createDataFrame([(10,), (11,), (12,)], "member int")
    cand = spark.createDataFrame([(0, 2, 10), (1, 10, 5), (2, 11, 20), (3, 12, 2)], "place int, first int, second int")
    sims = spark.createDataFrame([(2, 10, 0.9), (5, 10, 0.9), (1, 10, 0.86), (11, 20, 0.9), (2, 12, 0.9), (1, 12, 0.3)], "first int, second int, similarity double")
    got = {r["member"]: r["cluster"] for r in C.attach_to_groups(groups, joiners, cand, sims).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 4, 10: 1, 11: 20, 20: 20}


def test_mask_similarity(spark):
    grid = np.zeros((2, 32, 32), bool)
    grid[0, 4, 4:10] = True
    grid[1, 5, 4:12] = True
    assert C.mask_similarity(grid[:1], grid[1:])[0] == pytest.approx(7 / 8)
    assert C.mask_similarity(grid[:1], np.zeros((1, 32, 32), bool))[0] == 0
    pack = lambda g: bytearray(np.packbits(g.reshape(-1), bitorder="little").tobytes())
    sig = [(1, "f", 1, pack(grid[0])), (2, "f", 2, pack(grid[1])), (2, "g", 3, pack(grid[0])), (3, "h", 4, pack(grid[0])), (4, None, 5, pack(grid[0])), (5, "f", 6, None)]
    df = spark.createDataFrame(sig, "code_point int, font_id string, sig_id long, mask_bits binary")
    pairs = spark.createDataFrame([(1, 2), (2, 3), (1, 4), (1, 5)], "first int, second int")
    got = {(r["first"], r["second"]): r["similarity"] for r in C.pair_similarity(pairs, df).collect()}
    assert got == {(1, 2): pytest.approx(0.875), (2, 3): pytest.approx((0.875 + 1) / 2), (1, 4): 0.0, (1, 5): 0.0}


def test_lookup_with_hot_keys(spark, rows, monkeypatch):
    monkeypatch.setattr(S, "HOT_ROWS", 10)
    left = spark.createDataFrame([(1 if i % 2 else i, i) for i in range(100)] + [(None, 7)], "k int, v int")
    right = spark.createDataFrame([(k, f"r{k}") for k in range(0, 100, 3)] + [(1, "hot")], "k int, w string")
    assert rows(S.lookup(left, right, "k")) == rows(left.join(right, "k", "left"))
    assert rows(S.lookup(left, right, "k", "inner")) == rows(left.join(right, "k"))


@pytest.mark.parametrize("kind", ["few", "many", "one"])
def test_weighted_statistics_equal_brute_force(spark, kind):
    rng = random.Random(3)
    pick = {"few": lambda: rng.choice([1.0, 2.0, None]), "many": lambda: rng.random() * 1e6, "one": lambda: 5.0}[kind]
    data = [(rng.choice(["a", "b", None]), pick()) for _ in range(500)] + [("c", None)]
    freqs = S.value_frequencies(spark.createDataFrame(data, "k string, v double"), ["k"], "v")
    stats = {r["k"]: r for r in S.distinct_and_mode(freqs, ["k"], "v").collect()}
    pct = {r["k"]: r for r in S.weighted_percentiles(freqs, ["k"], "v", {"m": 0.5, "p": 0.9, "z": 0.0}).collect()}
    for k in ("a", "b", None, "c"):
        vals = sorted(v for kk, v in data if kk == k and v is not None)
        assert stats[k]["rows"] == sum(kk == k for kk, _ in data) and stats[k]["n_distinct"] == len(set(vals))
        if vals:
            assert stats[k]["mode"] == min(set(vals), key=lambda v: (-vals.count(v), v))
            assert [pct[k][c] for c in "mpz"] == [vals[max(math.ceil(len(vals) * q), 1) - 1] for q in (0.5, 0.9, 0.0)]
        else:
            assert stats[k]["mode"] is None and k not in pct


def test_splits_are_stable(spark):
    df = spark.range(4000).select(F.concat(F.lit("writer"), "id").alias("w"))
    assert abs(df.where(held_out(F.lit("toy"), F.col("w"))).count() / 4000 - 0.2) < 0.03
    import hashlib

    want = int.from_bytes(hashlib.sha256(b"x").digest()[:8], "big") / 2**64
    assert spark.range(1).select(stable_fraction(F.lit("x"))).first()[0] == pytest.approx(want, abs=1e-12)


INK = "array<array<struct<x: double, y: double>>>"


def test_fitting_and_segments(spark):
    ink = lambda *s: [[{"x": float(x), "y": float(y)} for x, y in k] for k in s]
    df = spark.createDataFrame([(1, ink([(0, 0), (100, 0), (100, 50)], [])), (2, ink([(3, 4)])), (3, None), (4, [])], f"id int, s {INK}")
    got = {r["id"]: r for r in df.select("id", fitted(F.col("s")).alias("f"), segments(F.col("s")).alias("g"), ink_length(F.col("s")).alias("n")).collect()}
    assert np.allclose([(p["x"], p["y"]) for p in got[1]["f"][0]], [(4.0, 18.0), (60.0, 18.0), (60.0, 46.0)]) and got[1]["n"] == 150
    assert [(p["x"], p["y"]) for p in got[2]["f"][0]] == [(32.0, 32.0)] and len(got[2]["g"]) == 1 and got[2]["n"] == 0
    assert got[3]["f"] is None and got[4]["f"] is None


def naive_image(strokes, side=64):
    lines = [raster.simplify(s, raster.TOLERANCE) for s in raster.fit(strokes, side)]
    out = np.zeros((side, side), np.uint8)
    for y in range(side):
        for x in range(side):
            best = np.inf
            for line in lines:
                for a, b in zip(line if len(line) == 1 else line[:-1], line if len(line) == 1 else line[1:]):
                    p, d = np.array([x + 0.5, y + 0.5]), b - a
                    t = np.clip((p - a) @ d / (d @ d), 0, 1) if d @ d > 0 else 0
                    best = min(best, np.hypot(*(p - a - t * d)))
            out[y, x] = np.rint(np.clip(1.25 + 0.5 - best, 0, 1) * 255)
    return out


def test_images_equal_the_plain_distance_field():
    rng = np.random.default_rng(2)
    for strokes in ([rng.random((6, 2)) * 300, rng.random((3, 2)) * 300], [np.array([[5.0, 5.0]])], [np.array([[0.0, 0.0], [10.0, 0.0]])]):
        assert (raster.draw(strokes) == naive_image(strokes)).all()
    assert raster.draw([np.array([[5.0, 5.0]])]).max() == 255
    assert len(raster.simplify(np.array([[0, 0], [1, 0.01], [2, 0], [3, 0.0]]), 0.1)) == 2
    with pytest.raises(ValueError):
        raster.fit([np.zeros((0, 2))], 64)


def test_features_have_length_one():
    images = np.stack([raster.draw([np.array([[0.0, 0.0], [9.0, 3.0], [4.0, 8.0]])]), raster.draw([np.array([[0.0, 0.0], [0.0, 9.0]])])]) / 255.0
    for make in raster.FEATURES.values():
        f = make(images)
        assert np.allclose(np.linalg.norm(f, axis=1), 1) and f[0] @ f[1] < 0.95
    assert raster.gradient_features(images).shape[1] == 7 * 7 * 36


def test_summary_has_a_total(spark):
    df = spark.createDataFrame([("a", 1, "w", True), ("a", 2, "v", False), (None, 1, None, None)], "ds string, code_point int, w string, t boolean")
    got = {r["ds"]: tuple(r)[1:] for r in summary_by(df, "ds", F.col("w"), F.col("t")).collect()}
    assert got == {"a": (2, 2, 2, 1, 1), "?": (1, 1, 0, 0, 0), "all": (3, 2, 2, 1, None)}


def test_principal_directions(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 3)) * [5, 1, 0.1] + 7
    df = spark.createDataFrame([([float(v) for v in r],) for r in x], "v array<double>").repartition(3)
    got = principal_directions(df, "v", 2)
    _, want = np.linalg.eigh(np.cov(x.T))
    assert np.allclose(np.abs(got), np.abs(want[:, ::-1][:, :2].T), atol=1e-6)
    assert principal_directions(df.limit(0), "v", 2).size == 0


def test_stream_counts_files_in_no_order_of_time(spark, tmp_path):
    from inkatlas.streaming.events import run_window_counts

    # Forty files, the newest day first: more batches than one, and each later file lies far before the first.
    for k in range(40):
        day = f"2024-{3 - k // 20:02d}-{20 - k % 20:02d}"
        one = spark.createDataFrame([(f"{day} 10:00:00", "a", 1.0), (f"{day} 12:00:00", "b", 2.0)], "ts string, event_type string, value double")
        one.selectExpr("cast(ts as timestamp_ntz) ts", "event_type", "value").coalesce(1).write.mode("append").parquet(str(tmp_path / "events.parquet"))
    got = run_window_counts(spark, str(tmp_path / "events.parquet")).collect()
    assert len(got) == 80 and {(r["event_type"], r["n"], r["total"]) for r in got} == {("a", 1, 1.0), ("b", 1, 2.0)}
