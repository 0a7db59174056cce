import numpy as np
import pytest
from pyspark.sql import functions as F

from inkatlas.llm import neighbours as N


def brute(ids, x, k, least, asked=None):
    ok = np.array([v is not None and len(v) == 8 and all(e is not None and np.isfinite(e) for e in v) and any(v) for v in x])
    ids, x = np.asarray(ids)[ok], np.array([v for v, o in zip(x, ok) if o], float)
    order = np.argsort(ids)
    ids, x = ids[order], x[order]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T
    out = {}
    for i, q in enumerate(ids):
        if asked and not asked(q):
            continue
        best = sorted((-round(float(s[i, j]), 6), int(ids[j])) for j in range(len(ids)) if j != i)
        out[int(q)] = [j for d, j in best[:k] if -d >= least]
    return {q: v for q, v in out.items() if v}


def data(seed=0, n=400):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(40, 8))
    x = [[float(np.float32(e)) for e in centres[rng.integers(40)] + rng.normal(size=8) * 0.15] for _ in range(n)]
    x += [x[0]] * 9 + [x[1]] * 2 + [None, [1.0] * 7, [0.0] * 8, [float("nan")] + [1.0] * 7, [None] + [1.0] * 7, [float("inf")] * 8]
    x += [[50 * e for e in x[3]]]
    return list(range(100, 100 + len(x))), x


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["id"], r["rank"])):
        out.setdefault(r["id"], []).append(r["neighbour"])
    return out


def recall(got, want):
    return sum(len(set(got.get(q, [])) & set(v)) for q, v in want.items()) / sum(map(len, want.values()))


@pytest.mark.parametrize("cells", [(4_096, 16_384), (16, 32)])
def test_all_lists_asked_is_exact(spark, monkeypatch, cells):
    monkeypatch.setattr(N, "CELL_STORED", cells[0])
    monkeypatch.setattr(N, "CELL_ASKING", cells[1])
    monkeypatch.setattr(N, "EPSILON", 50.0)
    ids, x = data()
    df = spark.createDataFrame(list(zip(ids, x)), "vec_id long, e array<float>").withColumn("rep", F.lit("clash"))
    got = found(N.most_similar(df, "vec_id", "e", 8, 5, probes=99, lists=7))
    want = brute(ids, x, 5, -1)
    assert set(got) == set(want) and recall(got, want) > 0.995  # float32 ties aside
    assert got[100][:5] == [500, 501, 502, 503, 504] and got[500][:2] == [100, 501]


def test_default_probes_and_bounds(spark):
    ids, x = data(1, 1500)
    df = spark.createDataFrame(list(zip(ids, x)), "vec_id long, e array<float>")
    want = brute(ids, x, 5, 0.9)
    near = N.most_similar(df, "vec_id", "e", 8, 5, 0.9)
    got = found(near)
    assert recall(got, want) > 0.95
    assert near.agg(F.min("similarity")).first()[0] >= 0.9 - 1e-6
    asked = found(N.most_similar(df, "vec_id", "e", 8, 5, queries=F.col("id") % 50 == 0))
    assert set(asked) == {q for q in brute(ids, x, 5, -1) if q % 50 == 0}
    assert recall(asked, brute(ids, x, 5, -1, lambda q: q % 50 == 0)) > 0.9


def test_small_tables(spark):
    schema = "vec_id long, e array<float>"
    assert N.most_similar(spark.createDataFrame([], schema), "vec_id", "e", 8).count() == 0
    assert N.most_similar(spark.createDataFrame([(1, [1.0] * 8)], schema), "vec_id", "e", 8).count() == 0
    assert found(N.most_similar(spark.createDataFrame([(1, [1.0] * 8), (2, [1.0] * 8), (3, None)], schema), "vec_id", "e", 8)) == {1: [2], 2: [1]}


def test_probes_are_as_many_as_the_recall_needs():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 8)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    centres = N._centres(x, 60, 1)
    assert 50 <= len(centres) <= 70
    probes = N.probes_for(x, centres, 5, -1)
    s = x @ x.T
    np.fill_diagonal(s, -2)
    near = np.argsort(-s, axis=1)[:, :5]
    asked = np.argsort(-(x @ centres.T), axis=1)[:, :probes]
    of = (x @ centres.T).argmax(1)
    assert (of[near][:, :, None] == asked[:, None, :]).any(2).mean() > 0.95
    assert N.FEWEST <= N.probes_for(x, centres, 5, 0.99) <= probes < len(centres)
