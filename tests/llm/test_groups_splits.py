import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from inkatlas.llm.components import connected_components
from inkatlas.llm.splits import QUARANTINE, extend_ledger, place, shared_key_links
from inkatlas.operators import skew


def brute_components(edges):
    of = {}

    def root(x):
        while of[x] != x:
            x = of[x]
        return x

    for a, b in edges:
        if a is None or b is None or a == b:
            continue
        for x in (a, b):
            of.setdefault(x, x)
        p, q = sorted((root(a), root(b)))
        of[q] = p
    return {x: root(x) for x in of}


SHAPES = {
    "empty": [],
    "nulls and loops": [(1, None), (None, 2), (3, 3), (4, 5), (5, 4), (4, 5)],
    "path": [(i, i + 1) for i in range(60)],
    "zigzag path": [(i * 37 % 101, (i + 1) * 37 % 101) for i in range(100)],
    "star": [(500, i) for i in range(200)],
    "random": None,
}


@pytest.mark.parametrize("shape", SHAPES)
def test_components_equal_union_find(spark, shape, monkeypatch):
    monkeypatch.setattr(skew, "HOT_ROWS", 20)
    rng = random.Random(5)
    edges = SHAPES[shape] if shape != "random" else [(rng.randrange(150), rng.randrange(150)) for _ in range(110)]
    df = spark.createDataFrame(edges, "first long, second long").withColumn("node", F.lit("clash"))
    got = {r["node"]: r["component"] for r in connected_components(df).collect()}
    assert got == brute_components(edges)


def test_shared_keys_link_without_pairs(spark):
    rows = [(1, "a", "p"), (2, "a", None), (3, None, "p"), (4, "b", None), (5, None, None)]
    df = spark.createDataFrame(rows, "k long, w string, p string")
    links = shared_key_links(df, "k", [F.col("w"), F.col("p")])
    assert links.count() == 2
    assert {r["node"]: r["component"] for r in connected_components(links).collect()} == {1: 1, 2: 1, 3: 1}


TARGETS = [("train", 0.8), ("validation", 0.1), ("test", 0.1)]


def test_units_fill_the_shares(spark):
    rng = random.Random(1)
    units = [(i, rng.choice([1, 1, 2, 5])) for i in range(3000)] + [(9001, 900), (9002, 400), (9003, 0)]
    targets = spark.createDataFrame(TARGETS, "split_name string, target_share double")
    df = spark.createDataFrame(units, "unit long, size long")
    got = place(df, targets).collect()
    assert len(got) == len(units)
    sums = Counter()
    for r in got:
        sums[r["split"]] += r["size"]
    total = sum(s for _, s in units)
    for name, share in TARGETS:
        assert abs(sums[name] / total - share) < 0.01
    assert sorted(map(tuple, got)) == sorted(map(tuple, place(df.repartition(3), targets).collect()))
    assert place(df.limit(0), targets).count() == 0


def test_ledger_keeps_fills_and_quarantines(spark):
    targets = spark.createDataFrame(TARGETS, "split_name string, target_share double")
    sizes = lambda rows: spark.createDataFrame(rows, "node long, size long")
    links = lambda rows: spark.createDataFrame(rows, "first long, second long")
    first = extend_ledger(None, links([(1, 2), (3, 4)]), sizes([(i, 10) for i in range(1, 201)]), targets)
    one = {r["node"]: r for r in first.collect()}
    assert len(one) == 200 and {r["status"] for r in one.values()} == {"new"}
    assert one[1]["split"] == one[2]["split"] and one[3]["component"] == one[4]["component"] == 3
    by = defaultdict(list)
    for n, r in one.items():
        if n > 4:
            by[r["split"]].append(n)
    a, b, c = by["train"][0], by["test"][0], by["train"][1]
    second = extend_ledger(first, links([(a, b), (c, 1000), (1001, 1002)]), sizes([(1000, 5), (1001, 5), (1002, None)]), targets)
    two = {r["node"]: r for r in second.collect()}
    assert len(two) == 203
    assert two[a]["split"] == two[b]["split"] == QUARANTINE and two[a]["status"] == "quarantined"
    assert two[1000]["split"] == "train" and two[1000]["status"] == "kept" and two[1001]["status"] == "new" and two[1001]["split"] == two[1002]["split"]
    assert all(two[n]["split"] == one[n]["split"] for n in one if n not in (a, b))
    third = {r["node"]: r["split"] for r in extend_ledger(second, links([]), sizes([]), targets).collect()}
    assert third == {n: r["split"] for n, r in two.items()}


def test_quarantined_records_get_their_splits_back(spark):
    from inkatlas.llm.splits import release

    targets = spark.createDataFrame(TARGETS, "split_name string, target_share double")
    sizes = lambda rows: spark.createDataFrame(rows, "node long, size long")
    links = lambda rows: spark.createDataFrame(rows, "first long, second long")
    first = extend_ledger(None, links([(1, 2), (3, 4)]), sizes([(i, 10) for i in range(1, 41)]), targets)
    one = {r["node"]: (r["component"], r["split"]) for r in first.collect()}
    a = next(n for n, (_, s) in one.items() if s == "train" and n > 4)
    b = next(n for n, (_, s) in one.items() if s != "train" and n > 4)
    second = extend_ledger(extend_ledger(first, links([(a, b), (b, 99)]), sizes([(99, 1)]), targets), links([]), sizes([]), targets)
    two = {r["node"]: r for r in second.collect()}
    assert two[a]["split"] == QUARANTINE and (two[a]["old_component"], two[a]["old_split"]) == one[a] and (two[b]["old_component"], two[b]["old_split"]) == one[b]
    back = {r["node"]: (r["component"], r["split"]) for r in extend_ledger(release(second, [min(a, b)]), links([]), sizes([]), targets).collect()}
    assert back == one


def test_ledger_is_kept_in_versions_at_its_path(spark, tmp_path):
    from inkatlas import storage
    from inkatlas.llm import splits as S

    path = f"file://{tmp_path}/ledger"
    targets = spark.createDataFrame(TARGETS, "split_name string, target_share double")
    sizes = lambda rows: spark.createDataFrame(rows, "node long, size long")
    links = lambda rows: spark.createDataFrame(rows, "first long, second long")
    assert S.read_ledger(spark, path) is None
    one = {r["node"]: r["split"] for r in S.extend_stored_ledger(path, links([(1, 2)]), sizes([(i, 1) for i in range(1, 30)]), targets).collect()}
    storage.clear(spark)
    two = {r["node"]: r for r in S.extend_stored_ledger(path, links([(2, 50)]), sizes([(50, 1)]), targets).collect()}
    assert len(S.ledger_versions(spark, path)) == 2
    assert all(two[n]["split"] == s for n, s in one.items()) and two[50]["component"] == 1 and two[50]["status"] == "kept"
    (tmp_path / "ledger" / "version=000000003").mkdir()  # a job that died while writing
    assert S.read_ledger(spark, path).count() == 30
