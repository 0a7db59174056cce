import numpy as np
import pytest
from pyspark.sql import functions as F

from inkatlas.operators import augment as A
from inkatlas.operators import network as K
from inkatlas.operators.evaluation import hash_sample, smallest_within
from inkatlas.sources.ucd import command_table


def plain(layers, image):
    x, saved = image[None].astype(float), []
    for la in layers:
        if la.kind == K.CONV:
            o, per, k, _ = la.weight.shape
            p = np.pad(x, ((0, 0), (k // 2, k // 2), (k // 2, k // 2)))
            h, w = (p.shape[1] - k) // la.stride + 1, (p.shape[2] - k) // la.stride + 1
            out = np.zeros((o, h, w))
            for f in range(o):
                g = f // (o // la.groups)
                for i in range(h):
                    for j in range(w):
                        patch = p[g * per : (g + 1) * per, i * la.stride : i * la.stride + k, j * la.stride : j * la.stride + k]
                        out[f, i, j] = (patch * la.weight[f]).sum() + la.bias[f]
            x = np.clip(out, 0, 6) if la.clipped else out
        elif la.kind == K.SAVE:
            saved.append(x)
        elif la.kind == K.ADD:
            x = x + saved.pop()
        elif la.kind == K.MEAN:
            x = x.mean((1, 2))
        elif la.kind == K.LINEAR:
            x = la.weight @ x + la.bias
        else:
            x = x / np.linalg.norm(x)
    return x


def network():
    rng = np.random.default_rng(0)
    conv = lambda o, per, k, s, g, r: K.Layer(K.CONV, rng.normal(size=(o, per, k, k)), rng.normal(size=o), s, g, r)
    return [conv(4, 1, 3, 2, 1, True), K.Layer(K.SAVE), conv(4, 1, 3, 1, 4, False), conv(4, 4, 1, 1, 1, False), K.Layer(K.ADD), K.Layer(K.MEAN), K.Layer(K.LINEAR, rng.normal(size=(5, 4)), rng.normal(size=5)), K.Layer(K.UNIT)]


def test_network_file_and_forward_pass(spark):
    data = K.write_network(network(), 8)
    layers, side = K.read_network(data)
    again, _ = K.read_network(K.write_network(layers, 8))
    assert side == 8 and all(a.weight is None or np.allclose(a.weight, b.weight, atol=1e-6) for a, b in zip(layers, again))
    images = np.random.default_rng(1).random((3, 8, 8))
    got = K.encode(layers, images)
    assert np.allclose(got, [plain(layers, i) for i in images], atol=1e-5)
    for bad in (b"x" + data[1:], data[:4] + b"\x07\x00" + data[6:], data + b"\x00"):
        with pytest.raises(ValueError):
            K.read_network(bad)
    pixels = (images * 255).astype(np.uint8)
    df = spark.createDataFrame([(i, bytearray(p.tobytes())) for i, p in enumerate(pixels)] + [(9, None)], "id long, image binary")
    rows = {r["id"]: r["vector"] for r in K.embed(df, "id", data).collect()}
    assert set(rows) == {0, 1, 2} and np.allclose([rows[i] for i in range(3)], K.encode(layers, pixels / 255), atol=1e-5)


def test_variants_repeat_and_differ(spark):
    square = [np.array([[0, 0], [100, 0], [100, 50], [0, 50], [0, 0.0]]), np.array([[50, 25.0]]), np.array([[5, 5], [5, 5.0]])]
    a, b, c = A.variant(square, [1, 2]), A.variant(square, [1, 2]), A.variant(square, [1, 3])
    assert all((x == y).all() for x, y in zip(a, b)) and not all(x.shape == y.shape and (x == y).all() for x, y in zip(a, c))
    every = np.vstack(a)
    assert np.isfinite(every).all() and 0.5 < np.ptp(every, axis=0).max() < 1.8 and len(a) == 3 and len(a[1]) == 1
    steps = np.abs(np.diff(A.evened(np.array([0, 1, 1 + 1j]))))
    assert steps.max() < 0.0121 and abs(steps.sum() - 2) < 0.02
    schema = "row_id long, s array<array<struct<x: double, y: double>>>"
    df = spark.createDataFrame([(7, [[{"x": 0.0, "y": 0.0}, {"x": 5.0, "y": 9.0}]]), (8, None), (9, [])], schema)
    rows = [(r["id"], r["variant"]) for r in A.synthesize(df, "row_id", "s", 3).collect()]
    assert sorted(rows) == [(7, 0), (7, 1), (7, 2)]


def test_commands_of_characters(spark, tmp_path, rows):
    xml = '<unicode><character id="U03B1"><latex>\\alpha </latex><mathlatex set="unicode-math">\\upalpha</mathlatex></character><character id="U0041-00300"><latex>no</latex></character><character id="U2A74"><AMS>\\Colon eq</AMS><latex/></character></unicode>'
    (tmp_path / "u.xml").write_text(xml)
    assert rows(command_table(spark, str(tmp_path / "u.xml"))) == [("\\Coloneq", 0x2A74, False), ("\\alpha", 0x3B1, False), ("\\upalpha", 0x3B1, True)]


def test_choice_and_sample(spark, rows):
    options = spark.createDataFrame([(16, 0.4), (48, 0.495), (64, 0.49), (128, 0.5)], "dims int, top1 double")
    assert rows(smallest_within(options, "dims", "top1", 0.006)) == [(48, 0.495)]
    df = spark.range(100)
    assert rows(hash_sample(df, "id", 5)) == rows(hash_sample(df.repartition(7).orderBy(F.desc("id")), "id", 5))
