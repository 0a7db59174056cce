import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkatlas.llm import encoding as C
from inkatlas.llm import mixing as M
from inkatlas.llm.packing import CAPACITY, pack, pack_sizes
from inkatlas.llm.tokens import DEFAULT_VOCABULARY, load, with_tokens


def test_sizes_fill_containers():
    rng = np.random.default_rng(0)
    sizes = np.minimum(rng.lognormal(5, 1, 5000).astype(int) + 1, CAPACITY - 1)
    where = pack_sizes(sizes)
    load_ = np.bincount(where, sizes)
    assert (where >= 0).all() and load_.max() <= CAPACITY
    assert 1 - sizes.sum() / (len(load_) * CAPACITY) < 0.03
    squares = np.bincount(where, sizes.astype(float) ** 2)
    blind = np.bincount(np.random.default_rng(1).permutation(where), sizes.astype(float) ** 2)
    assert squares.std() < blind.std()
    assert pack_sizes(np.array([], int)).tolist() == [] and set(pack_sizes(np.full(4, CAPACITY - 1)).tolist()) == {0, 1, 2, 3}


def test_documents_are_packed_whole(spark):
    long = " ".join(f"word{i}" for i in range(2500))
    texts = [(1, "a short text"), (2, None), (3, ""), (4, long), (5, "x" * 200_000), (6, "a short text"), (6, "a short text"), (7, "\ud800".encode("utf-16", "surrogatepass").decode("utf-16", "replace"))]
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumn("container", F.lit("clash")).withColumn("tokens", F.lit(1))
    tokens = {r["id"]: r["tokens"] for r in with_tokens(df, "doc_id", "text").collect()}
    enc = load(DEFAULT_VOCABULARY)
    assert tokens[4] == len(enc.encode_ordinary(long)) and tokens[2] == tokens[3] == 0
    rows = pack(df, "doc_id", "text").collect()
    by, held = defaultdict(list), defaultdict(int)
    for r in rows:
        by[r["id"]].append(r)
        held[r["container"]] += r["tokens"]
    assert sum(r["tokens"] for r in by[4]) == tokens[4] and len(by[4]) == -(-tokens[4] // CAPACITY) > 1
    assert sorted(r["first_token"] for r in by[4]) == [i * CAPACITY for i in range(len(by[4]))]
    inside = defaultdict(list)
    for r in rows:
        if r["container"]:
            inside[r["container"]].append((r["place"], r["offset"], r["tokens"]))
    for parts in inside.values():
        parts.sort()
        assert [p for p, _, _ in parts] == list(range(len(parts))) and [o for _, o, _ in parts] == [sum(t for _, _, t in parts[:i]) for i in range(len(parts))]
    assert len(by[6]) == 2 and by[2][0]["container"] is None and all(v <= CAPACITY for k, v in held.items() if k)
    assert {r["id"] for r in rows if r["pieces"] > 1} == {k for k, v in tokens.items() if v > CAPACITY}
    assert pack(df.limit(0), "doc_id", "text").count() == 0


def test_texts_with_one_id_share_no_full_container(spark):
    long = " ".join(f"word{i}" for i in range(2500))
    rows = pack(spark.createDataFrame([(1, long)] * 5 + [(2, "short")], "doc_id long, text string"), "doc_id", "text").collect()
    held = defaultdict(int)
    for r in rows:
        held[r["container"]] += r["tokens"]
    assert max(held.values()) <= CAPACITY and len([c for c in held if c.startswith("full")]) == 5 * (rows[0]["pieces"] - 1)


@pytest.mark.parametrize("rate", [0.02, 0.3, 0.9])
def test_what_stays_open_is_small_for_heavy_tails(rate):
    for seed in range(40):
        sizes = np.maximum(1, (20 * np.random.default_rng(seed).pareto(1.1, 1500)).astype(int))
        sizes = np.minimum(sizes, int(sizes.sum() * min(rate, 1 - rate) / 4))  # one that is most of its source has no remedy
        p, left = M.pivotal(np.arange(1500), sizes, np.full(1500, rate), seed)
        want = rate * sizes.sum()
        taken = np.rint(p)  # the open record either way
        assert abs((taken * sizes).sum() - want) <= max(0.005 * want, sizes.min()), (seed, left)


def test_pivotal_keeps_the_weighted_sum_and_the_expectations():
    rng = np.random.default_rng(0)
    sizes, shares = rng.integers(1, 300, 400), rng.random(400)
    means = np.zeros(400)
    for seed in range(300):
        p, left = M.pivotal(np.arange(400), sizes, shares, seed)
        assert sum((p > 1e-6) & (p < 1 - 1e-6)) <= 1
        assert (p * sizes).sum() == pytest.approx((shares * sizes).sum(), rel=1e-6)
        means += p / 300
    assert abs(means - shares).mean() < 0.04
    assert M.pivotal(np.array([], int), np.array([]), np.array([]), 1)[1] == -1


@pytest.mark.parametrize("cell", [20_000, 40])
def test_mix_reaches_its_shares(spark, monkeypatch, cell):
    monkeypatch.setattr(M, "CELL_RECORDS", cell)
    monkeypatch.setattr(M, "FAN_IN", 4)
    rng = random.Random(2)
    rows = [(s, i, rng.randint(0, 400)) for i, s in enumerate(rng.choices(["A", "B", "C", None, "Z"], [60, 30, 1, 4, 5], k=4000))]
    records = spark.createDataFrame(rows, "source string, id long, tokens long")
    targets = spark.createDataFrame([("A", "a", 0.3, 2), ("B", "b", 0.5, 4), ("C", "c", 0.1, 2), ("Y", "y", 0.1, 3)], "source string, name string, target_share double, max_repeats int")
    whole = sum(t for _, _, t in rows)
    own = {s: sum(t for k, _, t in rows if k == s) for s in "ABC"}
    got = M.mix(records, targets).collect()
    assert len(got) == sum(r[0] in ("A", "B", "C") for r in rows) and len({r["id"] for r in got}) == len(got)
    most, sums = defaultdict(int), defaultdict(int)
    for r in got:
        most[r["source"]] = max(most[r["source"]], r["copies"])
        sums[r["source"]] += r["copies"] * r["tokens"]
    assert most["A"] <= 2 and most["B"] <= 4 and most["C"] == 2
    assert abs(sums["A"] / whole - 0.3) < 0.002 and abs(sums["B"] / whole - 0.5) < 0.002 and sums["C"] == 2 * own["C"]
    again = {(r["source"], r["id"]): r["copies"] for r in M.mix(records.repartition(5), targets).collect()}
    assert again == {(r["source"], r["id"]): r["copies"] for r in got}
    assert M.mix(records.limit(0), targets).count() == 0
    with pytest.raises(ValueError):
        M.mix(records, targets, "other")


SENTENCES = [
    "Für das schließende Maß wäre eine größere Prüfmenge nötig.", "Während der Prüfung fiel auf, dass die Ähnlichkeit genügt.", "La séance a été répétée parce que la liste était incomplète.",
    "Сеанс повторили, потому что толщина пера оказалась неполной.", "Η ομοιότητα ήταν μικρή, άρα το ζεύγος απορρίφθηκε.", "Uczniowie często zaczynają od góry, a długi ogonek kończą niżej.",
    "The pair was rejected — it’s far too narrow.", "The character “ζ” looks fine.", "Plain words only.",
]
CHAINS = [("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "cp437"), ("utf-8", "mac_roman"), ("utf-8", "cp1251"), ("utf-8", "cp1252", "utf-8", "cp1252")]


def test_chains_round_trip():
    for chain in C.chains_kept():
        for text in SENTENCES:
            garbled = C.garble(text, chain)
            back = C.ungarble(garbled, chain)
            if C._by_utf8(chain):
                assert back == (text, 0), (chain, text)
            elif back and "?" not in garbled and chain[1] != "utf-8" and "\x1a" not in garbled:
                assert back[0] == text or "?" in back[0]


def test_lost_characters_are_counted():
    garbled = C.garble("It “is” so", ("utf-8", "cp1252"), "mark")
    assert C.LOST in garbled and C.ungarble(garbled, ("utf-8", "cp1252")) == ("It “is� so", 1)
    assert C.ungarble("„Ã“", ("utf-8", "cp1252")) is None


def test_garbled_documents_are_found_and_restored(spark):
    clean = [(i, " ".join(SENTENCES[(i + j) % len(SENTENCES)] for j in range(4))) for i in range(80)]
    bad, origin = [], {}
    for k, chain in enumerate(CHAINS * 2):
        a, b = SENTENCES[k % 8], SENTENCES[(k + 3) % 8]
        origin[1000 + k] = f"{a} {b} {a}"
        bad.append((1000 + k, f"{a} {C.garble(b, chain)} {a}"))
    single = [(1100, C.garble(SENTENCES[3], ("cp1251", "koi8-r"))), (1101, C.garble(SENTENCES[0], ("cp1252", "cp437"))), (1102, C.garble(SENTENCES[4], ("cp1253", "cp1252")))]
    origin |= {1100: SENTENCES[3], 1101: SENTENCES[0], 1102: SENTENCES[4]}
    lost = [(1200, C.garble(SENTENCES[6] + " " + SENTENCES[7], ("utf-8", "cp1252"), "drop"))]
    sound = [
        (2000, "If you see Ã± instead of ñ, the reader has picked the wrong encoding."), (2001, "Test case 12 feeds “├º” and expects “ç” back."), (2002, "The replacement character � has its own glyph."),
        (2003, "╔═══════╗ ║ ░▒▓ ║ ╚═══════╝ was drawn as one box."), (2004, "The accents row reads À Á Â Ã Ä Å Æ Ç and then Ð Ñ Ò Ó Ô Õ Ö."), (2005, "Session 5 contains 3 attempts at “Ð”."), (2006, None), (2007, "   "), (2008, "∂ ∑ ∏ √ ∞ ≈ ≠ ≤ ≥ ◊ Ω π µ"),
    ]
    df = spark.createDataFrame(clean + bad + single + lost + sound, "doc_id long, text string").withColumn("word", F.lit("clash"))
    got = {r["id"]: r for r in C.repair(df, "doc_id", "text").collect()}
    assert set(got) == set(origin) | {1200}
    wrong = {k: got[k]["restored"] for k in origin if got[k]["restored"] != origin[k]}
    assert not wrong
    assert "it’s" in got[1200]["restored"] and got[1200]["lost"] <= 1
    assert C.repair(df.limit(0), "doc_id", "text").count() == 0


STRIPPED = ["À l’échelle 54, un carré reste tracé d’un seul geste.", "L’image de 32 × 32 points reste à droite, même après 7 essais.", "Ça ne change rien à l’index — ni à l’œil.", "On cite “l’index” plus loin."]


@pytest.mark.parametrize("read", ["latin-1", "iso8859-15"])
def test_stripped_bytes_are_restored_from_known_words(spark, read):
    clean = [(i, " ".join(STRIPPED)) for i in range(9)]
    strip = lambda t: "".join(c for c in t if not "\x7f" < c < "\xa0")
    bad = [(100 + i, strip(C.garble(t, ("utf-8", read)))) for i, t in enumerate(STRIPPED)] + [(200 + i, strip(C.garble(t, ("utf-8", read))).replace("\xa0", " ")) for i, t in enumerate(STRIPPED)]
    sound = [(300, "If you see Ã± instead of ñ, the reader is wrong."), (301, "Session 5 has 3 attempts at 'Ã'."), (302, "Île, château et Âge."), (303, "The rows read Ã and â and é.")]
    got = {r["id"]: r["restored"] for r in C.repair(spark.createDataFrame(clean + bad + sound, "doc_id long, text string"), "doc_id", "text").collect()}
    assert got == {i: STRIPPED[i % 100] for i, _ in bad}


def test_copies_of_garbled_texts_do_not_outvote_their_originals(spark):
    texts = {("cp1251", "koi8-r"): SENTENCES[3], ("cp1252", "cp437"): SENTENCES[0], ("cp1253", "cp1252"): SENTENCES[4], ("cp1250", "cp1252"): SENTENCES[5]}
    clean = [(i, t) for i, t in enumerate(texts.values())]
    bad = [(100 * (k + 1) + i, C.garble(t, chain) + (f" Copy {i}." if i > 20 else "")) for k, (chain, t) in enumerate(texts.items()) for i in range(40)]
    got = {r["id"]: r["restored"] for r in C.repair(spark.createDataFrame(clean + bad, "doc_id long, text string"), "doc_id", "text").collect()}
    assert set(got) == {i for i, _ in bad}
    assert all(got[i].startswith(list(texts.values())[i // 100 - 1]) for i in got)
