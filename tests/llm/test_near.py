import random
import re

import numpy as np

from sextant.llm.near import near_duplicates, super_minhash


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    if 0 < len(w) < 5:
        return {tuple(w)}
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute(rows):
    sets = {i: shingles(t) for i, t in rows}
    up = {i: i for i in sets}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                p, q = sorted((find(i), find(j)))
                up[q] = p
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def run(spark, rows, schema="doc_id long, text string"):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(spark.createDataFrame(rows, schema)).collect()}


def test_against_brute_force(spark):
    rnd = random.Random(5)
    rows, i = [], 0
    for _ in range(12):
        base = [f"W{rnd.randrange(3000)}" for _ in range(rnd.randrange(3, 300))]
        for _ in range(rnd.randrange(1, 14)):
            w = list(base)
            for _ in range(rnd.randrange(0, 1 + len(w) // 20)):
                w[rnd.randrange(len(w))] = f"n{rnd.randrange(99)}"
            rows.append((i, (" ".join(w)).lower() if rnd.random() < 0.5 else "\n".join(w)))
            i += 1
    chain = [f"c{k}" for k in range(300)]
    rows += [(500 + k, " ".join(chain[6 * k : 6 * k + 200])) for k in range(16)]
    rows += [(900, None), (901, ""), (902, "one two"), (903, "ONE  two"), (904, "one two three"), (905, " \n")]
    assert run(spark, rows) == brute(rows)


def test_edges(spark):
    assert run(spark, []) == {}
    assert run(spark, [(None, "a", 1), (1, "a", 1), (1, "a", 1)], "doc_id long, text string, kept int") == {1: (1, 1, True)}


def test_signature_estimates_similarity():
    rnd = np.random.default_rng(1)
    for share in (0.2, 0.75):
        common, own = int(400 * share), 400 - int(400 * share)
        e = rnd.integers(0, 1 << 63, common + own, dtype=np.uint64)
        a, b = e[: common + own // 2], np.append(e[:common], e[common + own // 2 :])
        h = super_minhash(np.append(a, b), np.array([0, len(a), len(a) + len(b)]), 200)
        assert abs((h[0] == h[1]).mean() - common / 400) < 0.12
        assert (np.sort(h[0] >> np.uint64(32)) <= 20).all()


def test_outsiders_of_a_star(spark):
    """Members that miss the centre but are linked with each other, by common additions or as
    parts of the centre, and many that are linked with nothing."""
    rnd = random.Random(8)
    base = [f"b{k}" for k in range(200)]
    rows = [(0, " ".join(base))]
    for i in range(1, 80):
        w = list(base)
        for k in rnd.sample(range(200), rnd.randrange(1, 10)):
            w[k] = f"x{i}_{k}"
        rows.append((i, " ".join(w)))
    tail = [f"t{k}" for k in range(60)]
    for i in range(80, 100):
        rows.append((i, " ".join(base[:150] + tail[: 50 + i % 10] + [f"y{i}"])))
    for i in range(100, 120):
        rows.append((i, " ".join(base[: rnd.randrange(110, 146)])))
    want = brute(rows)
    assert len({c for _, c, _ in want.values()}) > 5
    assert run(spark, rows) == want


def test_fillings_of_one_template(spark, monkeypatch):
    """Hundreds of documents that share a frame and lie just below the threshold: few pairs are
    looked at beyond those with a centre, and none is lost."""
    from sextant.llm import near

    looked = []
    meet = near._meet

    def counted(members, percent):
        pairs = near.cut(meet(members, percent))
        looked.append(pairs.select("a", "b").distinct().count())
        return pairs

    monkeypatch.setattr(near, "_meet", counted)
    rnd = random.Random(11)
    base = [f"b{k}" for k in range(300)]
    rows = []
    for i in range(500):
        w = list(base)
        for k in rnd.sample(range(300), 9):
            w[k] = f"x{i}_{k}"
        rows.append((i, " ".join(w)))
    for i in range(500, 520):  # linked with one another through what only they share
        w = list(base)
        w[40:110] = [f"s{k}" for k in range(70)]
        w[rnd.randrange(200, 300)] = f"y{i}"
        w[rnd.randrange(0, 40)] = f"z{i}"
        rows.append((i, " ".join(w)))
    want = brute(rows)
    assert run(spark, rows) == want and len({c for _, c, _ in want.values()}) > 400
    assert sum(looked) <= len(rows)


def test_very_long_text(spark):
    rnd = random.Random(3)
    long = [f"v{rnd.randrange(50_000)}" for _ in range(200_000)]
    near = list(long)
    near[1000:1040] = ["new"] * 40
    rows = [(1, " ".join(long)), (2, " ".join(near)), (3, "a b c d e f"), (4, " ".join(long[:100_000]))]
    assert run(spark, rows) == brute(rows)


def test_oracle(spark, same):
    from sextant.llm.queries import ORACLES, QUERIES

    sf = "/root/testdata/sf0.001"
    same(QUERIES["op4_minhash_near_dedup"](spark, sf), ORACLES["op4_minhash_near_dedup"], sf_dir=sf)


def test_a_third_in_one_band_and_one_class(spark, monkeypatch):
    """A third of all documents are copies of one text, another third are near it: the keys they share
    are dealt out, and the result stays."""
    from sextant.operators import graph

    monkeypatch.setattr(graph, "HUB", 20)
    rnd = random.Random(12)
    base = [f"w{rnd.randrange(500)}" for _ in range(120)]
    rows = [(i, " ".join(base)) for i in range(100)]
    for i in range(100, 200):
        w = list(base)
        w[rnd.randrange(120)] = f"own{i}"
        rows.append((i, " ".join(w)))
    rows += [(i, " ".join(f"x{rnd.randrange(500)}" for _ in range(60))) for i in range(200, 290)] + [(290, None), (291, "")]
    got = {r.doc_id: (r.component_id, r.kept) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: (0, i == 0) if i < 200 else (i, True) for i, _ in rows}
