import hashlib
import random
import re

from sextant.llm.substring import doubled, strip_repeats


def brute(rows, window=20):
    seen, out = set(), {}
    for i, t in sorted((i, t) for i, t in rows):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            k = tuple(w[s : s + window])
            if k in seen:
                gone[s : s + window] = [True] * window
            seen.add(k)
        kept = [x for x, g in zip(w, gone) if not g]
        out[i] = (len(w), sum(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    return out


def run(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in strip_repeats(df).collect()}


def planted(seed):
    rnd = random.Random(seed)
    word = lambda: rnd.choice(["a", "b", "the", "of"]) if rnd.random() < 0.5 else f"w{rnd.randrange(400)}é"
    passage = [word() for _ in range(70)]
    rows = []
    for i in range(60):
        w = [word() for _ in range(rnd.randrange(1, 200))]
        if rnd.random() < 0.5:
            a = rnd.randrange(40)
            w[3:3] = passage[a : a + rnd.randrange(15, 60)]
        if rnd.random() < 0.2 and rows:
            w = rows[-1][1].split(" ")
            w[rnd.randrange(len(w))] = "new"
        rows.append((i, " ".join(w)))
    rows += [(100 + i, " ".join(passage)) for i in range(30)]
    rows += [(200, None), (201, ""), (202, " \t\n"), (203, "x " * 500), (204, "only one word " * 30), (205, "y\x0bz\x1c q " * 50)]
    return rows


def test_against_brute_force(spark):
    for seed in (1, 2):
        rows = planted(seed)
        assert run(spark, rows) == brute(rows)


def test_levels_and_hot_windows(spark, monkeypatch):
    """More levels, and every short window that is met twice dealt out by its run, change nothing."""
    from sextant.llm import substring

    rows = planted(4)
    frame = [f"f{k}" for k in range(120)]
    rnd = random.Random(4)
    for i in range(300, 380):
        w = list(frame)
        w[rnd.randrange(120)] = f"own{i}"
        rows.append((i, " ".join(w)))
    want = brute(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    hot = substring._hot
    for start, least in ((10, 2), (10, 16), (5, 16)):
        monkeypatch.setattr(substring, "_hot", lambda *a, n=least: hot(*a, least=n))
        assert len(substring._hot(df, 20, start)) > 0
        assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in strip_repeats(df, start=start).collect()} == want


def test_edges(spark):
    assert run(spark, []) == {}
    long = " ".join(f"t{i % 7001}" for i in range(60_000))
    rows = [(1, long), (2, "tail " + long)]
    assert run(spark, rows) == brute(rows)
    repeated = spark.createDataFrame([(None, "a b"), (3, "a b"), (3, "a b"), (3, None)], "doc_id long, text string")
    extra = repeated.selectExpr("doc_id", "text", "1 as runs", "2 as n_words", "'x' as key")
    assert [tuple(r)[:3] for r in strip_repeats(extra).collect()] == [(3, 2, 0)]


def test_doubling_until_nothing_survives(spark):
    rows = [r for r in planted(3) if r[1] is not None]
    passage = rows[-6][1]
    rows += [(300, "z1 " + passage + " z2 " + passage), (301, "q " * 300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.length, (x >> 32) + k) for r in doubled(df, start=5).collect() for x in r.ranges for k in range(x & 0xFFFFFFFF)}
    want, length = set(), 5
    while True:
        count, places = {}, {}
        for i, t in rows:
            w = re.findall(r"[^\x20\x09-\x0D]+", t)
            for s in range(len(w) - length + 1):
                k = tuple(w[s : s + length])
                count[k] = count.get(k, 0) + 1
                places[i, s] = k
        level = {(i, length, s) for (i, s), k in places.items() if count[k] > 1}
        if not level:
            break
        want |= level
        length *= 2
    assert length > 80 and got == want
    assert doubled(df.limit(0)).collect() == [] and {r.length for r in doubled(df, start=5, levels=2).collect()} == {5, 10}


def test_oracle(spark, same):
    from sextant.llm.queries import ORACLES, QUERIES

    sf = "/root/testdata/sf0.001"
    same(QUERIES["op1_substring_dedup"](spark, sf), ORACLES["op1_substring_dedup"], sf_dir=sf)
