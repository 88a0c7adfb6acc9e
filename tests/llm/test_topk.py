import math
import random

import pytest

from sextant.llm.topk import search


def brute(rows, k=20, every=20):
    ok = {}
    for i, v in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        if v is not None and all(x is not None and math.isfinite(x) for x in v):
            ok[i] = [math.floor(64 * x) for x in v]
    out = set()
    for q in ok:
        if q % every == 0:
            best = sorted((-sum(a * b for a, b in zip(ok[q], v)), i) for i, v in ok.items() if i != q)[:k]
            out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(best)}
    return out


def run(spark, rows, **more):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "vec_id as score", "1 as tile", "'x' as rank")
    return {tuple(r) for r in search(df, **more).collect()}


def vectors(seed, n, width=6):
    rnd = random.Random(seed)
    centres = [[rnd.gauss(0, 1) for _ in range(width)] for _ in range(5)]
    return [(i, [c + rnd.gauss(0, 0.1) for c in centres[i // 100 % 5]]) for i in range(n)]


def test_against_brute_force(spark):
    rows = vectors(1, 900)
    for tile in (None, 64, 300):
        assert run(spark, rows, tile=tile) == brute(rows)


def test_ties_and_copies(spark):
    """A third of all vectors are equal; small integers make many equal scores."""
    rnd = random.Random(2)
    rows = [(i, [0.5, 0.25] if i % 3 == 0 else [rnd.randrange(-3, 4) / 64, rnd.randrange(-3, 4) / 64]) for i in range(600)]
    for tile in (None, 50):
        assert run(spark, rows, tile=tile) == brute(rows)


def test_edges(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [1.0, 2.0]), (1, None), (2, [None, 1.0]), (20, [nan, 1.0]), (40, [inf, 0.0]), (60, []), (-20, [3.0]), (5, [-0.001, 0.0, 7.0]), (7, [1e-9, -1e-9]), (None, [1.0, 1.0])]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == set() and run(spark, [(0, [1.0])]) == set() and run(spark, [(1, [1.0]), (2, [2.0])]) == set()
    twice = [(0, [1.0]), (1, [2.0]), (1, [3.0]), (1, [3.0])]
    assert run(spark, twice) == {(0, 1, 1, 64 * 192)}


def test_wide_integers(spark):
    """Products beyond what doubles hold are exact, those beyond 64 bits an error."""
    rows = [(0, [2.0**25, 1.0, -3.0]), (1, [2.0**24 + 1, 2.0**20, 5.0]), (2, [2.0**24 + 1, 2.0**20 + 1, 5.0]), (3, [-(2.0**25), 0.0, 1 / 64])]
    assert run(spark, rows) == brute(rows)
    with pytest.raises(Exception, match="64 bits"):
        run(spark, [(0, [2.0**40]), (1, [2.0**40])])


def test_real_width(spark):
    rows = [(i, v * 8) for i, v in vectors(3, 1300)]
    assert run(spark, rows, k=3, tile=256) == brute(rows, k=3)
