import random
from collections import Counter

from sextant.llm.packing import best_fit, pack


def plain_best_fit(pieces, capacity, per_source):
    bins, out = [], []
    for size, source, cluster in pieces:
        fits = [(left, i) for i, (left, held) in enumerate(bins) if left >= size and all(c != cluster for _, c in held) and sum(s == source for s, _ in held) < per_source]
        if not fits:
            bins.append((capacity, []))
            fits = [(capacity, len(bins) - 1)]
        _, i = min(fits)
        left, held = bins[i]
        out.append((i, len(held)))
        bins[i] = (left - size, [*held, (source, cluster)])
    return out


def test_against_plain_search():
    rnd = random.Random(2)
    for _ in range(60):
        pieces = [(rnd.randrange(1, 60), 1 << rnd.randrange(3), 1 << rnd.choice([0, 0, *range(1, 30)])) for _ in range(80)]
        if rnd.random() < 0.5:
            pieces.sort(reverse=True)
        assert best_fit(pieces, 60, 3) == plain_best_fit(pieces, 60, 3)


def test_invariants(spark):
    rnd = random.Random(9)
    rows = [(i, f"s{rnd.choice([0, 0, 1, 2])}" if i % 11 else None, " ".join(f"w{rnd.randrange(9)}" for _ in range(rnd.randrange(0, 130)))) for i in range(300)]
    rows += [(1000 + i, "s0", "Same text  here" if i % 2 else "same TEXT\nhere") for i in range(60)] + [(2000, None, None), (2001, "s1", " "), (None, "s1", "x"), (3000, "s", "z"), (3000, "s", "z")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, source string, text string, shard int")
    out = pack(df, capacity=50, per_source=2, shard=100).collect()
    texts = {i: (t or "").split() for i, _, t in rows if i is not None}
    sources = {i: s for i, s, _ in rows}
    held = Counter()
    for i, words in texts.items():
        mine = sorted((r.piece, r.first_word, r.n_words) for r in out if r.doc_id == i)
        assert sum(n for _, _, n in mine) == len(words) and [f for _, f, _ in mine] == [50 * k for k in range(len(mine))]
    bins = {}
    for r in out:
        assert (r.bin is None) == (r.n_words == 0)
        if r.bin is not None:
            held[r.bin] += r.n_words
            bins.setdefault(r.bin, []).append(r)
    assert max(held.values()) <= 50
    for rs in bins.values():
        assert sorted(r.slot for r in rs) == list(range(len(rs)))
        assert max(Counter(sources[r.doc_id] for r in rs).values()) <= 2
        assert max(Counter(" ".join(texts[r.doc_id]).lower() for r in rs).values()) == 1
    assert pack(df.limit(0)).collect() == []


def test_really_long_text(spark):
    rows = [(1, "s", "word " * 300_000), (2, "s", "word " * 10), (3, "t", "x" * 1_000_000)]
    out = pack(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()
    assert sum(r.n_words for r in out if r.doc_id == 1) == 300_000 and max(r.n_words for r in out) == 4096
    assert [(r.n_words, r.slot) for r in out if r.doc_id == 3] == [(1, r.slot) for r in out if r.doc_id == 3] and len({(r.bin, r.slot) for r in out}) == len(out)
