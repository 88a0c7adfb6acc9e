import math
import random

import numpy as np

from sextant.llm import language as L


def test_forward_sums_all_segmentations():
    pieces = [L.MARK, "a", "b", "ab", L.MARK + "a", "ba", "bab"]
    table, rnd = L.Pieces(pieces), random.Random(1)
    p = np.array([[rnd.random() / 7 for _ in range(2)] for _ in pieces] + [[0, 0], [1e-3, 1e-3]])

    def plain(word, lang):
        if not word:
            return 1.0
        total = 0.0
        for k in range(1, len(word) + 1):
            q = p[pieces.index(word[:k]), lang] if word[:k] in pieces else 1e-3 if k == 1 else 0.0
            total += q * plain(word[k:], lang) if q else 0.0
        return total

    words = ["ab", "babab", "a", "xab", "b" * 7, "ab" * 5 + "z"]
    points = L._points("".join(L.MARK + w for w in words))
    length = np.array([len(w) + 1 for w in words])
    got = np.empty((len(words), 2))
    for part, graph in L.lattices(points, np.cumsum(length) - length, length, table):
        got[part] = graph.logs(p)
    assert np.allclose(got, [[math.log(plain(L.MARK + w, k)) for k in (0, 1)] for w in words])


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.collect()}
    out = L.identify(docs).collect()
    held = [r for r in out if r.held_out]
    assert len(out) == len(truth) and 0 < len(held) < len(out)
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in out)


def test_edges(spark):
    schema = "doc_id long, text string, lang string, score int"
    rows = [(i, "the cat and the dog " * 5 if i % 2 else "le chat et le chien " * 5, "en" if i % 2 else "fr", 0) for i in range(40)]
    odd = [(100, None, "en", 0), (101, "", "en", 0), (102, "12 %% 7", None, 0), (103, "z" * 30_000 + " the dog and the cat", None, 0), (104, "THE DOG!", None, 0), (None, "the", "en", 0), (1, "a", "en", 0)]
    got = {r.doc_id: r for r in L.identify(spark.createDataFrame(rows + odd, schema)).collect()}
    assert len(got) == 45 and [got[i].lang_pred for i in (100, 101, 102)] == ["und"] * 3 and got[100].score == 0
    assert got[104].lang_pred == "en" and got[2].lang_pred == "fr"
    assert L.identify(spark.createDataFrame([], schema)).collect() == []
    assert {r.lang_pred for r in L.identify(spark.createDataFrame([(1, "word", None, 0)], schema)).collect()} == {"und"}
    swapped = spark.createDataFrame([(i, t, "fr" if i == 3 else lang, s) for i, t, lang, s in rows], schema)  # a held-out label is never read
    assert [r.held_out for r in L.identify(swapped).filter("doc_id = 3").collect()] in ([True], [False])


def test_long_pieces_count():
    pieces = L.vocabulary()
    assert len(pieces) == 22_240 and max(len(p.removeprefix(L.MARK)) for p in pieces) == 15
    word = next(p for p in pieces if len(p) == 15 and p[0] != L.MARK)
    pieces, table = [L.MARK, word], L.Pieces([L.MARK, word])
    p = np.array([[0.5], [0.25], [0], [1e-7]])
    points = L._points(L.MARK + word)
    (_, graph), = L.lattices(points, np.array([0]), np.array([16]), table)
    assert np.isclose(graph.logs(p)[0, 0], math.log(0.5 * 0.25))


def test_expected_uses_against_all_segmentations():
    pieces = [L.MARK, "a", "b", "ab", L.MARK + "a", "ba", "bab"]
    table, rnd = L.Pieces(pieces), random.Random(5)
    p = np.array([[rnd.random() / 7] for _ in pieces] + [[0.0], [1e-3]])

    def ways(word):
        if not word:
            yield 1.0, []
        for k in range(1, len(word) + 1):
            i = pieces.index(word[:k]) if word[:k] in pieces else len(pieces) + 1 if k == 1 else None
            if i is not None:
                yield from ((p[i, 0] * q, [i, *rest]) for q, rest in ways(word[k:]))

    words, weight = ["ab", "babab", "a", "xab", "ab" * 5 + "z", "b" * 9], np.array([1.0, 2, 3, 1, 5, 1])
    want = np.zeros(len(p))
    for w, n in zip(words, weight):
        found = list(ways(L.MARK + w))
        total = sum(q for q, _ in found)
        for q, used in found:
            for i in used:
                want[i] += n * q / total
    points = L._points("".join(L.MARK + w for w in words))
    length = np.array([len(w) + 1 for w in words])
    got = sum(g.expected(p, weight[part]) for part, g in L.lattices(points, np.cumsum(length) - length, length, table))
    assert np.allclose(got, want)


def test_expected_uses_of_very_long_words():
    pieces = [L.MARK, "a", "b"]
    table, p = L.Pieces(pieces), np.array([[0.2], [0.5], [1e-6], [0.0], [1e-7]])
    word = "ab" * 4000 + "z"
    (part, graph), = L.lattices(L._points(L.MARK + word), np.array([0]), np.array([len(word) + 1]), table)
    assert np.allclose(graph.expected(p, np.ones(1)), [1, 4000, 4000, 0, 1])


def test_posterior_against_plain_version(spark):
    """Training and prediction of the query on a few documents, word by word in plain Python."""
    rows = [(i, ("der hund und die katze " if i % 2 else "the dog and the cat ") * (1 + i % 3), "de" if i % 2 else "en") for i in range(30)]
    rows += [(100, "the katze", None), (101, "hund and cat the", None), (102, "und und the", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    langs, table, p = L.train(df, sample=1000)
    names = L.vocabulary()
    at = {piece: i for i, piece in enumerate(names)}

    def score(word, q):
        a = [1.0] + [0.0] * len(word)
        for i in range(1, len(word) + 1):
            for k in range(1, i + 1):
                piece = word[i - k : i]
                a[i] += a[i - k] * (q[at[piece]] if piece in at else L.UNKNOWN if k == 1 else 0.0)
        return a[-1]

    for r in L.identify(df, sample=1000).collect():
        text = dict((i, t) for i, t, _ in rows)[r.doc_id]
        logs = [sum(math.log(score(L.MARK + w, p[:, k])) for w in text.split()) for k in range(len(langs))]
        best = max(range(len(langs)), key=logs.__getitem__)
        assert r.lang_pred == langs[best] and math.isclose(r.score, 1 / sum(math.exp(x - logs[best]) for x in logs), rel_tol=1e-6)


def test_dirty_labels_are_bounded(spark):
    rows = [(i, "some words here", "en" if i % 3 else f"bad{i}") for i in range(60)]
    langs, _, p = L.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), languages=3)
    assert len(langs) == 3 == p.shape[1] and "en" in langs
