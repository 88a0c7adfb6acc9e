import math
import random
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from sextant.llm import quality as Q
from sextant.llm.quality import classify


def corpus(n, seed=1):
    rnd = random.Random(seed)
    docs, labels, truth = [], [], {}
    for i in range(n):
        w = [f"w{rnd.randrange(400)}" for _ in range(rnd.randrange(20, 120))]
        kind = rnd.random()
        if kind < 0.15:
            w = [x + "###" for x in w]
        elif kind < 0.3:
            for _ in range(3):
                w[rnd.randrange(len(w))] = rnd.choice(["awful", "nasty"])
        docs.append((i, " ".join(w), "en", f"s{i % 3}", "x"))
        truth[i] = kind >= 0.3
        if i % 2:
            labels.append((i, int(kind >= 0.15), int(0.15 <= kind < 0.3)))
    return docs, labels, truth


DOCS, LABELS = "doc_id long, text string, lang string, source string, score string", "doc_id long, quality int, toxic int"


def test_held_out_accuracy(spark):
    docs, labels, truth = corpus(1200)
    out = classify(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)).collect()
    held = [r for r in out if r.doc_id % 2 == 0]
    assert len(out) == 1200 and np.mean([r.kept == truth[r.doc_id] for r in held]) > 0.97
    assert all(0 <= s <= 1 for r in out for s in (r.content_score, r.metadata_score, r.score))
    again = classify(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)).collect()
    assert sorted(out) == sorted(again)


def test_edges(spark):
    docs, labels, _ = corpus(200)
    odd = [(500, None, None, None, None), (501, "", "en", "s", "x"), (502, " \n", None, "s", "x"), (None, "a", "en", "s", "x"), (1, "zz", None, None, None), (503, "long " * 60_000, "en", "s", "x")]
    got = {r.doc_id: r for r in classify(spark.createDataFrame(docs + odd, DOCS), spark.createDataFrame(labels + labels + [(None, 1, 0), (900, 0, 1), (3, None, None)], LABELS)).collect()}
    assert set(got) == {d[0] for d in docs} | {500, 501, 502, 503}
    assert all(got[i].score == 0 and not got[i].kept for i in (500, 501, 502))
    none = spark.createDataFrame([], LABELS)
    assert all(r.kept and r.score == 1 for r in classify(spark.createDataFrame(docs, DOCS), none).collect())
    assert classify(spark.createDataFrame([], DOCS), spark.createDataFrame(labels, LABELS)).collect() == []
    one = spark.createDataFrame([(i, 1, 0) for i in range(100)], LABELS)
    assert all(r.score == 1 for r in classify(spark.createDataFrame(docs, DOCS), one).collect())


SPACES = re.compile(rb"[^\x20\x09-\x0D]+")


def tokens(text):
    low = re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())
    return low, SPACES.findall(low)


def holds(text):
    """What the content view sees: words, and their beginnings of 4 and 5 bytes."""
    return {x for w in tokens(text)[1] for x in (("word", w), (4, w[:4]), (5, w[:5]))}


def numbers(doc):
    """What the metadata view sees, value by value."""
    low, words = tokens(doc[1])
    n, size, lines = len(words), max(len(low), 1), low.count(b"\n") + 1
    share = lambda kind: sum(c in kind for c in low) / size
    triples = [tuple(words[i : i + 3]) for i in range(n - 2)]
    out = [
        math.log1p(n), math.log1p(lines), math.log1p(n / lines), sum(map(len, words)) / max(n, 1),
        share(b"#*$%&|<>{}\\^~=_@"), share(b"0123456789"), share(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
        sum(x == y for x, y in zip(words, words[1:])) / max(n, 1), len(set(triples)) / len(triples) if triples else 1.0, len(set(words)) / n if n else 1.0,
    ]
    places = [0.0] * 256
    places[zlib.crc32((doc[2] or "").encode()) % 128] = places[128 + zlib.crc32((doc[3] or "").encode()) % 128] = 1.0
    return out + places


def logistic(x, y, decay, rounds, divided):
    """Adam on the full batch: step 0.1, averages 0.9 and 0.99. ``decay`` is per weight, and divided by
    the number of rows or not."""
    w, m, v = np.zeros(x.shape[1]), 0, 0
    for t in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = (x.T @ (p - y) + decay * w) / len(y) if divided else x.T @ (p - y) / len(y) + decay * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w - 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return w


class PlainContent:
    """A head per reason, over the words whose chi-square with it is 30 at least."""

    def __init__(self, vocabulary, rows):
        self.heads = []
        for k in (0, 1):
            known = [(h, y[k]) for h, y in rows if y[k] is not None]
            if len({y for _, y in known}) < 2:
                continue
            y = np.array([y for _, y in known])
            chosen = []
            for word in sorted(vocabulary, key=repr):
                has = np.array([word in h for h, _ in known])
                a, b, c, d = (has & (y == 1)).sum(), (has & (y == 0)).sum(), (~has & (y == 1)).sum(), (~has & (y == 0)).sum()
                below = float(a + b) * (c + d) * (a + c) * (b + d)
                if has.sum() >= 5 and below and len(y) * float(a * d - b * c) ** 2 / below >= 30:
                    chosen.append(word)
            x = np.array([[*(float(w in h) for w in chosen), 1.0] for h, _ in known])
            self.heads.append((chosen, logistic(x, y, np.append(np.full(len(chosen), 0.02), 0.0), 300, True)))

    def logit(self, held):
        return min(sum(w[k] for k, word in enumerate(chosen) if word in held) + w[-1] for chosen, w in self.heads)


class PlainMetadata:
    def __init__(self, rows):
        x = np.array([r for r, _ in rows])
        self.mean, self.std = x.mean(axis=0), x.std(axis=0) + 1e-6
        self.w = logistic(np.array([self.wide(r) for r, _ in rows]), np.array([y for _, y in rows]), 1e-4, 400, False)

    def wide(self, row):
        z = np.clip((np.array(row) - self.mean) / self.std, -8, 8)
        return np.concatenate([z, z[:10] ** 2, [1.0]])

    def logit(self, row):
        return float(self.wide(row) @ self.w)


def plain(docs, labels, order, rounds, per_round):
    """Everything once more in plain Python: features as sets and values, heads, exchange, calibration;
    (content, metadata, combined) score of each document, and how many labels were exchanged."""
    judged = {i: (float(q == 1), float(not t)) for i, q, t in labels}
    held_by, meta = {d[0]: holds(d[1]) for d in docs}, {d[0]: numbers(d) for d in docs}
    often = Counter(x for i in order for x in held_by[i])
    vocabulary = {x for x, n in often.items() if n >= 5}
    train, rest = [i for k, i in enumerate(order) if k % 3 != 2], [i for k, i in enumerate(order) if k % 3 == 2]
    share = np.mean([min(judged[i]) for i in train])
    given = [{}, {}]
    for r in range(rounds + 1):
        content = PlainContent(vocabulary, [(held_by[i], judged[i]) for i in train] + [(held_by[i], (1.0, 1.0) if y else (0.0, None)) for i, y in given[0].items()])
        metadata = PlainMetadata([(meta[i], min(judged[i])) for i in train] + [(meta[i], y) for i, y in given[1].items()])
        logits = {d[0]: (content.logit(held_by[d[0]]), metadata.logit(meta[d[0]])) for d in docs}
        if r == rounds:
            break
        new = [{}, {}]
        for view in (0, 1):
            for sign, label, part in ((-1, 1.0, share), (1, 0.0, 1 - share)):
                sure = sorted((sign * x[view], i) for i, x in logits.items() if i not in judged and i not in given[1 - view] and sign * x[view] < -2 and sign * x[1 - view] < 0)
                new[view].update((i, label) for _, i in sure[: max(1, int(per_round * part))])
        given[1].update(new[0])
        given[0].update(new[1])
    clip = lambda i: [min(max(x, -8.0), 8.0) for x in logits[i]]
    both = lambda i: [*clip(i), min(clip(i))]
    y = np.array([min(judged[i]) for i in rest])
    views = [logistic(np.array([[clip(i)[k], 1.0] for i in rest]), y, 1e-4, 500, False) for k in (0, 1)]
    mixture = logistic(np.array([[*both(i), 1.0] for i in rest]), y, 1e-4, 500, False)
    squash = lambda z: 1 / (1 + math.exp(-min(max(z, -30), 30)))
    scores = {i: (*(squash(clip(i)[k] * views[k][0] + views[k][1]) for k in (0, 1)), squash(float(np.dot([*both(i), 1.0], mixture)))) for i in logits}
    return scores, [len(g) for g in given]


def test_all_scores_against_plain_python(spark):
    docs, labels, _ = corpus(420, seed=4)
    rnd = random.Random(9)
    docs = [(i, t.replace(" ", "\n", rnd.randrange(4)).title() if i % 5 else t, rnd.choice(["en", "ne", "de", None]), s, x) for i, t, _, s, x in docs]
    labels = [x for x in labels if x[0] % 3]
    d, l = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)
    order = [r.doc_id for r in l.orderBy(F.xxhash64("doc_id"), "doc_id").collect()]
    want, given = plain(docs, labels, order, 2, 40)
    assert min(given) > 20
    got = {r.doc_id: (r.content_score, r.metadata_score, r.score, r.kept) for r in classify(d, l, rounds=2, per_round=40).collect()}
    assert got.keys() == want.keys()
    for i, scores in want.items():
        assert np.allclose(got[i][:3], scores, rtol=1e-3, atol=1e-3), (i, got[i], scores)
        assert got[i][3] == (scores[2] >= 0.5) or abs(scores[2] - 0.5) < 1e-3


def test_surest_of_all_documents(spark):
    rnd = random.Random(2)
    rows = [(i, rnd.uniform(-6, 6), rnd.uniform(-6, 6)) for i in range(3000)]
    rows += [(3000 + i, 5.0, 1.0) for i in range(40)]  # ties
    scores = spark.createDataFrame(rows, "doc_id long, content double, metadata double")
    taken = [i for i, _, _ in rows if i % 7 == 0]
    for view in (0, 1):
        want = {}
        for sign, label, n in ((-1, 1.0, 30), (1, 0.0, 70)):
            sure = sorted((sign * r[1 + view], r[0]) for r in rows if r[0] not in taken and sign * r[1 + view] < -2 and sign * r[2 - view] < 0)
            want.update((i, label) for _, i in sure[:n])
        assert Q.surest(scores, view, 0.3, taken, 100) == want and len(want) == 100


def test_heads_hold_little_beside_the_documents():
    """Training copies neither all places nor a weight for each of them."""
    import tracemalloc

    r = np.random.default_rng(3)
    size, total = np.full(2000, 500), 20_000
    y = (np.arange(2000) % 2).astype(float)
    flat = np.concatenate([np.sort(r.choice(10_000, 500, False)) + (0 if good else 4000) for good in y]).astype(np.int32)
    docs = Q.Docs(flat, size)
    tracemalloc.start()
    try:
        head = Q.Head(total, docs, y)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 14 * len(flat)
    assert ((head.of(docs) > 0) == (y > 0)).mean() > 0.99


def test_the_driver_holds_no_features(spark):
    """The documents that the views learn from go to a task; the driver has their labels and the model."""
    import tracemalloc

    docs, labels, _ = corpus(3000, seed=6)
    docs = [(i, f"{t} {t[::-1]}", *rest) for i, t, *rest in docs]
    d, l = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)
    held = len(labels) * 266 * 8  # the metadata view's values alone
    tracemalloc.start()
    try:
        model, _ = Q.fit(d, l, rounds=1)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert isinstance(model, Q.CoTrained) and peak < held
