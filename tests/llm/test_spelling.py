import random
import re
from binascii import crc32
from collections import Counter

from sextant.llm.spelling import near_pairs, roots, spelling_variants


def brute_words(rows):
    n = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = crc32(f"{i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(n):
    out = {}
    for w in n:
        some = [v for v in n if near(w, v)]
        best = min(some, key=lambda v: (-n[v], v), default=None)
        form = best if best is not None and n[best] >= 2 * n[w] else None
        out[w] = (form, n[w], len(some), n[form] if form else None)
    return out


def root(out, w):
    while out[w][0]:
        w = out[w][0]
    return w


def words(seed, size=220):
    rnd = random.Random(seed)
    some = {"".join(rnd.choice("abé") for _ in range(rnd.randrange(1, 7))) for _ in range(size)}
    some |= {"a" * k for k in range(1, 12)} | {"inter" + "".join(rnd.choice("xy") for _ in range(5)) for _ in range(60)}
    return {w: rnd.choice([1, 2, 3, 5, 8, 50]) for w in some}


def test_pairs_against_brute_force(spark):
    """Whole, and cut into ranges of any size, down to a word or two: open nodes on all sides."""
    for seed, spread in ((1, 50_000), (2, 40), (3, 7), (4, 2)):
        n = words(seed)
        df = spark.createDataFrame(list(n.items()), "word string, n long").repartition(3)
        got = {}
        for r in near_pairs(df, spread).collect():
            c, b = got.get(r["word"], (0, (0, "")))
            best = (r.best.minus, r.best.word)
            got[r["word"]] = (c + r["count"], min(b, best))
        want = {}
        for w in n:
            some = [v for v in n if near(w, v)]
            if some:
                want[w] = (len(some), min((-n[v], v) for v in some))
        assert got == want


def test_whole_query_against_brute_force(spark):
    rnd = random.Random(5)
    base = ["letter", "LETTER", "lettre", "letters", "better", "Öster", "öster", "äpfeln", "apfeln", "abcde", "naïveté", "naiveté", "aaaaa", "aaaaaa", "aaaaaaa"]
    rows = [(i, " ".join(rnd.choice(base) + rnd.choice(["", "", "s", ",", "1", "×"]) for _ in range(rnd.randrange(80)))) for i in range(150)]
    rows += [(500, None), (501, ""), (502, "x" * 40_000 + " " + "x" * 39_999), (503, "x" * 40_000 + " " + "x" * 40_000), (504, "x" * 40_000 + " " + "x" * 39_999 + " " + "x" * 39_999)]
    df = spark.createDataFrame([(i, t, i, "w", -1) for i, t in rows], "doc_id long, text string, n long, word string, best int")
    out = brute(brute_words(rows))
    got = {r.word: (r.form, r.n, r.n_near, r.form_n, r.root) for r in spelling_variants(df).collect()}
    assert got == {w: (*v, root(out, w)) for w, v in out.items()}
    assert any(v[2] for v in out.values())


def test_ids(spark):
    """Rows without an id are left out; of rows that share one the greatest text stays."""
    rows = [(None, "spelling spelling spelling"), (1, "another another another"), (1, "words words words"), (1, "words words words")]
    assert [(r.word, r.n) for r in spelling_variants(spark.createDataFrame(rows, "doc_id long, text string")).collect()] == [("words", 3)]


def test_roots_and_empty(spark):
    forms = [("a", "b"), ("b", "c"), ("c", None), ("d", "b"), ("e", None)]
    got = {r.word: r.root for r in roots(spark.createDataFrame(forms, "word string, form string")).collect()}
    assert got == {"a": "c", "b": "c", "c": "c", "d": "c", "e": "e"}
    empty = spelling_variants(spark.createDataFrame([], "doc_id long, text string"))
    assert empty.collect() == [] and empty.columns == ["word", "form", "root", "n", "n_near", "form_n"]
