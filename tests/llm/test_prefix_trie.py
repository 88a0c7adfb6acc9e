import hashlib
import random
import re
from binascii import crc32
from collections import defaultdict

from sextant.llm import prefix_trie as M

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, r or "", x or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(own):
        h = crc32(str(c).encode()) % 4
        path = own.get(c - int(c / 20) * 0 - (abs(c) % 20) * (1 if c >= 0 else -1), [])[:h] + own[c][h:]
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
        ends[tuple(path)].append(c)
    words = lambda p: len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
    kids, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for p in members:
        if p:
            kids[p[:-1]] += 1
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in kids
            saved[p[:d]] += (len(m) - 1) * words(p)
    digest = lambda p: hashlib.sha256(",".join(map(str, ends.get(p, []))).encode()).hexdigest()
    return sorted(((m[0], len(p), members[p[:-1]][0] if p else None, len(m), kids.get(p, 0), leaves[p], saved[p], digest(p)) for p, m in members.items()), key=repr)


def run(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as depth", "'k' as ka", "2 as base", "'n' as node")
    return sorted((tuple(r[c] for c in COLUMNS) for r in M.prefix_trie(df).collect()), key=repr)


def talks(seed, n=70, most=9):
    rnd = random.Random(seed)
    rows = []
    for c in rnd.sample(range(200), n):
        for t in range(rnd.randrange(1, most)):
            rows.append((c, t, rnd.choice(["user", "assistant", None]), rnd.choice(["", None, "a", "a b", " c\td\x0be ", "é ü"])))
    return rows


def test_against_brute_force(spark):
    for seed in (1, 2):
        rows = talks(seed)
        assert run(spark, rows) == brute(rows)


def test_edges(spark):
    """Negative ids, absent bases, turns without a number, ties and repeated rows, no id."""
    rows = talks(3, 30) + [(-c - 1, t, r, x) for c, t, r, x in talks(4, 30)]
    rows += [(None, 1, "user", "x"), (61, None, "user", "b"), (61, None, "user", "a"), (61, None, "user", "a"), (61, 0, None, None), (1001, 0, "user", "only"), (1002, 0, "user", "only"), (1003, 7, "user", "only"), (1004, -5, "user", "x"), (1004, -2000, "user", "y")]
    rows += [(80, 5, "user", "b"), (80, 5, "user", "a"), (80, 5, "assistant", "z"), (81, 5, "user", "b" * 30_000)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []


def test_long_and_common(spark, monkeypatch):
    """Conversations cut into many chunks, and a third of all that are equal."""
    monkeypatch.setattr(M, "CHUNK", 4)
    monkeypatch.setattr(M, "IDS", 8)
    rows = talks(5, 30, 40)
    for c in range(300, 400):
        rows += [(c, 3 * t, "user", f"t {t}") for t in range(7)]
    rows += [(400, t, "user", "same") for t in range(150)] + [(401, t + 10, "user", "same") for t in range(150)] + [(420, t, "user", "same") for t in range(30, 170)]
    assert run(spark, rows) == brute(rows)
