"""Spelling variants by merging a trie of all words with one error.

Two words are near if one inserted, deleted or replaced character turns one into the other. Where
they part, at a node of the trie of all words, one of them goes down a child; merging that child's
subtree with its siblings' (a character replaced) or with the node's own (a character skipped) makes
the two end at the same place. Heavy-path decomposition keeps the merges small: at every node
only words below light children move (small-to-large, at most log2(words) moves a word), and they
look for their partner below the heavy child by name:

* replaced: the light words of a node meet under (node, rest), with node + heavy + rest;
* skipped: a light word looks for node + rest, and for the word with the heavy character put before
  its own; a word that ends at the node looks for node + heavy. A pair counts where the skipped
  character differs from the next one, so each pair is found once.

The sorted words are dealt into ranges, so a range holds whole subtrees but for the prefixes of its
first and last word. Of these open nodes each range reports how many words stand below each child,
and gets the heavy child over all ranges back; no row goes to one task per node. All that moves
then is merged by hash joins on strings: coinciding terminals.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sextant.llm._shared import cut, keyed

RANGE, MOD = 50_000, 97
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: stands for the replaced character; not a letter
_ANY = "*"


def corpus_words(docs: DataFrame, shortest: int = 5, often: int = 3, mod: int = MOD) -> DataFrame:
    """(word, n): runs of letters in lower case, one code point deleted where ``mod`` divides the
    crc32 of document and run; those of ``shortest`` code points that occur ``often`` times."""
    runs = F.explode(F.split(F.translate("text", _UPPER, _LOWER), "[^a-zÀ-ÿ]+"))
    rows = keyed(docs, "doc_id", "text").filter("text is not null").select("doc_id", runs.alias("run")).filter(F.length("run") >= shortest)
    rows = rows.withColumn("h", F.crc32(F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("run"))))
    word = F.expr(f"if(h % {mod} = 0, concat(substring(run, 1, cast(h % length(run) as int)), substring(run, cast(h % length(run) as int) + 2)), run)")
    return rows.select(word.alias("word")).filter(F.length("word") >= shortest).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= often)


def _names(word: str) -> list[bytes]:
    """A name of 128 bits for each prefix of ``word``."""
    state, out = hashlib.blake2b(digest_size=16), []
    out.append(state.digest())
    for c in word:
        state.update(c.encode())
        out.append(state.copy().digest())
    return out


def _common(a: str, b: str) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n - 1
    while low < high:
        mid = (low + high + 1) // 2
        if a[:mid] == b[:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def _open(table: pa.Table) -> pa.Table:
    """How many words of a range stand below each child of the prefixes of its first (side 0) and
    last word (side 1); child -1 with no word for the node itself."""
    words = sorted(table.column("word").to_pylist())
    shared = _common(words[0], words[-1])
    out: dict[tuple[int, int, int], int] = defaultdict(int)
    for side, end in enumerate((words[0], words[-1])):
        for depth in range(shared + 1 if side else 0, len(end) + 1):
            out[side, depth, -1] = 0
        below = np.zeros(len(end) + 1, np.int64)  # words by how much they share with ``end``
        for w in words:
            same = _common(w, end)
            below[same] += 1
            if same < len(w) and (same > shared or not side):
                out[side, same, ord(w[same])] += 1
        deeper = np.cumsum(below[::-1])[::-1]
        for depth in range(shared + 1 if side else 0, len(end)):
            out[side, depth, ord(end[depth])] = int(deeper[depth + 1])
    names = [_names(words[0]), _names(words[-1])]
    rows = [(s, d, c, n, names[s][d]) for (s, d, c), n in out.items()]
    part = table.column("part")[0].as_py()
    return pa.table([[part] * len(rows), *map(list, zip(*rows, strict=True))], schema=_OPEN)


_OPEN = pa.schema([("part", pa.int32()), ("side", pa.int32()), ("depth", pa.int32()), ("child", pa.int32()), ("n", pa.int64()), ("node", pa.binary())])
_MOVED = pa.schema([("merge", pa.string()), ("partner", pa.string()), ("word", pa.string()), ("n", pa.int64())])


def _merges(table: pa.Table, opened: pa.Table) -> pa.Table:
    """What the light words of a range send: (merge, partner, word, n), ``merge`` naming node and
    rest for a replaced character and null for a skipped one."""
    order = np.argsort(np.array(table.column("word").to_pylist(), object), kind="stable") if table.num_rows else []
    words = [table.column("word")[int(i)].as_py() for i in order]
    counts = table.column("n").to_numpy()[order].tolist() if len(words) else []
    n = len(words)
    length = np.array([len(w) for w in words])
    lcp = np.array([-1, *(_common(a, b) for a, b in zip(words, words[1:], strict=False))])
    heavy_at = {(s, d): c for s, d, c in zip(*(opened.column(c).to_pylist() for c in ("side", "depth", "heavy")), strict=True) if c >= 0}
    shared = _common(words[0], words[-1])
    depths = set(lcp[1:].tolist())
    for (side, d), c in heavy_at.items():
        end = words[-1] if side else words[0]
        if d == len(end) or ord(end[d]) != c:
            depths.add(d)
    out: tuple[list, list, list, list] = ([], [], [], [])

    def move(merge, partner, j):
        for to, x in zip(out, (merge, partner, words[j], counts[j]), strict=True):
            to.append(x)

    longest_open = max((d for _, d in heavy_at), default=-1)
    for d in sorted(depths):
        inside = (lcp >= d) | np.append(lcp[1:] >= d, False)
        if d <= longest_open:
            inside[[0, -1]] = True
        at = np.flatnonzero((length >= d) & inside)
        if not len(at):
            continue
        run = np.cumsum(np.append(True, (lcp[at[1:]] < d) | (np.diff(at) > 1)))
        child = np.array([ord(words[j][d]) if length[j] > d else -1 for j in at])
        new = np.append(True, (run[1:] != run[:-1]) | (child[1:] != child[:-1]))
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(at)))
        heavy: dict[int, tuple[int, int]] = {}
        for i, m in zip(first.tolist(), size.tolist(), strict=True):
            if child[i] >= 0 and (run[i] not in heavy or m > heavy[run[i]][0]):
                heavy[run[i]] = (m, int(child[i]))
        if at[0] == 0 and (0, d) in heavy_at:
            heavy[run[0]] = (0, heavy_at[0, d])
        if at[-1] == n - 1 and (1, d) in heavy_at:
            heavy[run[-1]] = (0, heavy_at[1, d])
        elif at[-1] == n - 1 and d <= shared and (0, d) in heavy_at:
            heavy[run[-1]] = (0, heavy_at[0, d])
        for j, r, c in zip(at.tolist(), run.tolist(), child.tolist(), strict=True):
            h = heavy.get(r)
            if h is None or h[1] == c:
                continue
            w, put = words[j], chr(h[1])
            node = w[:d]
            if c < 0:
                move(None, node + put, j)
                continue
            rest = w[d + 1 :]
            move(node + _ANY + rest, node + put + rest, j)
            move(None, node + put + w[d:], j)
            if not rest or rest[0] != w[d]:
                move(None, node + rest, j)
    return pa.table(list(out), schema=_MOVED)


def near_pairs(words: DataFrame, spread: int = RANGE) -> DataFrame:
    """(word, count, best): a row or more per word of ``words`` (word, n) that has near words. The counts
    of a word sum up to the number of its near words, and the least best, a struct of minus n and
    word, is the most frequent of them. Words are distinct and have no "*"."""
    n, letters = words.agg(F.count("*"), F.coalesce(F.sum(F.length("word")), F.lit(0))).first()
    parts = max(1, -(-n // spread), -(-letters // (16 * spread)))
    dealt = cut(words.repartitionByRange(parts, "word").select("word", "n", F.spark_partition_id().alias("part")))
    opened = cut(dealt.groupBy("part").applyInArrow(_open, "part int, side int, depth int, child int, n long, node binary"))
    heavy = opened.groupBy("node", "child").agg(F.sum("n").alias("n")).filter("child >= 0").groupBy("node").agg(F.max_by("child", F.struct("n", "child")).alias("heavy"))
    places = opened.filter("child = -1").select("part", "side", "depth", "node").join(heavy, "node").select("part", "side", "depth", "heavy")
    moved = cut(dealt.groupBy("part").cogroup(places.groupBy("part")).applyInArrow(_merges, "merge string, partner string, word string, n long"))

    name = lambda n, w: F.struct((-F.col(n)).alias("minus"), F.col(w).alias("word"))
    partner = words.select(F.col("word").alias("partner"), F.col("n").alias("partner_n"))
    skipped = moved.filter("merge is null").select("word", "n", "partner").join(partner, "partner")
    one = skipped.select("word", F.lit(1).cast("long").alias("count"), name("partner_n", "partner").alias("best"))
    other = skipped.select(F.col("partner").alias("word"), F.lit(1).cast("long").alias("count"), name("n", "word").alias("best"))

    # a node has a child per letter at most, so a merged place has no more words than letters exist
    groups = moved.filter("merge is not null").groupBy("merge", "partner").agg(F.collect_list(name("n", "word")).alias("members")).join(partner, "partner", "left")
    members = F.array_sort(F.when(F.col("partner_n").isNull(), F.col("members")).otherwise(F.array_append("members", name("partner_n", "partner"))))
    groups = groups.select(members.alias("members")).filter("size(members) > 1")
    replaced = groups.select(F.explode("members").alias("m"), (F.size("members") - 1).cast("long").alias("count"), F.col("members")[0].alias("top"), F.col("members")[1].alias("next"))
    replaced = replaced.select(F.col("m.word").alias("word"), "count", F.when(F.col("m") == F.col("top"), F.col("next")).otherwise(F.col("top")).alias("best"))
    return one.union(other).union(replaced)


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): where following forms ends. Each round goes one form further
    from the words without one; forms at least double in frequency, so there are few rounds."""
    front = cut(forms.filter("form is null").select("word", F.col("word").alias("root")))
    left, out = cut(forms.filter("form is not null").select("word", "form")), front
    while not front.isEmpty():
        front = cut(left.join(front.select(F.col("word").alias("form"), "root"), "form").select("word", "root"))
        out = out.union(front)
    return out


def spelling_variants(docs: DataFrame, shortest: int = 5, often: int = 3, factor: int = 2, mod: int = MOD, spread: int = RANGE) -> DataFrame:
    """(word, form, root, n, n_near, form_n): a word's form is its near word with the most
    occurrences (of equals the first in code-point order), if it has ``factor`` times as many as the word; its
    root is where forms lead.

    Defined results: a null or empty text has no word; rows with a null doc_id are left out; of
    rows that share a doc_id the one with the greatest text stays; words of any length are whole;
    an empty table gives no row; other columns are not read.
    """
    words = cut(corpus_words(docs, shortest, often, mod))
    near = near_pairs(words, spread).groupBy("word").agg(F.sum("count").alias("n_near"), F.min("best").alias("best"))
    found = words.join(near, "word", "left").withColumn("good", F.expr(f"-best.minus >= {factor} * n"))
    forms = cut(found.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.expr("if(good, best.word, null)").alias("form"), F.expr("if(good, -best.minus, null)").alias("form_n")))
    return forms.join(roots(forms), "word").select("word", "form", "root", "n", "n_near", "form_n")


ORACLE = r"""
WITH RECURSIVE tab AS (SELECT list_transform(range(256), lambda b: list_reduce(list_concat([b], range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))) AS t),
r AS (SELECT CAST(doc_id AS VARCHAR) AS d, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS w FROM documents),
o AS (SELECT d, w, count(*) AS n FROM r WHERE length(w) >= 5 GROUP BY d, w),
b AS (SELECT d, w, n, flatten(list_transform(string_split(d || ':' || w, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [CAST(unicode(c) AS BIGINT)] ELSE [CAST(192 + (unicode(c) >> 6) AS BIGINT), CAST(128 + (unicode(c) & 63) AS BIGINT)] END)) AS s FROM o),
h AS (SELECT w, n, xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], s), lambda x, c: xor(x >> 8, t[(xor(x, c) & 255) + 1]))) AS h FROM b, tab),
g AS (SELECT CASE WHEN h % 97 = 0 THEN substring(w, 1, CAST(h % length(w) AS INTEGER)) || substring(w, CAST(h % length(w) AS INTEGER) + 2) ELSE w END AS word, n FROM h),
v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM g WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
e AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v),
x AS (SELECT word, n, i, substring(word, 1, i - 1) AS p, substring(word, i + 1) AS s FROM e),
near AS (SELECT a.word, b.word AS other, b.n FROM x a JOIN x b ON a.p = b.p AND a.s = b.s AND a.word <> b.word
  UNION SELECT x.word, v.word, v.n FROM x JOIN v ON v.word = x.p || x.s UNION SELECT v.word, x.word, x.n FROM x JOIN v ON v.word = x.p || x.s),
best AS (SELECT word, count(*) AS n_near, min(struct_pack(a := -n, b := other)) AS top FROM near GROUP BY word),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN -top.a >= 2 * v.n THEN top.b END AS form, CASE WHEN -top.a >= 2 * v.n THEN -top.a END AS form_n FROM v LEFT JOIN best ON v.word = best.word),
z AS (SELECT word, word AS root FROM f WHERE form IS NULL UNION ALL SELECT f.word, z.root FROM f JOIN z ON f.form = z.word)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN z ON f.word = z.word
"""
