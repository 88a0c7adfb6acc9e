"""Prefix trie of conversations by family-first merging.

Conversations whose ids share a base (``conv_id - conv_id % family``) are a family. They are dealt
out by base, rebuilt there from the base's first turns and their own, and every task's partial
aggregate is the small trie of its families: only these combined nodes are shuffled and merged.

A node is named by the exclusive or of 128-bit hashes of (depth, role, text) over its turns, so the
name of every prefix is a running aggregate, and a long conversation can be cut into chunks of
``CHUNK`` turn numbers that go to different tasks: carries of chunk totals join them again.

Sums over subtrees need no walk by levels. Every node belongs to its smallest member, and the nodes
of a member m are those of its path from some depth s(m) on. So the distinct words below a node
u are the sum over its members m of the words of m's path from max(depth(u), s(m)) on, and the
leaves below u are the members that own a childless node: a second merge of the same paths.

The digest of a node's ended members is sequential by definition: sorted pieces of at most
``IDS`` consecutive ids are streamed through one hash per node, in bounded memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sextant.llm import _tokens as K
from sextant.llm._shared import cut, lean

CHUNK, IDS, SALTS = 1024, 4096, 16
_KEY = ["ka", "kb"]
_FIRST = -(1 << 62)  # the chunk of turns without a number, before all others


def _numbered(conversations: DataFrame, family: int) -> DataFrame:
    """(base, conv_id, chunk, local, a, b, w): the turns in order within their chunk, texts as hashes
    and word counts. Turns that share a number are ordered by role and text; only they carry
    their texts through the shuffle."""
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).filter("conv_id is not null")
    ties = rows.groupBy("conv_id", "turn").count().filter("count > 1").select("conv_id", F.col("turn").alias("tied_turn"), F.lit(True).alias("tied"))
    if ties.isEmpty():
        rows = rows.withColumns({"tie_role": F.lit(None).cast("string"), "tie_text": F.lit(None).cast("string")})
    else:
        ties = ties.withColumnRenamed("conv_id", "tied_id")
        rows = rows.join(ties, (F.col("conv_id") == F.col("tied_id")) & F.col("turn").eqNullSafe(F.col("tied_turn")), "left")
        rows = rows.withColumns({"tie_role": F.when(F.col("tied"), F.col("role")), "tie_text": F.when(F.col("tied"), F.col("text"))})
    rows = rows.select(
        F.expr(f"conv_id - conv_id % {family}").alias("base"), "conv_id", F.expr(f"coalesce(turn div {CHUNK}, {_FIRST})").alias("chunk"), "turn", "tie_role", "tie_text",
        F.xxhash64("role", "text").alias("a"), F.xxhash64(F.lit(1), "role", "text").alias("b"), F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("w"),
    )
    order = Window.partitionBy("base", "conv_id", "chunk").orderBy(F.col("turn").asc_nulls_first(), "tie_role", "tie_text")
    return rows.repartition("base", "chunk").select("base", "conv_id", "chunk", F.row_number().over(order).alias("local"), "a", "b", "w")


def _paths(turns: DataFrame, heads: int) -> DataFrame:
    """(base, conv_id, chunk, depth, ka, kb, pa, pb, w, upto, rest, ends): a row per rebuilt turn, the
    root at depth 0. ``upto`` counts the words down to the turn, ``rest`` those from it on."""
    part = ["base", "conv_id", "chunk"]
    chunks = turns.groupBy(*part).agg(F.count("*").alias("n"))
    own = Window.partitionBy("conv_id")
    before = own.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = cut(chunks.select(*part, "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"), F.sum("n").over(own).alias("n_turns")))

    first = turns.filter(f"conv_id = base and local < {heads}").join(chunks.select(*part, "before"), part)
    first = first.withColumn("place", F.col("before") + F.col("local")).filter(F.col("place") < heads)
    first = first.groupBy("base").agg(F.array_sort(F.collect_list(F.struct("place", "a", "b", "w"))).alias("head"))  # fewer than ``heads``
    family = chunks.join(first, "base", "left").withColumn("taken", F.crc32(F.col("conv_id").cast("string")) % heads)
    family = family.withColumn("head", F.slice(F.coalesce("head", F.expr("array()").cast("array<struct<place:bigint,a:bigint,b:bigint,w:bigint>>")), F.lit(1), F.col("taken").cast("int")))
    family = family.withColumn("length", F.expr("size(head) + greatest(0, n_turns - taken)"))
    family = family.select(*part, "before", "taken", "head", "length", (F.col("n") < F.col("n_turns")).alias("several"))

    rows = turns.join(family, part).withColumn("place", F.col("before") + F.col("local") - 1)
    turn = lambda depth, a, b, w: f"named_struct('depth', cast({depth} as bigint), 'a', {a}, 'b', {b}, 'w', {w})"
    kept = f"if(place >= taken, array({turn('size(head) + place - taken + 1', 'a', 'b', 'w')}), array())"
    start = f"if(place = 0, concat(array({turn(0, '0L', '0L', '0L')}), transform(head, (x, i) -> {turn('i + 1', 'x.a', 'x.b', 'x.w')})), array())"
    rows = rows.select(*part, "length", "several", F.inline(F.expr(f"concat({start}, {kept})")))
    rows = rows.withColumns({"za": F.expr("if(depth = 0, 0L, xxhash64(depth, a, b))"), "zb": F.expr("if(depth = 0, 0L, xxhash64(1, depth, b, a))")})

    total = rows.filter("several").groupBy(*part).agg(F.bit_xor("za").alias("xa"), F.bit_xor("zb").alias("xb"), F.sum("w").alias("xw"))
    carry = total.select(*part, *(F.coalesce(f(c).over(before), F.lit(0)).alias(f"c{c}") for f, c in ((F.bit_xor, "xa"), (F.bit_xor, "xb"), (F.sum, "xw"))), F.sum("xw").over(own).alias("all_words"))
    rows = rows.join(carry, part, "left").fillna(0, ["cxa", "cxb", "cxw"]).repartition("base", "chunk")
    here = Window.partitionBy(*part)
    upto = here.orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"ka": F.bit_xor("za").over(upto).bitwiseXOR(F.col("cxa")), "kb": F.bit_xor("zb").over(upto).bitwiseXOR(F.col("cxb")), "upto": F.sum("w").over(upto) + F.col("cxw"), "all_words": F.coalesce("all_words", F.sum("w").over(here))})
    return rows.select(*part, "depth", "ka", "kb", F.col("ka").bitwiseXOR(F.col("za")).alias("pa"), F.col("kb").bitwiseXOR(F.col("zb")).alias("pb"), "w", "upto", F.expr("all_words - upto + w").alias("rest"), (F.col("depth") == F.col("length")).alias("ends"))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One SHA-256 per node over its pieces, which come in order."""
    key, state = None, None
    for batch in batches:
        done = []
        for a, b, ids in zip(*(batch.column(c).to_pylist() for c in ("ka", "kb", "ids")), strict=True):
            if key != (a, b):
                if state:
                    done.append((*key, state.hexdigest()))
                key, state = (a, b), hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        if done:
            yield K.as_batch(ka=[d[0] for d in done], kb=[d[1] for d in done], ends_sha256=[d[2] for d in done])
    if state:
        yield K.as_batch(ka=[key[0]], kb=[key[1]], ends_sha256=[state.hexdigest()])


def prefix_trie(conversations: DataFrame, family: int = 20, heads: int = 4) -> DataFrame:
    """One row per distinct sequence of first turns: conv_id (smallest member), depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, and the node's
    own and its parent's name (node, parent).

    Conversation c starts with the first crc32(c) % ``heads`` turns of its base, its own turns
    after as many follow. Defined results: rows with a null conv_id are left out; a null turn
    comes first; turns that share a number are ordered by role and text, repeated rows are turns
    of their own; a null role or text is empty; a conversation without a rebuilt turn ends in the
    root; an empty table has no node; other columns are not read.
    """
    lean(conversations.sparkSession)
    paths = cut(_paths(cut(_numbered(conversations, family)), heads))
    nodes = paths.groupBy(*_KEY).agg(
        F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.count("*").alias("n_convs"), F.min("pa").alias("pa"), F.min("pb").alias("pb"), F.min(F.col("upto") - F.col("w")).alias("above"), F.sum("rest").alias("all_rest")
    )
    nodes = cut(nodes)
    kids = nodes.filter("depth > 0").groupBy(F.col("pa").alias("ka"), F.col("pb").alias("kb")).agg(F.count("*").alias("n_children"))
    nodes = cut(nodes.join(kids, _KEY, "left").fillna(0, ["n_children"]))

    # the owner of each node's path: where it starts, what stands above it, whether it ends in a leaf
    owners = cut(nodes.groupBy("conv_id").agg(F.min_by(F.struct("depth", "above", *_KEY, "pa", "pb"), "depth").alias("top"), F.max(F.expr("if(n_children = 0, 1L, 0L)")).alias("leaf")))
    of_chunks = paths.select("conv_id", "chunk").distinct().join(owners.select("conv_id", "top.above", "leaf"), "conv_id")
    below = paths.join(of_chunks, ["conv_id", "chunk"]).groupBy(*_KEY).agg(F.sum(F.expr("rest + (upto - w) - greatest(upto - w, above)")).alias("own_rest"), F.sum("leaf").alias("n_leaves"))

    # a path's first node hangs from a node of another path; nodes with many such children are dealt out
    tops = owners.select("top.*").filter("depth > 0").withColumn("salt", F.pmod(F.xxhash64(*_KEY), F.lit(SALTS)).cast("int"))
    above = nodes.filter("n_children > 0").select(F.col("ka").alias("pa"), F.col("kb").alias("pb"), F.col("conv_id").alias("parent_conv_id"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    tops = tops.join(above.hint("merge"), ["pa", "pb", "salt"]).select(*_KEY, "parent_conv_id")

    ends = paths.filter("ends").groupBy(*_KEY, F.expr(f"conv_id div {IDS}").alias("piece")).agg(F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))
    ends = ends.repartition(*_KEY).sortWithinPartitions(*_KEY, "piece").mapInArrow(_digests, "ka long, kb long, ends_sha256 string")
    out = nodes.join(below, _KEY).join(tops, _KEY, "left").join(ends, _KEY, "left")
    name = lambda a, b: F.format_string("%016x%016x", a, b)
    return out.select(
        "conv_id", "depth", F.expr("if(depth = 0, null, coalesce(parent_conv_id, conv_id))").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", (F.col("all_rest") - F.col("own_rest")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"), name("ka", "kb").alias("node"), F.when(F.col("depth") > 0, name("pa", "pb")).alias("parent"),
    )


#: crc32 of a string of ASCII characters, by eight shifts a byte
_CRC = """xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split({0}, ''), lambda c: CAST(ascii(c) AS BIGINT))),
  lambda r, v: list_reduce(list_concat([xor(r, v)], range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))))"""

ORACLE = rf"""
WITH RECURSIVE t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i, {{'role': coalesce(role, ''), 'text': coalesce(text, '')}} AS m
      FROM conversations WHERE conv_id IS NOT NULL),
l AS (SELECT c, list(m ORDER BY i) AS own FROM t GROUP BY c),
f AS (SELECT c, own, CAST({_CRC.format('CAST(c AS VARCHAR)')} % 4 AS INTEGER) AS h FROM l),
s AS (SELECT f.c, list_concat(CASE WHEN h = 0 THEN f.own[1:0] ELSE coalesce(b.own, f.own[1:0])[1:h] END, f.own[h + 1:]) AS q FROM f LEFT JOIN l b ON b.c = f.c - f.c % 20),
p AS (SELECT c, len(q) AS n, d, q[1:d] AS k, CASE WHEN d = 0 THEN 0 ELSE len(regexp_extract_all(q[d].text, '[^\x20\x09-\x0D]+')) END AS w FROM (SELECT c, q, unnest(range(0, len(q) + 1)) AS d FROM s)),
v AS (SELECT k, d, min(c) AS c, count(*) AS n, min(w) AS w, coalesce(string_agg(CASE WHEN n = d THEN CAST(c AS VARCHAR) END, ',' ORDER BY c), '') AS ends FROM p GROUP BY k, d),
e AS (SELECT x.k, x.d, count(y.k) AS kids, min(z.c) AS up FROM v x LEFT JOIN v y ON y.d = x.d + 1 AND y.k[1:x.d] = x.k LEFT JOIN v z ON z.d = x.d - 1 AND x.k[1:z.d] = z.k GROUP BY x.k, x.d),
u AS (SELECT k, d, k AS low FROM v UNION ALL SELECT k[1:d - 1], d - 1, low FROM u WHERE d > 0),
g AS (SELECT u.k, u.d, sum(CASE WHEN e.kids = 0 THEN 1 ELSE 0 END) AS leaves, sum((v.n - 1) * v.w) AS saved FROM u JOIN v ON v.k = u.low AND v.d = len(u.low) JOIN e ON e.k = u.low AND e.d = len(u.low) GROUP BY u.k, u.d)
SELECT v.c AS conv_id, CAST(v.d AS BIGINT) AS depth, CASE WHEN v.d > 0 THEN e.up END AS parent_conv_id, v.n AS n_convs, e.kids AS n_children, CAST(g.leaves AS BIGINT) AS n_leaves, CAST(g.saved AS BIGINT) AS saved_tokens, sha256(v.ends) AS ends_sha256
FROM v JOIN e ON e.k = v.k AND e.d = v.d JOIN g ON g.k = v.k AND g.d = v.d
"""
