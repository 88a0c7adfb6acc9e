"""Graph operators on edge tables (src, dst).

Loops are DataFrame rounds that are written to the shared folder; a spent round is deleted. No graph
is too small for them: nothing is collected, broadcast or handed to one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sextant.plans.store import cut, drop

#: rows that a numbered range takes; bitmaps of 4 KB a component held at a time
ROWS, BUCKETS = 1 << 18, 8
#: rows of one key that go to one task, and copies of what more of them need
HUB, SALTS = 1 << 16, 64
#: pivots of a part, and layers trimmed before a batch
SLOTS, TRIM = 62, 4


def plain(edges: DataFrame) -> DataFrame:
    """Distinct edges without loops."""
    if getattr(edges, "settled", False):
        return edges
    return edges.select("src", "dst").filter("src <> dst").distinct()


def settled(edges: DataFrame) -> DataFrame:
    """Distinct edges without loops, written once for all steps that ask for such."""
    out = cut(plain(edges))
    out.settled = True
    return out


def reversed_edges(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def bfs(edges: DataFrame, roots: DataFrame, depth: int | None = None) -> DataFrame:
    """(root, id, depth): every node that is reached from ``roots`` (root, id) with its least
    depth, the roots at 0. Each round joins the frontier alone and drops what was seen."""
    seen = cut(roots.select("root", "id", F.lit(0).alias("depth")).distinct())
    if depth == 0 or seen.isEmpty():
        return seen
    if not hasattr(edges, "written"):
        edges = cut(edges.select("src", "dst").distinct())  # read in every round
    front, level = seen, 0
    while depth is None or level < depth:
        level += 1
        step = front.join(edges, front["id"] == edges["src"]).select("root", F.col("dst").alias("id")).distinct()
        front = cut(step.join(seen, ["root", "id"], "left_anti").withColumn("depth", F.lit(level)))
        if front.isEmpty():
            break
        seen = seen.union(front)
    return seen


def matched(rows: DataFrame, table: DataFrame, keys: list[str], weight: str, by: str) -> DataFrame:
    """``rows`` joined with ``table``, which has a row per key and in ``weight`` how many rows ask
    for it. What more than ``HUB`` rows ask for is copied ``SALTS`` times and those rows are dealt out
    by ``by``, so no key goes to one task."""
    hot = table.filter(F.col(weight) > HUB)
    if hot.isEmpty():
        return rows.join(table, keys)
    salt = F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")
    copies = hot.withColumns({"_hot": F.lit(True), "_salt": F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))})
    both = rows.withColumn("_salt", salt).join(copies.hint("merge"), [*keys, "_salt"], "left")
    columns = [*rows.columns, *(c for c in table.columns if c not in keys)]
    cold = both.filter("_hot is null").select(*rows.columns).join(table.filter(F.col(weight) <= HUB), keys)
    return both.filter("_hot").select(*columns).union(cold.select(*columns))


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One half round: each node u has the least of itself and its neighbours, and links those
    neighbours that are greater (``large``) or smaller than u with it."""
    pairs = edges.select(F.col("src").alias("u"), F.col("dst").alias("v"))
    if large:
        pairs = pairs.union(edges.select("dst", "src"))
    else:
        pairs = pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = cut(pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("low"), F.count("*").alias("n")))
    found = matched(pairs.filter("v > u") if large else pairs, low, ["u"], "n", "v")
    out = found.filter("v <> low").select(F.col("v").alias("src"), F.col("low").alias("dst"))
    if not large:
        out = out.union(low.filter("u <> low").select("u", "low"))
    out = cut(out.distinct())
    drop(low)
    return out


def connected(edges: DataFrame) -> DataFrame:
    """(id, component) of the undirected graph; a component is named by its least id.

    Large-star and small-star rounds by turns: every node hands its neighbours on to the least of
    them, until each component is a star around its least id; about log(nodes) rounds. A
    neighbourhood is only ever reduced to its minimum, never gathered, and the neighbours of a hub are dealt
    out over tasks.
    """
    # the edges may be a long plan: it runs once
    now = cut(edges.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct())
    nodes = cut(now.select(F.col("src").alias("id")).union(now.select("dst")).distinct())
    state = lambda e: tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("src", "dst")), F.bit_xor(F.xxhash64("dst", "src"))).first())
    path, now = now.written, now.filter("src <> dst")
    now.written = path
    before = state(now)
    while True:
        large = _star(now, True)
        new = _star(large, False)
        drop(large)
        drop(now)
        now, after = new, state(new)
        if after == before:
            return nodes.join(now.select(F.col("src").alias("id"), F.col("dst").alias("component")), "id", "left").select("id", F.coalesce("component", "id").alias("component"))
        before = after


def _trimmed(edges: DataFrame, rounds: int) -> DataFrame:
    """``edges`` (sub, src, dst) without nodes that have no edge in or none out, which are components of
    their own; at most ``rounds`` layers of them."""
    n = edges.count()
    for _ in range(rounds):
        if not n:
            break
        ends = edges.select(F.col("src").alias("id"), F.lit(1).alias("way")).union(edges.select("dst", F.lit(2))).groupBy("id").agg(F.bit_or("way").alias("ways"))
        inner = ends.filter("ways = 3").select("id")
        less = cut(edges.join(inner.withColumnRenamed("id", "src"), "src", "left_semi").join(inner.withColumnRenamed("id", "dst"), "dst", "left_semi").select("sub", "src", "dst"))
        drop(edges)
        edges, before, n = less, n, less.count()
        if n == before:
            break
    return edges


def scc(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """(id, component) for every vertex; a component is named by its least id.

    Forward and backward search from many pivots at once. Every part of the graph that may still hold
    components has up to ``SLOTS`` pivots, a bit each; a node carries two bitmaps, of the pivots that
    reach it and of those that it reaches, and a round passes them on along all edges. A node that
    shares a bit in both is in that pivot's component. All others can only be together with nodes of
    equal bitmaps, so these make the parts of the next batch and edges between parts go. Layers
    without an edge in or out are trimmed before each batch.

    A batch settles every pivot, and the first one starts from the nodes with most edges; it takes as
    many rounds as its longest shortest path from a pivot, and random pivots need about log(nodes)
    batches.
    """
    e = _trimmed(cut(plain(edges).select(F.lit(0).cast("long").alias("sub"), "src", "dst")), TRIM)
    done, batch = None, 0
    while not e.isEmpty():
        nodes = e.groupBy("sub", F.col("src").alias("id")).agg(F.count("*").alias("n")).union(e.groupBy("sub", "dst").agg(F.count("*"))).groupBy("sub", "id").agg(F.sum("n").alias("n"))
        slot = F.pmod(F.xxhash64(F.lit(batch), "id"), F.lit(SLOTS)).cast("int")
        rank = F.struct(F.col("n") if batch == 0 else F.xxhash64(F.lit(-batch), "id"), "id")
        pivots = nodes.groupBy("sub", slot.alias("slot")).agg(F.max_by("id", rank).alias("id"))
        start = nodes.join(pivots, ["sub", "id"], "left").withColumn("bit", F.coalesce(F.expr("shiftleft(1L, slot)"), F.lit(0).cast("long")))
        state = cut(start.select("sub", "id", F.col("bit").alias("f"), F.col("bit").alias("b"), (F.col("bit") != 0).alias("new")))
        both = cut(e.select(F.col("src").alias("id"), F.col("dst").alias("to"), F.lit(True).alias("on")).union(e.select("dst", "src", F.lit(False))))
        while True:
            front = state.filter("new").select("id", "f", "b")
            sent = both.join(front, "id").groupBy(F.col("to").alias("id")).agg(F.bit_or(F.expr("if(on, f, 0L)")).alias("mf"), F.bit_or(F.expr("if(on, 0L, b)")).alias("mb"))
            next_ = cut(state.join(sent, "id", "left").selectExpr("sub", "id", "f | coalesce(mf, 0L) f", "b | coalesce(mb, 0L) b", "coalesce(f | mf <> f or b | mb <> b, false) new"))
            drop(state)
            state = next_
            if state.filter("new").isEmpty():
                break
        drop(both)
        # the lowest shared bit names a component within its part
        hit = state.filter("f & b <> 0").selectExpr("sub", "id", "f & b & -(f & b) as low")
        names = cut(hit.groupBy("sub", "low").agg(F.min("id").alias("component"), F.count("*").alias("n")))
        named = cut(matched(hit, names, ["sub", "low"], "n", "id").select("id", "component"))
        done = named if done is None else done.union(named)
        rest = state.filter("f & b = 0").select("id", F.xxhash64("sub", "f", "b").alias("sub"))
        e_, old = e.select("src", "dst").join(rest.select(F.col("id").alias("src"), "sub"), "src").join(rest.select(F.col("id").alias("dst"), F.col("sub").alias("other")), "dst").filter("sub = other"), e
        e = cut(e_.select("sub", "src", "dst"))
        drop(old)
        drop(state)
        e, batch = _trimmed(e, TRIM), batch + 1
    every = vertices.select("id").distinct()
    if done is None:
        return every.select("id", F.col("id").alias("component"))
    return every.join(done, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def sizes(components: DataFrame) -> DataFrame:
    return components.groupBy("component").agg(F.count("id").alias("size"))


def numbered(rows: DataFrame, *order: Column | str, name: str = "no", weight: str | None = None) -> DataFrame:
    """``rows`` with their place, 1, 2, 3 ..., in ``order``, which must be total; with ``weight`` the
    sum of that column up to the row. Ranges add up by themselves; the driver sees one sum per range."""
    n = max(1, -(-rows.count() // ROWS))
    value = F.col(weight).cast("long") if weight else F.lit(1).cast("long")
    dealt = cut(rows.repartitionByRange(n, *order).withColumns({"_part": F.spark_partition_id(), "_value": value}))
    sums = {r["_part"]: r["n"] for r in dealt.groupBy("_part").agg(F.sum("_value").alias("n")).collect()}
    before, total = {}, 0
    for part in sorted(sums):
        before[part], total = total, total + sums[part]
    offset = rows.sparkSession.createDataFrame(list(before.items()), "_part int, _offset long")
    upto = F.sum("_value").over(Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return dealt.withColumn("_upto", upto).join(F.broadcast(offset), "_part").select(*rows.columns, (F.col("_upto") + F.col("_offset")).alias(name))


def levels(dag: DataFrame) -> list[DataFrame]:
    """The sources of an acyclic graph's edges by the length of their longest path: those that only
    lead to sinks, those that only lead to them and sinks, and so on; (id) each."""
    out, left = [], dag
    while not left.isEmpty():
        more = left.select(F.col("src").alias("dst")).distinct()
        rest = cut(left.join(more, "dst", "left_semi").select("src", "dst"))
        out.append(cut(left.select(F.col("src").alias("id")).distinct().join(rest.select(F.col("src").alias("id")), "id", "left_anti")))
        left = rest
    return out


def reach_counts(edges: DataFrame, components: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(id, reach): how many other nodes each node reaches.

    The closure is taken over components, as bitmaps of 32,768 numbered nodes: a component's set is
    its members' bits together with the sets of the components that it leads to, level by level from the
    sinks. No row stands for a pair of nodes. ``buckets`` bitmaps a component are held at a time.

    Components that nothing leads to are in no other's set, so they have no bits; those of them that lead to
    the same components reach the same, and one bitmap stands for them all (told apart by 128 bits).
    """
    of = lambda side: components.select(F.col("id").alias(side), F.col("component").alias(f"c_{side}"))
    dag = cut(plain(plain(edges).join(of("src"), "src").join(of("dst"), "dst").select(F.col("c_src").alias("src"), F.col("c_dst").alias("dst"))))
    size = sizes(components)
    if dag.isEmpty():
        return components.join(size, "component").select("id", (F.col("size") - 1).alias("reach"))
    outer = dag.join(dag.select(F.col("dst").alias("src")).distinct(), "src", "left_anti").groupBy(F.col("src").alias("component"))
    outer = cut(outer.agg(F.count("*").alias("n_out"), F.bit_xor(F.xxhash64(F.lit(1), "dst")).alias("h1"), F.bit_xor(F.xxhash64(F.lit(2), "dst")).alias("h2")))
    alike = ["n_out", "h1", "h2"]
    named = cut(outer.groupBy(*alike).agg(F.min("component").alias("first"), F.count("*").alias("asked")))
    of_first = cut(matched(outer, named, alike, "asked", "component").select("component", "first"))
    kept = cut(dag.join(of_first.filter("component <> first").select(F.col("component").alias("src")), "src", "left_anti"))
    steps = levels(kept)
    inner = components.join(of_first, "component", "left_anti")
    bits = numbered(inner.select("id").distinct(), "id").join(inner, "id")
    bits = cut(bits.select("component", F.bitmap_bucket_number("no").alias("bucket"), F.bitmap_bit_position("no").alias("bit")))
    last = bits.agg(F.max("bucket")).first()[0]
    total = None
    for low in range(1, last + 1, buckets):
        own = cut(bits.filter(F.col("bucket").between(low, low + buckets - 1)).groupBy("component", "bucket").agg(F.bitmap_construct_agg("bit").alias("bits")))
        sets = own.join(kept.select(F.col("src").alias("component")).distinct(), "component", "left_anti")
        for k, step in enumerate(steps):
            here = kept.join(step.withColumnRenamed("id", "src"), "src", "left_semi")
            far = here.join(sets.withColumnRenamed("component", "dst"), "dst").select(F.col("src").alias("component"), "bucket", "bits")
            mine = own.join(step.withColumnRenamed("id", "component"), "component", "left_semi")
            level = cut(far.union(mine).groupBy("component", "bucket").agg(F.bitmap_or_agg("bits").alias("bits")))
            sets = sets.union(level)
            if k % 16 == 15:
                sets = cut(sets)
        part = cut(sets.groupBy("component").agg(F.sum(F.bitmap_count("bits")).alias("n")))
        total = part if total is None else total.union(part)
    n = cut(total.groupBy("component").agg(F.sum("n").alias("n")))
    found = n.join(of_first, "component", "left_anti").select("component", (F.col("n") - 1).alias("others"), F.lit(0).cast("long").alias("own"))
    same = named.select("first", "asked").join(n.withColumnRenamed("component", "first"), "first")
    outside = matched(of_first, same, ["first"], "asked", "component").select("component", F.col("n").alias("others"), F.lit(1).cast("long").alias("own"))
    far = found.union(outside).join(size, "component").select("component", (F.col("others") + F.col("own") * (F.col("size") - 1)).alias("reach"), "size")
    return matched(components, far, ["component"], "size", "id").select("id", "reach")


def core(components: DataFrame) -> DataFrame:
    """(id) of the largest component of two or more nodes; of equals that with the least name."""
    top = sizes(components).filter("size > 1").orderBy(F.desc("size"), "component").limit(1)
    return components.join(F.broadcast(top.select("component")), "component", "left_semi").select("id")


def inside(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges with both ends in ``nodes`` (id)."""
    return plain(edges).join(nodes.withColumnRenamed("id", "src"), "src", "left_semi").join(nodes.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst")


def degrees(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """(id, fan_out, fan_in), zeros included."""
    e = plain(edges)
    out = e.groupBy(F.col("src").alias("id")).agg(F.count("dst").alias("fan_out"))
    back = e.groupBy(F.col("dst").alias("id")).agg(F.count("src").alias("fan_in"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return vertices.select("id").distinct().join(out, "id", "left").join(back, "id", "left").select("id", zero("fan_out"), zero("fan_in"))
