import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from sextant.operators import central as C
from sextant.operators import graph as G
from sextant.operators import metrics as M


def reach(n, edges):
    out = {v: set() for v in range(n)}
    for a, b in edges:
        out[a].add(b)
    seen = {}
    for v in range(n):
        todo, got = list(out[v]), set()
        while todo:
            x = todo.pop()
            if x not in got:
                got.add(x)
                todo += out[x]
        seen[v] = got
    return seen


def frames(spark, n, edges):
    return spark.createDataFrame(edges or [], "src long, dst long"), spark.createDataFrame([(i,) for i in range(n)], "id long")


CASES = [(6, [(0, 1), (1, 2), (2, 0), (2, 3), (3, 4), (4, 3), (4, 5)]), (3, [])]
for seed in (1, 2):
    rnd = random.Random(seed)
    CASES.append((14, sorted({(a, b) for a, b in ((rnd.randrange(14), rnd.randrange(14)) for _ in range(20)) if a != b})))


def components(n, edges):
    """node -> least member of its strongly connected component, by depth-first search twice."""
    out, back = {v: [] for v in range(n)}, {v: [] for v in range(n)}
    for a, b in edges:
        out[a].append(b)
        back[b].append(a)
    order, seen = [], set()
    for root in range(n):
        stack = [(root, iter(out[root]))] if root not in seen else []
        seen.add(root)
        while stack:
            node, rest = stack[-1]
            nxt = next((x for x in rest if x not in seen), None)
            if nxt is None:
                order.append(stack.pop()[0])
            else:
                seen.add(nxt)
                stack.append((nxt, iter(out[nxt])))
    name = {}
    for root in reversed(order):
        if root not in name:
            group, todo = {root}, [root]
            while todo:
                new = {x for x in back[todo.pop()] if x not in name} - group
                group |= new
                todo += new
            name |= dict.fromkeys(group, min(group))
    return name


@pytest.mark.parametrize("case", range(len(CASES)))
def test_components_and_reach(spark, case):
    n, edges = CASES[case]
    e, v = frames(spark, n, edges)
    far = reach(n, edges)
    found = G.scc(e, v)
    assert {r.id: r.component for r in found.collect()} == components(n, edges) == {x: min([x, *(y for y in far[x] if x in far[y])]) for x in range(n)}
    assert {r.id: r.reach for r in G.reach_counts(e, found).collect()} == {x: len(far[x] - {x}) for x in range(n)}


def test_components_of_many_batches(spark, monkeypatch):
    """Two pivots a part, one trimmed layer: many batches, parts and rounds; keys of more than five
    rows are dealt out."""
    monkeypatch.setattr(G, "SLOTS", 2)
    monkeypatch.setattr(G, "TRIM", 1)
    monkeypatch.setattr(G, "HUB", 5)
    rnd = random.Random(7)
    n = 90
    edges = {(k, k + 1 if (k + 1) % 6 else k - 5) for k in range(60)} | {(a, b) for a, b in ((rnd.randrange(n), rnd.randrange(n)) for _ in range(70)) if a < b}
    e, v = frames(spark, n, sorted(edges))
    found = G.scc(e, v)
    want = components(n, edges)
    assert {r.id: r.component for r in found.collect()} == want and len(set(want.values())) > 20
    monkeypatch.setattr(G, "ROWS", 25)
    far = reach(n, edges)
    assert {r.id: r.reach for r in G.reach_counts(e, found).collect()} == {x: len(far[x] - {x}) for x in range(n)}


def test_reach_over_many_bitmaps(spark):
    """0 -> 1 -> 2 -> a component of all others: three bitmaps, one at a time."""
    n = 80_000
    e = spark.createDataFrame([(0, 1), (1, 2), (2, 3)], "src long, dst long")
    found = spark.range(n).selectExpr("id", "least(id, 3L) as component")
    got = G.reach_counts(e, found, buckets=1).groupBy("reach").agg({"id": "count"}).collect()
    assert {tuple(r) for r in got} == {(n - 1, 1), (n - 2, 1), (n - 3, 1), (n - 4, n - 3)}


def test_connected(spark, monkeypatch):
    rnd = random.Random(3)
    edges = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(45)] + [(100 + k, 101 + k) for k in range(40)] + [(7, 7), (200, 200)]
    name = {x: x for e in edges for x in e}
    while True:
        new = dict(name)
        for a, b in edges:
            new[a] = new[b] = min(new[a], new[b])
        if new == name:
            break
        name = new
    e = spark.createDataFrame(edges, "src long, dst long")
    assert {r.id: r.component for r in G.connected(e).collect()} == name
    monkeypatch.setattr(G, "HUB", 3)
    assert {r.id: r.component for r in G.connected(e).collect()} == name


@pytest.fixture
def sixteen(spark):
    conf = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def test_hub_is_dealt_out(spark, sixteen):
    """A star of a million leaves: its centre is one key, and no task joins more than a small part."""
    leaves = spark.range(1, 1_000_001).selectExpr("id as src", "0L as dst")
    table = leaves.groupBy("dst").agg({"src": "count"}).toDF("dst", "n")
    parts = G.matched(leaves, table, ["dst"], "n", "src").selectExpr("spark_partition_id() as p").groupBy("p").count().collect()
    assert len(parts) > 4 and sum(r["count"] for r in parts) == 1_000_000 and max(r["count"] for r in parts) < 500_000
    assert G.connected(leaves).filter("component <> 0").isEmpty()


def brandes(nodes, edges):
    out = {v: [] for v in nodes}
    for a, b in edges:
        out[a].append(b)
    score = dict.fromkeys(nodes, 0.0)

    def dist(s):
        d, q = {s: 0}, [s]
        for x in q:
            for y in out[x]:
                if y not in d:
                    d[y] = d[x] + 1
                    q.append(y)
        return d

    d = {s: dist(s) for s in nodes}

    def paths(s, t):
        return 1 if s == t else sum(paths(s, x) for x in nodes if t in out[x] and x in d[s] and d[s][x] + 1 == d[s][t])

    for s in nodes:
        for t in d[s]:
            for m in nodes:
                if s != t and m not in (s, t) and m in d[s] and t in d[m] and d[s][m] + d[m][t] == d[s][t]:
                    score[m] += paths(s, m) * paths(m, t) / paths(s, t)
    return score


@pytest.mark.parametrize("sizes", [{}, {"part": 3, "width": 4, "batch": 2}, {"part": 5, "width": 2, "batch": 1}])
def test_betweenness(spark, sizes):
    star = [(a, 0) for a in (1, 2, 3)] + [(0, a) for a in (1, 2, 3)]
    e, v = frames(spark, 4, star)
    assert {r.id: r.betweenness for r in C.betweenness(e, v, **sizes).collect()} == {0: 6.0, 1: 0.0, 2: 0.0, 3: 0.0}
    n, edges = CASES[2]
    e, v = frames(spark, n, edges)
    want = brandes(range(n), edges)
    assert {r.id: pytest.approx(r.betweenness) for r in C.betweenness(e, v, **sizes).collect()} == want
    assert C.betweenness(e, v.limit(0), **sizes).collect() == []


def test_bfs_core_degrees(spark):
    n, edges = CASES[0]
    e, v = frames(spark, n, edges)
    roots = spark.createDataFrame([(0, 0)], "root long, id long")
    assert {r.id: r.depth for r in G.bfs(e, roots).collect()} == {0: 0, 1: 1, 2: 2, 3: 3, 4: 4, 5: 5}
    assert max(r.depth for r in G.bfs(e, roots, 2).collect()) == 2
    assert {r.id for r in G.core(G.scc(e, v)).collect()} == {0, 1, 2}
    assert {(r.id, r.fan_out, r.fan_in) for r in G.degrees(e, v).collect()} == {(0, 1, 1), (1, 1, 1), (2, 2, 1), (3, 1, 2), (4, 2, 1), (5, 0, 1)}
    assert {r.id: r.component for r in G.connected(e.filter("src <> 2")).collect()} == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 3}


def test_betweenness_writes_no_states(spark, monkeypatch):
    """A ring, whose searches take a level per node: what is written does not grow with levels and
    sources."""
    written, real = [], C.cut
    monkeypatch.setattr(C, "cut", lambda df, *a: written.append(df) or real(df, *a))
    n = 30
    e, v = frames(spark, n, [(k, (k + 1) % n) for k in range(n)])
    assert {r.id: r.betweenness for r in C.betweenness(e, v, part=7, width=4, batch=2).collect()} == dict.fromkeys(range(n), (n - 1) * (n - 2) / 2)
    assert len(written) <= 5


def test_connected_runs_its_edges_once(spark):
    n = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            n.add(batch.num_rows)
            yield batch

    e = spark.createDataFrame([(i, i // 2) for i in range(1, 50)] + [(60, 60), (71, 70)], "src long, dst long").mapInArrow(counted, "src long, dst long")
    got = {r.id: r.component for r in G.connected(e).collect()}
    assert got == {i: 0 for i in range(50)} | {60: 60, 70: 70, 71: 70}
    assert n.value == 51


def cells_of(tmp_path, edges, n, part, most, files):
    """The edges as cells in some files, by where they start."""
    folder = tmp_path / f"cells{len(list(tmp_path.iterdir()))}"
    folder.mkdir()
    ends = np.array(sorted(edges))
    for k, some in enumerate(np.array_split(np.arange(n), files)):
        u, w = ends[np.isin(ends[:, 0], some)].T
        rows = list(C._packed(part, most)(pa.RecordBatch.from_pydict({"u": u[i : i + 3], "w": w[i : i + 3]}) for i in range(0, len(u), 3)))
        assert sum(len(r["to"][0].as_py()) for r in rows) == 4 * len(u) and all(len(r["to"][0].as_py()) <= 4 * most for r in rows)
        pq.write_table(pa.Table.from_batches(rows), folder / f"{k}.parquet")
    return C.Cells(f"file://{folder}", 1, 1, n)


@pytest.mark.parametrize("read", [0, 16 << 20])
def test_betweenness_of_split_rows(tmp_path, monkeypatch, read):
    """Cells of two edges at most, so rows go on in the next one; each source searches from its own side."""
    monkeypatch.setattr(C, "READ", read)
    rnd = random.Random(5)
    n = 12
    edges = {(a, b) for a, b in ((rnd.randrange(n), rnd.randrange(n)) for _ in range(60)) if a != b}
    out, into = cells_of(tmp_path, edges, n, 4, 2, 3), cells_of(tmp_path, {(b, a) for a, b in edges}, n, 4, 2, 3)
    got = sum(C._block(out, into, n, first, 5) for first in (0, 5, 10))
    assert list(got) == pytest.approx([brandes(range(n), edges)[x] for x in range(n)])


def test_search_reads_what_it_follows(tmp_path, monkeypatch):
    """A ring in ten files: a level of one source reads the file of its frontier alone."""
    monkeypatch.setattr(C, "READ", 0)
    n, files = 40, 10
    edges = {(k, (k + 1) % n) for k in range(n)}
    out, into = cells_of(tmp_path, edges, n, 4, 100, files), cells_of(tmp_path, {(b, a) for a, b in edges}, n, 4, 100, files)
    read, real = [], C.Cells._cells
    monkeypatch.setattr(C.Cells, "_cells", lambda self, path: read.append(path) or real(self, path))
    assert list(C._block(out, into, n, 0, 1)) == [0, *range(n - 2, -1, -1)]
    assert len(read) <= 2 * n + files


def test_break_points_run_their_edges_once(spark):
    n = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            n.add(batch.num_rows)
            yield batch

    ring = [(k, (k + 1) % 6) for k in range(6)] + [(0, 3)]
    e = spark.createDataFrame(ring, "src long, dst long").mapInArrow(counted, "src long, dst long")
    got = M.break_points(e, spark.range(6).select("id"), top=2).collect()
    want = brandes(range(6), ring)
    assert [(r.id, r.betweenness) for r in got] == sorted(((k, v) for k, v in want.items()), key=lambda x: (-x[1], x[0]))[:2]
    assert n.value == len(ring)
