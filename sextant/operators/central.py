"""Betweenness of all nodes by Brandes' accumulation, for blocks of sources at a time.

Nodes are numbered, sources dealt into blocks. Edges are written once by where they start and once by where
they end, as cells of consecutive rows. A task takes some blocks, one after the other: its state has a row
for each source of the block and a column for each node (depth, number of shortest paths, dependency), and
each level streams the cells past it. Each source follows the edges of its own frontier only, from the
side that has fewer of them, and cells that no source asks for are not read. States are never written
or shuffled, as all of them together are a row for each pair of nodes; what leaves a task is one sum for
each node. A block is as wide as ``STATE`` bytes allow.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs, parquet
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sextant.operators.graph import numbered, plain
from sextant.plans.store import cut

#: rows of a cell, larger where more cells than that would have them, and edges; sources of a block, blocks of a core
PART, PARTS, EDGES, WIDTH, SPREAD = 4096, 16, 1 << 20, 256, 4
#: bytes of a block's state, and of it for a node and source; of cells that a task reads at once; edges followed at once
STATE, CELL, READ, STEP = 256 << 20, 29, 16 << 20, 1 << 17
#: edges of a run of rows from which on it is copied as a piece; nodes whose numbers are broadcast; edges that a task packs
RUN, SENT, DEALT = 24, 1 << 20, 1 << 20


def _packed(part: int, edges: int):
    """Edges that come sorted, as cells: a first row, where each row from it on starts, what its edges
    lead to. A row that is too long goes on in the next cell."""

    def cell(u: np.ndarray, w: np.ndarray) -> pa.RecordBatch:
        off = np.searchsorted(u, np.arange(u[0], u[-1] + 2)).astype(np.int32)
        return pa.RecordBatch.from_pydict({"first": pa.array(u[:1], pa.int32()), "off": [off.tobytes()], "to": [w.astype(np.int32).tobytes()]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def cells(last: bool) -> Iterator[pa.RecordBatch]:
            u, w = (np.concatenate([b.column(c).to_numpy() for b in held]) for c in ("u", "w"))
            at = 0
            while at < len(u):
                end = min(at + edges, int(np.searchsorted(u, u[at] + part)))
                if end == len(u) and not last:
                    break
                yield cell(u[at:end], w[at:end])
                at = end
            held[:] = [pa.RecordBatch.from_pydict({"u": u[at:], "w": w[at:]})]

        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= edges:
                yield from cells(False)
                size = held[0].num_rows
        if size:
            yield from cells(True)

    return run


class Cells:
    """A table of packed cells, read as often as asked; a small one is read once."""

    def __init__(self, folder: str, bytes_: int, largest: int, n: int):
        self.files, path = fs.FileSystem.from_uri(folder)
        found = self.files.get_file_info(fs.FileSelector(path))
        self.rows, self.degree, self.spans = max(1, min(1024, READ // max(largest, 1))), np.zeros(n, np.int64), {}
        for path in sorted(f.path for f in found if f.base_name.endswith(".parquet")):
            span = []
            for first, off in self._columns(path, "first", "off"):
                self.degree[first : first + len(off) - 1] += np.diff(off)
                span += [first, first + len(off) - 1]
            if span:
                self.spans[path] = min(span), max(span)
        self.kept = [c for path in self.spans for c in self._cells(path)] if bytes_ <= READ else None
        self.ends, self.values = np.empty(STEP, np.int64), np.empty(STEP)

    def _columns(self, path: str, *names: str) -> Iterator[tuple]:
        with self.files.open_input_file(path) as file:
            for batch in parquet.ParquetFile(file).iter_batches(self.rows, columns=list(names)):
                columns = [batch.column(c).to_pylist() if c == "first" else [np.frombuffer(x.as_buffer(), np.int32) for x in batch.column(c)] for c in names]
                yield from zip(*columns, strict=True)

    def _cells(self, path: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        for first, off, to in self._columns(path, "first", "off", "to"):
            yield first, off.astype(np.int64), to.astype(np.int64)

    def _read(self, asked: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """The cells, without files that have no row of ``asked``."""
        if self.kept is not None:
            yield from self.kept
            return
        for path, (first, end) in self.spans.items():
            if asked[first:end].any():
                yield from self._cells(path)

    def _followed(self, asked: np.ndarray, sources: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """For some rows of ``asked`` (source, row) at a time: the source, the rows, how many edges each has,
        and what these lead to."""
        for first, off, to in self._read(asked[sources].any(axis=0)):
            size = np.diff(off)
            for s in sources:
                rows = np.flatnonzero(asked[s, first : first + len(size)])
                rows = rows[size[rows] > 0]
                n = size[rows]
                upto = np.cumsum(n)
                at = 0
                while at < len(rows):
                    end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + STEP, "right")))
                    yield s, rows[at:end] + first, n[at:end], self._ends(rows[at:end], n[at:end], off, to)
                    at = end

    def _ends(self, rows: np.ndarray, n: np.ndarray, off: np.ndarray, to: np.ndarray) -> np.ndarray:
        """What the edges of ``rows`` lead to; consecutive rows are one piece."""
        gap = np.flatnonzero(np.diff(rows) != 1)
        total = int(n.sum())
        if total < RUN * (len(gap) + 1):
            return to[np.repeat(off[rows] - (np.cumsum(n) - n), n) + np.arange(total)]
        start, end = off[rows[np.append(0, gap + 1)]].tolist(), off[rows[np.append(gap, -1)] + 1].tolist()
        if len(start) == 1:
            return to[start[0] : end[0]]
        if total > len(self.ends):
            self.ends, self.values = np.empty(total, np.int64), np.empty(total)
        return np.concatenate([to[a:b] for a, b in zip(start, end, strict=True)], out=self.ends[:total])

    def push(self, asked: np.ndarray, sources: list[int], value: Callable[[int, np.ndarray], np.ndarray], total: np.ndarray) -> None:
        """Adds what the rows ``asked`` send along their edges to ``total`` where it arrives."""
        for s, rows, n, ends in self._followed(asked, sources) if sources else ():
            np.add.at(total[s], ends, np.repeat(value(s, rows), n))

    def pull(self, asked: np.ndarray, sources: list[int], value: np.ndarray, total: np.ndarray) -> None:
        """Adds for the rows ``asked`` what stands at the ends of their edges to ``total``."""
        for s, rows, n, ends in self._followed(asked, sources) if sources else ():
            found = value[s].take(ends, out=self.values[: len(ends)] if len(ends) <= len(self.values) else None, mode="clip")
            total[s, rows] += np.add.reduceat(found, np.cumsum(n) - n)


def _block(out: Cells, into: Cells, n: int, first: int, width: int) -> np.ndarray:
    """What ``width`` sources from ``first`` on add to each node; nothing for themselves."""
    width = min(width, n - first)
    depth, asked = np.full((width, n), -1, np.int32), np.zeros((width, n), bool)
    paths, work, share = np.zeros((width, n)), np.zeros((width, n)), np.zeros((width, n))
    own = np.arange(width)
    depth[own, first + own], paths[own, first + own] = 0, 1
    deepest, rest = np.zeros(width, int), into.degree.sum() - into.degree[first + own]
    level, live = 0, list(range(width))
    while live:
        push, pull = [], []
        for s in live:
            front = depth[s] == level
            if out.degree[front].sum() <= rest[s]:
                asked[s], work[s] = front, 0
                push.append(s)
            else:
                np.less(depth[s], 0, out=asked[s])
                np.multiply(paths[s], front, out=work[s])
                pull.append(s)
        out.push(asked, push, lambda s, rows: paths[s, rows], work)
        into.pull(asked, pull, work, paths)
        level, left = level + 1, live
        live, pushed = [], set(push)
        for s in left:
            new = np.flatnonzero(((work if s in pushed else paths)[s] > 0) & (depth[s] < 0))
            if len(new):
                if s in pushed:
                    paths[s, new] = work[s, new]
                depth[s, new] = level
                deepest[s] = level
                rest[s] -= into.degree[new].sum()
                if rest[s]:
                    live.append(s)
    for k in range(int(deepest.max()), 1, -1):
        push, pull = [], []
        for s in np.flatnonzero(deepest >= k).tolist():
            far, near = depth[s] == k, depth[s] == k - 1
            work[s] = 0
            if into.degree[far].sum() <= out.degree[near].sum():
                asked[s] = far
                push.append(s)
            else:
                asked[s] = near
                work[s, far] = (1 + share[s, far]) / paths[s, far]
                pull.append(s)
        into.push(asked, push, lambda s, rows: (1 + share[s, rows]) / paths[s, rows], work)
        out.pull(asked, pull, work, share)
        for s in push:
            near = np.flatnonzero(depth[s] == k - 1)
            share[s, near] = paths[s, near] * work[s, near]
        for s in pull:
            share[s, asked[s]] *= paths[s, asked[s]]
    return share.sum(axis=0)


def _summed(out: tuple[str, int, int], into: tuple[str, int, int], n: int, width: int, blocks: int, tasks: int):
    """Of each task, the sums over its blocks for every node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for task in (i for batch in batches for i in batch.column("id").to_pylist()):
            one, other = Cells(*out, n), Cells(*into, n)
            total = np.zeros(n)
            for b in range(task * blocks // tasks, (task + 1) * blocks // tasks):
                total += _block(one, other, n, b * width, width)
            some = np.flatnonzero(total)
            for k in range(0, len(some), 1 << 16):
                rows = some[k : k + (1 << 16)]
                yield pa.RecordBatch.from_pydict({"no": pa.array(rows + 1, pa.int64()), "part": pa.array(total[rows], pa.float64())})

    return run


def betweenness(edges: DataFrame, nodes: DataFrame, part: int = PART, width: int = WIDTH, batch: int = 1) -> DataFrame:
    """(id, betweenness): directed, unweighted, within ``nodes`` (id), not normalised, ends not
    counted. A block has ``width`` sources at most, a task ``batch`` blocks at least and a cell
    ``part`` rows (in large graphs a 16th of all) at most; the work is all in one stage, whose tasks do not wait for each other."""
    spark = nodes.sparkSession
    every = cut(numbered(nodes.select("id").distinct(), "id"))
    n = every.count()
    if not n:
        return every.select("id", F.lit(0.0).alias("betweenness"))
    part = max(part, -(-n // PARTS))
    cores = spark.sparkContext.defaultParallelism
    width = max(1, min(width, -(-n // (SPREAD * cores)), STATE // (CELL * n)))
    e = plain(edges)
    for side, name in (("src", "u"), ("dst", "w")):
        number = every.select(F.col("id").alias(side), (F.col("no") - 1).cast("int").alias(name))
        e = e.join(F.broadcast(number) if n <= SENT else number, side)
    e = cut(e.select("u", "w"))
    parts = max(1, -(-e.count() // DEALT))

    def packed(rows: DataFrame) -> tuple[str, int, int]:
        dealt = rows.repartitionByRange(parts, "u").sortWithinPartitions("u", "w")
        cells = cut(dealt.mapInArrow(_packed(part, EDGES), "first int, off binary, to binary"), None, {"compression": "none"})
        size = F.octet_length("off") + F.octet_length("to")
        r = cells.agg(F.coalesce(F.sum(size), F.lit(0)).alias("all"), F.coalesce(F.max(size), F.lit(0)).alias("most")).first()
        return cells.written, r["all"], r["most"]

    out = packed(e)
    into = packed(e.select(F.col("w").alias("u"), F.col("u").alias("w")))
    blocks = -(-n // width)
    tasks = max(1, min(-(-blocks // batch), 8 * cores))
    sums = spark.range(0, tasks, 1, tasks).mapInArrow(_summed(out, into, n, width, blocks, tasks), "no long, part double")
    sums = cut(sums.groupBy("no").agg(F.sum("part").alias("betweenness")))
    return every.join(sums, "no", "left").select("id", F.coalesce("betweenness", F.lit(0.0)).alias("betweenness"))
