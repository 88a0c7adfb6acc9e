"""Exact top-k search by block-at-a-time pruning.

Vectors become integers and are dealt, by ranges of their ids, into tiles of bounded size, and a
tile into blocks of ``BLOCK`` vectors. A block's forward index is its matrix; beside it stand the
maximum and the minimum of each dimension. The sum over dimensions of the larger of weight * maximum
and weight * minimum bounds the score of every vector of the block. A task has a group of
queries and a tile: each query takes the blocks in order of their bounds and stops where the bound
falls below its kth best score (with equal scores, where only greater ids can follow).

Two passes share thresholds. First every tile is searched for the queries that it holds, which
gives each query the kth score of its own neighbourhood. With that as its threshold a query then goes to
all other tiles, and only what beats it leaves a task. Ranking those few rows gives the result.

A group and a tile are at most 65,536 vectors and 32 MB of integers each, so a task's memory does
not grow with the table, and N vectors and Q queries are sent N * Q / 65,536 times at most in sum.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sextant.llm import _tokens as K
from sextant.llm._shared import cut, keyed

BLOCK, TILE, TILE_BYTES = 512, 1 << 16, 32 << 20
_NONE = np.iinfo(np.int64)


def _integers(vectors: pa.Array, scale: float) -> np.ndarray:
    """floor(scale * x) of all vectors, shorter ones filled up with zeros, in the smallest type
    that holds them."""
    n = np.diff(np.frombuffer(vectors.buffers()[1], np.int32)[vectors.offset : vectors.offset + len(vectors) + 1])
    flat = np.floor(np.asarray(vectors.flatten().to_numpy(zero_copy_only=False), np.float64) * scale)
    if len(flat) and np.abs(flat).max() >= 2.0**62:
        raise OverflowError("a component times its scale does not fit into 64 bits")
    out = np.zeros((len(n), int(n.max(initial=0))), np.int64)
    out[np.arange(out.shape[1]) < n[:, None]] = flat.astype(np.int64)
    most = int(np.abs(out).max(initial=0))
    return out.astype(next(t for t in (np.int8, np.int16, np.int32, np.int64) if most <= np.iinfo(t).max))


def _packed(every: int, scale: float):
    """Blocks of a tile, whose rows come in order of their ids: all vectors (kind 0) and those that
    are queries (kind 1), each with extremes by dimension."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                ids, x = K.ids(part, "vec_id"), _integers(part.column("embedding"), scale)
                asks = ids % every == 0
                for kind, use in ((0, np.ones(len(ids), bool)), (1, asks)):
                    if use.any():
                        yield K.as_batch(
                            tile=part.column("tile").slice(0, 1), kind=pa.array([kind], pa.int32()), ids=[ids[use].tobytes()], size=pa.array([int(use.sum())], pa.int64()), bits=pa.array([x.itemsize], pa.int32()), values=[x[use].tobytes()],
                            low=[x[use].min(0).astype(np.int64).tobytes()], high=[x[use].max(0).astype(np.int64).tobytes()],
                        )

    return rows


_BLOCKS = "tile int, kind int, ids binary, size long, bits int, values binary, low binary, high binary"


def _stacked(rows: pa.Table) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The ids and matrices of block rows, all as wide as the widest."""
    ids = [np.frombuffer(x, np.int64) for x in rows.column("ids").to_pylist()]
    return ids, [np.frombuffer(v, f"i{b}").reshape(len(i), -1) for v, b, i in zip(rows.column("values").to_pylist(), rows.column("bits").to_pylist(), ids, strict=True)]


def _wide(x: np.ndarray, width: int, kind: np.dtype) -> np.ndarray:
    out = np.zeros((len(x), width), kind)
    out[:, : x.shape[1]] = x
    return out


def _exact(most_left: int, most_right: int, width: int) -> np.dtype:
    """A type in which all inner products and bounds are exact."""
    most = most_left * most_right * max(width, 1)
    return np.dtype(np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64 if most < 1 << 63 else object)


def _search(queries: pa.Table, blocks: pa.Table, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, score) of at most ``k`` vectors of ``blocks`` for each query, those that can still
    be among its best. ``queries`` may have ``least`` and ``last``, score and id of its kth so far."""
    q_ids, q = _stacked(queries)
    b_ids, b = _stacked(blocks)
    ask = np.concatenate(q_ids)
    low, high = ([np.frombuffer(x, np.int64) for x in blocks.column(c).to_pylist()] for c in ("low", "high"))
    width = max(x.shape[1] for x in [*q, *b])
    kind = _exact(max(int(np.abs(x.astype(np.int64)).max(initial=0)) for x in q), max(int(np.abs(x.astype(np.int64)).max(initial=0)) for x in b), width)
    q = np.concatenate([_wide(x, width, kind) for x in q])
    low, high = (np.concatenate([_wide(x[None], width, kind) for x in side]) for side in (low, high))
    bound = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
    order = np.argsort(-bound, axis=1, kind="stable")
    first = np.array([x[0] for x in b_ids])
    least, last = np.full(len(ask), _NONE.min, object if kind == object else np.int64), np.full(len(ask), _NONE.max)
    if "least" in queries.column_names:
        least[:] = np.concatenate([np.frombuffer(x, np.int64) for x in queries.column("least").to_pylist()])
        last[:] = np.concatenate([np.frombuffer(x, np.int64) for x in queries.column("last").to_pylist()])
    best_q, best_id, best = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, least.dtype)
    every = np.arange(len(ask))
    for rank in range(len(b)):
        at = order[:, rank]
        top = bound[every, at]
        live = top >= least
        if not live.any():
            break
        live &= (top > least) | (first[at] < last)
        found = []
        for block in np.unique(at[live]):
            mine = np.flatnonzero(live & (at == block))
            score = q[mine] @ _wide(b[block], width, kind).T
            ids = b_ids[block]
            good = (score > least[mine, None]) | ((score == least[mine, None]) & (ids < last[mine, None]))
            good &= ids != ask[mine, None]
            x, y = np.nonzero(good)
            found.append((mine[x], ids[y], score[x, y].astype(least.dtype)))
        if not found or not sum(len(f[0]) for f in found):
            continue
        new_q = np.concatenate([f[0] for f in found])
        again = np.zeros(len(ask), bool)
        again[new_q] = True
        old = again[best_q]
        c_q, c_id, c = (np.concatenate([o[old], *n]) for o, n in zip((best_q, best_id, best), zip(*found, strict=True), strict=True))
        o = np.lexsort((c_id, -c, c_q))
        c_q, c_id, c = c_q[o], c_id[o], c[o]
        start = np.flatnonzero(np.append(True, c_q[1:] != c_q[:-1]))
        place = np.arange(len(c_q)) - np.repeat(start, np.diff(np.append(start, len(c_q))))
        full = c_q[place == k - 1]
        least[full], last[full] = c[place == k - 1], c_id[place == k - 1]
        few = place < k
        best_q, best_id, best = (np.concatenate([o[~old], n[few]]) for o, n in zip((best_q, best_id, best), (c_q, c_id, c), strict=True))
    if kind == object and len(best) and max(map(abs, best)) > _NONE.max:
        raise OverflowError("a score does not fit into 64 bits")
    return ask[best_q], best_id, best.astype(np.int64)


def _home(k: int):
    """Searches a tile for its own queries. The rows that are found (kind 0), and the queries again
    with their thresholds (kind 1)."""

    def run(tile: pa.Table) -> pa.Table:
        kind = tile.column("kind").to_numpy()
        queries, blocks = tile.filter(pa.array(kind == 1)), tile.filter(pa.array(kind == 0))
        if not queries.num_rows:
            return _FOUND.empty_table()
        query, vec, score = _search(queries, blocks, k)
        o = np.lexsort((vec, -score, query))
        query, vec, score = query[o], vec[o], score[o]
        start = np.flatnonzero(np.append(True, query[1:] != query[:-1])) if len(query) else np.zeros(0, int)
        full = start[np.diff(np.append(start, len(query))) == k] + k - 1
        least = dict(zip(query[full].tolist(), zip(score[full].tolist(), vec[full].tolist(), strict=True), strict=True))
        limits = [[least.get(i, (_NONE.min, _NONE.max)) for i in np.frombuffer(x, np.int64).tolist()] for x in queries.column("ids").to_pylist()]
        n, m = queries.num_rows, len(query)
        none = lambda kind, size: pa.nulls(size, kind)
        cast = lambda c, kind: queries.column(c).combine_chunks().cast(kind)
        parts = {
            "tile": (pa.array(tile.column("tile").to_numpy()[:1].repeat(m), pa.int32()), cast("tile", pa.int32())), "ids": (none(pa.binary(), m), cast("ids", pa.binary())), "size": (none(pa.int64(), m), cast("size", pa.int64())),
            "bits": (none(pa.int32(), m), cast("bits", pa.int32())), "values": (none(pa.binary(), m), cast("values", pa.binary())),
            "least": (none(pa.binary(), m), pa.array([np.array([y[0] for y in x], np.int64).tobytes() for x in limits], pa.binary())), "last": (none(pa.binary(), m), pa.array([np.array([y[1] for y in x], np.int64).tobytes() for x in limits], pa.binary())),
            "query_id": (pa.array(query, pa.int64()), none(pa.int64(), n)), "vec_id": (pa.array(vec, pa.int64()), none(pa.int64(), n)), "score": (pa.array(score, pa.int64()), none(pa.int64(), n)),
        }
        return pa.table({c: pa.concat_arrays(x) for c, x in parts.items()}, schema=_FOUND)

    return run


_FOUND = pa.schema([("tile", pa.int32()), ("ids", pa.binary()), ("size", pa.int64()), ("bits", pa.int32()), ("values", pa.binary()), ("least", pa.binary()), ("last", pa.binary()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
_FOUND_SQL = "tile int, ids binary, size long, bits int, values binary, least binary, last binary, query_id long, vec_id long, score long"
_RESULT = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def _away(k: int):
    def run(queries: pa.Table, blocks: pa.Table) -> pa.Table:
        if not queries.num_rows or not blocks.num_rows:
            return _RESULT.empty_table()
        return pa.table(list(_search(queries, blocks, k)), schema=_RESULT)

    return run


def search(vectors: DataFrame, k: int = 20, every: int = 20, scale: float = 64.0, tile: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose vec_id is divisible by ``every`` the
    ``k`` other rows with the greatest inner product of floor(``scale`` * x), ties to the
    smaller vec_id; all of them if there are fewer.

    Defined results: rows with a null vec_id, a null vector or a null or non-finite component take
    no part, neither as query nor as candidate; of rows that share a vec_id the one with the
    greatest vector stays; shorter vectors are filled up with zeros; equal vectors are rows of their own;
    an empty table gives no row; other columns are not read. Scores are exact; one beyond 64 bits
    is an error.
    """
    spark = vectors.sparkSession
    finite = "embedding is not null and not exists(embedding, x -> x is null or isnan(x) or abs(cast(x as double)) = double('infinity'))"
    rows = keyed(vectors, "vec_id", "embedding").filter(finite)
    n, width = rows.agg(F.count("*"), F.coalesce(F.max(F.size("embedding")), F.lit(0))).first()
    most = tile or max(BLOCK, min(TILE, TILE_BYTES // max(8 * width, 1)))
    tiles = max(-(-n // most), min(spark.sparkContext.defaultParallelism, -(-n // (4 * BLOCK))), 1)
    dealt = rows.repartitionByRange(tiles, "vec_id").sortWithinPartitions("vec_id").select(F.spark_partition_id().alias("tile"), "vec_id", "embedding")
    blocks = cut(dealt.mapInArrow(_packed(every, scale), _BLOCKS))
    ranges = blocks.agg(F.max("tile")).first()[0]
    ranges = 0 if ranges is None else ranges + 1
    if ranges > tiles:  # successive ranges together make a tile
        blocks = blocks.withColumn("tile", F.expr(f"cast(tile * {tiles}L div {ranges} as int)"))
    found = cut(blocks.groupBy("tile").applyInArrow(_home(k), _FOUND_SQL))

    # groups of queries by their tiles, of about ``most`` queries
    count = blocks.agg(F.max("tile"), F.sum(F.when(F.col("kind") == 1, F.col("size")))).first()
    tiles = (-1 if count[0] is None else count[0]) + 1
    groups = max(1, min(-(-(count[1] or 0) // most), tiles))
    queries = found.filter("ids is not null").withColumn("grp", F.expr(f"cast(tile * {groups}L div {max(tiles, 1)} as int)"))
    queries = queries.select("grp", F.col("tile").alias("home"), "ids", "size", "bits", "values", "least", "last").withColumn("tile", F.explode(F.sequence(F.lit(0), F.lit(max(tiles - 1, 0))))).filter("tile <> home")
    docs = blocks.filter("kind = 0").withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    away = queries.groupBy("grp", "tile").cogroup(docs.groupBy("grp", "tile")).applyInArrow(_away(k), "query_id long, vec_id long, score long")
    both = found.filter("query_id is not null").select("query_id", "vec_id", "score").union(away)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return both.select("query_id", rank.alias("rank"), "vec_id", "score").filter(F.col("rank") <= k)


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0),
e AS (SELECT vec_id, unnest(x) AS c, generate_subscripts(x, 1) AS d FROM v),
p AS (SELECT q.vec_id AS query_id, e.vec_id, CAST(sum(q.c * e.c) AS BIGINT) AS score FROM e AS q JOIN e ON q.d = e.d AND q.vec_id <> e.vec_id WHERE q.vec_id % 20 = 0 GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""
