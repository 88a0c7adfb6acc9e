"""Conflict-constrained best-fit packing of documents into sequences of fixed capacity.

Documents are dealt over shards by a hash of doc_id, so a hot source or a large group of copies
spreads evenly, and each shard is packed on its own: the longest piece first into the fullest bin
that takes it. Bins are kept by residual; the successor search starts at the piece's own length
and goes on to the next residual until a bin is compatible. A bin's bitmaps tell which duplicate
clusters it holds and which sources have used up their share in it.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sextant.llm import _tokens as K
from sextant.llm._shared import keyed

CAPACITY, PER_SOURCE, SHARD = 4096, 4, 8000
OUT = "doc_id long, piece int, first_word long, n_words long, bin long, slot int"


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in K.slices(batches):
        words = K.Words(part.column("text"), lower=True)
        cluster = K.Rolling(words.hashes(), K.WORD)(words.first[:-1], words.first[1:])
        yield K.as_batch(doc_id=part.column("doc_id"), source=part.column("source"), n=pa.array(words.count, pa.int64()), cluster=K.signed(cluster))


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, source, n, cluster): words of each text, and a hash that copies share (words
    compared without case and spacing)."""
    return docs.select("doc_id", "source", "text").mapInArrow(_measure, "doc_id long, source string, n long, cluster long")


def best_fit(pieces: list[tuple], capacity: int, per_source: int) -> list[tuple[int, int]]:
    """(bin, slot) of each (size, source bit, cluster bit), in the order given.

    A bin is compatible if it has not the piece's cluster and fewer than ``per_source`` pieces of
    its source. Of equally full bins the oldest is taken.
    """
    by_residual: dict[int, list[int]] = defaultdict(list)
    filled = 0  # bit r: a bin with residual r exists
    full: list[int] = []
    clusters: list[int] = []
    counts: list[Counter] = []
    out = []
    for size, source, cluster in pieces:
        at, rest, chosen = size, filled >> size, None
        while rest:
            skip = (rest & -rest).bit_length() - 1
            at, rest = at + skip, rest >> skip
            chosen = next((b for b in by_residual[at] if not (clusters[b] & cluster or full[b] & source)), None)
            if chosen is not None:
                break
            at, rest = at + 1, rest >> 1
        if chosen is None:
            chosen, at = len(full), capacity
            full.append(0)
            clusters.append(0)
            counts.append(Counter())
        else:
            by_residual[at].remove(chosen)
            if not by_residual[at]:
                filled ^= 1 << at
        out.append((chosen, sum(counts[chosen].values())))
        clusters[chosen] |= cluster
        counts[chosen][source] += 1
        if counts[chosen][source] == per_source:
            full[chosen] |= source
        if left := at - size:
            bins = by_residual[left]
            bins.append(chosen)
            bins.sort()
            filled |= 1 << left
    return out


def pack_shard(rows: list[tuple], capacity: int, per_source: int) -> list[tuple]:
    """OUT for the (doc_id, source, n, cluster) of one shard; bins are numbered from 0."""
    whole, rest, empty = [], [], []
    for doc_id, source, n, cluster in rows:
        k = 0
        for k in range(n // capacity):
            whole.append((doc_id, k, k * capacity, capacity))
        done = n // capacity
        if n % capacity:
            rest.append((n % capacity, doc_id, done, source, cluster))
        elif not n:
            empty.append((doc_id, 0, 0, 0, None, None))
    rest.sort(key=lambda r: (-r[0], r[1], r[2]))
    whole.sort()
    source_bit: dict = {}
    cluster_bit: dict = {}
    bit = lambda names, name: 1 << names.setdefault(name, len(names))
    placed = best_fit([(n, bit(source_bit, s), bit(cluster_bit, c)) for n, _, _, s, c in rest], capacity, per_source)
    out = [(d, k, f, n, i, 0) for i, (d, k, f, n) in enumerate(whole)]
    out += [(d, k, k * capacity, n, len(whole) + b, slot) for (n, d, k, _, _), (b, slot) in zip(rest, placed, strict=True)]
    return out + empty


def pack(docs: DataFrame, capacity: int = CAPACITY, per_source: int = PER_SOURCE, shard: int = SHARD) -> DataFrame:
    """One row per piece of a document: its words ``first_word`` on, the bin and the place in it.

    A text longer than ``capacity`` words is cut into full pieces, each a bin of its own, and a
    rest that is packed. No bin holds two documents of one duplicate cluster, or more than
    ``per_source`` of one source (null counts as a source). A text without words has one row
    with a null bin; rows with a null doc_id are left out; of rows that share a doc_id the one
    with the greatest (text, source) stays; other columns are not read. ``shard`` is the mean
    number of documents packed together.
    """
    rows = keyed(docs, "doc_id", "text", "source")
    n = max(1, -(-rows.count() // shard))

    def run(table: pa.Table) -> pa.Table:
        columns = [table.column(c).to_pylist() for c in ("doc_id", "source", "n", "cluster")]
        base = table.column("shard")[0].as_py() << 32
        out = [(*r[:4], None if r[4] is None else base + r[4], r[5]) for r in pack_shard(list(zip(*columns, strict=True)), capacity, per_source)]
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], [x.split()[0] for x in OUT.split(", ")])

    # a partition for each shard, roughly: their few bytes say nothing about the work in them
    dealt = measured(rows).withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(n))).repartition(n, "shard")
    return dealt.groupBy("shard").applyInArrow(run, OUT)
