"""Substring deduplication by level-wise doubling.

The first level looks at windows of ``start`` words, sampled without loss: of the ``start``-word
windows inside each ``window``-word window, the one with the least hash (the leftmost of equals)
speaks for it, so equal long windows always choose equal short ones. Short windows that occur
once in the corpus end here; only those that repeat are doubled, level by level up to ``window``
words or until no candidate survives. Neighbouring long windows with one representative form a
run, which is compared as a whole at each level: later copies of an equal run are repeats, and only
runs that share their short window but differ elsewhere (the edges of a repeated passage) go on.
That answers what to remove; ``doubled`` goes on from there, doubling the length until no window
repeats.

Hot keys: rows are merged inside each task before the shuffle, so that a passage found in a third of
all documents sends a row or two per task and not a row per document; the merged rows travel under
keys of their own. Short windows that a sample of documents shows to be
frequent (many near copies that differ in the run) are dealt out by the whole run instead of the
short window, and go on to the next level, which decides. The sample changes where rows are
compared, never the result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sextant.llm import _tokens as K
from sextant.llm._shared import cut, keyed

_RUN, MEMO = 1 << 12, 1 << 16


class _Merged:
    """Per row: the shuffle key, and whether an earlier row that went out before equals it. Rows of a
    slice are compared with each other, and with the passages that earlier slices of the task
    have met twice; of those at most ``MEMO`` are kept, which decides how many rows go out and never
    the result."""

    def __init__(self):
        self.name, self.key, self.doc, self.at = (np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64))

    def __call__(self, key: np.ndarray, rest: np.ndarray, doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort((at, doc, rest, key))
        k, r, d, a = key[order], rest[order], doc[order], at[order]
        same = np.zeros(len(key), bool)
        same[1:] = (k[1:] == k[:-1]) & (r[1:] == r[:-1])
        lead = np.maximum.accumulate(np.where(same, 0, np.arange(len(key))))
        later = same & ((d > d[lead]) | (a > a[lead]))
        both = K.mix(k ^ K.mix(r))
        if len(self.name):
            place = np.minimum(np.searchsorted(self.name, both), len(self.name) - 1)
            met = (self.name[place] == both) & (self.key[place] == k)
            later |= met & ((d > self.doc[place]) | ((d == self.doc[place]) & (a > self.at[place])))
        twice = np.unique(lead[same])
        if len(twice):
            held = [np.concatenate(x) for x in ((self.name, both[twice]), (self.key, k[twice]), (self.doc, d[twice]), (self.at, a[twice]))]
            o = np.lexsort((held[3], held[2], held[0]))
            first = np.append(True, held[0][o][1:] != held[0][o][:-1])
            self.name, self.key, self.doc, self.at = (x[o][first][:MEMO] for x in held)
        known = np.empty(len(key), bool)
        known[order] = later
        own = K.mix(doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + at.astype(np.uint64))
        return np.where(known, own, key), known


def _places(runs: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The document and the place of each window in the runs of a batch, in ascending order."""
    per = np.diff(np.frombuffer(runs.buffers()[1], np.int32)[runs.offset : runs.offset + len(runs) + 1])
    flat = runs.flatten().to_numpy(zero_copy_only=False)
    doc = np.repeat(np.arange(len(per)), per)
    order = np.lexsort((flat, doc))
    flat, doc = flat[order], doc[order]
    n = flat % _RUN
    place = np.repeat(flat // _RUN - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
    return np.repeat(doc, n), place


def _level_one(window: int, start: int, hot: np.ndarray, some: bool = False):
    """The runs of all windows, or with ``some`` of those in the runs that are left."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merged = _Merged()
        for part in K.slices(batches):
            words = K.Words(part.column("text"))
            room = words.room()
            if not len(room) or room.max() < window:
                continue
            roll = K.Rolling(words.hashes(), K.WORD)
            at = np.arange(len(room) - start + 1)
            short = roll(at, at + start)
            lead = K.leftmost_minimum(short, window - start + 1)
            if some:
                doc, place = _places(part.column("runs"))
                s = place + words.first[doc]
            else:
                s = np.flatnonzero(room >= window)
            p = lead[s]
            new = np.ones(len(s), bool)
            new[1:] = (p[1:] != p[:-1]) | (s[1:] != s[:-1] + 1)
            first = np.flatnonzero(new)
            n = np.diff(np.append(first, len(s)))
            lo = s[first]
            doc = words.doc()[lo]
            whole = roll(lo, lo + n + window - 1)
            local = lo - words.first[doc]
            owner = K.ids(part, "doc_id")[doc]
            key = short[p[first]]
            often = np.isin(key, hot)
            key = np.where(often, K.mix(key ^ K.mix(whole)), key)
            key, known = merged(key, whole, owner, local)
            yield K.as_batch(key=K.signed(key), whole=K.signed(whole), doc_id=owner, run=local * _RUN + n, known=known, often=often)

    return rows


def _sampled_keys(window: int, start: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in _level_one(window, start, np.zeros(0, np.uint64))(batches):
            yield K.as_batch(key=found.column("key"))

    return rows


def _hot(docs: DataFrame, window: int, start: int, sample: int = 1 << 15, least: int = 16) -> np.ndarray:
    """Short windows that ``least`` runs of a sample of about ``sample`` documents share, so
    that at most a ``least``-th of the sample's runs come to the driver."""
    n = docs.count()
    share = min(1.0, sample / max(n, 1))
    some = docs.filter(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1 << 20)) < int(share * (1 << 20)))
    keys = some.mapInArrow(_sampled_keys(window, start), "key long").groupBy("key").count().filter(F.col("count") >= least).select("key")
    return np.sort(keys.toArrow().column("key").to_numpy().view(np.uint64))


def _windows(window: int):
    """The long windows of the runs that are left, each with a hash of 128 bits."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merged = _Merged()
        for part in K.slices(batches):
            words = K.Words(part.column("text"))
            h = words.hashes()
            roll, other = K.Rolling(h, K.WORD), K.Rolling(K.mix(h + np.uint64(1)), K.WORD2)
            doc, s = _places(part.column("runs"))
            g = s + words.first[doc]
            a, b = roll(g, g + window), other(g, g + window)
            owner = K.ids(part, "doc_id")[doc]
            key, known = merged(a, b, owner, s)
            yield K.as_batch(key=K.signed(key), whole=K.signed(b), doc_id=owner, run=s * _RUN + 1, known=known)

    return rows


_ROW = "key long, whole long, doc_id long, run long, known boolean"


def repeats(docs: DataFrame, window: int = 20, start: int = 5) -> DataFrame:
    """(doc_id, runs): the windows of each document whose words also start earlier, a smaller
    doc_id or an earlier place. A run is place * 4096 + number of successive windows.

    ``docs`` has unique doc_ids. ``start`` doubles to ``window``.
    """
    if window % start or window // start & (window // start - 1) or window == start:
        raise ValueError("window must be start, doubled once or more")
    if window - start + 1 >= _RUN:
        raise ValueError("windows of this length are not supported")
    texts = docs.select("doc_id", "text")
    by_key, by_whole = Window.partitionBy("key"), Window.partitionBy("key", "whole")
    place = F.struct("doc_id", "run")
    earlier = F.col("known") | (place > F.col("first"))
    hot = _hot(texts, window, start)
    source, found, length = texts, None, start
    while length < window:
        one = source.mapInArrow(_level_one(window, length, hot, source is not texts), f"{_ROW}, often boolean").repartition("key")
        judged = (
            one.withColumn("first", F.min(place).over(by_whole))
            .withColumn("later", earlier)
            .withColumn("kinds", F.sum(F.when(F.col("later"), 0).otherwise(1)).over(by_key))
            .filter("later or often or kinds > 1")
            .select("doc_id", "run", "later")
        )
        judged = cut(judged)
        later = judged.filter("later").select("doc_id", "run")
        found = later if found is None else found.union(later)
        left = judged.filter("not later")
        length *= 2
        if left.isEmpty():  # no candidate survives
            return found.groupBy("doc_id").agg(F.collect_list("run").alias("runs"))
        source = texts.join(left.groupBy("doc_id").agg(F.collect_list("run").alias("runs")), "doc_id")
    two = source.mapInArrow(_windows(window), _ROW).repartition("key")
    two = two.withColumn("first", F.min(place).over(by_whole)).filter(earlier).select("doc_id", "run")
    return found.union(two).groupBy("doc_id").agg(F.collect_list("run").alias("runs"))


def _ranges(places: np.ndarray) -> np.ndarray:
    """Ascending places as place * 2**32 + number of successive ones."""
    if not len(places):
        return np.zeros(0, np.int64)
    first = np.flatnonzero(np.append(True, places[1:] != places[:-1] + 1))
    return places[first] * (1 << 32) + np.diff(np.append(first, len(places)))


def _members(ranges: np.ndarray) -> np.ndarray:
    n = ranges % (1 << 32)
    return np.repeat(ranges >> 32, n) + np.arange(n.sum()) - np.repeat(np.append(0, np.cumsum(n)[:-1]), n)


def _level(length: int, doubled: bool):
    """The candidate windows of a level: all of them at first, later those whose two halves both
    repeat. Equal windows of a slice are sent once, with how many there are."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in K.slices(batches):
            words = K.Words(part.column("text"))
            h, room = words.hashes(), words.room()
            at = np.flatnonzero(room >= length)
            doc = np.searchsorted(words.first, at, "right") - 1
            if doubled:
                keep = []
                for i, ranges in enumerate(part.column("ranges").to_pylist()):
                    half = _members(np.sort(np.array(ranges, np.int64))) + words.first[i]
                    keep.append(np.intersect1d(half, half - length // 2, assume_unique=True))
                both = np.concatenate(keep)
                use = np.isin(at, both)
                at, doc = at[use], doc[use]
            if not len(at):
                continue
            roll, other = K.Rolling(h, K.WORD), K.Rolling(K.mix(h + np.uint64(1)), K.WORD2)
            a, b = roll(at, at + length), other(at, at + length)
            order = np.lexsort((b, a))
            new = np.append(True, (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1]))
            group = np.cumsum(new) - 1
            size = np.bincount(group)
            lead = np.zeros(len(at), bool)
            lead[order[new]] = True
            n = np.empty(len(at), np.int64)
            n[order] = size[group]
            ids = K.ids(part, "doc_id")[doc]
            local = at - words.first[doc]
            own = K.mix(ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + local.astype(np.uint64))
            yield K.as_batch(key=K.signed(np.where(lead, a, own)), whole=K.signed(b), doc_id=ids, place=pa.array(local, pa.int64()), n=pa.array(n, pa.int64()), lead=pa.array(lead))

    return rows


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ranges = [_ranges(np.unique(np.array(p, np.int64))) for p in batch.column("places").to_pylist()]
        yield K.as_batch(doc_id=batch.column("doc_id"), ranges=pa.array(ranges, pa.list_(pa.int64())))


def doubled(docs: DataFrame, start: int = 20, levels: int | None = None) -> DataFrame:
    """(doc_id, length, ranges): for start, 2 * start, 4 * start ... words, the windows of that
    length that occur twice or more in the corpus, as place * 2**32 + number of successive
    places. A window is a candidate where both its halves repeat; the search ends when no
    candidate survives, or after ``levels`` lengths.

    Defined results are those of strip_repeats: texts without a window, null ones included, give
    no row.
    """
    rows = keyed(docs, "doc_id", "text")
    length, known, out = start, None, []
    while levels is None or len(out) < levels:
        source = rows if known is None else rows.join(known, "doc_id")
        found = source.mapInArrow(_level(length, known is not None), "key long, whole long, doc_id long, place long, n long, lead boolean")
        own = Window.partitionBy("key", "whole")
        found = found.repartition("key").withColumn("total", F.sum(F.when(F.col("lead"), F.col("n")).otherwise(0)).over(own)).filter("not lead or total > 1")
        known = cut(found.groupBy("doc_id").agg(F.collect_list("place").alias("places")).mapInArrow(_gather, "doc_id long, ranges array<long>"))
        if known.isEmpty():
            break
        out.append(known.select("doc_id", F.lit(length).alias("length"), "ranges"))
        length *= 2
    if not out:
        return rows.sparkSession.createDataFrame([], "doc_id long, length int, ranges array<long>")
    result = out[0]
    for more in out[1:]:
        result = result.union(more)
    return result


def _strip(window: int, keep_text: bool):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in K.slices(batches):
            n_words, n_removed, digests, texts = [], [], [], []
            for text, runs in zip(part.column("text").to_pylist(), part.column("runs").to_pylist(), strict=True):
                words = (text or "").encode().split()
                if runs:
                    r = np.array(runs)
                    diff = np.zeros(len(words) + 1, np.int64)
                    np.add.at(diff, r // _RUN, 1)
                    np.add.at(diff, r // _RUN + r % _RUN + window - 1, -1)
                    kept = list(compress(words, (np.cumsum(diff[:-1]) == 0).tolist()))
                else:
                    kept = words
                joined = b" ".join(kept)
                n_words.append(len(words))
                n_removed.append(len(words) - len(kept))
                digests.append(hashlib.sha256(joined).hexdigest())
                if keep_text:
                    texts.append(text if len(kept) == len(words) else joined.decode())
            out = {"doc_id": part.column("doc_id"), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept_sha256": pa.array(digests, pa.string())}
            if keep_text:
                out["text"] = pa.array(texts, pa.string())
            yield K.as_batch(**out)

    return rows


def strip_repeats(docs: DataFrame, window: int = 20, start: int = 5, keep_text: bool = True) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256[, text]): every document without the words that
    a window of ``window`` words covers whose words also start earlier.

    Windows are judged on the input. A text that loses nothing stays as it is, else its kept
    words are joined by one space. Defined results: a null, empty or short text has no window
    and loses nothing (a null text stays null); rows with a null doc_id are left out; of rows
    that share a doc_id the one with the greatest text stays; other columns are not read.
    """
    rows = keyed(docs, "doc_id", "text")
    found = repeats(rows, window, start)
    kept = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", text string" * keep_text
    return rows.join(found, "doc_id", "left").mapInArrow(_strip(window, keep_text), kept)


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 19), ' ') AS k FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 19)) AS i FROM d)),
f AS (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS r FROM g),
c AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 19)) AS p FROM f WHERE r > 1),
x AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS t FROM x WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.doc_id = x.doc_id AND c.p = x.p) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""
