"""Benchmark decontamination by template windows.

Texts are canonicalised to templates: lower-case words without outer punctuation, numbers, names
(capitalised words inside a sentence) and units after a number replaced with typed placeholders.
The windows of template words of the benchmark and those of the documents meet in a hash join.
Part of its key is the pattern of the slots, which tells what slots of a window hold the same value:
two windows have the same pattern if and only if their values correspond one to one. So a
re-parameterised question is caught and a mere similar frame is not. Where most words are slots,
ten words say little: such a window has twenty words, or is the item as a whole, with two words at least
that stand for themselves, and the pattern has to agree over all of it. With fewer, any list
of numbers or names would fit, and only a verbatim copy counts.

Windows of the lower-case words themselves are joined beside them, in the same pass: a copy that
stands in capitals, or consists of numbers and names for the most part, matches word for word.

The documents are read once, whatever the benchmark's size, and only windows whose hash the
benchmark may have go to the join: the test is a sorted list of up to ``block`` hashes, a bitmap of
fixed size beyond that. Equal windows of the benchmark are one row, a class, so a frame that all
items share joins each document once. Of items that have all windows in common the smallest speaks for
the others. A document names the items that alone have one of its windows; a class that none of these items has is named by its smallest item. ``window_links`` and
``window_members`` give the rest: every document's classes, and every class's items. Rows are salted, so
a passage that a third of all documents have is dealt out.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sextant.llm import _tokens as K
from sextant.llm._shared import cut, keyed

WINDOW, BLOCK, SALTS = 10, 1 << 20, 16
#: words of a template window that stand for themselves; items of fewer words than SHORTEST are left out
OWN, SHORTEST = 2, 3
#: bits of the bitmap that stands for more than ``block`` hashes
_BITS = 26
UNITS = (
    "mm cm m km mg g kg lb lbs oz ml l mile miles meter meters metre metres kilometer kilometers kilometre kilometres inch inches foot feet yard yards "
    "gram grams kilogram kilograms pound pounds ounce ounces liter liters litre litres second seconds minute minutes hour hours day days week weeks "
    "month months year years dollar dollars cent cents euro euros percent degree degrees mph kmh"
)
_ROW = "id long, size long, place long, n long, key long, whole long, slots long, kinds array<long>, values array<long>"
_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".!?:\n")] = True


def _lower(texts: pa.Array, words: K.Words) -> np.ndarray:
    """The bytes of ``words`` with every letter in lower case whose lower case takes as many bytes."""
    low = pa.compute.utf8_lower(texts.cast(pa.large_string()).fill_null(""))
    if not pa.compute.equal(pa.compute.binary_length(low), pa.array(np.diff(words.off), pa.int64())).to_numpy(zero_copy_only=False).all():
        keep = lambda c: c.lower() if len(c.lower().encode()) == len(c.encode()) else c
        low = pa.array(["".join(map(keep, t or "")) for t in texts.to_pylist()], pa.large_string())
    return K.Words(low).buf


def _capital(buf: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Whether the character that begins at a byte is a capital."""
    lead = np.flatnonzero((buf & 0xC0) != 0x80)
    out = np.zeros(len(buf), bool)
    if len(lead):
        out[lead] = np.logical_or.reduceat(buf != low, lead)
    return out


class Templates:
    """Template words of a column of texts. ``kind`` is 0 for a word that stands for itself."""

    def __init__(self, texts: pa.Array):
        words = K.Words(texts)
        buf = words.buf
        solid = np.flatnonzero(_ALNUM[buf])
        lo = np.searchsorted(solid, words.start)
        hi = np.searchsorted(solid, words.end)
        has = hi > lo
        start, end = solid[lo[has]], solid[hi[has] - 1] + 1
        low = _lower(texts, words)
        roll = K.Rolling(low.astype(np.uint64) + np.uint64(1), K.BYTE)
        self.value = roll(start, end)
        number = _DIGIT[buf[start]] if len(start) else np.zeros(0, bool)
        upper = _capital(buf, low)
        # a sentence begins after .!?: at the end of the word before, at a line's or a text's begin
        stops = np.append(0, np.cumsum(_STOP[buf]))
        opens = np.ones(len(start), bool)
        opens[1:] = stops[start[1:]] > stops[end[:-1]]
        self.first = np.append(0, np.cumsum(has))[words.first]
        self.count = np.diff(self.first)
        opens[self.first[:-1][self.count > 0]] = True
        name = (upper[start] if len(start) else np.zeros(0, bool)) & ~opens & ~number
        unit = np.isin(self.value, _unit_values())
        unit[1:] &= number[:-1]
        unit[:1] = False
        unit[self.first[:-1][self.count > 0]] = False
        self.kind = np.select([number, name, unit], [1, 2, 3], 0)
        self.form = np.where(self.kind > 0, K.mix(self.kind.astype(np.uint64)), self.value)

    def windows(self, size: int, literal: bool, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places, hashes and documents of the windows of ``size`` literal words, or of template
        words: up to ``window`` of them where half at least stand for themselves, beyond that where
        fewer do, but ``OWN`` of them. A short item that is one window as a whole needs ``OWN`` at most."""
        room = np.repeat(self.first[1:], self.count) - np.arange(len(self.form))
        at = np.flatnonzero(room >= size)
        if not literal:
            own = np.append(0, np.cumsum(self.kind == 0))
            own = own[at + size] - own[at]
            half = (size + 1) // 2
            at = at[own >= (half if size == window else min(OWN, half))] if size <= window else at[(own >= OWN) & (own < half)]
        doc = np.searchsorted(self.first, at, "right") - 1
        return at, K.Rolling(self.value if literal else self.form, K.WORD)(at, at + size), doc


_unit_cache: list[np.ndarray] = []


def _unit_values() -> np.ndarray:
    if not _unit_cache:
        words = K.Words(pa.array([UNITS]))
        _unit_cache.append(K.Rolling(words.buf.astype(np.uint64) + np.uint64(1), K.BYTE)(words.start, words.end))
    return _unit_cache[0]


def _pattern(t: Templates, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each window its kinds and values, and a hash of its pattern: each slot is numbered by the
    first slot of its kind with the same value."""
    place = at[:, None] + np.arange(size)
    kind, value = t.kind[place], t.value[place]
    first = np.tile(np.arange(size), (len(at), 1))
    for i in range(size - 1, -1, -1):  # the leftmost equal slot wins
        same = (kind == kind[:, i : i + 1]) & (value == value[:, i : i + 1])
        first = np.where(same, i, first)
    code = np.where(kind > 0, first + 1, 0).astype(np.uint64)
    slots = K.mix((code * K.mix(np.arange(1, size + 1, dtype=np.uint64))).sum(axis=1, dtype=np.uint64))
    return kind, value, slots


class Lookup:
    """Tells whether the benchmark may have a hash: exactly from a sorted list, or from a bitmap."""

    def __init__(self, keys: np.ndarray | None, bitmap: np.ndarray | None = None):
        self.keys, self.bitmap = keys, bitmap

    def __call__(self, h: np.ndarray) -> np.ndarray:
        if self.bitmap is not None:
            bit = h >> np.uint64(64 - _BITS)
            return (self.bitmap[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) > 0
        if not len(self.keys):
            return np.zeros(len(h), bool)
        return self.keys[np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)] == h


def _rows(t: Templates, ids: np.ndarray, sizes: list[int], window: int, lookup: Lookup | None, values: bool) -> pa.RecordBatch:
    """The windows of all sizes, template and literal ones, that pass ``lookup``. Windows of other
    sizes than ``window`` and twice that are whole items; documents are searched for them everywhere."""
    parts = []
    for size in sizes:
        for literal in (False, True) if size <= window else (False,):
            at, h, doc = t.windows(size, literal, window)
            h = K.mix(h + np.uint64(2 * size + literal))
            some = lookup(h) if lookup else np.ones(len(at), bool) if size in (window, 2 * window) else t.count[doc] == size
            at, h, doc = at[some], h[some], doc[some]
            whole = K.Rolling(K.mix((t.value if literal else t.form) + np.uint64(1)), K.WORD2)(at, at + size)
            for k in range(0, len(at), 1 << 14):
                p = at[k : k + (1 << 14)]
                kind, value, slots = _pattern(t, p, size)
                own = slice(k, k + len(p))
                kinds, held = ([x[y > 0] for x, y in zip(m, kind, strict=True)] if values and not literal else [[]] * len(p) for m in (kind, value))
                held = [K.signed(np.asarray(x, np.uint64)) for x in held]
                zero = np.zeros(len(p), np.int64)
                parts.append(K.as_batch(
                    id=ids[doc[own]], size=np.full(len(p), size, np.int64), place=pa.array(p - t.first[doc[own]], pa.int64()), n=pa.array(t.count[doc[own]], pa.int64()), key=K.signed(h[own]), whole=K.signed(whole[own]),
                    slots=zero if literal else K.signed(slots), kinds=pa.array(kinds, pa.list_(pa.int64())), values=pa.array(held, pa.list_(pa.int64())),
                ))
    return pa.Table.from_batches(parts).combine_chunks().to_batches() if parts else []


def _bench_windows(window: int, values: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in K.slices(batches):
            t = Templates(part.column("text"))
            sizes = sorted({min(w, int(n)) for n in t.count if n for w in (window, 2 * window)})
            yield from _rows(t, K.ids(part, "item_id"), sizes, window, None, values)

    return run


def _doc_windows(window: int, sizes: list[int], lookup: Lookup, values: bool):
    """For each document a row with place -1 and the number of its words, and its possible hits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in K.slices(batches):
            t = Templates(part.column("text"))
            zero, none = np.zeros(part.num_rows, np.int64), pa.array([[]] * part.num_rows, pa.list_(pa.int64()))
            yield K.as_batch(id=part.column("doc_id").cast(pa.int64()), size=zero, place=zero - 1, n=pa.array(t.count, pa.int64()), key=zero, whole=zero, slots=zero, kinds=none, values=none)
            yield from _rows(t, K.ids(part, "doc_id"), sizes, window, lookup, values)

    return run


def _lookup(keys: DataFrame, block: int) -> Lookup:
    """``keys`` has distinct hashes; at most ``block`` of them, or a bitmap, reach the driver."""
    if keys.limit(block + 1).count() <= block:
        found = keys.toArrow().column("key")
        return Lookup(np.sort(found.to_numpy().view(np.uint64)))
    bit = F.expr(f"shiftrightunsigned(key, {64 - _BITS})")
    words = keys.select(F.shiftright(bit, 6).alias("word"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(key, {64 - _BITS}) & 63 as int))").alias("bit"))
    found = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    bitmap = np.zeros(1 << (_BITS - 6), np.uint64)
    bitmap[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return Lookup(None, bitmap)


def _aligned(table: pa.Table) -> pa.Table:
    """Windows of one document and item on its best alignment, from the left, whose slots agree with
    those taken before."""
    rows = table.to_pylist()
    lines = defaultdict(list)
    for r in rows:
        lines[r["place"] - r["item_place"]].append(r)
    best = 0
    for found in lines.values():
        there, back, places = {}, {}, set()
        for r in sorted(found, key=lambda r: (r["place"], r["key"])):
            new_there, new_back = dict(there), dict(back)
            if all(new_there.setdefault((k, b), a) == a and new_back.setdefault((k, a), b) == b for k, a, b in zip(r["kinds"], r["values"], r["item_values"], strict=True)):
                there, back = new_there, new_back
                places.add(r["place"])
        best = max(best, len(places))
    return pa.table({"doc_id": [rows[0]["doc_id"]], "item_id": [rows[0]["item_id"]], "n": pa.array([best], pa.int64())})


def _bench(items: DataFrame, window: int, shortest: int, values: bool = False) -> DataFrame:
    return items.mapInArrow(_bench_windows(window, values), _ROW).filter(F.col("n") >= shortest)


def _hits(rows: DataFrame, bench: DataFrame, window: int, block: int, values: bool) -> DataFrame:
    sizes = sorted(r["size"] for r in bench.select("size").distinct().collect())  # at most 2 * window
    found = rows.mapInArrow(_doc_windows(window, sizes, _lookup(bench.select("key").distinct(), block), values), _ROW).withColumnRenamed("id", "doc_id")
    return cut(found.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")))


def _salted(df: DataFrame) -> DataFrame:
    return df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


_SAME = ["key", "whole", "slots"]


def window_members(benchmark: DataFrame, window: int = WINDOW, shortest: int = SHORTEST) -> DataFrame:
    """(key, whole, slots, item_id): every class of equal benchmark windows with all its items."""
    return _bench(keyed(benchmark, "item_id", "text"), window, shortest).select(*_SAME, F.col("id").alias("item_id")).distinct()


def window_links(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shortest: int = SHORTEST, block: int = BLOCK) -> DataFrame:
    """(doc_id, key, whole, slots): every document with the classes of ``window_members`` that it has.
    Joined on the class they are all pairs of documents and items."""
    bench = cut(_bench(keyed(benchmark, "item_id", "text"), window, shortest))
    found = _hits(keyed(docs, "doc_id", "text"), bench, window, block, False)
    return found.filter("place >= 0").join(_salted(bench.select(*_SAME).distinct()), [*_SAME, "salt"]).select("doc_id", *_SAME).distinct()


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, least: int = 1, block: int = BLOCK, shortest: int = SHORTEST) -> DataFrame:
    """One row per document: its windows, how many of them (``n_matched``) the benchmark has too,
    the items in ascending order (see above for windows that several items share), and ``kept``,
    false with any such window.

    With ``least`` above 1 an item counts from that many windows on one alignment on (all, if it is
    short), between which the slots agree as well; every pair of a document and an item that share a
    window is looked at then, and n_matched is the sum over the items.

    A null, empty or short text has no window and is kept; a benchmark item of fewer than ``shortest``
    words matches nothing; rows with a null doc_id or item_id are left out; of rows that share an id
    the one with the greatest text stays; other columns are not read. Items shorter than ``window``
    words are one window as a whole.
    """
    rows, items = keyed(docs, "doc_id", "text"), keyed(benchmark, "item_id", "text")
    bench = cut(_bench(items, window, shortest, least > 1))
    found = _hits(rows, bench, window, block, least > 1)
    counts = found.filter("place = -1").select("doc_id", F.greatest(F.col("n") - window + 1, F.lit(0).cast("long")).alias("n_windows"))
    hits = found.filter("place >= 0")
    if least == 1:
        sets = bench.select("id", *_SAME).distinct().groupBy("id").agg(F.count("*").alias("n"), *(F.bit_xor(F.xxhash64(F.lit(k), *_SAME)).alias(f"set{k}") for k in (1, 2)))
        one = sets.groupBy("n", "set1", "set2").agg(F.min("id").alias("id")).select("id")
        bench = cut(bench.join(one, "id", "left_semi"))  # of items with the same windows the smallest
        classes = bench.groupBy(*_SAME).agg(F.min("id").alias("item_id"), (F.min("id") == F.max("id")).alias("own"))
        met = cut(hits.select("doc_id", "place", *_SAME, "salt").join(_salted(classes), [*_SAME, "salt"]))
        named = met.filter("own").select("doc_id", "item_id").distinct()
        # classes of several items: what an item that is named already has needs no name
        shared = met.filter("not own").select("doc_id", *_SAME, "item_id").distinct()
        several = bench.join(classes.filter("not own").select(*_SAME), _SAME, "left_semi").select(*_SAME, F.col("id").alias("item_id")).distinct()
        covered = named.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(_salted(several), ["item_id", "salt"]).select("doc_id", *_SAME).distinct()
        rest = shared.join(covered, ["doc_id", *_SAME], "left_anti").select("doc_id", "item_id")
        ids = named.union(rest).groupBy("doc_id").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"))
        matched = met.groupBy("doc_id").agg(F.count_distinct("place").alias("n_matched")).join(ids, "doc_id")
    else:
        first = bench.select(*_SAME, F.col("id").alias("item_id"), F.col("place").alias("item_place"), F.col("values").alias("item_values"), F.greatest(F.lit(1), F.col("n") - window + 1).alias("windows"))
        pairs = hits.join(_salted(first), [*_SAME, "salt"])
        need = first.groupBy("item_id").agg(F.least(F.lit(least), F.max("windows")).alias("need"))
        pairs = pairs.select("doc_id", "item_id", "place", "item_place", "key", "kinds", "values", "item_values").groupBy("doc_id", "item_id").applyInArrow(_aligned, "doc_id long, item_id long, n long")
        matched = pairs.join(need, "item_id").filter("n >= need").groupBy("doc_id").agg(F.sum("n").alias("n_matched"), F.array_sort(F.collect_set("item_id")).alias("item_ids"))
    none = F.array().cast("array<long>")
    out = counts.join(matched, "doc_id", "left")
    return out.select("doc_id", "n_windows", F.coalesce("n_matched", F.lit(0).cast("long")).alias("n_matched"), F.coalesce("item_ids", none).alias("item_ids"), F.col("n_matched").isNull().alias("kept"))
