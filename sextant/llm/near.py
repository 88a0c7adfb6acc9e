"""Near-duplicate detection with SuperMinHash.

1. Every whole text becomes its set of distinct five-word shingles (64-bit hashes), a SuperMinHash
   signature and one key per band. In a SuperMinHash each element walks a random permutation of
   the registers and offers register p[j] the value j + r; once every register holds a value
   below j + 1 no later step can lower one, so the walk stops early.
2. Documents with equal sets form a class, whose smallest doc_id goes on alone: exact copies never
   meet in a bucket.
3. Buckets are joined as stars: each member with the member that shares most buckets, its centre.
   These pairs are compared on full sets, and union-find by label propagation merges those that
   are linked.
4. Members of one centre that are still in different components may be linked with each other.
   No bucket is expanded into its pairs for that. The members of a centre are described by
   what sets them apart from the group's consensus c (the shingles that more than half of them
   have): with o(x) = |x & c| and D(x) = (x - c) + (c - x), two of them share exactly
   o(x) + o(y) - |c| + |D(x) & D(y)| shingles. Pairs that are linked whatever their differences
   are linked through the member that is nearest to the consensus. All others must have
   differences in common, which is an equi-join on one or two of the rarest of those (the prefix
   and position filters of set joins; differences that nobody else, or nobody of another component,
   has are left out). The pairs found are decided on the differences, exactly, and no text is read
   again.

With 40 bands of 5 rows a pair of similarity 0.75 meets in some band but for 2 in 100,000 cases,
one of 0.8 but for 1 in 8 million.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sextant.llm import _tokens as K
from sextant.llm._shared import components, cut, keyed, matched

BANDS, ROWS, SHINGLE, SALTS, DEALT, PREFIX = 40, 5, 5, 16, 512, 24
#: ids that are broadcast, 8 MB of them
NAMED = 1 << 20
_STEP = 0x9E3779B97F4A7C15


def shingle_sets(texts: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of all texts, ascending in each, and where each text's begin."""
    words = K.Words(texts, lower=True)
    roll, room = K.Rolling(words.hashes(), K.WORD), words.room()
    short = np.zeros(len(room), bool)
    short[words.first[:-1][(words.count > 0) & (words.count < size)]] = True
    at = np.flatnonzero((room >= size) | short)
    values = roll(at, at + np.minimum(room[at], size))
    ends = np.searchsorted(at, words.first)
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        values[a:b].sort()
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    new[ends[:-1][ends[:-1] < len(values)]] = True
    return values[new], np.append(0, np.cumsum(new))[ends]


def super_minhash(values: np.ndarray, first: np.ndarray, m: int) -> np.ndarray:
    """Registers (documents by m): step * 2**32 + fraction, the least that any element offers."""
    count = np.diff(first)
    out = np.full((len(count), m), np.iinfo(np.uint64).max, np.uint64)
    flat = out.reshape(-1)
    doc = np.repeat(np.arange(len(count)), count)
    drawn: list[np.ndarray] = []
    for j in range(m):
        u = K.mix(values + np.uint64((j + 1) * _STEP % (1 << 64)))
        k = (j + ((u >> np.uint64(32)) * np.uint64(m - j) >> np.uint64(32)).astype(np.int32)).astype(np.int32)
        x = k
        for i in range(j - 1, -1, -1):  # where the register at place k stood before the earlier swaps
            x = np.where(drawn[i] == x, np.int32(i), x)
        drawn.append(k)
        np.minimum.at(flat, doc * m + x, (u & np.uint64(0xFFFFFFFF)) | np.uint64(j << 32))
        going = (out.max(axis=1) >= np.uint64((j + 1) << 32))[doc]
        if not going.any():
            break
        if not going.all():
            values, doc, drawn = values[going], doc[going], [d[going] for d in drawn]
    return out


def _signed_rows(bands: int, rows: int):
    m = bands * rows
    factors = K.mix(np.arange(1, rows + 1, dtype=np.uint64)) | np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in K.slices(batches):
            values, first = shingle_sets(part.column("text"))
            n = np.diff(first)
            sums = [np.append(np.uint64(0), np.cumsum(K.mix(values ^ np.uint64(salt)), dtype=np.uint64)) for salt in (1, 2)]
            a, b = (K.signed(s[first[1:]] - s[first[:-1]]) for s in sums)
            h = super_minhash(values, first, m)
            keys = (h.reshape(len(n), bands, rows) * factors).sum(axis=2, dtype=np.uint64)
            keys = K.signed(K.mix(K.mix(keys) + np.arange(bands, dtype=np.uint64)))
            some = n > 0
            offsets = np.append(0, np.cumsum(some)).astype(np.int32)
            yield K.as_batch(
                doc_id=part.column("doc_id"),
                n=pa.array(n, pa.int64()),
                set_a=a,
                set_b=b,
                keys=pa.ListArray.from_arrays(offsets * np.int32(bands), keys[some].reshape(-1)),
            )

    return run


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sizes, overlap, and the shingles that only ``id`` and only ``other`` has."""
    for part in K.slices(batches, "text_id", "text_other"):
        (x, fx), (y, fy) = shingle_sets(part.column("text_id")), shingle_sets(part.column("text_other"))
        both, more, less = [], [], []
        for i in range(part.num_rows):
            p, q = x[fx[i] : fx[i + 1]], y[fy[i] : fy[i + 1]]
            more.append(K.signed(np.setdiff1d(p, q, assume_unique=True)))
            less.append(K.signed(np.setdiff1d(q, p, assume_unique=True)))
            both.append(len(p) - len(more[-1]))
        yield K.as_batch(
            id=part.column("id"), other=part.column("other"), n_id=pa.array(np.diff(fx), pa.int64()), n_other=pa.array(np.diff(fy), pa.int64()),
            both=pa.array(both, pa.int64()), more=pa.array(more, pa.list_(pa.int64())), less=pa.array(less, pa.list_(pa.int64())),
        )


_COMPARED = "id long, other long, n_id long, n_other long, both long, more array<long>, less array<long>"


def _salted(df: DataFrame) -> DataFrame:
    """A row of a centre for each salt of its members."""
    return df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).hint("merge")


def _apart(members: DataFrame, percent: int) -> DataFrame:
    """(centre, id, label, h, d, least, nearest): what sets the members of a centre apart from their
    consensus. ``members`` has (centre, salt, id, label, n, n_other, both, more, less) against the
    centre; x and y are linked if 2 * (100 + percent) * |d(x) & d(y)| >= h(x) + h(y); ``nearest`` is
    the member with the least h."""
    p, unit = percent, 100 + percent
    # the consensus: the centre's set with every difference that more than half of the members have
    none = F.array().cast("array<long>")
    apart = members.select("centre", F.explode("more").alias("e"), F.lit(1).alias("outside")).union(members.select("centre", F.explode("less"), F.lit(0)))
    size = members.groupBy("centre").agg(F.count("id").alias("members"))
    flip = apart.groupBy("centre", "e", "outside").agg(F.count("*").alias("often")).join(size, "centre").filter("2 * often > members")
    flip = flip.groupBy("centre").agg(F.collect_list("e").alias("flips"), F.sum("outside").alias("added"), F.sum(1 - F.col("outside")).alias("removed"))
    m = members.join(_salted(flip), ["centre", "salt"], "left").fillna(0, ["added", "removed"]).withColumn("flips", F.coalesce("flips", none))
    apart = F.concat("more", "less")
    m = m.withColumn("d", F.concat(F.array_except(apart, "flips"), F.array_except("flips", apart)))
    m = m.withColumn("common", F.col("both") + F.size(F.array_intersect("more", "flips")) - F.col("removed") + F.size(F.array_intersect("less", "flips")))
    m = m.withColumn("h", F.expr(f"2 * ({p} * n - {unit} * common) + {unit} * (n_other + added - removed)"))
    m = cut(m.select("centre", "salt", "id", "label", "h", "d"))
    nearest = m.groupBy("centre").agg(F.min(F.struct("h", "id")).alias("nearest"))
    m = m.join(_salted(nearest), ["centre", "salt"])
    return cut(m.select("centre", "id", "label", "h", "d", F.col("nearest.h").alias("least"), F.col("nearest.id").alias("nearest")))


def _meet(m: DataFrame, percent: int) -> DataFrame:
    """(centre, a, b): the members with different labels that may have enough differences in common.

    Differences are ranked, the rarest first (by powers of two, then by chance, since neighbours in a
    text come and go together). A pair that needs t of them meets on one among the
    first size - t + 1 of both members, and on two among the first size - t + 2. Members that need
    most of their differences (at most ``PREFIX`` come into question) meet on two, since a
    difference that many have says little by itself; all other pairs on one. Bitmaps of 256 hashed
    differences then bound how many each lacks of the other's, so that pairs which only happen to
    meet are not emitted.
    """
    unit = 2 * (100 + percent)
    need = lambda h, least=1: f"greatest({least}, cast(ceil(({h}) / {unit}) as int))"
    every = m.select("centre", "id", "label", "h", "least", F.explode("d").alias("e"))
    often = every.groupBy("centre", "e").agg(F.count("id").alias("often"), F.min("label").alias("lo"), F.max("label").alias("hi")).filter("often > 1 and lo < hi").drop("lo", "hi")
    own = Window.partitionBy("centre", "id")
    ranked = every.join(often, ["centre", "e"]).withColumn("rank", F.row_number().over(own.orderBy(F.expr("cast(log2(often) as int)"), F.xxhash64("e"), "e"))).withColumn("size", F.count("e").over(own))
    ranked = ranked.withColumn("room", F.expr(f"size - {need(f'h + greatest(least, {unit})', 2)} + 2")).withColumn("most", F.expr(f"h >= {unit} and room <= {PREFIX}"))
    ranked = ranked.select("*", *(F.bit_or(F.expr(f"if(pmod(xxhash64(e, 1), 256) div 64 = {k}, shiftleft(1L, cast(pmod(xxhash64(e, 1), 64) as int)), 0L)")).over(own).alias(f"bits{k}") for k in range(4)))
    bits = [f"bits{k}" for k in range(4)]
    ranked = cut(ranked.filter(f"rank <= size - {need('h + least')} + 2").select("centre", "e", "id", "label", "h", "rank", "size", *bits, "room", "most", "least"))
    columns = ["id", "label", "h", "size", "rank", "most", *bits]
    side = lambda d, name, *keys: d.select(*keys, *(F.col(c).alias(f"{name}_{c}") for c in columns))
    lacks = lambda x, y: " + ".join(f"bit_count({x}_bits{k} & ~{y}_bits{k})" for k in range(4))
    wanted = f"""struct(x_h, x_id) < struct(y_h, y_id) and x_label <> y_label and x_h + y_h > 0
        and x_size - ({lacks('x', 'y')}) >= {need('x_h + y_h')} and y_size - ({lacks('y', 'x')}) >= {need('x_h + y_h')}"""

    # on two differences
    place = F.struct("rank", "e")
    few = ranked.filter("most and rank <= room").groupBy("centre", "id", "label", "h", "size", "most", *bits).agg(F.array_sort(F.collect_list(place)).alias("first"))
    two = F.flatten(F.transform("first", lambda p, i: F.transform(F.slice("first", i + 2, PREFIX), lambda q: F.struct(F.xxhash64(p["e"], q["e"]).alias("e"), q["rank"].alias("rank")))))
    few = few.select("centre", "id", "label", "h", "size", "most", *bits, F.inline(two))
    x, y = side(few.filter(f"rank <= size - {need('2 * h', 2)} + 2"), "x", "centre", "e"), side(few, "y", "centre", "e")
    both = x.join(y, ["centre", "e"]).filter(f"{wanted} and 2 + least(x_size - x_rank, y_size - y_rank) >= {need('x_h + y_h')}")

    # on one; a member's row names the kind of partner that it looks for
    one = ranked.filter(f"rank <= size - {need('h + least')} + 1").withColumn("seeks", F.explode(F.when(F.col("most"), F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True)))))
    other = ranked.groupBy("centre").agg(F.bool_or(~F.col("most")).alias("any")).filter("any").select("centre")
    one = one.join(other, "centre", "left_semi")
    x = side(one.filter(f"rank <= size - {need('2 * h')} + 1"), "x", "centre", "e", F.col("most").alias("kind"), F.col("seeks").alias("sought"))
    y = side(one, "y", "centre", "e", F.col("seeks").alias("kind"), F.col("most").alias("sought"))
    single = x.join(y, ["centre", "e", "kind", "sought"]).filter(f"{wanted} and 1 + least(x_size - x_rank, y_size - y_rank) >= {need('x_h + y_h')}")
    return both.unionByName(single.select(*both.columns)).select("centre", F.col("x_id").alias("a"), F.col("y_id").alias("b")).distinct()


def _across(members: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between members of one centre: those that need no common difference, through the
    nearest member, and those that have enough of them."""
    m = _apart(members, percent)
    free = m.filter("h + least <= 0 and id <> nearest").select(F.col("id").alias("a"), F.col("nearest").alias("b"))
    meet = cut(_meet(m, percent))
    for side in "ab":
        meet = meet.join(m.select("centre", F.col("id").alias(side), F.col("h").alias(f"h_{side}"), F.col("d").alias(f"d_{side}")), ["centre", side])
    return free.union(meet.filter(f"{2 * (100 + percent)} * size(array_intersect(d_a, d_b)) >= h_a + h_b").select("a", "b"))


def near_duplicates(docs: DataFrame, percent: int = 75, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): components of the documents whose shingle sets
    have 100 * intersection >= ``percent`` * union; ``kept`` marks the smallest doc_id of each.

    Defined results: a text of one to four words is one shingle; a null or empty text has no
    shingle and is a component of its own; rows with a null doc_id are left out; of rows that
    share a doc_id the one with the greatest text stays; other columns are not read.
    """
    m = bands * rows
    texts = keyed(docs, "doc_id", "text")
    signed = cut(texts.mapInArrow(_signed_rows(bands, rows), "doc_id long, n long, set_a long, set_b long, keys array<long>"))
    same = ["n", "set_a", "set_b"]
    classes = cut(signed.filter("n > 0").groupBy(*same).agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")))
    single = signed.select("doc_id", "keys").join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")

    member = single.select(F.explode("keys").alias("key"), F.col("doc_id").alias("id"))
    shared = cut(member.groupBy("key").agg(F.count("id").alias("size")).filter("size > 1"))
    member = cut(matched(member, shared, ["key"], "size", "id"))
    degree = member.groupBy("id").agg(F.sum(F.col("size") - 1).alias("degree"))
    centre = member.join(degree, "id").groupBy("key").agg(F.max(F.struct("degree", (-F.col("id")).alias("minus"))).alias("top"), F.max("size").alias("asked"))
    centre = cut(centre.select("key", (-F.col("top.minus")).alias("other"), "asked"))
    star = cut(matched(member, centre, ["key"], "asked", "id").filter("id <> other").select("id", "other").distinct())

    # a centre may have a third of all members: they are dealt out over copies of its text
    often = cut(star.groupBy("other").agg(F.count("*").alias("asked")))
    star = matched(star, often, ["other"], "asked", "id").withColumn("copies", F.expr(f"cast(1 + asked div {DEALT} as int)")).select("id", "other", "copies")
    star = cut(star.withColumn("salt", F.expr("cast(pmod(xxhash64(id), copies) as int)")))
    # few documents meet another one: where a count says so, their ids go to all tasks and the other texts stay
    asked = cut(star.select(F.col("id").alias("doc_id")).union(star.select("other")).distinct())
    if asked.count() <= NAMED:
        texts = texts.join(F.broadcast(asked), "doc_id", "left_semi")
    ends = star.select("other", "copies").distinct().join(texts.select(F.col("doc_id").alias("other"), F.col("text").alias("text_other")), "other")
    ends = ends.select("other", "text_other", F.explode(F.expr("sequence(0, copies - 1)")).alias("salt"))
    pairs = star.select("id", "other", "salt").join(texts.select(F.col("doc_id").alias("id"), F.col("text").alias("text_id")), "id").join(ends, ["other", "salt"])
    pairs = cut(pairs.select("id", "other", "text_id", "text_other").mapInArrow(_compare, _COMPARED))
    links = pairs.filter(f"100 * both >= {percent} * (n_id + n_other - both)").select(F.col("id").alias("a"), F.col("other").alias("b"))
    labels = components(links)
    named = pairs.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
    middle = _salted(labels.select(F.col("id").alias("other"), F.col("label").alias("middle")))
    named = named.join(middle, ["other", "salt"], "left").withColumn("middle", F.coalesce("middle", "other")).withColumnRenamed("other", "centre").withColumnRenamed("n_id", "n")
    mixed = named.groupBy("centre").agg(F.min(F.least("label", "middle")).alias("lo"), F.max(F.greatest("label", "middle")).alias("hi"), F.count("id").alias("size")).filter("lo < hi and size > 1")
    members = cut(named.join(_salted(mixed.select("centre")), ["centre", "salt"], "left_semi").select("centre", "salt", "id", "label", "n", "n_other", "both", "more", "less"))
    if not members.isEmpty():
        labels = components(links.union(_across(members, percent)))

    named = cut(classes.join(labels.withColumnRenamed("id", "rep"), "rep", "left").select(*same, F.coalesce("label", "rep").alias("component_id"), "copies"))
    out = matched(signed.filter("n > 0").select("doc_id", *same), named, same, "copies", "doc_id").select("doc_id", "n", "component_id")
    out = out.union(signed.filter("n = 0").select("doc_id", "n", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id").withColumn("kept", F.expr("doc_id = component_id"))


ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(list_slice(w, i, i + 4), ' ') END AS k
      FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON p.a = x.doc_id JOIN n y ON p.b = y.doc_id WHERE 100 * common >= 75 * (x.n + y.n - common)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(m.low, d.doc_id)) AS component_id, d.doc_id = least(d.doc_id, coalesce(m.low, d.doc_id)) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS low FROM r GROUP BY a) m USING (doc_id)
"""
