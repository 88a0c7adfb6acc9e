"""Snapshots that follow a stream of line items, against a full build."""

from collections import Counter

from pyspark.sql import functions as F

from sextant.facts import SCHEMAS
from sextant.operators import metrics
from sextant.plans import star
from sextant.plans.snapshots import Snapshots

SF = "/root/testdata/sf0.001"


def rows(df, columns):
    return Counter(map(repr, df.select(*columns).collect()))


def test_three_batches_one_replayed(spark, tmp_path):
    t = star.tables(spark, SF)
    store = Snapshots(spark, f"file://{tmp_path}/store", star.stored_schemas(t), buckets=4)
    assert store.version() == 0 and star.created(store, t) == 1 and star.created(store, t) == 1
    # lines of one order come in different batches
    part = F.pmod(F.xxhash64("l_orderkey", "l_linenumber"), F.lit(3))
    for k in range(3):
        t["lineitem"].filter(part == k).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    for k in range(3):
        t["lineitem"].limit(0).coalesce(1).write.mode("append").parquet(f"{tmp_path}/stream")
    build = star.order_changes(store, t)
    pinned = None
    for k in range(3):
        spark.read.parquet(f"{tmp_path}/in/{k}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/stream")
        stream = spark.readStream.schema(t["lineitem"].schema).parquet(f"{tmp_path}/stream")
        store.follow(stream, build, f"{tmp_path}/checkpoint", once=True).awaitTermination(300)
        if k == 0:
            pinned = star.stored_facts(store, 2)
            before = rows(pinned.params, ["member_id", "ordinal", "ord"])
    assert store.version() == 4
    # a batch that is delivered again changes nothing, nor do its rows under another name
    assert store.apply("stream-1", *build(spark.read.parquet(f"{tmp_path}/in/1"))) == 3 and store.version() == 4
    store.apply("again", *build(spark.read.parquet(f"{tmp_path}/in/1")))
    now, full = star.stored_facts(store), star.facts(spark, SF)
    for name in SCHEMAS:
        columns = getattr(full, name).columns
        assert rows(getattr(now, name), columns) == rows(getattr(full, name), columns), name
    types = lambda f: f.types.filter("kind <> 'interface'")
    assert rows(metrics.coupling(now, types(now)), ["type_id", "ce", "ca"]) == rows(metrics.coupling(full, types(full)), ["type_id", "ce", "ca"])
    assert before and rows(pinned.params, ["member_id", "ordinal", "ord"]) == before
    assert store.vacuum(keep=1) > 0 and rows(star.stored_facts(store).params, ["ord"]) == rows(full.params, ["ord"])


def test_only_changed_buckets_are_rewritten(spark, tmp_path):
    store = Snapshots(spark, f"file://{tmp_path}/s", {"a": "x string"}, key="string", buckets=8)
    make = lambda *r: spark.createDataFrame(list(r), "_key string, x string")
    keys = lambda *r: spark.createDataFrame([(k,) for k in r], "_key string")
    store.apply("1", keys(*"abcdefgh"), {"a": make(*((k, "old") for k in "abcdefgh"))})
    first = store._folders(1)
    store.apply("2", keys("a", "z"), {"a": make(("z", "new"))})
    second = store._folders(2)
    assert sum(first.get(k) != v for k, v in second.items()) <= 2
    assert {tuple(r) for r in store.read("a").collect()} == {(k, "old") for k in "bcdefgh"} | {("z", "new")}
    assert {tuple(r) for r in store.read("a", 1).collect()} == {(k, "old") for k in "abcdefgh"}
    store.apply("3", keys(*"abcdefghz"), {"a": make()})
    assert store.read("a").collect() == [] and store.version() == 3 and store.read("a", 2).count() == 8


def test_a_batch_that_comes_again_is_not_built(spark, tmp_path):
    store = Snapshots(spark, f"file://{tmp_path}/s", {"a": "x string"}, key="string", buckets=2)
    built = []

    def build(rows):
        built.append(rows)
        return rows.select("_key"), {"a": rows}

    rows_ = spark.createDataFrame([("a", "1")], "_key string, x string")
    assert store.take("1", rows_, build) == 1 and store.take("1", rows_, build) == 1 and len(built) == 1


def test_whole_deltas_and_replaced_lines(spark, tmp_path):
    """Line items of null keys and doubled ones: a line that comes again takes the old one's place, null is like nothing."""
    t = star.tables(spark, SF)
    schema = t["lineitem"].schema
    store = Snapshots(spark, f"file://{tmp_path}/s", star.stored_schemas(t, "types", "bases", "type_uses"), buckets=3)
    star.created(store, t)
    build = star.order_changes(store, t)
    line = lambda o, n, p=1, s=1: {"l_orderkey": o, "l_linenumber": n, "l_partkey": p, "l_suppkey": s}
    make = lambda *r: spark.createDataFrame([tuple({**dict.fromkeys(schema.names), **x}.values()) for x in r], schema)
    store.take("1", make(line(1, 1), line(1, 1), line(1, 2), line(2, 1), line(None, 1), line(3, None)), build)
    store.take("2", make(line(1, 1), line(1, 3), line(None, 1), line(3, None), line(4, 1)), build)
    got = Counter((r.l_orderkey, r.l_linenumber) for r in store.read("lineitem").collect())
    assert got == {(1, 1): 1, (1, 2): 1, (2, 1): 1, (None, 1): 2, (3, None): 2, (1, 3): 1, (4, 1): 1}
    assert set(store.read("lineitem").columns) == {"_key", *star.LINE_KEYS}
