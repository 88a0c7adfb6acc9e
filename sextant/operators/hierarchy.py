"""The type hierarchy as an index: interval labels of the classes, and the closure of the interfaces.

A class has one base, so the classes are a forest; numbered in its order, everything below a
class is a range of numbers. Interfaces have any number of supers, so for them the pairs
themselves are stored. Building takes a round per level; a lookup is a range filter and an equality filter.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.operators.graph import bfs, levels, matched, numbered
from sextant.plans.store import cut

_SCHEMAS = {"spans": "type_id BIGINT, low BIGINT, high BIGINT", "closure": "super_id BIGINT, type_id BIGINT"}


@dataclass
class Hierarchy:
    """``spans`` (type_id, low, high): what is below a type has its low from low + 1 to high.
    ``closure`` (super_id, type_id): what is below an interface, by any number of steps."""

    spans: DataFrame
    closure: DataFrame

    def descendants(self, type_id: int) -> DataFrame:
        """(type_id) of everything below a type, without a loop."""
        own = self.spans.filter(F.col("type_id") == type_id).select(F.col("low").alias("from"), F.col("high").alias("to"))
        derived = self.spans.join(F.broadcast(own), (F.col("low") > F.col("from")) & (F.col("low") <= F.col("to"))).select("type_id")
        return derived.union(self.closure.filter(F.col("super_id") == type_id).select("type_id")).distinct()

    def save(self, path: str) -> None:
        for name, key in (("spans", "low"), ("closure", "super_id")):
            getattr(self, name).repartitionByRange(key, "type_id").sortWithinPartitions(key).write.option("parquet.bloom.filter.enabled#type_id", str(name == "spans").lower()).parquet(f"{path}/{name}")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Hierarchy:
        return cls(**{n: spark.read.schema(s).parquet(f"{path}/{n}") for n, s in _SCHEMAS.items()})


def build(types: DataFrame, bases: DataFrame) -> Hierarchy:
    """The index of ``types`` (type_id, kind) over ``bases``. A class with several base edges
    (partial declarations) has the one to the least id; cycles, which no compiler accepts, have no span."""
    ids = types.select("type_id").distinct()
    known = bases.filter("super_id is not null and super_id <> type_id")
    known = known.join(ids, "type_id", "left_semi").join(ids.withColumnRenamed("type_id", "super_id"), "super_id", "left_semi")
    up = cut(known.filter("edge = 'base'").groupBy("type_id").agg(F.min("super_id").alias("super_id")))
    steps = levels(up.select(F.col("super_id").alias("src"), F.col("type_id").alias("dst")))

    # sizes of subtrees from the leaves up, then places from the roots down
    inner = up.select(F.col("super_id").alias("type_id")).distinct()
    sized = ids.join(inner, "type_id", "left_anti").select("type_id", F.lit(1).cast("long").alias("size"))
    for step in steps:
        sums = up.join(step.withColumnRenamed("id", "super_id"), "super_id", "left_semi").join(sized, "type_id").groupBy(F.col("super_id").alias("type_id")).agg((F.sum("size") + 1).alias("size"))
        sized = sized.union(cut(sums))
    sized = cut(sized)
    children = numbered(up.join(sized, "type_id").select("super_id", "type_id", "size"), "super_id", "type_id", name="upto", weight="size").withColumn("at", F.col("upto") - F.col("size"))
    first = children.groupBy("super_id").agg(F.min("at").alias("start"), F.count("*").alias("n"))
    beside = cut(matched(children, first, ["super_id"], "n", "type_id").select("type_id", "super_id", "size", (F.col("at") - F.col("start") + 1).alias("offset")))
    roots = numbered(sized.join(up.select("type_id"), "type_id", "left_anti"), "type_id", name="upto", weight="size")
    spans = cut(roots.select("type_id", (F.col("upto") - F.col("size")).alias("low"), (F.col("upto") - 1).alias("high")))
    front = spans
    while True:
        above = front.select(F.col("type_id").alias("super_id"), F.col("low").alias("start")).join(beside.groupBy("super_id").agg(F.count("*").alias("n")), "super_id")
        front = cut(matched(beside, above, ["super_id"], "n", "type_id").select("type_id", (F.col("start") + F.col("offset")).alias("low"), (F.col("start") + F.col("offset") + F.col("size") - 1).alias("high")))
        if front.isEmpty():
            break
        spans = spans.union(front)

    interfaces = known.filter("edge = 'interface'").select(F.col("super_id").alias("id")).distinct()
    down = known.select(F.col("super_id").alias("src"), F.col("type_id").alias("dst"))
    closure = bfs(down, interfaces.select(F.col("id").alias("root"), "id")).filter("depth > 0").select(F.col("root").alias("super_id"), F.col("id").alias("type_id")).distinct()
    return Hierarchy(spans.select("type_id", "low", "high"), closure)
