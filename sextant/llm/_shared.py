"""What the operators share: document keys and connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.operators.graph import connected, matched
from sextant.plans.store import cut, shared_folder

__all__ = ["components", "cut", "keyed", "matched", "shared_folder"]


_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def lean(spark: SparkSession) -> None:
    """Batches of 4 MB for Python workers, unless the application says otherwise: texts come in all
    lengths, and 10,000 long ones are more than a worker and its executor should hold."""
    if not spark.sparkContext.getConf().contains(_BATCH):
        spark.conf.set(_BATCH, "4m")


def keyed(docs: DataFrame, key: str, *columns: str) -> DataFrame:
    """``key`` and ``columns`` with one row per key.

    Rows with a null key are left out: no result could name them. Where a key is repeated, the
    row whose columns are greatest stays. The test for repeats reads the key column alone, so
    clean tables pay no shuffle of their texts.
    """
    lean(docs.sparkSession)
    rows = docs.select(key, *columns).filter(F.col(key).isNotNull())
    if rows.groupBy(key).count().filter("count > 1").isEmpty():
        return rows
    best = rows.groupBy(key).agg(F.max(F.struct(*columns)).alias("_best"))
    return best.select(key, *(F.col(f"_best.{c}").alias(c) for c in columns))


def components(edges: DataFrame) -> DataFrame:
    """(id, label) for every end of ``edges`` (a, b): the smallest id that it is connected with."""
    return connected(edges.toDF("src", "dst")).withColumnRenamed("component", "label")
