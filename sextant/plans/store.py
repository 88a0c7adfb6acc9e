"""Intermediate tables of the iterative operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new folder name below ``spark.checkpoint.dir``. Where that is unset a local session gets a
    temporary one; on a cluster, whose executors would each write to a disk of their own, that is
    an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="sextant-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/sextant-{uuid.uuid4().hex}"


def cut(df: DataFrame, files: int | None = None, options: dict[str, str] | None = None) -> DataFrame:
    """``df`` written to the shared folder, in at most ``files`` files and with ``options`` of the writer, and
    read again: an iterative plan stays short, and a lost executor costs a re-read only."""
    spark = df.sparkSession
    path = shared_folder(spark)
    (df.coalesce(files) if files else df).write.options(**options or {}).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written = path
    return out


def drop(table: DataFrame) -> None:
    """Deletes a table that ``cut`` has written, once no plan reads it any more."""
    path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table.written)
    path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
