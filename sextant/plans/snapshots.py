"""Fact tables that change: immutable files, and a manifest per version that says which of them count.

A table's rows carry the key that they were derived from (``_key``: an order, a file, a project) and
are dealt into buckets by it. A change of some keys rewrites the buckets that hold them, under the new
version's folder, and then appends one manifest; that single commit is the swap. Readers
name a version once and keep its files, whatever comes later. Manifests also carry the id of
the batch that made them, so a batch that is delivered twice changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Collection
from concurrent.futures import ThreadPoolExecutor

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sextant.streaming.usage import refresh

_MANIFEST = "version long, batch string, table string, bucket int, folder string"


class Snapshots:
    """``schemas`` has the columns of each table besides ``_key``, whose type is ``key``."""

    def __init__(self, spark: SparkSession, root: str, schemas: dict[str, str], key: str = "long", buckets: int = 16):
        self.spark, self.root, self.schemas, self.key, self.buckets = spark, root.rstrip("/"), schemas, key, buckets

    def _manifests(self) -> DataFrame:
        try:
            return self.spark.read.schema(_MANIFEST).parquet(f"{self.root}/_manifest")
        except AnalysisException:
            return self.spark.createDataFrame([], _MANIFEST)

    def version(self) -> int:
        """The newest version, 0 where there is none."""
        return self._manifests().agg(F.coalesce(F.max("version"), F.lit(0))).first()[0]

    def _folders(self, version: int) -> dict[tuple[str, int], str]:
        """A version's folder of each table and bucket: at most tables x buckets entries."""
        return {(r.table, r.bucket): r.folder for r in self._manifests().filter((F.col("version") == version) & F.col("folder").isNotNull()).collect()}

    def _open(self, table: str, folders: list[str]) -> DataFrame:
        columns = f"_key {self.key}, {self.schemas[table]}"
        if not folders:
            return self.spark.createDataFrame([], columns)
        return self.spark.read.schema(columns).parquet(*(f"{self.root}/{f}" for f in folders))

    def read(self, table: str, version: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """A table, or some of its buckets, as of a version, the newest if none is named."""
        folders = self._folders(self.version() if version is None else version)
        return self._open(table, [f for (t, b), f in sorted(folders.items()) if t == table and (buckets is None or b in buckets)])

    def _bucket(self) -> F.Column:
        return F.pmod(F.xxhash64("_key"), F.lit(self.buckets)).cast("int")

    def hit(self, changed: DataFrame) -> list[int]:
        """The buckets that hold the keys in ``changed`` (_key), at most ``buckets``."""
        return sorted(r.bucket for r in changed.select(F.col("_key").cast(self.key)).select(self._bucket().alias("bucket")).distinct().collect())

    def _known(self, batch: str) -> int | None:
        """The version that holds a batch."""
        return self._manifests().filter(F.col("batch") == batch).agg(F.min("version")).first()[0]

    def take(self, batch: str, rows: DataFrame, build: Callable[[DataFrame], tuple]) -> int:
        """Applies what ``build`` makes of the rows of a batch; of one that came before it makes nothing."""
        known = self._known(batch)
        return self.apply(batch, *build(rows)) if known is None else known

    def apply(self, batch: str, changed: DataFrame, deltas: dict[str, DataFrame], whole: Collection[str] = ()) -> int:
        """Replaces the rows of the keys in ``changed`` (_key) by those of ``deltas``, which have _key
        and a table's columns; tables without a delta keep theirs. The deltas of the tables in ``whole`` also
        have all other rows of the buckets that are hit. Returns the version that holds
        the batch. One writer at a time; a writer that died before its manifest is done over."""
        known = self._known(batch)
        if known is not None:
            return known
        old = self.version()
        new, folders = old + 1, self._folders(old)
        changed = changed.select(F.col("_key").cast(self.key)).distinct()
        hit = self.hit(changed)

        def written(table: str, delta: DataFrame) -> set[int]:
            names = [c.split()[0] for c in self._open(table, []).columns]
            rows = delta.withColumn("_key", F.col("_key").cast(self.key)).select(*names)
            if table not in whole:
                kept = self._open(table, [folders[table, b] for b in hit if (table, b) in folders]).join(changed, "_key", "left_anti")
                rows = kept.select(*names).unionByName(rows)
            to = f"{self.root}/{table}/v{new:012d}"
            # each task writes its rows of every bucket: nothing moves for that
            rows.withColumn("bucket", self._bucket()).write.partitionBy("bucket").mode("overwrite").option("compression", "zstd").parquet(to)
            return {r.bucket for r in self.spark.read.schema(f"_key {self.key}, bucket int").parquet(to).select("bucket").distinct().collect()}

        writers, held = "spark.sql.maxConcurrentOutputFileWriters", self.spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")
        self.spark.conf.set(writers, max(self.buckets, int(held)))  # a file for each bucket is open at once, so rows are not sorted by it
        try:
            with ThreadPoolExecutor(4) as pool:  # tables are independent jobs
                full = dict(zip(deltas, pool.map(written, deltas, deltas.values()), strict=True))
        finally:
            self.spark.conf.set(writers, held)
        for table in deltas:
            for b in hit:
                folders.pop((table, b), None)
                if b in full[table]:
                    folders[table, b] = f"{table}/v{new:012d}/bucket={b}"
        lines = [(new, batch, t, b, f) for (t, b), f in sorted(folders.items())] or [(new, batch, None, None, None)]
        self.spark.createDataFrame(lines, _MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.root}/_manifest")
        return new

    def vacuum(self, keep: int = 2) -> int:
        """Deletes the folders that none of the ``keep`` newest versions has; returns how many."""
        m, last = self._manifests().filter("folder is not null"), self.version()
        live = m.filter(F.col("version") > last - keep).select("folder").distinct()
        dead = [r.folder for r in m.select("folder").distinct().join(live, "folder", "left_anti").collect()]
        for folder in dead:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{folder}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        return len(dead)

    def follow(self, changes: DataFrame, build: Callable[[DataFrame], tuple], checkpoint: str, name: str = "stream", once: bool = False) -> StreamingQuery:
        """Applies each micro-batch of a stream: ``build`` makes the changed keys and the deltas of
        it, and names those that are whole. The stream's batch numbers, which a restart repeats, are the batch ids."""
        return refresh(changes, lambda rows, k: self.take(f"{name}-{k}", rows, build) and None, checkpoint, once=once)
