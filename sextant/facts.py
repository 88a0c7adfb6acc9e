"""The fact tables: one row per thing that the source code states.

``ord`` orders rows as a reader meets them (project, file, place); "first" always means least
``ord``. Ids are BIGINT and unique per table. Lines and columns count from 1.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from sextant.operators import hierarchy, names
from sextant.operators.hierarchy import Hierarchy
from sextant.operators.names import Names

_AT = "path STRING, line INT, col INT, context STRING, ord BIGINT"
_FLAGS = "accessibility STRING, is_static BOOLEAN, is_abstract BOOLEAN, is_virtual BOOLEAN, is_override BOOLEAN, is_sealed BOOLEAN, is_readonly BOOLEAN"

SCHEMAS: dict[str, str] = {
    "files": "project STRING, project_ord INT, file_ord INT, path STRING, text STRING, loc INT",
    "types": f"type_id BIGINT, project STRING, kind STRING, name STRING, display STRING, namespace STRING, parent_id BIGINT, depth INT, end_line INT, all_abstract BOOLEAN, {_FLAGS}, {_AT}",
    "members": f"member_id BIGINT, type_id BIGINT, kind STRING, name STRING, display STRING, signature STRING, value_type STRING, is_implicit BOOLEAN, is_accessor BOOLEAN, has_body BOOLEAN, cyclomatic INT, n_calls INT, single_call BIGINT, single_root STRING, single_links ARRAY<STRING>, multi_init BOOLEAN, {_FLAGS}, {_AT}",
    "params": f"member_id BIGINT, ordinal INT, name STRING, type_display STRING, type_kind STRING, declared_id BIGINT, {_AT}",
    "bases": "type_id BIGINT, super_id BIGINT, super_name STRING, edge STRING, ordinal INT",
    "type_uses": "type_id BIGINT, member_id BIGINT, role STRING, used_id BIGINT",
    "attrs": "owner_id BIGINT, name STRING",
    "refs": f"target_id BIGINT, target_kind STRING, containing STRING, kinds ARRAY<STRING>, namespace STRING, in_type BOOLEAN, {_AT}",
    "calls": f"call_id BIGINT, caller_id BIGINT, callee_id BIGINT, form STRING, name STRING, receiver STRING, receiver_root STRING, receiver_type STRING, receiver_member BOOLEAN, owner_name STRING, owner_namespace STRING, callee_static BOOLEAN, same_type BOOLEAN, type_args ARRAY<STRING>, arg_kinds ARRAY<STRING>, arg_texts ARRAY<STRING>, lambda_interp BOOLEAN, chain_root_type STRING, containing STRING, {_AT}",
    "accesses": f"type_id BIGINT, method_id BIGINT, receiver STRING, receiver_type STRING, receiver_member BOOLEAN, table_name STRING, member_type STRING, links ARRAY<STRING>, {_AT}",
    "assigns": f"method_id BIGINT, receiver_type STRING, in_add_init BOOLEAN, target STRING, {_AT}",
    "field_uses": "type_id BIGINT, method_name STRING, field STRING",
}


#: how ``Facts.save`` lays out the tables that symbols are looked up in
CLUSTERED = {"refs": "target_id", "calls": "callee_id"}
BUCKETED = {"members": "member_id", "params": "member_id"}
ROW_GROUP = 16 << 20


@dataclass
class Facts:
    """Lazy DataFrames under the names of SCHEMAS."""

    files: DataFrame
    types: DataFrame
    members: DataFrame
    params: DataFrame
    bases: DataFrame
    type_uses: DataFrame
    attrs: DataFrame
    refs: DataFrame
    calls: DataFrame
    accesses: DataFrame
    assigns: DataFrame
    field_uses: DataFrame
    #: the indexes, where the facts were saved
    hierarchy: Hierarchy | None = None
    names: Names | None = None

    @classmethod
    def empty(cls, spark: SparkSession, **given: DataFrame) -> Facts:
        return cls(**{n: given.get(n) if given.get(n) is not None else spark.createDataFrame([], s) for n, s in SCHEMAS.items()})

    def save(self, path: str, buckets: int = 32) -> None:
        """A snapshot that readers pin by its path.

        References are clustered by their target and calls by their callee (ranges, sorted, with a
        Bloom filter per row group), so a lookup of one symbol reads few row groups. Members and
        parameters are bucketed on the member, so their join moves no rows. The hierarchy and the
        names are stored as indexes.
        """
        spark = self.types.sparkSession
        for name_ in SCHEMAS:
            df, to = getattr(self, name_), f"{path}/{name_}"
            if name_ in CLUSTERED:
                key = CLUSTERED[name_]
                sorted_ = df.repartitionByRange(key, "ord").sortWithinPartitions(key, "ord")
                sorted_.write.option(f"parquet.bloom.filter.enabled#{key}", "true").option("parquet.block.size", str(ROW_GROUP)).parquet(to)
            elif name_ in BUCKETED:
                name = _table(path, name_)
                spark.sql(f"DROP TABLE IF EXISTS {name}")
                df.repartition(buckets, BUCKETED[name_]).write.bucketBy(buckets, BUCKETED[name_]).sortBy(BUCKETED[name_]).option("path", to).format("parquet").saveAsTable(name)
            else:
                df.write.parquet(to)
        hierarchy.build(self.types, self.bases).save(f"{path}/_hierarchy")
        names.build(self.types, self.members, self.params).save(f"{path}/_names")
        spark.createDataFrame([(buckets,)], "buckets int").coalesce(1).write.parquet(f"{path}/_layout")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Facts:
        """Bucketed tables are named in the session's catalog, which knows nothing of other sessions'."""
        buckets = spark.read.parquet(f"{path}/_layout").first().buckets
        out = {}
        for n, s in SCHEMAS.items():
            if n in BUCKETED:
                name = _table(path, n)
                if not spark.catalog.tableExists(name):
                    spark.sql(f"CREATE TABLE {name} ({s}) USING parquet CLUSTERED BY ({BUCKETED[n]}) SORTED BY ({BUCKETED[n]}) INTO {buckets} BUCKETS LOCATION '{path}/{n}'")
                out[n] = spark.table(name)
            else:
                out[n] = spark.read.schema(s).parquet(f"{path}/{n}")
        return cls(**out, hierarchy=Hierarchy.load(spark, f"{path}/_hierarchy"), names=Names.load(spark, f"{path}/_names"))


def _table(path: str, name: str) -> str:
    return f"facts_{hashlib.sha256(path.encode()).hexdigest()[:16]}_{name}"
