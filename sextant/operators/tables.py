"""Who touches which database table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sextant.facts import Facts
from sextant.functions import predicates as P
from sextant.operators.graph import bfs
from sextant.operators.lookups import entry
from sextant.operators.resolve import first_of


def context_types(facts: Facts) -> DataFrame:
    """(name) of every type whose name, or that of a base, ends with DbContext."""
    own = facts.types.select("type_id", "name")
    based = facts.bases.filter("edge = 'base'")
    direct = own.filter(P.is_context(F.col("name"))).select("type_id").union(based.filter(P.is_context(F.col("super_name"))).select("type_id")).distinct()
    down = based.filter("super_id is not null").select(F.col("super_id").alias("src"), F.col("type_id").alias("dst"))
    found = bfs(down, direct.select(F.lit(0).cast("long").alias("root"), F.col("type_id").alias("id"))).select(F.col("id").alias("type_id"))
    return own.join(found.distinct(), "type_id", "left_semi").select("name").distinct()


def is_context_type(df: DataFrame, contexts: DataFrame, column: str) -> DataFrame:
    """``df`` with ``in_context``: the simple type name in ``column`` is a context's."""
    return df.join(contexts.select(F.col("name").alias(column), F.lit(True).alias("_ctx")), column, "left").withColumn("in_context", F.coalesce("_ctx", F.lit(False)) | P.is_context(F.col(column))).drop("_ctx")


def member_accesses(facts: Facts) -> DataFrame:
    """Accesses of a DbSet through a context-typed member of the accessing type itself."""
    hits = is_context_type(facts.accesses.filter(P.is_dbset(F.col("member_type")) & F.col("receiver_member")), context_types(facts), "receiver_type")
    return hits.filter("in_context")


def dbset_usage(facts: Facts, type_id: int) -> DataFrame:
    """Q11: every access of a table by one class."""
    name = first_of(facts.types.filter(F.col("type_id") == type_id), "type_id").select("type_id", F.col("name").alias("type_name"))
    return entry(member_accesses(facts).join(F.broadcast(name), "type_id"), "context", "type_name", "table_name")


def ownership_violations(facts: Facts, owner: str, tables: list[str]) -> DataFrame:
    """Q12: accesses of the owner's tables by other types, test projects apart; one row per
    place."""
    types = first_of(facts.types.filter(~P.test_project(F.col("project")) & (F.col("depth") <= 1)), "type_id")
    others = types.filter(~((F.col("name") == owner) | F.col("display").endswith(f".{owner}"))).select("type_id", F.col("name").alias("type_name"))
    rows = member_accesses(facts).filter(F.col("table_name").isin(tables)).join(others, "type_id")
    return first_of(entry(rows, "context", "type_name", "table_name"), "path", "line", "col")


def service_map(facts: Facts, namespace: str | None = None) -> DataFrame:
    """Q13: (name, path, line, injected, tables) of the types that are given a context: their
    injected interfaces in order, and the tables they use, sorted."""
    types = first_of(facts.types.filter(~P.test_project(F.col("project")) & (F.col("depth") <= 1)), "type_id")
    if namespace:
        types = types.filter(F.coalesce("namespace", F.lit("")).startswith(namespace))
    given = facts.members.filter("kind = 'constructor' and not is_implicit").select("member_id", "type_id", F.col("ord").alias("ctor_ord")).join(facts.params, "member_id")
    given = is_context_type(given, context_types(facts), "type_display")
    services = given.filter("in_context").select("type_id").distinct()
    injected = given.filter("type_kind = 'interface'").groupBy("type_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ctor_ord", "ordinal", "type_display"))), lambda p: p["type_display"]).alias("injected"))
    used = member_accesses(facts).groupBy("type_id").agg(F.array_sort(F.collect_set("table_name")).alias("tables"))
    rows = types.join(services, "type_id", "left_semi").join(injected, "type_id", "left").join(used, "type_id", "left")
    none = F.array().cast("array<string>")
    return rows.select("name", "path", "line", F.coalesce("injected", none).alias("injected"), F.coalesce("tables", none).alias("tables"))
