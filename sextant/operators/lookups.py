"""References, callers, members, dependencies, injection, usages and parameters.

Every operator returns ENTRY columns and ``ord``; a limit takes the first rows by ``ord``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sextant.facts import Facts
from sextant.functions import predicates as P
from sextant.functions.text import member_signature
from sextant.operators.graph import bfs
from sextant.operators.resolve import first_of
from sextant.plans.store import cut

ENTRY = ["path", "line", "col", "context", "containing"]


def entry(df: DataFrame, context: Column | str, containing: Column | str, *extra: str) -> DataFrame:
    as_column = lambda c: F.col(c) if isinstance(c, str) else c
    return df.select("path", "line", "col", as_column(context).alias("context"), as_column(containing).alias("containing"), "ord", *extra)


def limited(df: DataFrame, limit: int | None) -> DataFrame:
    return df.orderBy("ord").limit(limit) if limit else df


def references(facts: Facts, target_id: int) -> DataFrame:
    """Q1: every place that names the symbol."""
    return entry(facts.refs.filter(F.col("target_id") == target_id), "context", "containing")


def overriding(facts: Facts, bases: DataFrame | None = None) -> DataFrame:
    """(base, id): method ``id`` overrides or implements method ``base``, over any number of steps:
    its type is below the other's, and name and parameter types are the same. ``bases`` (base)
    limits the methods asked about. Only methods of types that have others below them are bases; where there
    is none nothing else is read."""
    m = facts.members.filter("kind = 'method'").select("member_id", "type_id", "name")
    down = cut(facts.bases.filter("super_id is not null").select(F.col("super_id").alias("src"), F.col("type_id").alias("dst")).distinct())
    heads = cut(down.select(F.col("src").alias("super")).distinct())
    sup = m.select(F.col("member_id").alias("base"), F.col("type_id").alias("super"), "name").join(heads, "super", "left_semi")
    if bases is not None:
        sup = sup.join(bases.select("base").distinct(), "base", "left_semi")
    sup = cut(sup)
    if sup.isEmpty():
        return facts.members.sparkSession.createDataFrame([], "base long, id long")
    roots = sup.select(F.col("super").alias("root"), F.col("super").alias("id")).distinct()
    below = bfs(down, roots.select("root", "id")).filter("depth > 0").select(F.col("root").alias("super"), F.col("id").alias("type_id"))
    # each method with the types above its own, then by (type, name): no base's methods meet all its descendants
    asked = m.join(cut(sup.select("name").distinct()), "name", "left_semi").join(below, "type_id")
    named = cut(asked.join(sup, ["super", "name"]).filter("base <> member_id").select("base", F.col("member_id").alias("id")))
    both = named.select(F.col("base").alias("member_id")).union(named.select("id")).distinct()
    types = F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "type_display"))), lambda p: p["type_display"]))
    shapes = facts.params.join(both, "member_id", "left_semi").groupBy("member_id").agg(types.alias("shape"))
    for column in ("base", "id"):
        named = named.join(shapes.select(F.col("member_id").alias(column), F.col("shape").alias(f"of_{column}")), column, "left")
    return named.filter("of_base <=> of_id").select("base", "id").distinct()


def cascade(facts: Facts, method_id: int) -> DataFrame:
    """(id): the method, the methods that it implements or overrides, and those that override or
    implement it."""
    m = facts.members.filter("kind = 'method'").select("member_id", "name")
    namesakes = m.join(F.broadcast(m.filter(F.col("member_id") == method_id).select("name").distinct()), "name").select(F.col("member_id").alias("base"))
    pairs = cut(overriding(facts, namesakes))
    own = facts.members.filter(F.col("member_id") == method_id).select(F.col("member_id").alias("id"))
    return own.union(pairs.filter(F.col("base") == method_id).select("id")).union(pairs.filter(F.col("id") == method_id).select("base")).distinct()


def callers(facts: Facts, method_id: int, cascading: bool = True) -> DataFrame:
    """Q2: every call of the method, directly or through what it implements or overrides."""
    wanted = cut(cascade(facts, method_id) if cascading else facts.members.filter(F.col("member_id") == method_id).select(F.col("member_id").alias("id")))
    return entry(facts.calls.join(wanted, facts.calls["callee_id"] == wanted["id"], "left_semi"), "context", "containing", "caller_id")


def call_chain(facts: Facts, method_id: int, depth: int = 5, cascading: bool = True) -> DataFrame:
    """Q3: callers of callers, each at its least depth and its first place; ``depth`` rounds."""
    calls = facts.calls.filter("caller_id is not null and callee_id is not null").select("caller_id", "callee_id", "path", "line", "col", "containing", "ord")
    if cascading:  # a call of a method may reach those that override it, and what it overrides
        pairs = cut(overriding(facts))
        other = pairs.union(pairs.select("id", "base")).toDF("callee_id", "reached")
        if not pairs.isEmpty():
            reached = calls.join(other, "callee_id").drop("callee_id").withColumnRenamed("reached", "callee_id")
            calls = calls.unionByName(reached.select(*calls.columns))
    calls = cut(calls)  # read for the rounds and for the places
    edges = cut(calls.select(F.col("callee_id").alias("src"), F.col("caller_id").alias("dst")).distinct())
    spark = facts.calls.sparkSession
    root = spark.createDataFrame([(method_id, method_id)], "root long, id long")
    found = bfs(edges, root, depth).filter("depth > 0").select(F.col("id").alias("caller_id"), "depth")
    before = cut(bfs_parents(edges, found, method_id))
    places = calls.join(before, ["caller_id", "callee_id"])
    name = facts.members.select(F.col("member_id").alias("caller_id"), F.col("name").alias("caller"))
    rows = first_of(places, "caller_id").join(name, "caller_id", "left")
    label = F.concat(F.lit("[depth "), F.col("depth").cast("string"), F.lit("] "), F.coalesce("containing", "caller"))
    return entry(rows, label, "containing", "caller_id", "depth")


def bfs_parents(edges: DataFrame, found: DataFrame, root: int) -> DataFrame:
    """(caller_id, callee_id, depth): the calls by which each caller was met at its least depth."""
    level = found.select(F.col("caller_id").alias("callee_id"), F.col("depth").alias("below")).union(found.sparkSession.createDataFrame([(root, 0)], "callee_id long, below int"))
    pairs = edges.select(F.col("src").alias("callee_id"), F.col("dst").alias("caller_id"))
    return pairs.join(found, "caller_id").join(level, "callee_id").filter("depth = below + 1").select("caller_id", "callee_id", "depth")


def descendants(facts: Facts, type_id: int) -> DataFrame:
    """(type_id) of everything below a type, by any number of steps: from the hierarchy index, or by
    a round a step where the facts have none."""
    if facts.hierarchy is not None:
        return facts.hierarchy.descendants(type_id)
    down = facts.bases.filter("super_id is not null").select(F.col("super_id").alias("src"), F.col("type_id").alias("dst")).distinct()
    root = facts.types.sparkSession.createDataFrame([(type_id, type_id)], "root long, id long")
    return bfs(down, root).filter("depth > 0").select(F.col("id").alias("type_id")).distinct()


def implementing(facts: Facts, type_id: int) -> DataFrame:
    """The first declarations of the types that implement an interface, also through others."""
    below = facts.types.join(descendants(facts, type_id), "type_id", "left_semi").filter("kind <> 'interface'")
    return first_of(below, "type_id")


def implementations(facts: Facts, type_id: int) -> DataFrame:
    """Q4: the types that implement an interface."""
    return entry(implementing(facts, type_id), "context", "name", "type_id")


def inheritors(facts: Facts, type_id: int) -> DataFrame:
    """Q5: the types derived from a class, or the implementers of an interface."""
    below = facts.types.join(descendants(facts, type_id), "type_id", "left_semi")
    is_interface = facts.types.filter((F.col("type_id") == type_id) & (F.col("kind") == "interface")).select(F.lit(True).alias("of_interface")).limit(1)
    rows = first_of(below, "type_id").join(F.broadcast(is_interface), F.lit(True), "left").filter("of_interface is null or kind <> 'interface'")
    return entry(rows, "context", "name", "type_id")


def members(facts: Facts, type_id: int) -> DataFrame:
    """Q6: explicit members without accessors."""
    own = facts.members.filter((F.col("type_id") == type_id) & ~F.col("is_implicit") & ~F.col("is_accessor"))
    name = facts.types.select("type_id", F.col("name").alias("type_name")).distinct()
    return entry(own.join(F.broadcast(name.filter(F.col("type_id") == type_id)), "type_id"), member_signature(), "type_name")


def dependencies(facts: Facts, type_id: int) -> DataFrame:
    """Q7: constructor parameters, then fields, then properties, without the primitive types."""
    own = facts.members.filter((F.col("type_id") == type_id) & ~F.col("is_implicit"))
    name = first_of(facts.types.filter(F.col("type_id") == type_id), "type_id").select("type_id", F.col("name").alias("type_name"))
    ctor = own.filter("kind = 'constructor'").select("member_id", "type_id").join(facts.params, "member_id")
    mods = F.concat_ws(" ", F.when(F.col("is_static"), F.lit("static")), F.when(F.col("is_readonly"), F.lit("readonly")))
    field = F.concat(F.when(mods != "", F.concat(mods, F.lit(" "))).otherwise(""), F.lit("field: "), F.col("value_type"), F.lit(" "), F.col("name"))
    row = lambda df, kind, text, type_col: df.withColumn("kind_ord", F.lit(kind)).select("type_id", "kind_ord", F.lit(1).alias("col"), text.alias("text"), F.col(type_col).alias("dependency"), "path", "line", "ord")
    labelled = lambda label, t: F.concat(F.lit(label), F.col(t), F.lit(" "), F.col("name"))
    rows = row(ctor, 0, labelled("constructor parameter: ", "type_display"), "type_display")
    rows = rows.unionByName(row(own.filter("kind = 'field'"), 1, field, "value_type"))
    rows = rows.unionByName(row(own.filter("kind = 'property'"), 2, labelled("property: ", "value_type"), "value_type"))
    rows = rows.filter(~P.is_primitive(F.col("dependency"))).join(F.broadcast(name), "type_id")
    return rows.select("path", "line", "col", F.col("text").alias("context"), F.col("type_name").alias("containing"), F.struct("kind_ord", "ord").alias("ord"), "dependency")


def injected(facts: Facts, target: int | str) -> DataFrame:
    """Q8: constructors with a parameter whose type is exactly the target, a type's id or the text
    of a type; one row each."""
    ctors = facts.members.filter("kind = 'constructor' and not is_implicit").select("member_id", "type_id", F.struct("path", "line", "col", "ord").alias("at"))
    hit = facts.params.filter(F.col("declared_id" if isinstance(target, int) else "type_display") == target).select("member_id", F.struct("ordinal", "ord").alias("place"), "type_display", "name")
    first = first_of(hit.join(ctors, "member_id").select("place", "name", "type_display", "type_id", "at.*"), "path", "line", "col", order="place")
    name = first_of(facts.types, "type_id").select("type_id", F.col("name").alias("type_name"))
    text = F.concat("type_name", F.lit("("), "type_display", F.lit(" "), "name", F.lit(")"))
    return entry(first.join(name, "type_id"), text, "type_name")


def usages(facts: Facts, target_id: int, namespace: str | None = None) -> DataFrame:
    """Q9: references with their kind; ``namespace`` is a prefix of the innermost one."""
    rows = facts.refs.filter(F.col("target_id") == target_id)
    if namespace:
        rows = rows.filter(F.col("in_type") & F.lower(F.coalesce("namespace", F.lit(""))).startswith(namespace.lower()))
    rows = rows.withColumn("usage", P.usage_kind(F.col("kinds")))
    return entry(rows, F.concat(F.lit("["), "usage", F.lit("] "), "context"), "containing", "usage")


def parameters(facts: Facts, name: str | None = None, type_name: str | None = None) -> DataFrame:
    """Q10: parameters by parts of their name and type, whatever the case; one row per place."""
    if not name and not type_name:
        raise ValueError("give a name or a type")
    rows = facts.params
    for column, kind, part in (("name", "parameter", name), ("type_display", "parameter type", type_name)):
        if part and facts.names is not None:
            rows = rows.join(facts.names.containing(kind, part).withColumnRenamed("text", column), column, "left_semi")
        elif part:
            rows = rows.filter(F.lower(column).contains(part.lower()))
    owner = facts.members.filter("not is_implicit").select("member_id", "type_id", F.col("name").alias("member"))
    types = first_of(facts.types.filter("depth <= 1"), "type_id").select("type_id", F.col("name").alias("type_name"))
    rows = rows.join(owner, "member_id").join(types, "type_id")
    text = F.concat("member", F.lit(" — parameter: "), "type_display", F.lit(" "), "name")
    return first_of(entry(rows, text, F.concat("type_name", F.lit("."), "member")), "path", "line", "col")
