"""Code health: complexity, coupling, cohesion, scores, and the one-row snapshot."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sextant.facts import Facts
from sextant.functions import predicates as P
from sextant.operators import central, graph
from sextant.operators.resolve import first_of
from sextant.plans.store import cut

NODE_KINDS = ["if", "case", "case pattern", "arm", "conditional", "for", "foreach", "while", "do", "catch", "&&", "||", "??", "?."]


def cyclomatic(nodes: DataFrame) -> DataFrame:
    """A1: (member_id, complexity) from (member_id, kind): 1 and the branching nodes."""
    return nodes.groupBy("member_id").agg((F.count_if(F.col("kind").isin(NODE_KINDS)) + 1).alias("complexity"))


def used(facts: Facts) -> DataFrame:
    """Distinct (type_id, used_id) of all types."""
    return facts.type_uses.select("type_id", "used_id").filter("type_id <> used_id").distinct()


def efferent(facts: Facts, types: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """A2: distinct (type_id, used_id) among ``types``."""
    ids = types.select("type_id").distinct()
    pairs = used(facts) if pairs is None else pairs
    return pairs.join(ids, "type_id", "left_semi").join(ids.withColumnRenamed("type_id", "used_id"), "used_id", "left_semi")


def coupling(facts: Facts, types: DataFrame) -> DataFrame:
    """A2-A4: (type_id, ce, ca, instability). A type is also depended on by those that depend on
    an interface that it declares."""
    ids = cut(types.select("type_id").distinct())
    every = cut(used(facts))
    pairs = efferent(facts, ids, every)
    direct = pairs.select(F.col("used_id").alias("type_id"), F.col("type_id").alias("by"))
    declared = cut(facts.bases.filter("edge = 'interface' and super_id is not null").select("type_id", F.col("super_id").alias("iface")))
    named = every.select(F.col("type_id").alias("by"), F.col("used_id").alias("iface")).join(declared.select("iface").distinct(), "iface", "left_semi").join(ids.withColumnRenamed("type_id", "by"), "by", "left_semi")
    through = cut(declared.join(named, "iface").select("type_id", "by").filter("type_id <> by"))
    by = direct if through.isEmpty() else direct.union(through).distinct()  # direct ones are distinct as they are
    ca = cut(by.groupBy("type_id").agg(F.count("by").alias("ca")))
    ce = cut(every.groupBy("type_id").agg(F.count("used_id").alias("ce")))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    out = ids.join(ce, "type_id", "left").join(ca, "type_id", "left").select("type_id", zero("ce"), zero("ca"))
    return out.withColumn("instability", P.instability(F.col("ce"), F.col("ca")))


_SOLVED = pa.schema([("type_id", pa.int64()), ("method_name", pa.string()), ("field", pa.string()), ("components", pa.int64())])


def _small_types(most: int):
    """The components of types with ``most`` uses at a time, of rows that come sorted by type; the
    uses of larger types are passed on as they are."""

    def solved(rows: pa.Table) -> pa.RecordBatch:
        owner = rows.column("type_id").to_numpy()
        place = lambda c: rows.select(["type_id", c]).append_column("at", pa.array(np.arange(len(rows)))).group_by(["type_id", c]).aggregate([("at", "list")])
        ends = []
        for c in ("method_name", "field"):
            lists = place(c).column("at_list").combine_chunks()
            code = np.empty(len(rows), np.int64)
            code[lists.flatten().to_numpy()] = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy())
            ends.append(code)
        m, f = ends
        label = np.arange(m.max() + 1)
        while True:  # each method takes the least label of those that it shares a field with
            low = np.full(f.max() + 1, len(label))
            np.minimum.at(low, f, label[m])
            new = label.copy()
            np.minimum.at(new, m, low[f])
            np.minimum.at(new, label, new.copy())
            while (new[new] != new).any():
                new = new[new]
            if (new == label).all():
                break
            label = new
        own = np.empty(len(label), np.int64)
        own[m] = owner
        types, n = np.unique(own[label == np.arange(len(label))], return_counts=True)
        return pa.RecordBatch.from_pydict({"type_id": types, "method_name": pa.nulls(len(types), pa.string()), "field": pa.nulls(len(types), pa.string()), "components": n}, schema=_SOLVED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["type_id", "method_name", "field"]
        held, large = None, None  # uses of the types that are not known to be whole; a type that is too large
        for batch in batches:
            rows = pa.Table.from_batches([batch.select(names)])
            rows = rows if held is None else pa.concat_tables([held, rows])
            owner = rows.column("type_id").to_numpy()
            if not len(owner):
                continue
            first = int(np.searchsorted(owner, owner[-1]))  # where the last type starts
            if first:
                yield from parts(rows.slice(0, first), large)
            held = rows.slice(first)
            if len(held) > most:
                large = int(owner[-1])
                yield from passed(held)
                held = held.slice(0, 0)
        if held is not None and len(held):
            yield from parts(held, large)

    def passed(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        yield from rows.append_column("components", pa.nulls(len(rows), pa.int64())).cast(_SOLVED).to_batches()

    def parts(rows: pa.Table, large: int | None) -> Iterator[pa.RecordBatch]:
        owner = rows.column("type_id").to_numpy()
        if large is not None and len(owner) and owner[0] == large:
            k = int(np.searchsorted(owner, large, "right"))
            yield from passed(rows.slice(0, k))
            rows, owner = rows.slice(k), owner[k:]
        if len(rows):
            _, at, n = np.unique(owner, return_index=True, return_counts=True)
            for k in np.flatnonzero(n > most):
                yield from passed(rows.slice(int(at[k]), int(n[k])))
            small = np.repeat(n <= most, n)
            if small.any():
                yield solved(rows.filter(pa.array(small)))

    return run


def cohesion(field_uses: DataFrame, most: int = 1 << 16) -> DataFrame:
    """A5: (type_id, components, cohesion) from (type_id, method_name, field): methods are
    connected when they share a field; 1 over the number of components. Components never leave
    a type, so those of types with ``most`` uses at most are found where the type's uses meet; the
    methods and fields of all larger types are the nodes of one graph."""
    uses = field_uses.select("type_id", "method_name", "field").filter("field is not null and method_name is not null and type_id is not null")
    met = uses.repartition("type_id").sortWithinPartitions("type_id")
    found = cut(met.mapInArrow(_small_types(most), "type_id long, method_name string, field string, components long"))
    n = found.filter("components is not null").select("type_id", "components")
    large = found.filter("components is null")
    if not large.isEmpty():
        n = n.union(_components(large))
    return n.select("type_id", "components", (1 / F.col("components")).alias("cohesion"))


def _components(field_uses: DataFrame) -> DataFrame:
    """(type_id, components) by one graph of all types."""
    uses = cut(field_uses.select("type_id", "method_name", "field").distinct())
    ends = uses.select("type_id", F.lit("m").alias("kind"), F.col("method_name").alias("name")).union(uses.select("type_id", F.lit("f"), "field")).distinct()
    seed = 0
    while True:  # names of 64 bits, tried until no two nodes share one
        node = lambda kind, name, seed=seed: F.xxhash64(F.lit(seed), "type_id", F.lit(kind), name)
        if ends.groupBy(F.xxhash64(F.lit(seed), "type_id", "kind", "name").alias("node")).count().filter("count > 1").isEmpty():
            break
        seed += 1
    links = cut(uses.select("type_id", node("m", "method_name").alias("src"), node("f", "field").alias("dst")))
    part = graph.connected(links.select("src", "dst")).filter("id = component").select(F.col("id").alias("node"))
    owner = links.select("type_id", F.explode(F.array("src", "dst")).alias("node")).distinct()
    return owner.join(part, "node").groupBy("type_id").agg(F.count("*").alias("components"))


def method_complexity(facts: Facts) -> DataFrame:
    """(type_id, n_methods, max_cc, max_method, avg_cc); of equal maxima the first by ``ord``."""
    m = facts.members.filter("has_body and kind in ('method', 'constructor')")
    best = F.max_by("name", F.struct("cyclomatic", -F.col("ord")))
    return m.groupBy("type_id").agg(F.count("*").alias("n_methods"), F.max("cyclomatic").cast("long").alias("max_cc"), best.alias("max_method"), F.avg("cyclomatic").alias("avg_cc"))


def health(facts: Facts, namespace: str | None = None) -> DataFrame:
    """Q14: the report of every type with 5 methods or 50 lines at least, worst first by
    (score desc, ord)."""
    types = facts.types.filter(~P.test_project(F.col("project")) & ~P.excluded_path(F.col("path"), migrations=False) & ~F.col("kind").isin("interface", "enum", "delegate") & ~F.col("all_abstract"))
    if namespace:
        types = types.filter(F.lower(F.coalesce("namespace", F.lit(""))).startswith(namespace.lower()))
    types = first_of(types, "display")
    rows = (
        types.withColumn("lines", (F.col("end_line") - F.col("line") + 1).cast("long")).join(method_complexity(facts), "type_id", "left").join(coupling(facts, types), "type_id", "left").join(cohesion(facts.field_uses), "type_id", "left")
        .fillna(0, ["n_methods", "max_cc"]).fillna(0.0, ["avg_cc"]).fillna(1.0, ["cohesion"]).fillna(1, ["components"])
        .filter("n_methods >= 5 or lines >= 50")
    )
    score = P.composite_score(F.col("max_cc"), F.col("lines"), F.col("ce"), F.col("ca"), F.col("cohesion"))
    return rows.select(
        "name", "display", "path", "line", "lines", "n_methods", "max_cc", "max_method", F.round("avg_cc", 6).alias("avg_cc"), "ce", "ca", F.round("instability", 6).alias("instability"),
        F.round("cohesion", 6).alias("cohesion"), "components", score.alias("score"), "ord",
    )


def nearest_rank(column: str, share: float) -> Column:
    """A9: the nearest-rank percentile."""
    return F.expr(f"percentile_disc({share}) within group (order by {column})")


def file_graph(facts: Facts) -> tuple[DataFrame, DataFrame]:
    """G1: vertices (id, loc) and edges (src, dst) between production files, by path. A type's
    file is that of its first declaration."""
    files = facts.files.filter(~P.test_project(F.col("project"), specs=True) & ~P.excluded_path(F.col("path")))
    files = files.withColumn("key", F.lower("path"))
    files = first_of(files.withColumn("o", F.struct("project_ord", "file_ord")), "key", order="o")
    vertices = files.select(F.col("path").alias("id"), "loc")
    home = first_of(facts.types.select("type_id", "path", "ord"), "type_id").select("type_id", F.col("path").alias("dst"))
    ids = vertices.select("id")
    home = home.join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    owner = home.select("type_id", "dst").union(facts.members.select(F.col("member_id"), "type_id").join(home, "type_id").select(F.col("member_id").alias("type_id"), "dst"))
    refs = facts.refs.select(F.col("target_id").alias("type_id"), F.col("path").alias("src")).join(ids.withColumnRenamed("id", "src"), "src", "left_semi")
    return vertices, graph.plain(refs.join(owner, "type_id"))


def cycles(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """Q16: (component, size) of the components of two or more, by (size desc, component)."""
    return graph.sizes(graph.scc(edges, vertices)).filter("size > 1")


def cycle_report(edges: DataFrame, vertices: DataFrame, top: int | None = None) -> DataFrame:
    """(rank, component, size, share, id): a row for each member of all cycles or the ``top`` largest."""
    found = cut(graph.scc(edges, vertices))
    best = graph.sizes(found).filter("size > 1")
    order = F.desc("size"), F.asc("component")
    if top:
        best = best.orderBy(*order).limit(top)
    total = F.broadcast(vertices.agg(F.countDistinct("id").alias("total")))
    ranked = graph.numbered(best, *order, name="rank").join(total).select(F.col("rank").cast("int").alias("rank"), "component", "size", F.round(F.col("size") / F.col("total"), 6).alias("share"))
    return graph.matched(found, ranked, ["component"], "size", "id").select("rank", "component", "size", "share", "id")


def break_points(edges: DataFrame, vertices: DataFrame, top: int = 5) -> DataFrame:
    """Q16 with suggestions: the most central nodes of the largest component, with their degrees
    inside it and three neighbours."""
    edges = graph.settled(edges)
    nodes = cut(graph.core(graph.scc(edges, vertices)))
    e = graph.settled(graph.inside(edges, nodes))
    near = e.groupBy(F.col("src").alias("id")).agg(F.slice(F.array_sort(F.collect_set("dst")), 1, 3).alias("sample"))
    rows = central.betweenness(e, nodes).join(graph.degrees(e, nodes), "id").join(near, "id", "left")
    return rows.withColumn("betweenness", F.round("betweenness", 6)).orderBy(F.desc("betweenness"), "id").limit(top)


def graph_snapshot(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """One row: files, edges, cycles, core size and share, reach (average, 95th, most with its
    node) and fan-out (average, most with its node). Ties go to the least id."""
    found = cut(graph.scc(edges, vertices))
    reach = cut(graph.reach_counts(edges, found))
    size = graph.sizes(found)
    first_max = lambda v, name: F.min(F.struct((-F.col(v)).alias("m"), "id"))["id"].alias(name)
    one = vertices.agg(F.countDistinct("id").alias("n_files"))
    one = one.crossJoin(graph.plain(edges).agg(F.count("*").alias("n_edges")))
    one = one.crossJoin(size.agg(F.count_if(F.col("size") > 1).alias("n_cycles"), F.coalesce(F.max(F.when(F.col("size") > 1, F.col("size"))), F.lit(0)).cast("long").alias("core_size")))
    one = one.crossJoin(reach.agg(F.round(F.avg("reach"), 6).alias("avg_reach"), nearest_rank("reach", 0.95).cast("long").alias("p95_reach"), F.max("reach").alias("max_reach"), first_max("reach", "max_reach_id")))
    one = one.crossJoin(graph.degrees(edges, vertices).agg(F.round(F.avg("fan_out"), 6).alias("avg_fan_out"), F.max("fan_out").alias("max_fan_out"), first_max("fan_out", "max_fan_out_id")))
    return one.withColumn("core_share", F.round(F.when(F.col("n_files") > 0, F.col("core_size") / F.col("n_files")).otherwise(0.0), 6))


def snapshot(facts: Facts, commit: str = "", committed: str = "") -> DataFrame:
    """Q15: the record of one commit, as one row of one-row aggregates."""
    vertices, edges = file_graph(facts)
    prod = facts.types.filter(~P.test_project(F.col("project"), specs=True) & ~P.excluded_path(F.col("path")))
    counts = prod.agg(F.count_if(F.col("kind").isin("class", "struct", "record")).alias("n_classes"), F.count_if(F.col("kind") == "interface").alias("n_interfaces"))
    lines = prod.filter("kind not in ('enum', 'delegate')").withColumn("lines", (F.col("end_line") - F.col("line") + 1).cast("long"))
    width = lambda df, v, name: df.agg(F.round(F.avg(v), 6).alias(f"avg_{name}"), nearest_rank(v, 0.95).cast("long").alias(f"p95_{name}"), F.max(v).cast("long").alias(f"max_{name}"), F.max_by("name", F.struct(F.col(v), -F.col("ord"))).alias(f"max_{name}_name"))
    owner = first_of(prod, "type_id").select("type_id", F.col("name").alias("owner"))
    methods = facts.members.filter("has_body and kind in ('method', 'constructor')").join(owner, "type_id")
    methods = methods.withColumn("name", F.concat("owner", F.lit("."), F.when(F.col("kind") == "constructor", "ctor").otherwise(F.col("name"))))
    one = graph_snapshot(edges, vertices).crossJoin(vertices.agg(F.coalesce(F.sum("loc"), F.lit(0)).alias("loc"))).crossJoin(counts)
    one = one.crossJoin(width(methods, "cyclomatic", "complexity")).crossJoin(width(lines, "lines", "class_loc"))
    return one.withColumn("commit", F.lit(commit)).withColumn("committed", F.lit(committed))


def snapshot_record(facts: Facts, solution: str = "", commit: str = "", committed: str = "") -> DataFrame:
    """Q15: the 27 fields of a snapshot, in their order; sizes of tests are those of the test projects."""
    tests = facts.files.filter(P.test_project(F.col("project"), specs=True) & ~P.excluded_path(F.col("path")))
    tests = first_of(tests.select(F.lower("path").alias("key"), "loc", F.struct("project_ord", "file_ord").alias("o")), "key", order="o")
    tests = tests.agg(F.count("*").cast("long").alias("files_test"), F.coalesce(F.sum("loc"), F.lit(0)).cast("long").alias("loc_test"))
    one = snapshot(facts, commit, committed).crossJoin(tests)
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias
    none = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias
    part = lambda c: F.coalesce(c, F.lit(0.0)).alias
    return one.select(
        F.col("committed").alias("commit_date"), "commit", F.lit(solution).alias("solution"), F.col("loc").cast("long").alias("loc_prod"), "loc_test", F.col("n_files").alias("files_prod"), "files_test",
        F.col("n_classes").alias("classes"), F.col("n_interfaces").alias("interfaces"), part("avg_reach")("avg_reach"), zero("p95_reach")("p95_reach"), zero("max_reach")("max_reach"), none("max_reach_id")("max_reach_file"),
        part("core_share")("core_size_pct"), F.col("core_size").alias("core_file_count"), F.col("n_cycles").alias("cycle_count"), part("avg_fan_out")("avg_fan_out"), zero("max_fan_out")("max_fan_out"), none("max_fan_out_id")("max_fan_out_file"),
        part("avg_complexity")("avg_cyclomatic"), zero("p95_complexity")("p95_cyclomatic"), zero("max_complexity")("max_cyclomatic"), none("max_complexity_name")("max_cyclomatic_method"),
        part("avg_class_loc")("avg_class_loc"), zero("p95_class_loc")("p95_class_loc"), zero("max_class_loc")("max_class_loc"), none("max_class_loc_name")("max_class_loc_name"),
    )
