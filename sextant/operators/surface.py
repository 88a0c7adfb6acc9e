"""What calls a type's methods, and what they reach."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sextant.facts import Facts
from sextant.functions import predicates as P
from sextant.functions.text import dependency_name
from sextant.operators.graph import bfs, levels, plain, scc
from sextant.operators.lookups import overriding
from sextant.operators.tables import context_types, is_context_type
from sextant.plans.store import cut


def body_shapes(facts: Facts, type_id: int) -> DataFrame:
    """(member_id, shape, hint): the first rule of the table in the guide that fits."""
    m = facts.members.filter((F.col("type_id") == type_id) & (F.col("kind") == "method"))
    c = is_context_type(facts.calls.join(cut(m.select(F.col("member_id").alias("caller_id"))), "caller_id", "left_semi"), context_types(facts), "receiver_type")
    on_set = F.col("in_context") | F.coalesce(F.col("receiver_type").startswith("DbSet"), F.lit(False))
    writes = c.filter(F.col("name").isin(P.ALWAYS_WRITES) | F.col("name").isin(P.WRITES) & on_set)
    writes = writes.groupBy(F.col("caller_id").alias("member_id")).agg(F.min_by("name", "ord").alias("api"))
    kind = F.when(F.col("in_context"), "repo").otherwise(P.receiver_kind(F.col("receiver"), F.coalesce("receiver_root", "receiver_type"), F.col("receiver_member")))
    single = c.select(F.col("call_id").alias("single_call"), F.col("name").alias("call_name"), "form", "receiver", "receiver_type", kind.alias("call_kind"))
    rows = m.join(single, "single_call", "left").join(writes, "member_id", "left")
    linq = F.col("call_name").isin(P.LINQ)
    through = (F.col("form") == "member") & ~linq
    root = F.when(F.coalesce(F.col("single_root").endswith("DbContext") | F.col("single_root").endswith("Repository") | (F.col("single_root") == "IDbContextFactory"), F.lit(False)), "repo").when(F.col("single_root").isNotNull(), "service")
    chain = linq & (F.size("single_links") > 0) & F.forall("single_links", lambda x: x.isin(P.LINQ))
    suffix: Column = F.when(F.col("call_kind").isNull(), F.lit("")).otherwise(F.concat(F.lit("-"), "call_kind"))
    shape = (
        F.when(~F.col("has_body"), "abstract").when(F.col("api").isNotNull(), "write").when(through, F.concat(F.lit("passthrough"), suffix))
        .when((F.col("form") == "bare") & F.col("call_name").isNotNull(), "passthrough-self")
        .when(chain, F.concat(F.lit("linq-over-"), F.coalesce(root, F.lit("source")))).when((F.col("n_calls") >= 3) | F.col("multi_init"), "composite").otherwise("complex")
    )
    hint = (
        F.when(F.col("has_body") & F.col("api").isNotNull(), F.col("api")).when(F.col("has_body") & through, F.concat("receiver", F.lit("."), "call_name"))
        .when(F.col("has_body") & (F.col("form") == "bare"), F.concat(F.lit("this."), "call_name"))
        .when(shape == "composite", F.when(F.col("n_calls") >= 3, F.concat(F.col("n_calls").cast("string"), F.lit(" calls"))).otherwise("multi-field projection"))
    )
    return rows.select("member_id", shape.alias("shape"), hint.alias("hint"))


def surface_callers(facts: Facts, type_id: int) -> DataFrame:
    """(member_id, is_test, path, line, col, context, containing, ord): a row per place that calls an
    ordinary method of the type, or one that implements or overrides it, by the path below the solution."""
    methods = facts.members.filter((F.col("type_id") == type_id) & (F.col("kind") == "method") & ~F.col("is_implicit"))
    own = methods.select(F.col("member_id").alias("id"), F.col("member_id").alias("method"))
    targets = cut(own.union(overriding(facts, methods.select(F.col("member_id").alias("base"))).select("id", F.col("base").alias("method"))).distinct())
    called = facts.calls.join(targets.select(F.col("id").alias("callee_id")), "callee_id", "left_semi")  # goes down to where the callees stem from
    calls = called.join(targets, called["callee_id"] == targets["id"]).select(F.col("method").alias("member_id"), "path", "line", "col", "context", "containing", "ord")
    best = calls.groupBy("member_id", "path", "line", "col").agg(F.min_by(F.struct("context", "containing", "ord"), F.struct("ord", "context", "containing")).alias("first"))
    return best.select("member_id", P.test_path(F.col("path")).alias("is_test"), "path", "line", "col", "first.*")


def audit_surface(facts: Facts, type_id: int) -> DataFrame:
    """Q21: (name, signature, prod_count, test_count, shape, hint, ord, member_id) of the ordinary
    methods of an interface or class; ``surface_callers`` has the callers that are counted. An
    interface's methods have no shape."""
    methods = facts.members.filter((F.col("type_id") == type_id) & (F.col("kind") == "method") & ~F.col("is_implicit"))
    counts = surface_callers(facts, type_id).groupBy("member_id").agg(F.count_if(~F.col("is_test")).alias("prod_count"), F.count_if("is_test").alias("test_count"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    is_interface = facts.types.filter((F.col("type_id") == type_id) & (F.col("kind") == "interface")).select("type_id").distinct()
    shapes = body_shapes(facts, type_id).join(methods.join(is_interface, "type_id", "left_anti").select("member_id"), "member_id", "left_semi")
    rows = methods.join(counts, "member_id", "left").join(shapes, "member_id", "left")
    return rows.select("name", F.coalesce("signature", "name").alias("signature"), zero("prod_count"), zero("test_count"), "shape", "hint", "ord", "member_id")


def classified_calls(facts: Facts, callers: DataFrame, contexts: DataFrame) -> DataFrame:
    """The calls of ``callers`` (caller_id) with ``class``: dependency, helper or external, the first rule
    that fits; ignored ones are left out. Only what the rules and lists ask for is kept of a call."""
    of = facts.calls.select("caller_id", "callee_id", "name", "form", "receiver", "receiver_type", "receiver_member", "owner_name", "owner_namespace", "callee_static", "same_type")
    io = P.is_external_io(F.col("owner_namespace"))
    member = (F.col("form") == "member") & F.col("receiver_member")
    c = is_context_type(of.filter(member | (F.col("form") == "member") & io | (F.col("form") == "bare")), contexts, "receiver_type")
    what = (
        F.when((F.col("form") == "member") & F.col("name").isin(P.SAVES), "ignored").when(member & F.col("in_context"), "ignored").when(member, "dependency")
        .when(F.col("form") == "member", F.when(io, "external").otherwise("ignored"))
        .when(F.col("form") == "bare", F.when(F.col("same_type"), "helper").when(F.col("callee_static"), "external").otherwise("ignored")).otherwise("ignored")
    )
    found = c.withColumn("class", what).filter("class <> 'ignored'").select("caller_id", "callee_id", "class", "name", "receiver", "receiver_type", "owner_name")
    return found.join(callers, "caller_id", "left_semi")


def dbset_effects(facts: Facts, methods: DataFrame) -> DataFrame:
    """(member_id, table_name, is_write) of ``methods`` (method_id): writes are accesses that lead to
    a write API before the statement ends, and all accesses of methods that save changes."""
    saves = facts.calls.filter(F.col("name").isin(P.SAVES)).select(F.col("caller_id").alias("method_id"), F.lit(True).alias("saves"))
    saves = saves.join(methods, "method_id", "left_semi").distinct()
    rows = facts.accesses.filter(P.is_dbset(F.col("member_type"))).join(methods, "method_id", "left_semi").join(saves, "method_id", "left")
    write = F.coalesce("saves", F.lit(False)) | F.exists(F.coalesce("links", F.array().cast("array<string>")), lambda x: x.isin(P.WRITES))
    return rows.select(F.col("method_id").alias("member_id"), "table_name", write.alias("is_write")).distinct()


def audit_downstream(facts: Facts, type_id: int) -> DataFrame:
    """Q22: (name, calls, reads, writes, untraced, external) of the ordinary methods of a class.
    Helpers of the class are followed to a fixpoint, repositories for one step, through an
    interface to all its implementations; what those call in other repositories is listed as
    untraced. A table that is written is not listed as read."""
    methods = facts.members.filter((F.col("type_id") == type_id) & (F.col("kind") == "method") & ~F.col("is_implicit")).select("member_id", "name", "ord")
    contexts = cut(context_types(facts))
    own = cut(facts.members.filter(F.col("type_id") == type_id).select(F.col("member_id").alias("caller_id")))
    mine = cut(classified_calls(facts, own, contexts))  # of one class, read once
    helper = mine.filter("class = 'helper'").select(F.col("caller_id").alias("src"), F.col("callee_id").alias("dst")).distinct()
    inlined = bfs(helper, methods.select(F.col("member_id").alias("root"), F.col("member_id").alias("id"))).select(F.col("root").alias("member_id"), F.col("id").alias("caller_id"))
    reached = cut(inlined.join(mine, "caller_id"))
    label = F.when(F.col("class") == "helper", F.concat("name", F.lit(" (private)"))).when(F.col("class") == "dependency", dependency_name(F.col("receiver"), F.col("name")))
    named = reached.filter("class in ('helper', 'dependency')").groupBy("member_id").agg(F.array_sort(F.collect_set(label)).alias("calls"))
    external = reached.filter("class = 'external'").groupBy("member_id").agg(F.array_sort(F.collect_set(F.concat_ws(".", "owner_name", "name"))).alias("external"))
    repo = cut(reached.filter("class = 'dependency'").filter(P.is_repository_like(F.col("receiver_type"))).select("member_id", "callee_id", "name").distinct())
    targets = cut(_bodies(facts, repo.select("callee_id").distinct()))
    touching = cut(own.select(F.col("caller_id").alias("method_id")).union(targets.select("body_id")).distinct())
    effects = cut(dbset_effects(facts, touching))
    direct = inlined.join(effects.withColumnRenamed("member_id", "caller_id"), "caller_id").select("member_id", "table_name", F.lit(None).cast("string").alias("via"), "is_write")
    hop = repo.join(targets, "callee_id").join(effects.withColumnRenamed("member_id", "body_id"), "body_id").select("member_id", "table_name", F.col("name").alias("via"), "is_write")
    reads, writes = _touched(direct.union(hop))
    calls = classified_calls(facts, cut(targets.select(F.col("body_id").alias("caller_id")).distinct()), contexts)
    inner = calls.filter("class = 'dependency'").filter(P.is_repository_like(F.col("receiver_type"))).select(F.col("caller_id").alias("body_id"), dependency_name(F.col("receiver"), F.col("name")).alias("label"))
    untraced = repo.join(targets, "callee_id").join(inner, "body_id").groupBy("member_id").agg(F.array_sort(F.collect_set("label")).alias("untraced"))
    return _listed(methods, named, reads, writes, untraced, external).select("name", "calls", "reads", "writes", "untraced", "external", "ord")


def downstream_of_all(facts: Facts) -> DataFrame:
    """Q22 for every class and record at once: type_id, member_id and the columns of
    ``audit_downstream``.

    What a helper reaches is summed up once, bottom-up: over the condensation of the graph of all
    helper calls, a component's effects are its members' own and those of the components that it calls.
    Methods take the summary of their component, so a helper that many methods share is a set of
    effects and not a row for each of them and each of its calls.
    """
    classes = facts.types.filter(F.col("kind").isin("class", "record")).select("type_id").distinct()
    own = cut(facts.members.join(classes, "type_id", "left_semi").select(F.col("member_id").alias("caller_id"), "type_id", "kind", "is_implicit", "name", "ord"))
    contexts = cut(context_types(facts))
    mine = cut(classified_calls(facts, own.select("caller_id"), contexts))
    helper = mine.filter("class = 'helper' and callee_id is not null").select(F.col("caller_id").alias("src"), F.col("callee_id").alias("dst")).distinct()
    of = lambda side: own.select(F.col("caller_id").alias(side), F.col("type_id").alias(f"t_{side}"))
    helper = cut(helper.join(of("src"), "src").join(of("dst"), "dst").filter("t_src = t_dst").select("src", "dst"))

    # the effects of a body of its own: labels, external calls, calls of repositories, tables
    label = F.when(F.col("class") == "helper", F.concat("name", F.lit(" (private)"))).when(F.col("class") == "dependency", dependency_name(F.col("receiver"), F.col("name")))
    effect = lambda kind, text, callee=F.lit(None), write=F.lit(None): (F.lit(kind).alias("kind"), text.alias("text"), callee.cast("long").alias("callee_id"), write.cast("boolean").alias("is_write"))
    text = mine.filter("class in ('helper', 'dependency')").select("caller_id", *effect("call", label))
    external = mine.filter("class = 'external'").select("caller_id", *effect("external", F.concat_ws(".", "owner_name", "name")))
    repo = mine.filter("class = 'dependency'").filter(P.is_repository_like(F.col("receiver_type"))).select("caller_id", *effect("repo", F.col("name"), F.col("callee_id")))
    tables = dbset_effects(facts, own.select(F.col("caller_id").alias("method_id")))
    tables = tables.select(F.col("member_id").alias("caller_id"), *effect("table", F.col("table_name"), write=F.col("is_write")))
    bodies = text.union(external).union(repo).union(tables)

    found = cut(scc(helper, own.select(F.col("caller_id").alias("id"))))
    part = lambda side: found.select(F.col("id").alias(side), F.col("component").alias(f"c_{side}"))
    dag = cut(plain(helper.join(part("src"), "src").join(part("dst"), "dst").select(F.col("c_src").alias("src"), F.col("c_dst").alias("dst"))))
    what = ["kind", "text", "callee_id", "is_write"]
    base = cut(bodies.join(found.withColumnRenamed("id", "caller_id"), "caller_id").select("component", *what).distinct())
    summary = base.join(dag.select(F.col("src").alias("component")).distinct(), "component", "left_anti")
    for k, step in enumerate(levels(dag)):
        below = dag.join(step.withColumnRenamed("id", "src"), "src", "left_semi").join(summary.withColumnRenamed("component", "dst"), "dst").select(F.col("src").alias("component"), *what)
        at = base.join(step.withColumnRenamed("id", "component"), "component", "left_semi")
        summary = summary.union(cut(below.union(at).distinct()))
        if k % 16 == 15:
            summary = cut(summary)

    methods = own.filter("kind = 'method' and not is_implicit").select("type_id", F.col("caller_id").alias("member_id"), "name", "ord")
    reached = cut(methods.select("member_id").distinct().join(found.withColumnRenamed("id", "member_id"), "member_id").join(summary, "component").select("member_id", *what))
    calls = cut(reached.filter("kind = 'repo'").select("member_id", "callee_id", F.col("text").alias("name")))
    targets = cut(_bodies(facts, calls.select("callee_id").distinct()))
    hops = dbset_effects(facts, cut(targets.select(F.col("body_id").alias("method_id")).distinct())).withColumnRenamed("member_id", "body_id")
    direct = reached.filter("kind = 'table'").select("member_id", F.col("text").alias("table_name"), F.lit(None).cast("string").alias("via"), "is_write")
    hop = calls.join(targets, "callee_id").join(hops, "body_id").select("member_id", "table_name", F.col("name").alias("via"), "is_write")
    inner = classified_calls(facts, cut(targets.select(F.col("body_id").alias("caller_id")).distinct()), contexts)
    inner = inner.filter("class = 'dependency'").filter(P.is_repository_like(F.col("receiver_type"))).select(F.col("caller_id").alias("body_id"), dependency_name(F.col("receiver"), F.col("name")).alias("label"))
    untraced = calls.join(targets, "callee_id").join(inner, "body_id").groupBy("member_id").agg(F.array_sort(F.collect_set("label")).alias("untraced"))
    named = reached.groupBy("member_id").agg(*(F.array_sort(F.collect_set(F.when(F.col("kind") == k, F.col("text")))).alias(c) for k, c in (("call", "calls"), ("external", "external"))))
    return _listed(methods, named, *_touched(direct.union(hop)), untraced).select("type_id", "member_id", "name", "calls", "reads", "writes", "untraced", "external", "ord")


def _touched(effects: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(member_id, reads) and (member_id, writes) from (member_id, table_name, via, is_write)."""
    once = effects.groupBy("member_id", "table_name", "via").agg(F.bool_or("is_write").alias("is_write"))
    written = once.filter("is_write").select("member_id", "table_name").distinct()
    pair = F.struct("table_name", "via")
    writes = once.filter("is_write").groupBy("member_id").agg(F.array_sort(F.collect_set(pair)).alias("writes"))
    reads = once.filter("not is_write").join(written, ["member_id", "table_name"], "left_anti").groupBy("member_id").agg(F.array_sort(F.collect_set(pair)).alias("reads"))
    return reads, writes


def _listed(methods: DataFrame, *parts: DataFrame) -> DataFrame:
    """All methods with the lists of ``parts``; an empty list is null."""
    out = methods
    for part in parts:
        lists = [c for c in part.columns if c != "member_id"]
        out = out.join(part.select("member_id", *(F.when(F.size(c) > 0, F.col(c)).alias(c) for c in lists)), "member_id", "left")
    return out


def _bodies(facts: Facts, callees: DataFrame) -> DataFrame:
    """(callee_id, body_id): the method itself, and what implements it if it is an interface's."""
    interfaces = facts.types.filter("kind = 'interface'").select("type_id").distinct()
    asked = cut(facts.members.select("member_id", "type_id").join(cut(callees), F.col("member_id") == F.col("callee_id"), "left_semi"))
    abstract = asked.join(interfaces, "type_id", "left_semi").select(F.col("member_id").alias("base"))
    bodies = overriding(facts, abstract).select(F.col("base").alias("callee_id"), F.col("id").alias("body_id"))
    return bodies.union(asked.select(F.col("member_id").alias("callee_id"), F.col("member_id").alias("body_id"))).distinct()
