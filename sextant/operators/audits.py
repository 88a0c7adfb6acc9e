"""Rule audits. Each gives ENTRY columns with ``rule``; places are kept once where noted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sextant.facts import Facts
from sextant.functions import predicates as P
from sextant.operators.graph import bfs
from sextant.operators.lookups import entry
from sextant.operators.resolve import first_of
from sextant.operators.tables import context_types, is_context_type


def _has(name: str, text: str = "name"):
    return F.coalesce(F.bool_or(P.has_attribute(F.col(text), name)), F.lit(False))


def base_chain(facts: Facts) -> DataFrame:
    """(type_id, id): each type with itself and all its base classes."""
    up = facts.bases.filter("edge = 'base' and super_id is not null").select(F.col("type_id").alias("src"), F.col("super_id").alias("dst"))
    ids = facts.types.select(F.col("type_id").alias("root"), F.col("type_id").alias("id")).distinct()
    return bfs(up, ids).select(F.col("root").alias("type_id"), "id")


def audit_auth(facts: Facts) -> DataFrame:
    """Q17: controller actions that change something without [Authorize], and posts without
    [ValidateAntiForgeryToken]."""
    chain = base_chain(facts)
    types = first_of(facts.types.filter(~P.test_project(F.col("project")) & F.col("kind").isin("class", "record")), "type_id")
    on_class = chain.join(facts.attrs, chain["id"] == facts.attrs["owner_id"]).groupBy("type_id").agg(_has("Authorize").alias("class_auth"), _has("AutoValidateAntiforgeryToken").alias("class_token"))
    own = facts.attrs.groupBy(F.col("owner_id").alias("type_id")).agg(_has("ApiController").alias("api"))
    based = chain.join(facts.bases.filter("edge = 'base'").select(F.col("type_id").alias("id"), "super_name"), "id").filter(F.col("super_name").isin("Controller", "ControllerBase")).select("type_id", F.lit(True).alias("mvc")).distinct()
    no = F.lit(False)
    controllers = (
        types.join(on_class, "type_id", "left").join(own, "type_id", "left").join(based, "type_id", "left")
        .filter(F.col("name").endswith("Controller") | F.coalesce("api", no) | F.coalesce("mvc", no))
        .select("type_id", F.col("name").alias("type_name"), F.coalesce("class_auth", no).alias("class_auth"), F.coalesce("class_token", no).alias("class_token"))
    )
    flags = [_has(a).alias(a) for a in (*P.ACTION_ATTRIBUTES, "Authorize", "AllowAnonymous", "ValidateAntiForgeryToken", "IgnoreAntiforgeryToken")]
    on_method = facts.attrs.groupBy(F.col("owner_id").alias("member_id")).agg(*flags)
    methods = facts.members.filter("kind = 'method' and accessibility = 'public'").join(on_method, "member_id").join(controllers, "type_id")
    any_of = lambda names: F.greatest(*(F.col(n) for n in names))
    methods = methods.filter(any_of(P.ACTION_ATTRIBUTES))
    verb = F.coalesce(*(F.when(F.col(v), F.lit(v)) for v in P.MUTATING_VERBS))
    auth = methods.filter(any_of(P.MUTATING_VERBS) & ~F.col("class_auth") & ~F.col("Authorize") & ~F.col("AllowAnonymous")).withColumn("rule", F.lit("Authorize"))
    token = methods.filter(F.col("HttpPost") & ~F.col("class_token") & ~F.col("ValidateAntiForgeryToken") & ~F.col("IgnoreAntiforgeryToken")).withColumn("rule", F.lit("ValidateAntiForgeryToken"))
    rows = auth.unionByName(token)
    return entry(rows, F.concat(F.lit("["), verb, F.lit("] "), "name", F.lit(" — missing ["), "rule", F.lit("]")), "type_name", "rule")


def audit_cache(facts: Facts, extra_methods: list[str] | None = None) -> DataFrame:
    """Q18: methods of classes with a context and a cache that save changes and evict nothing,
    neither themselves nor by a method of the class that they call."""
    contexts = context_types(facts)
    types = first_of(facts.types.filter(~P.test_project(F.col("project")) & F.col("kind").isin("class", "record")), "type_id").select("type_id", F.col("name").alias("type_name"))
    held = facts.members.filter("kind in ('field', 'property') and not is_implicit").select("type_id", F.col("value_type").alias("held"))
    given = facts.members.filter("kind = 'constructor'").select("member_id", "type_id").join(facts.params, "member_id").select("type_id", F.col("type_display").alias("held"))
    ifaces = facts.types.select("type_id", F.col("name").alias("held")).join(facts.bases.filter("edge = 'interface'").select("type_id", "super_name"), "type_id").filter(F.col("super_name").contains("Cache")).select("held").distinct()
    with_context = is_context_type(held.union(given), contexts, "held").filter("in_context").select("type_id").distinct()
    caches = held.join(ifaces.withColumn("_if", F.lit(True)), "held", "left").filter(F.col("held").isin("IMemoryCache", "IDistributedCache") | F.col("held").contains("Cache") | F.col("_if")).select("type_id", "held")
    methods = facts.members.filter("kind = 'method'").join(types, "type_id").join(with_context, "type_id", "left_semi").join(caches.select("type_id").distinct(), "type_id", "left_semi")
    evict = [*P.CACHE_METHODS, *(extra_methods or [])]
    calls = facts.calls.select(F.col("caller_id").alias("member_id"), "callee_id", "name", "receiver_type", "receiver_member", "same_type")
    saves = calls.filter(F.col("name").isin(P.SAVES)).select("member_id").distinct()
    touches = calls.filter(F.col("name").isin(evict) & F.col("receiver_member")).join(facts.members.select("member_id", "type_id"), "member_id")
    touches = touches.join(caches.withColumnRenamed("held", "receiver_type").distinct(), ["type_id", "receiver_type"], "left_semi").select("member_id").distinct()
    helped = calls.filter("same_type").join(touches.withColumnRenamed("member_id", "callee_id"), "callee_id", "left_semi").select("member_id").distinct()
    rows = methods.join(saves, "member_id", "left_semi").join(touches.union(helped).distinct(), "member_id", "left_anti")
    return entry(rows.withColumn("rule", F.lit("cache")), F.concat("name", F.lit(" — SaveChangesAsync without cache eviction")), "type_name", "rule")


def audit_immutable(facts: Facts, protected: list[str], dedup: bool = True) -> DataFrame:
    """Q19: removals, bulk changes and property changes of entities that are append-only. An entity is
    named by its simple name, or by the full one of a type in the solution; facts carry simple names, so
    a full one stands for all types of that simple name."""
    named = facts.types.filter(F.col("display").isin(protected)).select("name").union(facts.types.sparkSession.createDataFrame([(p,) for p in protected], "name string")).distinct()
    of = lambda df, entity: df.withColumn("name_", entity).join(named.withColumnRenamed("name", "name_"), "name_", "left_semi")
    held = lambda column: F.regexp_extract(column, r"^DbSet<(.+)>$", 1)
    calls = facts.calls
    first = of(calls.filter(F.col("name").isin(P.REMOVERS)), held("receiver_type")).withColumn("rule", F.concat(F.col("name"), F.lit(" on append-only entity")))
    bulk = of(calls.filter(F.col("name").isin(P.BULK_CHANGES)), held("chain_root_type")).withColumn("rule", F.concat(F.col("name"), F.lit(" on append-only entity")))
    change = of(facts.assigns.filter(~F.col("in_add_init")), F.col("receiver_type")).withColumn("rule", F.lit("property change of append-only entity"))
    columns = ["path", "line", "col", "context", "ord", "rule"]
    rows = first.select(columns).unionByName(bulk.select(columns)).unionByName(change.select(columns))
    out = entry(rows, F.concat("context", F.lit(" -- "), "rule"), F.lit(""), "rule")
    return first_of(out.withColumn("_o", F.struct("ord", "rule")), "path", "line", "col", order="_o").drop("_o") if dedup else out


def audit_ef(facts: Facts, dedup: bool = True) -> DataFrame:
    """Q20: HasDefaultValue with the type's own default, HasConversion<string>(), and
    interpolated strings inside query predicates."""
    c = facts.calls
    default = c.filter((F.col("name") == "HasDefaultValue") & (F.size("arg_kinds") == 1) & P.is_clr_default(F.get("arg_kinds", 0), F.get("arg_texts", 0))).withColumn("rule", F.lit("HasDefaultValue with the CLR default"))
    convert = c.filter((F.col("name") == "HasConversion") & (F.size("type_args") == 1) & (F.get("type_args", 0) == "string")).withColumn("rule", F.lit("HasConversion<string> stores the name"))
    interp = c.filter(F.col("name").isin(P.LINQ_PREDICATES) & F.col("lambda_interp")).withColumn("rule", F.lit("interpolated string in a query predicate"))
    columns = ["path", "line", "col", "context", "ord", "rule"]
    rows = default.select(columns).unionByName(convert.select(columns)).unionByName(interp.select(columns))
    out = entry(rows, F.concat("context", F.lit(" -- "), "rule"), F.lit(""), "rule")
    return first_of(out.withColumn("_o", F.struct("ord", "rule")), "path", "line", "col", order="_o").drop("_o") if dedup else out
