"""The fact tables over a star schema, so that every operator runs on tables of any size.

Regions are interfaces, nations classes that implement theirs, suppliers and customers classes
derived from their nation. An order is a method of its customer (a constructor if urgent), its
line items are the method's parameters, references and calls; a supplier has one method, Ship,
which calls the Ship of the supplier of the next line of the same order. Suppliers are also the
files of two dependency graphs over all line items: a dense one with every such pair of suppliers,
and a sparse one that keeps each supplier's most frequent followers, where structure shows.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sextant.facts import SCHEMAS, Facts
from sextant.plans.store import cut

#: first id of each kind of symbol
REGION, NATION, SUPPLIER, CUSTOMER, ORDER, SHIP, FIELD = (k * 1_000_000_000_000 for k in range(1, 8))
#: order of line items by order and number, those that share both told apart by part and supplier; 63 bits
#: up to order 2**40
ORD = "(l_orderkey * 8 + l_linenumber) * 1048576 + (l_partkey * 8191 + l_suppkey) % 1048576"
CALL = "xxhash64(l_orderkey, l_linenumber, l_partkey, l_suppkey)"
#: lines are INT
LINE = "cast({} % 2147483647 as int)"
PLAIN = "cast(null as string) accessibility, false is_static, false is_abstract, false is_virtual, false is_override, false is_sealed, false is_readonly"


def tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    names = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents"]
    return {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names}


def _shaped(df: DataFrame, name: str) -> DataFrame:
    """Columns in the order and with the types of the schema; those not given are null."""
    want = [c.rsplit(" ", 1) if "<" not in c else c.split(" ", 1) for c in SCHEMAS[name].split(", ")]
    have = set(df.columns)
    key = "cast(_key as bigint) _key" if "_key" in have else "-1L _key"
    return df.selectExpr(key, *(f"cast({c} as {t}) {c}" if c in have else f"cast(null as {t}) {c}" for c, t in want))


def lines(t: dict[str, DataFrame]) -> DataFrame:
    """Line items with their order, customer, its nation and region, supplier and part. What hangs on the order
    is joined with the order, before the many line items are."""
    orders = (
        t["orders"].join(t["customer"], t["orders"]["o_custkey"] == t["customer"]["c_custkey"])
        .join(t["nation"], t["customer"]["c_nationkey"] == t["nation"]["n_nationkey"]).join(t["region"], t["nation"]["n_regionkey"] == t["region"]["r_regionkey"])
    )
    return _named_lines(t, t["lineitem"].join(orders, t["lineitem"]["l_orderkey"] == orders["o_orderkey"]))


def _named_lines(t: dict[str, DataFrame], placed: DataFrame) -> DataFrame:
    """Line items that are joined with their order and customer, with supplier, part and place."""
    return (
        placed.join(t["supplier"].select("s_suppkey", "s_name"), F.col("l_suppkey") == F.col("s_suppkey")).join(t["part"].select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
        .selectExpr("*", f"{ORD} ord", "concat('Web/', c_name, '.cs') path", f"{LINE.format('l_orderkey')} line", "l_linenumber col", "concat(c_name, '.Order', l_orderkey) containing", "concat(s_name, ' ', p_brand) context", f"{ORDER} + l_orderkey order_id", f"{CUSTOMER} + o_custkey customer_id")
    )


def supplier_edges(t: dict[str, DataFrame]) -> DataFrame:
    """(src, dst, l_orderkey, l_linenumber, ord, call_id): line ``l_linenumber`` of an order from supplier
    src is followed by one from supplier dst."""
    li = t["lineitem"]
    a = li.selectExpr("l_orderkey", "l_linenumber + 1 next_line", "l_linenumber", "l_partkey", "l_suppkey")
    b = li.selectExpr("l_orderkey", "l_linenumber next_line", "l_suppkey dst")
    pairs = a.join(b, ["l_orderkey", "next_line"]).filter("l_suppkey <> dst")
    return pairs.selectExpr("l_suppkey src", "dst", "l_orderkey", "l_linenumber", f"{ORD} ord", f"{CALL} call_id")


def leading_edges(t: dict[str, DataFrame]) -> DataFrame:
    """(src, dst): the suppliers that follow src most often, all of them if they are equal."""
    often = supplier_edges(t).groupBy("src", "dst").count()
    rank = F.rank().over(Window.partitionBy("src").orderBy(F.desc("count")))
    return often.withColumn("rank", rank).filter("rank = 1").select("src", "dst")


def facts(spark: SparkSession, sf_dir: str) -> Facts:
    return Facts(**{n: df.drop("_key") for n, df in keyed_facts(tables(spark, sf_dir)).items()})


def keyed_facts(t: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The fact tables by name, each row with the order that it stems from (``_key``; -1 for those of
    the other tables)."""
    li = lines(t)
    nation = t["nation"].join(t["region"], t["nation"]["n_regionkey"] == t["region"]["r_regionkey"])
    supplier = t["supplier"].join(nation, t["supplier"]["s_nationkey"] == nation["n_nationkey"])
    customer = t["customer"].join(nation, t["customer"]["c_nationkey"] == nation["n_nationkey"])
    orders = t["orders"].join(customer, t["orders"]["o_custkey"] == customer["c_custkey"])
    at = lambda folder, name: f"concat('{folder}/', {name}, '.cs') path, 1 line, 1 col, concat('class ', {name}) context"

    def type_rows(df, base, key, kind, name, display, namespace, project, folder, end="1"):
        return _shaped(df.selectExpr(*_split(f"{base} + {key} type_id, '{project}' project, '{kind}' kind, {name} name, {display} display, {namespace} namespace, 0 depth, {end} end_line, false all_abstract, {PLAIN}, {at(folder, name)}, {base} + {key} ord")), "types")

    ns = "concat_ws('.', r_name, n_name)"
    types = type_rows(t["region"], REGION, "r_regionkey", "interface", "r_name", "r_name", "cast(null as string)", "Core", "Core")
    types = types.union(type_rows(nation, NATION, "n_nationkey", "class", "n_name", ns, "r_name", "Core", "Core"))
    types = types.union(type_rows(supplier, SUPPLIER, "s_suppkey", "class", "s_name", f"concat({ns}, '.', s_name)", ns, "Services", "Services", "cast(1 + abs(s_acctbal) / 10 as int)"))
    types = types.union(type_rows(customer, CUSTOMER, "c_custkey", "class", "c_name", f"concat({ns}, '.', c_name)", ns, "Web", "Web", "cast(1 + abs(c_acctbal) / 10 as int)"))

    bases = nation.selectExpr(f"{NATION} + n_nationkey type_id", f"{REGION} + n_regionkey super_id", "r_name super_name", "'interface' edge", "0 ordinal")
    bases = bases.union(t["supplier"].join(t["nation"], t["supplier"]["s_nationkey"] == t["nation"]["n_nationkey"]).selectExpr(f"{SUPPLIER} + s_suppkey", f"{NATION} + s_nationkey", "n_name", "'base'", "0"))
    bases = bases.union(t["customer"].join(t["nation"], t["customer"]["c_nationkey"] == t["nation"]["n_nationkey"]).selectExpr(f"{CUSTOMER} + c_custkey", f"{NATION} + c_nationkey", "n_name", "'base'", "0"))

    branches = t["lineitem"].groupBy("l_orderkey").agg(F.count("*").alias("n_lines"), F.count_if(F.col("l_quantity") > 25).alias("n_large"))
    sized = orders.join(branches, orders["o_orderkey"] == branches["l_orderkey"], "left")
    methods = sized.selectExpr(
        f"{ORDER} + o_orderkey member_id", f"{CUSTOMER} + o_custkey type_id", "if(o_orderpriority = '1-URGENT', 'constructor', 'method') kind", "concat('Order', o_orderkey) name", f"concat({ns}, '.', c_name, '.Order', o_orderkey) display",
        "concat('Order', o_orderkey, '() -> ', o_orderpriority) signature", "o_orderpriority value_type", "false is_implicit", "o_orderpriority = '5-LOW' and o_orderstatus = 'P' is_accessor", "true has_body", "cast(1 + coalesce(n_large, 0) as int) cyclomatic", "cast(coalesce(n_lines, 0) as int) n_calls",
        "o_totalprice > 400000 multi_init", "case o_orderstatus when 'F' then 'public' when 'O' then 'private' else 'internal' end accessibility", "o_totalprice > 300000 is_static", "false is_abstract", "o_totalprice < 50000 is_virtual", "false is_override", "false is_sealed", "false is_readonly",
        "concat('Web/', c_name, '.cs') path", f"{LINE.format('o_orderkey')} line", "1 col", "concat('Order', o_orderkey) context", "o_orderkey ord", "o_orderkey _key",
    )
    held = "stack(2, 0, '_db', if(c_acctbal >= 0, 'AppDbContext', 'int'), 1, '_cache', if(c_mktsegment in ('AUTOMOBILE', 'FURNITURE'), 'IMemoryCache', 'string')) as (k, name, value_type)"
    fields = customer.selectExpr("*", held).selectExpr(f"{FIELD} + c_custkey * 2 + k member_id", f"{CUSTOMER} + c_custkey type_id", "'field' kind", "name", "concat(c_name, '.', name) display", "false is_implicit", "false is_accessor", "false has_body", "'private' accessibility", "k = 1 is_readonly", "false is_static", "concat('Web/', c_name, '.cs') path", "cast(k + 1 as int) line", "5 col", "name context", "value_type", "cast(k as bigint) ord")
    ships = supplier.selectExpr(f"{SHIP} + s_suppkey member_id", f"{SUPPLIER} + s_suppkey type_id", "'method' kind", "'Ship' name", f"concat({ns}, '.', s_name, '.Ship') display", "'Ship()' signature", "'void' value_type", "false is_implicit", "false is_accessor", "true has_body", "1 cyclomatic", "'public' accessibility", "concat('Services/', s_name, '.cs') path", "2 line", "1 col", "'Ship' context", f"{SHIP} + s_suppkey ord")
    members = _shaped(methods, "members").union(_shaped(fields, "members")).union(_shaped(ships, "members"))

    params = li.selectExpr("l_orderkey _key", "order_id member_id", "cast(l_linenumber as int) ordinal", "concat('p', l_returnflag, l_linestatus) name", "case when l_linenumber = 7 then 'AppDbContext' else s_name end type_display", "if(l_returnflag = 'R', 'interface', 'class') type_kind", f"case when l_linenumber <> 7 then {SUPPLIER} + l_suppkey end declared_id", "path", "line", "col", "context", "ord")
    refs = li.selectExpr("l_orderkey _key", f"{SUPPLIER} + l_suppkey target_id", "'type' target_kind", "containing", "case l_returnflag when 'A' then array('block', 'parameter', 'method') when 'N' then array('field', 'type') else array('argument', 'new', 'method') end kinds", f"{ns} namespace", "l_linestatus = 'O' in_type", "path", "line", "col", "context", "ord")
    edges = supplier_edges(t).join(t["supplier"].selectExpr("s_suppkey src", "s_name src_name"), "src")
    calls = edges.selectExpr("l_orderkey _key", "call_id", f"{SHIP} + src caller_id", f"{SHIP} + dst callee_id", "'member' form", "'Ship' name", "concat(src_name, '.Ship') containing", "concat('Services/', src_name, '.cs') path", f"{LINE.format('l_orderkey')} line", "l_linenumber col", "concat('line ', l_linenumber) context", "ord")
    least = t["orders"].groupBy("o_custkey").agg({"o_orderkey": "min"}).withColumnRenamed("min(o_orderkey)", "first_order").withColumnRenamed("o_custkey", "k")
    # calls of a first order apart, so that a join on the callee goes down to the one table that names it
    head = orders.join(least, orders["o_custkey"] == least["k"])
    first = _named_lines(t, t["lineitem"].filter("l_linenumber = 1").join(head, F.col("l_orderkey") == F.col("o_orderkey")))
    called = lambda rows, name, callee: rows.selectExpr(
        "l_orderkey _key", f"{CALL} call_id", "order_id caller_id", f"{callee} callee_id", "if(l_linenumber = 1, 'bare', 'member') form",
        f"case l_linenumber when 1 then {name} when 2 then 'SaveChangesAsync' when 3 then 'Remove' when 4 then 'ExecuteDeleteAsync' when 5 then 'HasDefaultValue' when 6 then if(l_returnflag = 'A', 'HasConversion', 'Where') else 'Ship' end name",
        "case l_linenumber when 2 then '_db' when 3 then if(l_returnflag = 'A', '_cache', 'set') when 4 then 'set' when 7 then '_repo' end receiver",
        "case l_linenumber when 2 then 'AppDbContext' when 3 then if(l_returnflag = 'A', 'IMemoryCache', concat('DbSet<', p_brand, '>')) when 7 then if(l_returnflag = 'N', 'BrandService', 'BrandRepository') end receiver_type",
        "l_linenumber = 2 or l_linenumber = 7 or (l_linenumber = 3 and l_returnflag = 'A') receiver_member", "if(l_returnflag = 'R', 'System.IO', 'Shop') owner_namespace", "'File' owner_name", "false callee_static", "l_linenumber = 1 same_type",
        "if(l_linenumber = 6 and l_returnflag = 'A', array('string'), array()) type_args", "if(l_linenumber = 5, array('number'), array()) arg_kinds", "if(l_linenumber = 5, array(if(l_discount = 0, '0', '5')), array()) arg_texts", "l_linenumber = 6 and l_linestatus = 'O' lambda_interp",
        "if(l_linenumber = 4, concat('DbSet<', p_brand, '>'), null) chain_root_type", "containing", "path", "line", "col", "context", "ord",
    )
    body = called(first, "concat('Order', first_order)", f"{ORDER} + first_order")
    body = body.union(called(li.filter("coalesce(l_linenumber, 0) <> 1"), "''", f"case when l_linenumber = 7 then {SHIP} + l_suppkey end"))
    accesses = li.selectExpr("l_orderkey _key", "customer_id type_id", "order_id method_id", "'_db' receiver", "'AppDbContext' receiver_type", "l_linestatus = 'O' receiver_member", "p_brand table_name", "'DbSet' member_type", "case l_returnflag when 'R' then array('Where', 'Remove') when 'A' then array('ToList') else array() end links", "path", "line", "col", "context", "ord")
    assigns = li.filter("l_linenumber = 2").selectExpr("l_orderkey _key", "order_id method_id", "p_brand receiver_type", "l_returnflag = 'A' in_add_init", "'x' target", "path", "line", "col", "context", "ord")
    attrs = t["orders"].selectExpr("o_orderkey _key", f"{ORDER} + o_orderkey owner_id", "case o_orderpriority when '2-HIGH' then 'HttpPost' when '3-MEDIUM' then 'HttpPutAttribute' when '4-NOT SPECIFIED' then 'HttpGet' when '5-LOW' then 'Mvc.HttpDelete' else 'Obsolete' end name")
    attrs = attrs.union(t["orders"].filter("o_totalprice > 300000").selectExpr("o_orderkey", f"{ORDER} + o_orderkey", "'ValidateAntiForgeryToken'"))
    attrs = attrs.union(t["customer"].selectExpr("-1L", f"{CUSTOMER} + c_custkey", "case c_mktsegment when 'MACHINERY' then 'Authorize' when 'HOUSEHOLD' then 'Obsolete' else 'ApiController' end"))
    used = t["lineitem"].join(t["orders"].select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).selectExpr("*", f"{ORDER} + l_orderkey order_id", f"{CUSTOMER} + o_custkey customer_id")
    type_uses = used.selectExpr("l_orderkey _key", "customer_id type_id", "order_id member_id", "'param' role", f"{SUPPLIER} + l_suppkey used_id").union(supplier_edges(t).selectExpr("l_orderkey", f"{SUPPLIER} + src", f"{SHIP} + src", "'return'", f"{SUPPLIER} + dst"))
    field_uses = used.selectExpr("l_orderkey _key", "customer_id type_id", "concat('Order', l_orderkey) method_name", "concat('s', l_suppkey) field")
    files = t["supplier"].selectExpr("'Services' project", "1 project_ord", "cast(s_suppkey as int) file_ord", "concat('Services/', s_name, '.cs') path", "'' text", "cast(abs(s_acctbal) as int) loc")
    given = {
        "files": files, "types": types, "members": members, "params": params, "bases": bases, "type_uses": type_uses, "attrs": attrs, "refs": refs,
        "calls": _shaped(calls, "calls").union(_shaped(body, "calls")), "accesses": accesses, "assigns": assigns, "field_uses": field_uses,
    }
    return {n: _shaped(df, n) for n, df in given.items()}


def code_base(spark: SparkSession, sf_dir: str) -> Facts:
    """The star facts as a code base with test projects, generated files and repeated paths: a
    file for each customer beside those of the suppliers, referring to them; suppliers refer to
    their most frequent followers."""
    t = tables(spark, sf_dir)
    f = facts(spark, sf_dir)
    folder = "case when c_acctbal < 0 then 'Web/obj/' when c_mktsegment = 'MACHINERY' then 'Web.Tests/' else 'Web/' end"
    own = t["customer"].selectExpr("c_custkey", f"{CUSTOMER} + c_custkey type_id", "if(c_mktsegment = 'MACHINERY', 'Web.Tests', 'Web') own_project", f"concat({folder}, c_name, '.cs') own_path", "cast(abs(c_acctbal) as int) loc", "c_acctbal < 0 generated")
    files = own.selectExpr("own_project project", "2 project_ord", "cast(c_custkey as int) file_ord", "own_path path", "'' text", "loc")
    again = own.filter("c_custkey % 10 = 0 and not generated").selectExpr("own_project project", "9 project_ord", "cast(c_custkey as int) file_ord", "upper(own_path) path", "'' text", "1000000 loc")
    types = f.types.join(own.select("type_id", "own_project", "own_path"), "type_id", "left").withColumns({"project": F.coalesce("own_project", "project"), "path": F.coalesce("own_path", "path")})
    at = t["lineitem"].join(t["orders"].join(own, F.col("o_custkey") == F.col("c_custkey")), F.col("l_orderkey") == F.col("o_orderkey"))
    name = t["supplier"].selectExpr("s_suppkey src", "concat('Services/', s_name, '.cs') path")
    refs = at.selectExpr(f"{SUPPLIER} + l_suppkey target_id", "own_path path").union(leading_edges(t).join(name, "src").selectExpr(f"{SUPPLIER} + dst", "path"))
    given = {"files": f.files.select(*files.columns).union(files).union(again), "types": types, "refs": refs}
    return replace(f, **{n: _shaped(df, n).drop("_key") for n, df in given.items()})


def _split(text: str) -> list[str]:
    """A select list at its top-level commas."""
    out, depth, at = [], 0, 0
    for i, c in enumerate(text):
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(text[at:i])
            at = i + 1
    return [*out, text[at:]]


#: columns of line items that make a line, and fact tables that are made of no others
LINE_KEYS, PLAIN_FACTS = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), {"types", "bases", "files", "type_uses", "field_uses"}


#: what a snapshot of the star facts stores: every fact table, or those named, and of the line items what these are made of
def stored_schemas(t: dict[str, DataFrame], *names: str) -> dict[str, str]:
    keys = LINE_KEYS if names and PLAIN_FACTS.issuperset(names) else t["lineitem"].columns
    return {"lineitem": ", ".join(f"{c} {k}" for c, k in t["lineitem"].dtypes if c in keys), **{n: s for n, s in SCHEMAS.items() if not names or n in names}}


def created(store, t: dict[str, DataFrame]) -> int:
    """The first version: all facts that stem from other tables than line items."""
    none = keyed_facts({**t, "lineitem": t["lineitem"].filter(F.lit(False))})
    none = {n: df for n, df in none.items() if n in store.schemas}
    keys = t["orders"].select(F.col("o_orderkey").cast("long").alias("_key")).union(store.spark.range(1).selectExpr("-1L"))
    return store.apply("created", keys, none)


def order_changes(store, t: dict[str, DataFrame]):
    """For ``Snapshots.follow``: the orders that a batch of line items touches, and their facts from all
    their line items, old and new. A line that comes again takes the old one's place."""
    columns = store.read("lineitem", 0).drop("_key").columns

    def build(batch: DataFrame) -> tuple[DataFrame, dict[str, DataFrame], set[str]]:
        batch = batch.select(*columns)
        same = [c for c in columns if c in LINE_KEYS]
        key = F.col("l_orderkey").cast("long")
        changed = cut(batch.select(key.alias("_key")).distinct())
        # old and new lines meet once: by their order, and in it by what makes a line; null is like nothing
        both = store.read("lineitem", buckets=store.hit(changed)).withColumn("_new", F.lit(0)).unionByName(batch.withColumns({"_key": key, "_new": F.lit(1)}))
        newest = lambda *by: F.max("_new").over(Window.partitionBy("_key", *by))
        both = both.withColumns({"_touched": (F.col("_new") == 1) | (F.col("_key").isNotNull() & (newest() == 1)), "_last": newest(*same)})
        whole = F.expr(" and ".join(f"{c} is not null" for c in same))
        lines_now = cut(both.filter((F.col("_new") == F.col("_last")) | ~whole).drop("_new", "_last"), None, {"compression": "zstd"})
        of_changed = lines_now.filter("_touched").select(*(F.col(c) if c in columns else F.lit(None).cast(k).alias(c) for c, k in t["lineitem"].dtypes))
        rows = keyed_facts({**t, "lineitem": of_changed})
        # these are lines of changed orders alone, and so are the facts of lines; members and attributes stem from all orders
        few = lambda n, df: df.join(changed, "_key", "left_semi") if n in ("members", "attrs") else df
        facts_now = {n: few(n, df) for n, df in rows.items() if n in store.schemas and n not in ("files", "types", "bases")}
        return changed, {"lineitem": lines_now.drop("_touched"), **facts_now}, {"lineitem"}

    return build


def stored_facts(store, version: int | None = None) -> Facts:
    version = store.version() if version is None else version
    return Facts.empty(store.spark, **{n: store.read(n, version).drop("_key") for n in SCHEMAS if n in store.schemas})
