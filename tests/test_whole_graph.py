"""The supplier graph of the queries over all line items, against plain SQL and Python."""

from collections import Counter

import duckdb

from sextant.plans import star
from sextant.plans.queries import ORACLES, QUERIES
from tests.test_graph import brandes, reach

SF = "/root/testdata/sf0.001"


def edges():
    sql = f"""select distinct a.l_suppkey, b.l_suppkey from '{SF}/lineitem.parquet' a join '{SF}/lineitem.parquet' b
              on a.l_orderkey = b.l_orderkey and b.l_linenumber = a.l_linenumber + 1 where a.l_suppkey <> b.l_suppkey"""
    return duckdb.sql(sql).fetchall()


def test_edges_of_all_line_items(spark):
    want = set(edges())
    got = star.supplier_edges(star.tables(spark, SF)).select("src", "dst").distinct().collect()
    assert {(r.src, r.dst) for r in got} == want
    calls = star.facts(spark, SF).calls.filter("name = 'Ship' and form = 'member' and context like 'line %'")
    assert {(r.caller_id - star.SHIP, r.callee_id - star.SHIP) for r in calls.select("caller_id", "callee_id").collect()} == want


def test_betweenness_of_the_whole_core(spark):
    found = edges()
    far = reach(1 + max(max(e) for e in found), found)
    core = sorted(x for x in far if x in far[x])  # one component at this scale
    assert all(far[x] >= set(core) for x in core)
    want = brandes(core, [(a, b) for a, b in found if a in core and b in core])
    got = {r.id: r.betweenness for r in QUERIES["betweenness"](spark, SF).collect()}
    assert got == {x: round(want[x], 6) for x in core}


def test_queries_have_no_date(spark):
    assert not any("l_shipdate" in sql for sql in ORACLES.values())
    fan = QUERIES["fan_stats"](spark, SF).selectExpr("sum(fan_out) n").first().n
    assert fan == len(edges())


def test_leading_edges(spark):
    sql = f"""select a.l_suppkey, b.l_suppkey from '{SF}/lineitem.parquet' a join '{SF}/lineitem.parquet' b
              on a.l_orderkey = b.l_orderkey and b.l_linenumber = a.l_linenumber + 1 where a.l_suppkey <> b.l_suppkey"""
    count = Counter(duckdb.sql(sql).fetchall())
    want = {(a, b) for (a, b), n in count.items() if n == max(m for (x, _), m in count.items() if x == a)}
    got = star.leading_edges(star.tables(spark, SF)).collect()
    assert {(r.src, r.dst) for r in got} == want and len(got) == len(want) < len(edges())


def test_defaults_of_chain_and_map(spark):
    assert "walk.depth < 5" in ORACLES["call_chain"] and "ASIA" not in ORACLES["service_map"]
    regions = f"""select distinct r_name from '{SF}/lineitem.parquet' join '{SF}/orders.parquet' on l_orderkey = o_orderkey join '{SF}/customer.parquet' on o_custkey = c_custkey
                  join '{SF}/nation.parquet' on c_nationkey = n_nationkey join '{SF}/region.parquet' on n_regionkey = r_regionkey where o_orderpriority = '1-URGENT' and l_linenumber = 7"""
    place = star.facts(spark, SF).types.select("path", "namespace")
    found = QUERIES["service_map"](spark, SF).join(place, "path").selectExpr("split(namespace, '[.]')[0] r").distinct().collect()
    want = {r[0] for r in duckdb.sql(regions).fetchall()}
    assert len(want) > 1 and {r.r for r in found} == want


def test_keys_of_very_large_tables(spark):
    """Order, part and supplier keys beyond 32 bits: the same facts, shifted."""
    t = star.tables(spark, SF)
    plus = lambda df, **by: df.selectExpr(*(f"cast({c} + {by[c]}L as bigint) {c}" if c in by else c for c in df.columns))
    far, part, sup = 3 << 37, 1 << 34, 1 << 29
    big = {**t, "lineitem": plus(t["lineitem"], l_orderkey=far, l_partkey=part, l_suppkey=sup), "orders": plus(t["orders"], o_orderkey=far), "part": plus(t["part"], p_partkey=part), "supplier": plus(t["supplier"], s_suppkey=sup)}
    small, large = star.keyed_facts(t), star.keyed_facts(big)
    for name in ("params", "refs", "calls", "members", "type_uses"):
        assert large[name].count() == small[name].count(), name
    assert large["calls"].select("call_id").distinct().count() == small["calls"].select("call_id").distinct().count()
    first = lambda f: [r.name for r in f["params"].orderBy("ord", "ordinal").select("name").limit(50).collect()]
    assert len(first(large)) == 50
