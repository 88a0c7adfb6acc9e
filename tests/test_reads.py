"""What the operators read, shuffle and keep at once; their results are tested elsewhere."""

from collections import Counter

from sextant.operators import graph, lookups, metrics, surface
from sextant.plans import queries, star

SF = "/root/testdata/sf0.001"


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


class Counting:
    """Facts that count how often each table is asked for."""

    def __init__(self, facts):
        self.facts, self.n = facts, Counter()

    def __getattr__(self, name):
        self.n[name] += 1
        return getattr(self.facts, name)


def test_sources_that_lead_to_the_same_share_a_bitmap(spark, monkeypatch):
    taken = []
    monkeypatch.setattr(graph, "levels", lambda dag, levels=graph.levels: taken.append(dag.count()) or levels(dag))
    edges = spark.createDataFrame([(k, 1000 + k % 2) for k in range(50)] + [(1000, 2000), (50, 51), (51, 50), (50, 1001)], "src long, dst long")
    nodes = spark.createDataFrame([(k,) for k in [*range(52), 1000, 1001, 2000, 3000]], "id long")
    reach = {r.id: r.reach for r in graph.reach_counts(edges, graph.scc(edges, nodes)).collect()}
    want = {k: 1 if k % 2 else 2 for k in range(50)} | {50: 2, 51: 2, 1000: 1, 1001: 0, 2000: 0, 3000: 0}
    assert reach == want
    assert taken[-1] == 3  # one source for each of two sets, and 1000


def test_a_callee_is_looked_up_before_names_are_joined(spark):
    f = star.facts(spark, SF)
    wanted = spark.createDataFrame([(star.SHIP + 1,)], "callee_id long")
    assert optimized(f.calls.join(wanted, "callee_id", "left_semi")).count("Join LeftSemi") == 3


def test_methods_are_read_once_where_nothing_overrides(spark):
    f = Counting(star.facts(spark, SF))
    assert lookups.overriding(f).isEmpty()
    assert f.n["members"] <= 2 and not f.n["params"]


def test_ignored_calls_are_not_kept(spark):
    f = star.facts(spark, SF)
    calls = surface.classified_calls(f, f.members.selectExpr("member_id caller_id"), f.types.select("name").limit(0))
    assert "context" not in calls.columns and calls.filter("class = 'ignored'").isEmpty()
    assert "next_line" not in optimized(calls)  # calls between suppliers are ignored as a whole


def test_coupling_reads_uses_once(spark):
    f = Counting(star.facts(spark, SF))
    metrics.coupling(f, f.types.filter("kind <> 'interface'"))
    assert f.n["type_uses"] == 1


def test_file_edges_are_made_distinct_last(spark):
    _, edges = metrics.file_graph(star.code_base(spark, SF))
    assert optimized(edges).startswith("Aggregate")


def test_a_chain_makes_its_edges_once(spark, monkeypatch):
    given = []
    monkeypatch.setattr(lookups, "bfs", lambda edges, *rest, bfs=lookups.bfs: given.append(edges) or bfs(edges, *rest))
    lookups.call_chain(star.facts(spark, SF), star.SHIP + 1)
    assert hasattr(given[-1], "written")


def test_an_indexed_query_builds_the_index_that_it_reads(spark):
    assert queries._indexed(spark, SF, "hierarchy").names is None
    assert queries._indexed(spark, SF, "names").hierarchy is None


def test_a_snapshot_stores_the_tables_that_it_names(spark):
    assert list(star.stored_schemas(star.tables(spark, SF), "type_uses")) == ["lineitem", "type_uses"]
