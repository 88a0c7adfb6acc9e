"""A solution with overloads, a middle class, equal simple names and tests, and the output contracts."""

import json

import pytest

from sextant.commands import Commands
from sextant.facts import Facts
from sextant.operators import lookups, metrics, surface
from sextant.operators.resolve import one
from sextant.sources.solution import read_solution

CORE = """namespace Core;
public interface IStore { User Get(int id); User Get(string name); int Count(); }
public class User { public string Name; }
public class AppDbContext : DbContext { public DbSet<User> Users { get; set; } }
public class DbContext { }
public class DbSet<T> { public void Add(T x) { } public int Count() { return 0; } }
public abstract class StoreBase : IStore
{
    public abstract User Get(int id);
    public virtual User Get(string name) { return null; }
    public virtual int Count() { return 1; }
}
public class StoreRepository : StoreBase
{
    private readonly AppDbContext _db;
    public StoreRepository(AppDbContext db) { _db = db; }
    public override User Get(int id) { _db.Users.Add(null); return null; }
    public override User Get(string name) { return null; }
    public override int Count() { return _db.Users.Count(); }
}
"""
OTHER = """namespace Other;
public class User { }
public class Keeper { public Keeper(User u) { } }
public class Holder { public Holder(Core.User u, Core.User[] many) { } }
"""
WEB = """using Core;
namespace Web;
public class Pages
{
    private readonly IStore _store;
    private readonly StoreRepository _repository;
    public Pages(IStore store, StoreRepository repository) { _store = store; _repository = repository; }
    public User ById(int id) { return _store.Get(id); }
    public User ByName(string name) { return _store.Get(name); }
    public int All() { return _repository.Count(); }
    public User Home(int id) { return this.ById(id); }
    public int Even(int n) { return Odd(n) + All(); }
    public int Odd(int n) { return Even(n); }
    public int Both() { Home(1); return Odd(2); }
    public bool Flag(System.String text, Int32 n) { if (text == null || n > 1) { return true; } return false; }
}
"""
TESTS = """using Core;
namespace Web.Tests;
public class PagesTests
{
    public void Finds(IStore store) { store.Get(1); store.Get("a"); }
}
"""


@pytest.fixture(scope="module")
def facts(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("dispatch")
    files = {"Core/Core.cs": CORE, "Other/Other.cs": OTHER, "Web/Pages.cs": WEB, "Web.Tests/PagesTests.cs": TESTS}
    projects = sorted({p.split("/")[0] for p in files})
    (root / "All.slnx").write_text("<Solution>" + "".join(f'<Project Path="{p}/{p}.csproj" />' for p in projects) + "</Solution>")
    for path, text in files.items():
        (root / path).parent.mkdir(exist_ok=True)
        (root / path).write_text(text)
    for p in projects:
        (root / p / f"{p}.csproj").write_text("<Project />")
    place = str(tmp_path_factory.mktemp("facts"))
    read_solution(spark, str(root)).save(place)
    return Facts.load(spark, place)


def method(facts, type_name, name, shape):
    rows = facts.members.filter((facts.members["name"] == name) & (facts.members["kind"] == "method")).join(facts.types.filter(facts.types["name"] == type_name).select("type_id"), "type_id").collect()
    return next(r.member_id for r in rows if f"({shape})" in r.signature)


def test_downstream_of_all_classes(facts):
    """Class by class the same, helpers that call each other and shared ones included."""
    every = surface.downstream_of_all(facts).collect()
    seen, asked = 0, set()
    for t in facts.types.filter("name in ('Pages', 'StoreRepository', 'PagesTests')").select("type_id").distinct().collect():
        asked.add(t.type_id)
        one_class = surface.audit_downstream(facts, t.type_id)
        want = sorted(map(repr, one_class.collect()))
        assert sorted(repr(r) for r in (type(r)(**{c: r[c] for c in one_class.columns}) for r in every if r.type_id == t.type_id)) == want
        seen += len(want)
    assert seen == sum(r.type_id in asked for r in every) > 8
    pages = {r.name: r for r in every}
    assert pages["Both"].calls == sorted({*pages["Odd"].calls, "Home (private)"})
    assert [x.table_name for x in pages["Odd"].reads] == ["Users"]


def test_overloads_and_middle_class(facts):
    pairs = {(r.base, r.id) for r in lookups.overriding(facts).collect()}
    name = lambda t, shape, n="Get": method(facts, t, n, shape)
    for shape in ("int", "string"):
        assert (name("IStore", shape), name("StoreRepository", shape)) in pairs and (name("IStore", shape), name("StoreBase", shape)) in pairs
        other = "string" if shape == "int" else "int"
        assert (name("IStore", shape), name("StoreRepository", other)) not in pairs
    assert len(pairs) == 9
    by_id, by_name = name("StoreRepository", "int"), name("StoreRepository", "string")
    containing = lambda df: sorted(r.containing for r in df.collect())
    assert containing(lookups.callers(facts, by_id)) == ["Pages.ById", "PagesTests.Finds"]
    assert containing(lookups.callers(facts, by_name)) == ["Pages.ByName", "PagesTests.Finds"]
    count = name("IStore", "", "Count")
    assert containing(lookups.callers(facts, count)) == ["Pages.All"]
    for m in (by_id, by_name, count):
        first = lookups.call_chain(facts, m).filter("depth = 1")
        assert containing(first) == containing(lookups.callers(facts, m))
    assert containing(lookups.call_chain(facts, by_id).filter("depth = 2")) == ["Pages.Home"]


def test_surface_by_signature(facts):
    rows = {r.signature: r for r in surface.audit_surface(facts, one(facts, "IStore")["id"]).collect()}
    assert {k: (r.prod_count, r.test_count) for k, r in rows.items()} == {"Get(int) -> User": (1, 1), "Get(string) -> User": (1, 1), "Count() -> int": (1, 0)}
    assert all(r.shape is None and r.hint is None for r in rows.values())
    down = {r.name: r for r in surface.audit_downstream(facts, one(facts, "Pages")["id"]).collect()}
    assert [(x.table_name, x.via) for x in down["All"].reads] == [("Users", "Count")] and not down["All"].writes


def test_injected_by_type_and_primitives(facts):
    names = lambda display: [r.containing for r in lookups.injected(facts, one(facts, display)["id"]).orderBy("ord").collect()]
    assert names("Core.User") == ["Holder"] and names("Other.User") == ["Keeper"]
    run = Commands(facts).run
    assert [r["containingSymbol"] for r in json.loads(run("injected", "Core.User", style="json"))["results"]] == ["Holder"]
    deps = [r["context"] for r in json.loads(run("dependencies", "Pages", style="json"))["results"]]
    assert deps == ["constructor parameter: IStore store", "constructor parameter: StoreRepository repository", "readonly field: IStore _store", "readonly field: StoreRepository _repository"]


def test_json_contracts(facts, tmp_path):
    run = Commands(facts).run
    got = json.loads(run("audit-surface", "IStore", style="json"))
    assert list(got) == ["command", "symbol", "kind", "implementations", "methods", "total"] and got["kind"] == "interface" and got["symbol"] == "Core.IStore"
    assert got["implementations"] == ["Core.StoreBase", "Core.StoreRepository"]
    assert list(got["methods"][0]) == ["name", "signature", "callers"] and list(got["methods"][0]["callers"]) == ["prodCount", "testCount", "prod", "test"]
    assert set(got["methods"][0]["callers"]["prod"][0]) == {"file", "line", "column", "context"}
    got = json.loads(run("audit-surface", "StoreRepository", style="json", limit=1))
    assert "implementations" not in got and got["kind"] == "class" and got["methods"][0]["bodyShape"] == "write" and got["totalBeforeLimit"] == 3
    got = json.loads(run("audit-downstream", "Pages", style="json"))
    assert set(got) == {"command", "symbol", "methods", "total"} and all(set(m) == {"name", "calls", "dbSets", "external"} for m in got["methods"])
    assert next(m for m in got["methods"] if m["name"] == "All")["dbSets"] == {"reads": [{"table": "Users", "via": "Count"}], "writes": []}
    for suggest in (False, True):
        got = json.loads(run("cycles", style="json", suggest=suggest))
        assert list(got) == ["command", "totalFiles", "cycleCount", "sccs", "suggestions"] and got["suggestions"] is None
    got = json.loads(run("health", style="json"))
    assert set(got) == {"command", "totalAnalyzed", "results", "total"}
    assert list(got["results"][0]) == [
        "name", "qualifiedName", "file", "line", "score", "lines", "methodCount", "maxCyclomaticComplexity", "maxComplexityMethod", "dependencyCount", "dependentCount", "instability", "cohesionScore", "fieldClusterCount",
    ]
    assert "(unstable)" in run("health") or "(stable)" in run("health")
    got = json.loads(run("snapshot", style="json", solution="All"))
    assert len(got) == 27 and list(got)[:9] == ["commitDate", "commit", "solution", "locProd", "locTest", "filesProd", "filesTest", "classes", "interfaces"]
    assert (got["filesProd"], got["filesTest"], got["interfaces"], got["locTest"]) == (3, 1, 1, 6) and got["maxCyclomaticMethod"] == "Pages.Flag" and got["p95Reach"] >= 0
    run("snapshot", append=str(tmp_path / "h.csv"))
    assert (tmp_path / "h.csv").read_text().splitlines()[0].split(",")[16:19] == ["avg_fanout", "max_fanout", "max_fanout_file"]


def test_cycles_in_files(spark):
    names = [f"f{i:02}" for i in range(25)]
    edges = [(names[2 * k], names[2 * k + 1]) for k in range(12)] + [(names[2 * k + 1], names[2 * k]) for k in range(12)] + [(names[1], names[2]), (names[2], names[0])]
    e, v = spark.createDataFrame(edges, "src string, dst string"), spark.createDataFrame([(n,) for n in names], "id string")
    from sextant.sources import sinks

    got = json.loads(sinks.cycles(metrics.cycle_report(e, v), 25, metrics.break_points(e, v, 2), "json"))
    assert got["cycleCount"] == len(got["sccs"]) == 11 and got["sccs"][0] == {"rank": 1, "size": 4, "pctOfCodebase": 0.16, "files": names[:4]}
    assert [list(s) for s in got["suggestions"]] == [["file", "betweenness", "fanOutInCore", "fanInInCore"]] * 2
    assert sinks.cycles(metrics.cycle_report(e, v), 25).count("#") == 10
