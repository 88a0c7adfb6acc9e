import json
from pathlib import Path

import pytest

from sextant.commands import Commands
from sextant.facts import SCHEMAS, Facts
from sextant.operators import lookups, metrics, surface, tables
from sextant.operators.resolve import NotResolved, one, resolve
from sextant.sources import sinks
from sextant.sources.csharp import parse
from sextant.sources.solution import discover, git_head, projects, read_solution

SHOP = Path(__file__).parent / "shop"


@pytest.fixture(scope="module")
def shop(spark, tmp_path_factory):
    place = str(tmp_path_factory.mktemp("facts"))
    read_solution(spark, str(SHOP)).save(place)
    return Facts.load(spark, place)


def places(df):
    return [(r.path.rpartition("/")[2], r.line) for r in df.orderBy("ord").collect()]


def test_discovery(tmp_path):
    assert discover(str(SHOP / "Shop.Core")).name == "Shop.slnx"
    assert [n for n, _ in projects(SHOP / "Shop.slnx")] == ["Shop.Core", "Shop.Web"]
    (tmp_path / "a.sln").touch()
    (tmp_path / "b.sln").touch()
    with pytest.raises(ValueError):
        discover(str(tmp_path))
    assert git_head(str(tmp_path)) == ("", "")


def test_parser_survives_what_it_does_not_know():
    text = "namespace N { class A { int x = ; void M() { ??? ; var y = 1; } string P { get; init; } } record R(int A, string B); enum E { One, Two } }"
    decls, _ = parse(text)
    assert [(d.kind, d.name) for d in decls] == [("class", "A"), ("record", "R"), ("enum", "E")]
    assert "M" in [m.name for m in decls[0].members] and decls[1].params[1][1] == "B"


def test_resolution(shop):
    assert {r.display for r in resolve(shop, "BasketService").collect()} == {"Shop.Core.BasketService"}
    assert [r.kind for r in resolve(shop, "BasketService.Get").collect()] == ["method"]
    assert resolve(shop, " ").collect() == [] and resolve(shop, "Nope").collect() == []
    with pytest.raises(NotResolved) as e:
        one(shop, "BasketSer")
    assert e.value.names == ["Shop.Core.BasketService"]
    with pytest.raises(NotResolved):
        one(shop, "BasketService.Get", "type")


def test_lookups(shop):
    i = lambda name, *kinds: one(shop, name, *kinds)["id"]
    assert places(lookups.callers(shop, i("BasketService.Get"))) == [("Controllers.cs", 17)]
    assert places(lookups.callers(shop, i("IBasketRepository.Load"))) == [("Baskets.cs", 29)]
    assert [(r.context, r.depth) for r in lookups.call_chain(shop, i("BasketRepository.Load")).orderBy("depth").collect()] == [("[depth 1] BasketService.Get", 1), ("[depth 2] BasketController.Open", 2)]
    assert places(lookups.references(shop, i("Basket.Open"))) == [("Baskets.cs", 13), ("Baskets.cs", 34), ("Baskets.cs", 36), ("Baskets.cs", 44)]
    assert [r.containing for r in lookups.implementations(shop, i("IBasketRepository")).collect()] == ["BasketRepository"]
    assert [r.containing for r in lookups.inheritors(shop, i("DbContext")).collect()] == ["ShopDbContext"]
    assert [r.dependency for r in lookups.dependencies(shop, i("BasketController")).orderBy("ord").collect()] == ["BasketService", "BasketService"]
    assert [r.containing for r in lookups.injected(shop, "ShopDbContext").orderBy("ord").collect()] == ["BasketRepository", "BasketService"]
    assert sorted(r.usage for r in lookups.usages(shop, i("BasketService"), "shop.w").collect()) == ["field", "instantiation", "parameter", "pattern match", "reference"]
    assert places(lookups.parameters(shop, name="BASKETid")) == [("Controllers.cs", 15)]
    assert [r.context for r in lookups.members(shop, i("IPriceCache")).collect()] == ["public abstract Remove(string) -> void"]


def test_tables_and_trace(shop):
    i = lambda name: one(shop, name)["id"]
    assert [r.table_name for r in tables.dbset_usage(shop, i("BasketService")).orderBy("ord").collect()] == ["Baskets", "Baskets", "Journal"]
    assert places(tables.ownership_violations(shop, "BasketRepository", ["Baskets"])) == [("Baskets.cs", 33), ("Baskets.cs", 43)]
    assert {r.name: (r.injected, r.tables) for r in tables.service_map(shop).collect()} == {"BasketRepository": ([], ["Baskets"]), "BasketService": (["IBasketRepository", "IPriceCache"], ["Baskets", "Journal"])}
    down = {r.name: r for r in surface.audit_downstream(shop, i("BasketService")).collect()}
    names = lambda v: [(x.table_name, x.via) for x in v or []]
    assert names(down["Get"].reads) == [("Baskets", "Load")] and names(down["Close"].writes) == [("Baskets", None)]
    assert down["Reopen"].calls == ["Forget (private)", "Log (private)", "_cache.Remove"] and ("Journal", None) in names(down["Reopen"].writes)
    assert down["Log"].external == ["File.AppendAllText"]
    shapes = {r.name: r.shape for r in surface.audit_surface(shop, i("BasketService")).collect()}
    assert shapes == {"Get": "passthrough-repo", "Close": "write", "Reopen": "write", "Forget": "complex", "Log": "write", "Total": "complex"}
    assert [(r.name, r.prod_count) for r in surface.audit_surface(shop, i("IBasketRepository")).orderBy("ord").collect()] == [("Load", 1), ("Count", 1)]


def test_health(shop):
    rows = {r.name: r for r in metrics.health(shop).collect()}
    assert rows["BasketService"].n_methods == 7 and rows["BasketService"].max_method == "Total" and rows["BasketService"].max_cc == 7
    assert metrics.snapshot(shop).first().n_interfaces == 2


def test_commands(shop, tmp_path):
    log = tmp_path / "usage.log"
    run = Commands(shop, sinks.UsageLog(str(log))).run
    got = json.loads(run("audit-auth", style="json"))
    assert [r["context"] for r in got["results"]] == ["[HttpPost] Open — missing [Authorize]", "[HttpPost] Open — missing [ValidateAntiForgeryToken]", "[HttpPost] Name — missing [ValidateAntiForgeryToken]"]
    assert [r["line"] for r in json.loads(run("audit-cache", style="json"))["results"]] == [31]
    assert [r["line"] for r in json.loads(run("audit-immutable", style="json", types="Entry"))["results"]] == [25]
    assert json.loads(run("audit-immutable", style="json", types="Shop.Core.Entry"))["total"] == 1 and json.loads(run("audit-immutable", style="json", types="Other.Entry"))["total"] == 0
    services = json.loads(run("service-map", style="json"))
    assert list(services) == ["command", "services", "total"] and list(services["services"][0]) == ["name", "file", "line", "injected", "tables"]
    assert run("service-map").split("\n\n")[2] == "BasketService\n  injected: IBasketRepository, IPriceCache\n  tables: Baskets, Journal"
    assert run("service-map", limit=1).startswith("1 of 2 services in service-map")
    assert json.loads(run("audit-ef", style="json"))["total"] == 0
    limited = json.loads(run("references", "BasketService", style="json", limit=2))
    assert limited["total"] == 2 and limited["totalBeforeLimit"] > 2 and set(limited["results"][0]) == {"file", "line", "column", "context", "containingSymbol"}
    assert run("callers", "BasketService.Get").splitlines() == ["1 callers of BasketService.Get", "", "Shop.Web/Controllers.cs", "  17: return _service.Get(basketId);"]
    assert "not found" in run("callers", "Nothing") and "only supports classes" in run("audit-downstream", "IBasketRepository") and "unknown" in run("dance")
    for name in ("health", "cycles", "service-map"):
        assert json.loads(run(name, style="json"))["command"] == name
    assert run("cycles", suggest=True) and run("audit-surface", "BasketService") and run("parameters", type_name="entry").startswith("1 ")
    history = tmp_path / "h.csv"
    for _ in range(2):
        run("snapshot", append=str(history), commit='a,"b')
    lines = history.read_text().splitlines()
    assert len(lines) == 3 and '"a,""b"' in lines[1]
    assert sinks.read_usage(shop.files.sparkSession, str(log)).filter("command = 'snapshot'").count() == 2
    wishes = sinks.Requests(str(tmp_path / "r.log"))
    wishes.run("more")
    assert "more" in wishes.run(show=True) and wishes.run("x", show=True, clear=True) == "cleared" and wishes.run(show=True) == ""


def test_empty_facts(spark):
    f = Facts.empty(spark)
    assert {*SCHEMAS, "hierarchy", "names"} == set(vars(f))
    for df in (lookups.references(f, 1), lookups.parameters(f, name="x"), tables.service_map(f), metrics.health(f), surface.audit_downstream(f, 1)):
        assert df.collect() == []
