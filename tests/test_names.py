import pytest

from sextant.facts import Facts
from sextant.operators import lookups, names
from sextant.operators.resolve import resolve, suggest
from sextant.plans import star

TEXTS = ["UserService", "userservice", "IUserService", "aaa", "aaaa", "a", "", "Öl", "xyzxyz", "zxy", None]


@pytest.fixture(scope="module")
def index(spark):
    types = spark.createDataFrame([(t, f"N.{t}") for t in TEXTS], "name string, display string")
    members = spark.createDataFrame([("N.User.Get",), ("User.Get",), ("rUser.Get",)], "display string")
    return names.build(types, members, spark.createDataFrame([("p1", "List<User>")], "name string, type_display string"))


def test_parts_of_any_length(index):
    known = {t for t in TEXTS if t is not None}
    for part in ("", "a", "A", "aa", "aaa", "aaaa", "aaaaa", "user", "SERVICE", "ö", "öl", "xyzx", "zxyz", "er", "rs", "userx", "%", "ser_"):
        assert {r.text for r in index.containing("type", part).collect()} == {t for t in known if part.lower() in t.lower() and t}, part
    assert {r.text for r in index.containing("parameter type", "t<user").collect()} == {"List<User>"}


def test_endings(index):
    for end in ("User.Get", ".User.Get", "Get", "N.aaa", "x"):
        whole = {f"N.{t}" for t in TEXTS if t is not None} | {"N.User.Get", "User.Get", "rUser.Get"}
        assert {r.text for r in index.ending("display", end).collect()} == {t for t in whole if t.endswith(end)}


def test_same_answers_with_saved_indexes(spark, tmp_path):
    full = star.facts(spark, "/root/testdata/sf0.001")
    full.save(f"file://{tmp_path}/f")
    saved = Facts.load(spark, f"file://{tmp_path}/f")
    rows = lambda df: list(map(repr, df.collect()))
    assert rows(suggest(saved, "er#0")) == rows(suggest(full, "er#0")) != []
    for query in ("AMERICA.NATION_1", "NATION_1.Supplier#000000001", "Supplier#000000001.Ship", "ASIA", "no.such"):
        assert sorted(rows(resolve(saved, query))) == sorted(rows(resolve(full, query))), query
    for options in ({"name": "pr"}, {"type_name": "er#000000001"}, {"name": "f", "type_name": "db"}):
        assert sorted(rows(lookups.parameters(saved, **options))) == sorted(rows(lookups.parameters(full, **options)))
    plan = saved.names.ending("display", "NATION_1")._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(back,1_NOITAN)" in plan
