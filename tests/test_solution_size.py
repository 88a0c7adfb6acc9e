"""Facts do not depend on which side of the outline's bound a solution falls."""

from pathlib import Path

from sextant.facts import SCHEMAS
from sextant.sources.solution import extract, source_files

SHOP = Path(__file__).parent / "shop"
FILES = [
    ("A", 0, 1, "A/Base.cs", "namespace A; public interface IRoot { void Ping(); } public class Root : IRoot { public void Ping() {} public Leaf Next { get; set; } } public class Leaf { public Tip Tip() { return null; } } public class Tip { public void End() {} } public class MarkAttribute {}"),
    ("A", 0, 2, "A/Outer.cs", "namespace A; public class Outer { public class Inner : Deep { } public class Deep { public Root Root; } }"),
    ("B", 1, 1, "B/Mid.cs", "using A; namespace B; public class Mid : Root { public System.Collections.Generic.List<Leaf> Leaves; public Outer.Inner In; }"),
    ("C", 2, 1, "C/Use.cs", "using A; using B; namespace C; [Mark] public class Use { private Mid _m; public void Go() { _m.Ping(); _m.Next.Tip().End(); _m.Leaves.First().Tip(); var x = _m.In.Root; x.Ping(); } }"),
    ("D", 3, 1, "D/Program.cs", "using C; var u = new Use(); u.Go();"),
    ("D", 3, 2, "D/Empty.cs", None),
]


def rows(facts):
    return {n: sorted(map(repr, getattr(facts, n).collect())) for n in SCHEMAS}


def test_both_ways_of_binding(spark):
    files = spark.createDataFrame([(*f, 1) for f in FILES], "project string, project_ord int, file_ord int, path string, text string, loc int")
    small, large = rows(extract(files)), rows(extract(files, bound=0))
    assert small == large
    bound = [r for r in small["calls"] if "C/Use.cs" in r and "callee_id=None" not in r]
    assert len(bound) >= 4  # across three projects
    shop = source_files(spark, str(SHOP))
    assert rows(extract(shop)) == rows(extract(shop, bound=0))
