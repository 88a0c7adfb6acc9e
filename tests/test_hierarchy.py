import random

from sextant.facts import Facts
from sextant.operators import lookups
from sextant.operators.hierarchy import build


def below(edges, x):
    seen, todo = set(), [x]
    while todo:
        y = todo.pop()
        for t, s, _ in edges:
            if s == y and t not in seen:
                seen.add(t)
                todo.append(t)
    return seen


def test_random_forests_and_interfaces(spark, monkeypatch):
    from sextant.operators import graph

    monkeypatch.setattr(graph, "ROWS", 7)
    monkeypatch.setattr(graph, "HUB", 4)
    rnd = random.Random(4)
    classes, faces = range(60), range(100, 115)
    edges = [(c, rnd.choice([0, rnd.randrange(c)]), "base") for c in classes if c % 7]
    edges += [(c, rnd.choice(faces), "interface") for c in rnd.sample(classes, 20)] + [(f, rnd.randrange(100, f), "interface") for f in faces if f > 100 and f % 2]
    types = spark.createDataFrame([(x,) for x in (*classes, *faces)], "type_id long")
    bases = spark.createDataFrame([*edges, (5, None, "base")], "type_id long, super_id long, edge string")
    index = build(types, bases)
    for x in (*classes, *faces):
        if x % 3 == 0 or x in (0, 1, 100, 101):
            assert {r.type_id for r in index.descendants(x).collect()} == below(edges, x), x
    spans = {r.type_id: (r.low, r.high) for r in index.spans.collect()}
    assert sorted(a for a, _ in spans.values()) == list(range(75)) and spans.keys() == {*classes, *faces}
    assert build(types.limit(0), bases.limit(0)).descendants(1).collect() == []


def test_lookup_has_no_loop(spark, tmp_path, monkeypatch):
    from sextant.plans import star

    full = star.facts(spark, "/root/testdata/sf0.001")
    full.save(f"file://{tmp_path}/f")
    saved = Facts.load(spark, f"file://{tmp_path}/f")
    want = {k: sorted(map(repr, f(full, star.NATION + k).collect())) for k, f in ((3, lookups.inheritors), (4, lookups.inheritors))}
    faces = sorted(map(repr, lookups.implementations(full, star.REGION + 1).collect()))
    monkeypatch.setattr(lookups, "bfs", None)
    assert {k: sorted(map(repr, lookups.inheritors(saved, star.NATION + k).collect())) for k in want} == want
    assert sorted(map(repr, lookups.implementations(saved, star.REGION + 1).collect())) == faces and faces
