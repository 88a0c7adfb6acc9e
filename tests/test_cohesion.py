import random

from pyspark.sql import functions as F

from sextant.operators import metrics as M


def test_components_of_small_and_large_types(spark, monkeypatch):
    """Types of many and few uses, with chains, against plain union; small types alone need no graph."""
    rnd = random.Random(5)
    rows = [(t, f"m{rnd.randrange(12)}", f"f{rnd.randrange(14)}") for t in range(40) for _ in range(rnd.randrange(1, 25))]
    rows += [(99, f"m{k}", f"f{k + d}") for k in range(60) for d in (0, 1)] + [(98, "m", "f")] * 50
    rnd.shuffle(rows)
    want = {}
    for t in {r[0] for r in rows}:
        own = [(m, f) for x, m, f in rows if x == t]
        name = {("m", m): ("m", m) for m, _ in own}
        for _ in range(len(own)):
            for m, f in own:
                low = min(name[("m", m)], name.get(("f", f), ("z",)))
                name[("m", m)] = name[("f", f)] = low
        want[t] = len(set(name.values()))
    e = spark.createDataFrame([*rows, (1, None, "f"), (1, "m", None), (None, "m", "f")], "type_id long, method_name string, field string")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for size, most in ((7, 20), (7, 1 << 16)):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            assert {r.type_id: r.components for r in M.cohesion(e, most).collect()} == want, (size, most)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    monkeypatch.setattr(M.graph, "connected", None)
    assert M.cohesion(e).agg(F.sum("components")).first()[0] == sum(want.values())
