"""Entries written by tasks: the document in the order of the file names."""

import glob
import json
import os
import subprocess
import sys

from sextant.sources import sinks

MILLION = """
import json, sys
from pyspark.sql import SparkSession
from sextant.sources import sinks
spark = SparkSession.builder.master("local[4]").config("spark.driver.memory", "512m").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "8").getOrCreate()
rows = spark.range(1_000_000).selectExpr("concat('f', id % 1000, '.cs') path", "cast(id as int) line", "1 col", "concat('context of ', id, ' ', repeat('x', 300)) context", "'c' containing", "id * 7919 % 1000000 ord")
print(sinks.write_entries(rows, sys.argv[1], "references", "X"))
"""


def text(path):
    return "".join(open(f).read() for f in sorted(glob.glob(f"{path}/part-*")))


def test_same_document(spark, tmp_path, monkeypatch):
    from sextant.operators import graph

    monkeypatch.setattr(graph, "ROWS", 20)
    monkeypatch.setattr(sinks, "ROWS", 20)
    rows = [(f"f{k % 7}.cs", k, 1, f'c "{k}"\t', "x" if k % 2 else None, k * 31 % 90) for k in range(90)]
    df = spark.createDataFrame(rows, "path string, line int, col int, context string, containing string, ord long")
    assert sinks.write_entries(df, f"{tmp_path}/j", "callers", 'A"b') == 90 and len(glob.glob(f"{tmp_path}/j/part-*")) > 3
    want = json.loads(sinks.entries(df, "callers", 'A"b', style="json"))
    got = json.loads(text(f"{tmp_path}/j"))
    assert got == want or [{k: v for k, v in r.items() if v is not None} for r in got["results"]] == want["results"]
    sinks.write_entries(df, f"{tmp_path}/c", "callers", "A", "compact")
    assert text(f"{tmp_path}/c").rstrip("\n") == sinks.entries(df, "callers", "A")
    assert sinks.write_entries(df.limit(0), f"{tmp_path}/e", "callers", "A") == 0
    assert json.loads(text(f"{tmp_path}/e")) == {"command": "callers", "symbol": "A", "results": [], "total": 0}


def test_a_million_entries_under_a_small_driver(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = subprocess.run([sys.executable, "-c", MILLION, f"{tmp_path}/m"], cwd=root, env=os.environ | {"PYTHONPATH": root}, capture_output=True, text=True, timeout=600)
    assert out.stdout.split()[-1:] == ["1000000"], out.stderr[-2000:]
    files = sorted(glob.glob(f"{tmp_path}/m/part-*"))
    assert len(files) >= 3
    with open(files[-1]) as f:
        assert f.read().endswith('], "total": 1000000}\n')
