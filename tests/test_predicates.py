"""Classifiers and scalar functions on literal rows."""

import pytest
from pyspark.sql import functions as F

from sextant.functions import predicates as P
from sextant.functions import text as T
from sextant.operators.metrics import cyclomatic, nearest_rank
from sextant.sources.sinks import csv_line


def values(spark, expr, column, rows, kind="string"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, {column} {kind}")
    return [r.v for r in df.select("i", expr.alias("v")).orderBy("i").collect()]


def test_names_and_paths(spark):
    c = F.col("x")
    assert values(spark, P.test_project(c), "x", ["My.Tests", "latest", "Core", "A.Spec"]) == [True, True, False, False]
    assert values(spark, P.test_project(c, specs=True), "x", ["A.Spec", "Core"]) == [True, False]
    assert values(spark, P.test_path(c), "x", ["src/tests/A.cs", "A.Tests/B.cs", "ATests.cs", "src/A.cs"]) == [True, True, True, False]
    assert values(spark, P.excluded_path(c), "x", ["", "obj/A.cs", "a/Migrations/B.cs", "a/B.cs"]) == [True, True, True, False]
    assert values(spark, P.excluded_path(c, migrations=False), "x", ["a/obj/A.cs", "a/Migrations/B.cs"]) == [True, False]
    assert values(spark, P.is_context(c), "x", ["DbContext", "ShopDbContext", "ContextDb", None]) == [True, True, False, False]
    assert values(spark, P.has_attribute(c, "Authorize"), "x", ["Authorize", "AuthorizeAttribute", "A.B.Authorize", "NotAuthorize"]) == [True, True, True, False]
    assert values(spark, P.is_external_io(c), "x", ["System.IO", "System.Net.Http.Json", "Google.Cloud", "Shop", None]) == [True, True, True, False, False]
    assert values(spark, T.relative_path(c, "/a/b"), "x", ["/a/b/C.cs", "/A/B/d\\E.cs", "/a/bc/F.cs"]) == ["C.cs", "d/E.cs", "/a/bc/F.cs"]


def test_usage_kind(spark):
    rows = [["argument", "new", "method"], ["property:type", "type"], ["property"], ["method:return"], ["is", "method"], [], ["catch"], ["local", "method"]]
    assert values(spark, P.usage_kind(F.col("x")), "x", rows, "array<string>") == ["instantiation", "property type", "reference", "return type", "pattern match", "reference", "catch", "local"]


def test_clr_defaults(spark):
    df = spark.createDataFrame([("false", "false"), ("true", "true"), ("number", "0"), ("number", "0.0f"), ("number", "0m"), ("number", "10"), ("string", '""'), ("string", '"a"'), ("default", "default")], "k string, t string")
    assert [r.v for r in df.select(P.is_clr_default(F.col("k"), F.col("t")).alias("v")).collect()] == [True, False, True, True, True, False, True, False, True]


def test_receivers(spark):
    df = spark.createDataFrame([("this", None), ("this._x", None), ("_r", "UserRepository"), ("_f", "IDbContextFactory"), ("_s", "Clock"), ("y", None)], "r string, t string")
    assert [r.v for r in df.select(P.receiver_kind(F.col("r"), F.col("t"), F.lit(True)).alias("v")).collect()] == ["self", "self", "repo", "repo", "service", None]


def test_scores_round_half_to_even(spark):
    df = spark.createDataFrame([(3, 0, 0, 0, 1.0), (0, 125, 0, 0, 1.0), (0, 175, 0, 0, 1.0), (300, 5000, 99, 99, 0.0)], "cc int, n int, ce int, ca int, coh double")
    got = [r.v for r in df.select(P.composite_score(F.col("cc"), F.col("n"), F.col("ce"), F.col("ca"), F.col("coh")).alias("v")).collect()]
    assert got == [2, 2, 4, 100]
    one = spark.range(1).select(P.instability(F.lit(0), F.lit(0)).alias("a"), P.instability(F.lit(3), F.lit(1)).alias("b"), P.instability_label(F.lit(0.9)).alias("c"), P.cohesion_label(F.lit(0.2)).alias("d")).first()
    assert (one.a, one.b, one.c, one.d) == (0.0, 0.75, "unstable", "low")


@pytest.mark.parametrize("n, want", [(10, 10), (100, 95), (1, 1)])
def test_nearest_rank(spark, n, want):
    assert spark.range(1, n + 1).agg(nearest_rank("id", 0.95).alias("v")).first().v == want


def test_complexity_and_lines(spark):
    df = spark.createDataFrame([(1, k) for k in ("if", "else", "case", "default", "&&", "??=", "arm")] + [(2, "else")], "member_id long, kind string")
    assert {r.member_id: r.complexity for r in cyclomatic(df).collect()} == {1: 5, 2: 1}
    assert values(spark, T.nonblank_lines(F.col("x")), "x", ["a\n\n \t\r\nb", "", None]) == [2, 0, 0]
    assert values(spark, T.source_line(F.col("x"), F.lit(2)), "x", ["a\n  b c\r\nd"]) == ["b c"]


def test_labels():
    assert T.comma_set(" a, b,,a ") == ["a", "b"]
    assert T.parameter_query("x", None) == "--name x" and T.parameter_query("x", "y") == "--name x --type y"
    assert csv_line(["a,b", 'c"d', 1]) == '"a,b","c""d",1'
