from pyspark.sql import functions as F

import corpus_pipeline as P
from sextant.llm.packing import pack_shard
from sextant.llm.quality import classify
from tests.llm.test_near import brute as near_brute
from tests.llm.test_substring import brute as substring_brute

SF = "/root/testdata/sf0.001"


def test_stages_against_plain_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(120)
    docs = docs.union(docs.limit(3))
    seen = {r.doc_id: r for r in docs.collect()}
    verdict = {r.doc_id: r.kept for r in classify(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()}

    one = P.quality(spark, docs, SF).collect()
    assert {r.doc_id for r in one} == {i for i, k in verdict.items() if k} and len(one) == len({r.doc_id for r in one})
    assert all(r == seen[r.doc_id] for r in one)
    make = lambda rows: spark.createDataFrame(rows, docs.schema)

    two = P.near(spark, make(one), SF).collect()
    want = near_brute([(r.doc_id, r.text) for r in one])
    assert {r.doc_id for r in two} == {i for i, (_, _, kept) in want.items() if kept}

    three = P.substrings(spark, make(two), SF).collect()
    want = substring_brute([(r.doc_id, r.text) for r in two])
    assert {r.doc_id for r in three} == {i for i, (n, gone, _) in want.items() if gone < n or not n}
    assert all(r.n_chars == len(r.text) for r in three)

    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    four = P.decontamination(spark, make(three), SF).collect()
    assert {r.doc_id for r in four} == {r.doc_id for r in three if not any(t in r.text for t in items)}

    five = P.packing(spark, make(four), SF).collect()
    assert sum(r.n_words for r in five) == sum(len(r.text.split()) for r in four)
    assert {r.doc_id for r in five} == {r.doc_id for r in four}
    assert pack_shard([], 10, 1) == []


def test_empty(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        assert stage(spark, docs, SF).collect() == []


def test_odd_rows(spark):
    """Null texts, ids and languages, very long texts, ties and clashing columns in every stage."""
    base = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    long = " ".join(f"w{i % 9000}" for i in range(60_000))
    odd = [(9001, None, "en", "s", 0), (9002, "", None, None, None), (None, "text", "en", "s", 4), (9003, long, "en", "s", len(long)), (9003, long, "en", "s", len(long)), (9004, " \n", "en", "s", 2)]
    rows = base.union(spark.createDataFrame(odd, base.schema)).withColumns({"kept": F.lit(1), "label": F.lit("x"), "runs": F.lit(2), "bin": F.lit(3)})
    for name, stage in P.STAGES[1:]:
        out = stage(spark, rows, SF)
        ids = [r.doc_id for r in out.select("doc_id").collect()]
        assert None not in ids and {9001, 9002, 9004} <= set(ids) and 9003 in ids
        if name != "packing":
            assert out.columns == P.COLUMNS and len(ids) == len(set(ids))
            text = {r.doc_id: r.text for r in out.filter("doc_id > 9000").collect()}
            assert text[9001] is None and text[9002] == "" and text[9003].split()[:9000] == long.split()[:9000]
    first = P.quality(spark, rows, SF)
    assert first.columns == P.COLUMNS and not {9001, 9002, 9004} & {r.doc_id for r in first.collect()}
