"""The corpus pipeline: five stages, each on all that the one before it kept.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns the columns
of documents, the last one the packed pieces. Rows with a null doc_id are left out, and of rows
that share a doc_id the one with the greatest columns stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.llm._shared import cut, keyed
from sextant.llm.decontaminate import contaminated
from sextant.llm.near import near_duplicates
from sextant.llm.packing import pack
from sextant.llm.quality import classify
from sextant.llm.substring import strip_repeats

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _kept(docs: DataFrame, verdicts: DataFrame) -> DataFrame:
    return docs.join(verdicts.filter("kept").select("doc_id"), "doc_id", "left_semi").select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled documents among them, accepts."""
    docs = keyed(docs, *COLUMNS)
    return _kept(docs, classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest doc_id, of each group of near duplicates."""
    docs = keyed(docs, *COLUMNS)
    return _kept(docs, near_duplicates(docs))


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 20 words or more that also stand earlier; documents of which
    nothing is left go."""
    docs = keyed(docs, *COLUMNS)
    kept = strip_repeats(docs).filter("n_removed < n_words or n_words = 0").select("doc_id", "text")
    rest = docs.select("doc_id", "lang", "source")
    return kept.join(rest, "doc_id").withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    docs = keyed(docs, *COLUMNS)
    return _kept(docs, contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences."""
    return pack(docs)


STAGES = [("quality", quality), ("near", near), ("substrings", substrings), ("decontamination", decontamination), ("packing", packing)]

#: Hashed signatures, a trained model and best-fit packing have no SQL form; tests/llm compares
#: the stages with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut(docs)
    return docs
