"""Names as an index: postings of letter groups for parts of names, reversed texts for endings.

A text has a posting for each distinct run of one, two or three characters of its lower case. A part
of up to three characters is a posting itself; a longer one's candidates have all of its groups, found by
counting, and are verified. An ending is the beginning of the reversed text, which a sorted table
answers from a range.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_SCHEMAS = {"postings": "kind STRING, gram STRING, text STRING", "endings": "kind STRING, back STRING, text STRING"}


def _grams(text: Column) -> Column:
    def runs(n: int) -> Column:
        all_ = F.transform(F.sequence(F.lit(1), F.length(text) - (n - 1)), lambda i: F.substring(text, i, F.lit(n)))
        return F.when(F.length(text) >= n, all_).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.concat(runs(1), runs(2), runs(3)))


@dataclass
class Names:
    """Texts of several kinds: the names of types and parameters, the texts of parameters' types,
    and the full names of types and members."""

    postings: DataFrame
    endings: DataFrame

    def containing(self, kind: str, part: str) -> DataFrame:
        """(text) of the texts that have ``part``, whatever the case."""
        part = part.lower()
        own = self.postings.filter(F.col("kind") == kind)
        if not part:
            return own.select("text").distinct()
        if len(part) <= 3:
            return own.filter(F.col("gram") == part).select("text")
        grams = sorted({part[i : i + 3] for i in range(len(part) - 2)})
        found = own.filter(F.col("gram").isin(grams)).groupBy("text").count().filter(F.col("count") == len(grams))
        return found.filter(F.lower("text").contains(part)).select("text")

    def ending(self, kind: str, end: str) -> DataFrame:
        """(text) of the texts that end with ``end``."""
        return self.endings.filter((F.col("kind") == kind) & F.col("back").startswith(end[::-1])).select("text")

    def save(self, path: str) -> None:
        for name, key in (("postings", "gram"), ("endings", "back")):
            getattr(self, name).repartitionByRange("kind", key, "text").sortWithinPartitions("kind", key).write.parquet(f"{path}/{name}")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Names:
        return cls(**{n: spark.read.schema(s).parquet(f"{path}/{n}") for n, s in _SCHEMAS.items()})


def build(types: DataFrame, members: DataFrame, params: DataFrame) -> Names:
    """The index of the fact tables' names; null texts have no entry."""
    of = lambda df, kind, column: df.select(F.lit(kind).alias("kind"), F.col(column).alias("text")).filter("text is not null").distinct()
    parts = of(types, "type", "name").union(of(params, "parameter", "name")).union(of(params, "parameter type", "type_display"))
    whole = of(types, "display", "display").union(of(members, "display", "display")).distinct()
    return Names(parts.select("kind", F.explode(_grams(F.lower("text"))).alias("gram"), "text"), whole.select("kind", F.reverse("text").alias("back"), "text"))
