"""From a name to symbols."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sextant.facts import Facts

#: how many candidates of an ambiguous name a message names
_NAMED = 50
SYMBOL = ["id", "kind", "name", "display", "parent_id", "path", "line", "col", "ord"]


class NotResolved(Exception):
    """Carries the message that a user sees, and candidates or suggestions."""

    def __init__(self, message: str, names: list[str]):
        super().__init__(message)
        self.names = names


def first_of(df: DataFrame, *keys: str, order: str = "ord") -> DataFrame:
    """The first row of each key."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return df.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def symbols(facts: Facts, where: Column | DataFrame | None = None) -> DataFrame:
    """Top-level types, their members, and nested types as members; one row per kind and
    display. ``where`` is on the name or display, or a table of displays, so it holds for all or
    none of the rows that are made one, and goes first."""
    types = facts.types.filter("depth <= 1").select(F.col("type_id").alias("id"), F.lit("type").alias("kind"), "name", "display", "parent_id", "path", "line", "col", "ord")
    top = facts.types.filter("depth = 0").select("type_id").distinct()
    members = facts.members.filter("not is_implicit and not is_accessor").join(top, "type_id", "left_semi")
    members = members.select(F.col("member_id").alias("id"), "kind", "name", "display", F.col("type_id").alias("parent_id"), "path", "line", "col", "ord")
    rows = types.unionByName(members)
    if isinstance(where, DataFrame):
        rows = rows.join(where, "display", "left_semi")
    elif where is not None:
        rows = rows.filter(where)
    return first_of(rows, "kind", "display")


def _least_priority(*found: DataFrame) -> DataFrame:
    """The first of several results that is not empty, without asking the driver."""
    all_ = None
    for k, df in enumerate(found):
        df = df.select(*SYMBOL).withColumn("priority", F.lit(k))
        all_ = df if all_ is None else all_.unionByName(df)
    best = all_.agg(F.min("priority").alias("best"))
    return all_.join(F.broadcast(best), F.col("priority") == F.col("best")).select(*SYMBOL)


def _qualified(facts: Facts, query: str) -> Column | DataFrame:
    if facts.names is not None:
        end = facts.names.ending("display", query).select(F.col("text").alias("display"))
        return end.filter((F.col("display") == query) | F.col("display").endswith("." + query))
    return (F.col("display") == query) | F.col("display").endswith("." + query)


def resolve(facts: Facts, query: str) -> DataFrame:
    """SYMBOL rows. With a dot: members of the types that the part before the last dot names,
    else the whole as a qualified name, in full before its end. Without: every symbol of that
    name."""
    if not query or not query.strip():
        return symbols(facts, F.lit(False)).select(*SYMBOL)
    if "." not in query:
        return symbols(facts, F.col("name") == query).select(*SYMBOL)
    owner, _, member = query.rpartition(".")
    if "." in owner:
        named = symbols(facts, _qualified(facts, owner)).filter("kind = 'type'")
        owners = _least_priority(named.filter(F.col("display") == owner), named)
    else:
        owners = symbols(facts, F.col("name") == owner).filter("kind = 'type'")
    owners = owners.select(F.col("id").alias("parent_id")).distinct()
    whole = symbols(facts, _qualified(facts, query))
    return _least_priority(symbols(facts, F.col("name") == member).join(owners, "parent_id", "left_semi"), whole.filter(F.col("display") == query), whole)


def suggest(facts: Facts, query: str, limit: int = 10) -> DataFrame:
    """The first types whose name contains the query, whatever the case."""
    if facts.names is not None:
        hits = facts.types.join(facts.names.containing("type", query).withColumnRenamed("text", "name"), "name", "left_semi")
    else:
        hits = facts.types.filter(F.lower("name").contains(query.lower()))
    return hits.groupBy("display").agg(F.min("ord").alias("ord")).orderBy("ord").limit(limit)


def one(facts: Facts, query: str, *kinds: str, prefer: bool = False) -> dict:
    """The single symbol that a command is about, of one of ``kinds`` if any are given. With
    ``prefer`` an ambiguous name is settled if exactly one candidate has such a kind. Of many
    candidates the first ``_NAMED`` are told."""
    fits = F.col("kind").isin(*kinds) if kinds else F.lit(True)
    rows = resolve(facts, query).withColumn("fits", fits)
    nth = F.row_number().over(Window.partitionBy("fits").orderBy("ord"))
    found = [r.asDict() for r in rows.withColumn("nth", nth).filter(F.col("nth") <= _NAMED).orderBy("ord").collect()]
    if not found:
        raise NotResolved(f"Symbol not found: {query}", [r.display for r in suggest(facts, query.rpartition(".")[2] or query).collect()])
    fitting = [r for r in found if r["fits"]]
    if prefer and len(fitting) == 1:
        return fitting[0]
    if len(found) > 1:
        raise NotResolved(f"Ambiguous symbol: {query}", [r["display"] for r in found])
    if not fitting:
        raise NotResolved(f"{query} is a {found[0]['kind']}; expected {' or '.join(kinds)}", [found[0]["display"]])
    return found[0]
