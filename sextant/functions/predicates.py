"""Classifiers over fact columns, as Column expressions. The sets are fixed values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CACHE_METHODS = ["Remove", "RemoveAsync", "Set", "SetAsync", "CreateEntry", "Evict", "EvictAsync"]
LINQ_PREDICATES = ["Where", "FirstOrDefault", "First", "Single", "SingleOrDefault", "Any", "Count", "LongCount", "All", "Last", "LastOrDefault"]
REMOVERS = ["Remove", "RemoveRange", "Update"]
BULK_CHANGES = ["ExecuteUpdate", "ExecuteDelete", "ExecuteUpdateAsync", "ExecuteDeleteAsync"]
ADDERS = ["Add", "AddRange", "AddAsync"]
WRITES = ["Add", "AddAsync", "AddRange", "AddRangeAsync", "Update", "UpdateRange", "Remove", "RemoveRange", "ExecuteDelete", "ExecuteDeleteAsync", "ExecuteUpdate", "ExecuteUpdateAsync"]
SAVES = ["SaveChanges", "SaveChangesAsync"]
ALWAYS_WRITES = [*SAVES, "ExecuteDelete", "ExecuteDeleteAsync", "ExecuteUpdate", "ExecuteUpdateAsync"]
LINQ = [
    "Where", "Select", "SelectMany", "Any", "All", "First", "FirstOrDefault", "Single", "SingleOrDefault", "Last", "LastOrDefault", "Count",
    "LongCount", "ToList", "ToArray", "ToDictionary", "ToHashSet", "OrderBy", "OrderByDescending", "ThenBy", "ThenByDescending", "GroupBy",
    "Distinct", "Skip", "Take", "ToListAsync", "ToArrayAsync", "ToDictionaryAsync", "FirstOrDefaultAsync", "FirstAsync", "SingleOrDefaultAsync",
    "SingleAsync", "AnyAsync", "AllAsync", "CountAsync", "LongCountAsync", "Sum", "Min", "Max", "Average", "Include", "ThenInclude", "AsNoTracking",
    "AsTracking", "Contains",
]
MUTATING_VERBS = ["HttpPost", "HttpPut", "HttpDelete", "HttpPatch"]
ACTION_ATTRIBUTES = [*MUTATING_VERBS, "HttpGet", "Route"]
PRIMITIVES = ["bool", "byte", "sbyte", "short", "ushort", "int", "uint", "long", "ulong", "float", "double", "decimal", "char", "string", "object", "void"]
#: the same types by their names in System
PRIMITIVE_NAMES = ["Boolean", "Byte", "SByte", "Int16", "UInt16", "Int32", "UInt32", "Int64", "UInt64", "Single", "Double", "Decimal", "Char", "String", "Object", "Void"]
IO_NAMESPACES = ["System.Net.Http", "System.IO", "Google.", "Microsoft.AspNetCore.SignalR.Client"]

#: ancestor kind -> usage kind; the nearest ancestor that is listed decides
USAGE_KINDS = {
    "base": "base type", "field": "field", "property:type": "property type", "property": "reference", "parameter": "parameter", "method:return": "return type",
    "method": "reference", "local": "local", "constraint": "type constraint", "attribute": "attribute", "new": "instantiation", "cast": "cast", "typeof": "typeof",
    "is": "pattern match", "catch": "catch", "type": "reference", "namespace": "reference", "unit": "reference",
}


def usage_kind(kinds: Column) -> Column:
    """The kind of a use, from the ancestors' kinds, the nearest first."""
    known = F.create_map(*(F.lit(x) for pair in USAGE_KINDS.items() for x in pair))
    hit = F.filter(F.transform(kinds, lambda k: known[k]), lambda v: v.isNotNull())
    return F.coalesce(F.get(hit, 0), F.lit("reference"))


def any_contains(name: Column, *parts: str) -> Column:
    """Whether a name has one of the parts, whatever the case."""
    out = F.lit(False)
    for p in parts:
        out = out | F.lower(name).contains(p.lower())
    return out


def test_project(name: Column, specs: bool = False) -> Column:
    """Rule A: the name has "test"; with ``specs`` (rule B) also "spec"."""
    return any_contains(name, "test", *(["spec"] if specs else []))


def test_path(path: Column) -> Column:
    return F.lower(path).contains("/tests/") | path.contains(".Tests/") | path.endswith("Tests.cs")


def excluded_path(path: Column, migrations: bool = True) -> Column:
    slashed = F.concat(F.lit("/"), path)
    out = (F.coalesce(path, F.lit("")) == "") | slashed.contains("/obj/")
    return out | slashed.contains("/Migrations/") if migrations else out


def is_context(name: Column) -> Column:
    return F.coalesce(name.endswith("DbContext"), F.lit(False))


def is_dbset(name: Column) -> Column:
    return F.coalesce(name == "DbSet", F.lit(False))


def has_attribute(text: Column, name: str) -> Column:
    """``name`` with or without its suffix, alone or at the end of a qualified name."""
    return text.isin(name, f"{name}Attribute") | text.endswith(f".{name}") | text.endswith(f".{name}Attribute")


def is_primitive(name: Column) -> Column:
    return name.isin(PRIMITIVES) | F.regexp_replace(name, r"^(global::)?System\.", "").isin(PRIMITIVE_NAMES)


def is_external_io(namespace: Column) -> Column:
    out = F.lit(False)
    for n in IO_NAMESPACES:
        out = out | F.coalesce(namespace.startswith(n), F.lit(False))
    return out


def is_clr_default(kind: Column, text: Column) -> Column:
    """false, a number that reads as 0, an empty string, or default."""
    number = F.regexp_replace(F.lower(text), "[fdmul]+$", "")
    return (kind == "false") | ((kind == "number") & number.rlike(r"^[0_]+(\.0+)?$")) | ((kind == "string") & text.isin('""', '@""')) | (kind == "default")


def is_repository_like(name: Column) -> Column:
    return is_context(name) | (name == "IDbContextFactory") | F.coalesce(name.endswith("Repository"), F.lit(False))


def receiver_kind(receiver: Column, root_type: Column, is_member: Column) -> Column:
    """self, repo, service or null: ``this`` and members of unknown type are self."""
    known = F.when(is_repository_like(root_type), "repo").when(root_type.isNotNull(), "service")
    return F.when(receiver == "this", "self").when(receiver.startswith("this."), F.coalesce(known, F.lit("self"))).otherwise(known)


def instability(ce: Column, ca: Column) -> Column:
    return F.when(ca + ce == 0, F.lit(0.0)).otherwise(ce / (ca + ce))


def composite_score(complexity: Column, lines: Column, ce: Column, ca: Column, cohesion: Column) -> Column:
    """0 to 100, rounded half to even."""
    part = lambda v, most, weight: F.least(v / F.lit(float(most)) * weight, F.lit(float(weight)))
    total = part(complexity, 30, 25) + part(lines, 1000, 20) + part(ce, 15, 20) + part(ca, 20, 15) + (1 - cohesion) * 20
    return F.bround(F.least(total, F.lit(100.0)), 0).cast("int")


def instability_label(value: Column) -> Column:
    return F.when(value > 0.8, "unstable").when(value < 0.2, "stable").otherwise("")


def cohesion_label(value: Column) -> Column:
    return F.when(value < 0.3, "low").when(value >= 0.6, "good").otherwise("")
