"""Formatters and logs. Formatting collects rows that a person will read; writing stays in Spark."""

from __future__ import annotations

import csv
import io
import json
import os
import time
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sextant.functions import predicates as P
from sextant.operators.graph import ROWS, matched, numbered
from sextant.plans.store import cut

#: digits of the snapshot's CSV columns that are not whole numbers
DIGITS = {"core_size_pct": 6, "avg_reach": 3, "avg_fan_out": 3, "avg_cyclomatic": 3, "avg_class_loc": 1}
#: names of that CSV which are not those of the record
HEADER = {"avg_fan_out": "avg_fanout", "max_fan_out": "max_fanout", "max_fan_out_file": "max_fanout_file"}


def _camel(name: str) -> str:
    head, *rest = name.split("_")
    return head + "".join(x.capitalize() for x in rest)


def _plain(value, nulls: bool = False):
    if hasattr(value, "asDict"):
        value = value.asDict()
    if isinstance(value, dict):
        return {_camel(k): _plain(v, nulls) for k, v in value.items() if nulls or v is not None}
    return [_plain(v, nulls) for v in value] if isinstance(value, list) else value


def as_json(value: dict, nulls: bool = False) -> str:
    """Camel-case keys, indented, nulls left out unless asked for."""
    return json.dumps(_plain(value, nulls), indent=2, ensure_ascii=False)


def message(command: str, text: str, names: list[str] = (), style: str = "compact") -> str:
    if style == "json":
        return as_json({"command": command, "message": text + (": " + ", ".join(names) if names else "")})
    return "\n".join([text, *(f"  {n}" for n in names)])


def entries(df: DataFrame, command: str, symbol: str, limit: int | None = None, style: str = "compact") -> str:
    """ENTRY rows by ``ord``: as JSON, or grouped by file in the order in which files are met.
    With a limit only that many rows leave the cluster; the total is counted there."""
    total = df.count() if limit else None
    ordered = df.orderBy("ord")
    rows = (ordered.limit(limit) if limit else ordered).collect()
    more = total is not None and total > len(rows)
    if style == "json":
        out = {"command": command, "symbol": symbol, "results": [{"file": r.path, "line": r.line, "column": r.col, "context": r.context, "containing_symbol": r.containing} for r in rows], "total": len(rows)}
        return as_json(out | ({"total_before_limit": total} if more else {}))
    lines = [f"{len(rows)} of {total} {command} of {symbol}" if more else f"{len(rows)} {command} of {symbol}"]
    groups: dict[str, list] = {}
    for r in rows:
        groups.setdefault(r.path, []).append(r)
    for path, own in groups.items():
        lines += ["", path, *(f"  {r.line}: {r.context}" for r in own)]
    return "\n".join(lines)


def _fetched(df: DataFrame, limit: int | None) -> tuple[list[dict], dict]:
    """The first rows by ``ord``, and their number, with the total if there are more."""
    total = df.count() if limit else None
    ordered = df.orderBy("ord")
    rows = [r.asDict(recursive=True) for r in (ordered.limit(limit) if limit else ordered).collect()]
    return rows, {"total": len(rows)} | ({"total_before_limit": total} if total is not None and total > len(rows) else {})


def write_entries(df: DataFrame, path: str, command: str, symbol: str, style: str = "json") -> int:
    """The same document as ``entries`` without a limit, written by tasks: text files that make the
    document when they are read in the order of their names. Returns the number of entries."""
    rows = df.select("path", "line", "col", "context", "containing", "ord")
    order = ["ord", "path", "line", "col", "context", "containing"]
    if style == "json":
        rows = cut(numbered(rows, *order))
        total = rows.count()
        head = json.dumps({"command": command, "symbol": symbol, "results": []}, ensure_ascii=False)[:-2]
        named = F.struct(F.col("path").alias("file"), "line", F.col("col").alias("column"), "context", F.col("containing").alias("containingSymbol"))
        text = F.concat(F.when(F.col("no") > 1, F.lit(",")).otherwise(F.lit("")), F.to_json(named))
        ends = df.sparkSession.createDataFrame([(0, head), (total + 1, f'], "total": {total}}}')], "no long, value string")
        lines, order = rows.select("no", text.alias("value")).union(ends), ["no"]
    else:
        rows = cut(rows)
        first = rows.groupBy("path").agg(F.min("ord").alias("met"), F.count("*").alias("n"))
        total = rows.count()
        own = matched(rows, first, ["path"], "n", "context").select(F.lit(1).alias("k"), "met", "path", F.lit(1).alias("part"), *(c for c in order if c != "path"), F.concat(F.lit("  "), "line", F.lit(": "), "context").alias("value"))
        none = [F.lit(None).cast(dict(own.dtypes)[c]).alias(c) for c in order if c != "path"]
        heads = first.select(F.lit(1).alias("k"), "met", "path", F.lit(0).alias("part"), *none, F.concat(F.lit("\n"), "path").alias("value"))
        title = df.sparkSession.createDataFrame([(f"{total} {command} of {symbol}",)], "value string").select(F.lit(0).alias("k"), *(F.lit(None).cast(k).alias(c) for c, k in own.dtypes if c not in ("k", "value")), "value")
        lines, order = own.union(heads).union(title.select(*own.columns)), ["k", "met", "path", "part", *(c for c in order if c != "path")]
    lines = lines.repartitionByRange(max(1, -(-total // ROWS)), *order).sortWithinPartitions(*order)
    lines.select("value").write.text(path)
    return total


def service_map(df: DataFrame, limit: int | None = None, style: str = "compact") -> str:
    """The services by name, with what is injected and the tables they use."""
    total = df.count() if limit else None
    ordered = df.orderBy("name", "path")
    rows = (ordered.limit(limit) if limit else ordered).collect()
    more = total is not None and total > len(rows)
    if style == "json":
        services = [{"name": r["name"], "file": r.path, "line": r.line, "injected": r.injected, "tables": r.tables} for r in rows]
        return as_json({"command": "service-map", "services": services, "total": len(rows)} | ({"total_before_limit": total} if more else {}))
    lines = [f"{len(rows)}{f' of {total}' if more else ''} services in service-map"]
    for r in rows:
        lines += ["", r["name"], *(f"  {part}: {', '.join(r[part])}" for part in ("injected", "tables") if r[part])]
    return "\n".join(lines)


def _of(numbers: dict) -> str:
    shown, total = numbers["total"], numbers.get("total_before_limit")
    return f"{shown}{f' of {total}' if total else ''} method{'' if shown == 1 else 's'}"


def surface(df: DataFrame, callers: DataFrame, symbol: str, is_interface: bool, implementations: list[str], limit: int | None = None, style: str = "compact") -> str:
    """The methods of a type with their callers, those of the methods that are shown."""
    rows, numbers = _fetched(df, limit)
    by_id = {r["member_id"]: r for r in rows}
    for r in rows:
        r |= {"prod": [], "test": []}
    shown = callers.filter(F.col("member_id").isin(list(by_id))) if limit else callers
    for x in shown.orderBy("member_id", "ord", "path", "line", "col").toLocalIterator():
        by_id[x.member_id]["test" if x.is_test else "prod"].append(x.asDict())
    if style == "json":
        place = lambda x: {"file": x["path"], "line": x["line"], "column": x["col"], "context": x["context"]}
        methods = [
            {
                "name": r["name"], "signature": r["signature"],
                "callers": {"prod_count": r["prod_count"], "test_count": r["test_count"], "prod": [place(x) for x in r["prod"] or []], "test": [place(x) for x in r["test"] or []]},
                "body_shape": r["shape"], "body_hint": r["hint"],
            }
            for r in rows
        ]
        kind = {"kind": "interface", "implementations": implementations} if is_interface else {"kind": "class"}
        return as_json({"command": "audit-surface", "symbol": symbol, **kind, "methods": methods, **numbers})
    head = f"{symbol} - {_of(numbers)}"
    if implementations:
        names = ", ".join(n.rpartition(".")[2] for n in implementations)
        head += f", {len(implementations)} implementation{'' if len(implementations) == 1 else 's'} ({names})"
    lines = [head]
    for r in rows:
        lines += ["", r["signature"], f"  Callers: {r['prod_count']} prod, {r['test_count']} test"]
        lines += [f"    {x['path']}:{x['line']}" for side in ("prod", "test") for x in r[side] or []]
        if r["shape"]:
            lines.append(f"  Body: {r['shape']}" + (f" ({r['hint']})" if r["hint"] else ""))
    return "\n".join(lines)


def downstream(df: DataFrame, symbol: str, limit: int | None = None, style: str = "compact") -> str:
    """The methods of a class with what they reach."""
    rows, numbers = _fetched(df, limit)
    touched = lambda r, side: [{"table": x["table_name"], "via": x["via"]} for x in r[side] or []]
    if style == "json":
        methods = [
            {"name": r["name"], "calls": r["calls"] or [], "db_sets": {"reads": touched(r, "reads"), "writes": touched(r, "writes"), "untraced_repo_calls": r["untraced"] or None}, "external": r["external"] or []}
            for r in rows
        ]
        return as_json({"command": "audit-downstream", "symbol": symbol, "methods": methods, **numbers})
    lines = [f"{symbol} - {_of(numbers)}"]
    for r in rows:
        lines += ["", r["name"]]
        tables = [f"{side} {', '.join(x['table'] + (f' (via {x["via"]})' if x['via'] else '') for x in touched(r, side))}" for side in ("reads", "writes") if r[side]]
        own = [f"  Calls: {', '.join(r['calls'])}"] if r["calls"] else []
        own += [f"  Tables: {'; '.join(tables)}"] if tables else []
        own += [f"  Untraced: {', '.join(r['untraced'])}"] if r["untraced"] else []
        own += [f"  External: {', '.join(r['external'])}"] if r["external"] else []
        lines += own or ["  (no outbound calls)"]
    return "\n".join(lines)


def cycles(report: DataFrame, n_files: int, points: DataFrame | None = None, style: str = "compact") -> str:
    """All cycles, and the files to break the largest at; the compact form shows ten cycles, or one
    beside suggestions."""
    found = None if points is None else [r.asDict() for r in points.collect()]
    if style == "json":
        sccs = []
        for r in report.orderBy("rank", "id").toLocalIterator():
            if not sccs or sccs[-1]["rank"] != r.rank:
                sccs.append({"rank": r.rank, "size": r.size, "pct_of_codebase": r.share, "files": []})
            sccs[-1]["files"].append(r.id)
        said = [{"file": p["id"], "betweenness": round(p["betweenness"], 2), "fan_out_in_core": p["fan_out"], "fan_in_in_core": p["fan_in"]} for p in found] if found else None
        return as_json({"command": "cycles", "total_files": n_files, "cycle_count": len(sccs), "sccs": sccs, "suggestions": said}, nulls=True)
    report = report.cache()
    lines = [f"{report.select('rank').distinct().count()} cycles in {n_files} files"]
    place = F.row_number().over(Window.partitionBy("rank").orderBy("id"))
    head = None
    for r in report.filter(F.col("rank") <= (10 if points is None else 1)).withColumn("place", place).filter("place <= 10").orderBy("rank", "place").collect():
        if r.rank != head:
            head = r.rank
            lines += ["", f"#{r.rank}: {r.size} files ({r.share:.1%})"]
        lines += [f"  {r.id}", *([f"  and {r.size - 10} more"] if r.place == 10 and r.size > 10 else [])]
    report.unpersist()
    for k, p in enumerate(found or [], 1):
        lines += [*([""] if k == 1 else []), f"{k}. {p['id']}: betweenness {p['betweenness']:.2f}, fan-out {p['fan_out']}, fan-in {p['fan_in']} in the core; leads to {', '.join(p['sample'] or [])}"]
    return "\n".join(lines)


def health(df: DataFrame, analyzed: int, limit: int, style: str = "compact") -> str:
    """The worst types, with what the figures say in words."""
    rows = df.withColumns({"unsteady": P.instability_label(F.col("instability")), "held": P.cohesion_label(F.col("cohesion"))}).orderBy(F.desc("score"), "ord").limit(limit).collect()
    if style == "json":
        names = {
            "name": "name", "qualified_name": "display", "file": "path", "line": "line", "score": "score", "lines": "lines", "method_count": "n_methods", "max_cyclomatic_complexity": "max_cc",
            "max_complexity_method": "max_method", "dependency_count": "ce", "dependent_count": "ca", "instability": "instability", "cohesion_score": "cohesion", "field_cluster_count": "components",
        }
        two = lambda v: round(v, 2) if isinstance(v, float) else v
        return as_json({"command": "health", "total_analyzed": analyzed, "results": [{k: two(r[c]) for k, c in names.items()} for r in rows], "total": len(rows)})
    lines = [f"{analyzed} types analyzed, the {len(rows)} worst by score"]
    for r in rows:
        held = f" ({r.held}{f', {r.components} field clusters' if r.held == 'low' else ''})" if r.held else ""
        lines += ["", f"{r['name']}  score {r.score}", f"  {r.path}:{r.line}", f"  coupling: {r.ce} out, {r.ca} in, instability {r.instability:.2f}{f' ({r.unsteady})' if r.unsteady else ''}"]
        lines += [f"  size: {r.lines} lines, {r.n_methods} methods, complexity at most {r.max_cc} ({r.max_method})", f"  cohesion: {r.cohesion:.2f}{held}"]
    return "\n".join(lines)


def csv_line(values: list) -> str:
    out = io.StringIO()
    csv.writer(out, lineterminator="").writerow(values)
    return out.getvalue()


def append_snapshot(row: dict, path: str) -> None:
    """One CSV line per commit; the header only where the file is new or empty."""
    fresh = not os.path.exists(path) or not os.path.getsize(path)
    text = [f"{v:.{DIGITS.get(k, 6)}f}" if isinstance(v, float) else "" if v is None else v for k, v in row.items()]
    with open(path, "a", encoding="utf-8", newline="") as f:
        f.write((csv_line([HEADER.get(k, k) for k in row]) + "\n") * fresh + csv_line(text) + "\n")


def append_table(df: DataFrame, path: str) -> None:
    """The same as a table that many writers may extend."""
    df.coalesce(1).write.mode("append").option("header", True).csv(path)


class UsageLog:
    """Tab-separated lines of time, command, arguments, rows and milliseconds. A log that cannot
    be written never fails a command."""

    def __init__(self, path: str | None):
        self.path = path

    def add(self, command: str, arguments: str, count: int, began: float) -> None:
        try:
            if self.path:
                with open(self.path, "a", encoding="utf-8") as f:
                    f.write("\t".join([datetime.now(UTC).isoformat(), command, arguments, str(count), str(round((time.time() - began) * 1000))]) + "\n")
        except OSError:
            pass


def read_usage(spark: SparkSession, path: str) -> DataFrame:
    """(ts, command, arguments, n, ms) of a usage log."""
    parts = F.split("value", "\t")
    return spark.read.text(path).select(F.to_timestamp(parts[0]).alias("ts"), parts[1].alias("command"), parts[2].alias("arguments"), parts[3].cast("long").alias("n"), parts[4].cast("long").alias("ms"))


class Requests:
    """The log of wishes: clearing goes before listing, listing before adding."""

    def __init__(self, path: str):
        self.path = path

    def run(self, text: str | None = None, show: bool = False, clear: bool = False) -> str:
        if clear:
            open(self.path, "w", encoding="utf-8").close()
            return "cleared"
        if show or not text:
            return open(self.path, encoding="utf-8").read() if os.path.exists(self.path) else ""
        with open(self.path, "a", encoding="utf-8") as f:
            f.write(f"{datetime.now(UTC).isoformat()}\t{text}\n")
        return "logged"
