"""The commands, by name, over one set of facts.

    session = Commands(read_solution(spark, "path/to/solution"))
    print(session.run("callers", "IUserService.GetUser", style="json", limit=20))

A session stays hot: facts are read once, and ``reload`` swaps them while running commands keep
what they started with.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sextant.facts import Facts
from sextant.functions.text import comma_set, parameter_query
from sextant.operators import audits, lookups, metrics, surface, tables
from sextant.operators.resolve import NotResolved, one
from sextant.sources import sinks

_target: ContextVar[str | None] = ContextVar("target", default=None)


class Commands:
    def __init__(self, facts: Facts, log: sinks.UsageLog | None = None):
        self.facts, self.log = facts, log or sinks.UsageLog(None)

    def reload(self, facts: Facts) -> None:
        self.facts = facts

    def names(self) -> list[str]:
        return sorted(n.removeprefix("do_").replace("_", "-") for n in dir(self) if n.startswith("do_"))

    def run(self, command: str, *args: str, style: str = "compact", limit: int | None = None, to: str | None = None, **options) -> str:
        """What a command prints. With ``to`` the entries of a symbol query or an audit are written to
        that folder by tasks, however many there are."""
        began = time.time()
        _target.set(to)
        do: Callable | None = getattr(self, "do_" + command.replace("-", "_"), None)
        if do is None:
            return sinks.message(command, f"unknown command; known are {', '.join(self.names())}", style=style)
        try:
            out = do(self.facts, *args, style=style, limit=limit, **options)
        except (NotResolved, ValueError) as e:
            out = sinks.message(command, str(e), getattr(e, "names", []), style)
        self.log.add(command, " ".join(args), out.count("\n"), began)
        return out

    def _entries(self, df: DataFrame, command: str, symbol: str, limit: int | None, style: str) -> str:
        to = _target.get()
        if to is None:
            return sinks.entries(df, command, symbol, limit, style)
        return f"{sinks.write_entries(lookups.limited(df, limit), to, command, symbol, style)} {command} of {symbol} in {to}"

    # symbol queries

    def do_references(self, f, symbol, style, limit):
        return self._entries(lookups.references(f, one(f, symbol)["id"]), "references", symbol, limit, style)

    def do_callers(self, f, symbol, style, limit):
        return self._entries(lookups.callers(f, one(f, symbol, "method")["id"]), "callers", symbol, limit, style)

    def do_call_chain(self, f, symbol, style, limit, depth=5):
        return self._entries(lookups.call_chain(f, one(f, symbol, "method")["id"], depth), "call-chain", symbol, limit, style)

    def do_implementations(self, f, symbol, style, limit):
        return self._entries(lookups.implementations(f, one(f, symbol, "type")["id"]), "implementations", symbol, limit, style)

    def do_inheritors(self, f, symbol, style, limit):
        return self._entries(lookups.inheritors(f, one(f, symbol, "type")["id"]), "inheritors", symbol, limit, style)

    def do_members(self, f, symbol, style, limit):
        return self._entries(lookups.members(f, one(f, symbol, "type", prefer=True)["id"]), "members", symbol, limit, style)

    def do_dependencies(self, f, symbol, style, limit):
        return self._entries(lookups.dependencies(f, one(f, symbol, "type")["id"]), "dependencies", symbol, limit, style)

    def do_injected(self, f, symbol, style, limit):
        return self._entries(lookups.injected(f, one(f, symbol, "type")["id"]), "injected", symbol, limit, style)

    def do_usages(self, f, symbol, style, limit, namespace=None):
        return self._entries(lookups.usages(f, one(f, symbol, "type")["id"], namespace), "usages", symbol, limit, style)

    def do_parameters(self, f, style, limit, name=None, type_name=None):
        return self._entries(lookups.parameters(f, name, type_name), "parameters", parameter_query(name, type_name), limit, style)

    # tables

    def do_dbset_usage(self, f, symbol, style, limit):
        return self._entries(tables.dbset_usage(f, one(f, symbol, "type")["id"]), "dbset-usage", symbol, limit, style)

    def do_ownership_violations(self, f, style, limit, owner, tables_owned):
        return self._entries(tables.ownership_violations(f, owner, comma_set(tables_owned)), "ownership-violations", f"{owner} owning {tables_owned}", limit, style)

    def do_service_map(self, f, style, limit, namespace=None):
        return sinks.service_map(tables.service_map(f, namespace), limit, style)

    # health

    def do_health(self, f, style, limit, top=20, namespace=None):
        df = metrics.health(f, namespace)
        return sinks.health(df, df.count(), limit or top, style)

    def do_cycles(self, f, style, limit, suggest=False, top=5):
        vertices, edges = metrics.file_graph(f)
        points = metrics.break_points(edges, vertices, top) if suggest else None
        return sinks.cycles(metrics.cycle_report(edges, vertices), vertices.count(), points, style)

    def do_snapshot(self, f, style, limit, append=None, commit="", committed="", solution=""):
        row = metrics.snapshot_record(f, solution, commit, committed).first().asDict()
        if append:
            sinks.append_snapshot(row, append)
        return sinks.as_json(row, nulls=True) if style == "json" else "\n".join(f"{k}: {v}" for k, v in row.items())

    # audits

    def do_audit_auth(self, f, style, limit):
        return self._entries(audits.audit_auth(f), "audit-auth", "issues", limit, style)

    def do_audit_cache(self, f, style, limit, methods=""):
        return self._entries(audits.audit_cache(f, comma_set(methods)), "audit-cache", "issues", limit, style)

    def do_audit_immutable(self, f, style, limit, types):
        return self._entries(audits.audit_immutable(f, comma_set(types)), "audit-immutable", types, limit, style)

    def do_audit_ef(self, f, style, limit):
        return self._entries(audits.audit_ef(f), "audit-ef", "EF Core patterns", limit, style)

    def do_audit_surface(self, f, symbol, style, limit):
        found = one(f, symbol, "type", prefer=True)
        is_interface = not f.types.filter((F.col("type_id") == found["id"]) & (F.col("kind") == "interface")).isEmpty()
        names = [r.display for r in lookups.implementing(f, found["id"]).select("name", "display").distinct().orderBy("name", "display").collect()] if is_interface else []
        return sinks.surface(surface.audit_surface(f, found["id"]), surface.surface_callers(f, found["id"]), found["display"], is_interface, names, limit, style)

    def do_audit_downstream(self, f, symbol, style, limit):
        found = one(f, symbol, "type", prefer=True)
        if f.types.filter((F.col("type_id") == found["id"]) & F.col("kind").isin("class", "record")).isEmpty():
            raise ValueError("audit-downstream only supports classes")
        return sinks.downstream(surface.audit_downstream(f, found["id"]), found["display"], limit, style)
