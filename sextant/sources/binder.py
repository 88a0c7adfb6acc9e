"""From parsed C# to fact rows: names are bound against an outline of all declarations."""

from __future__ import annotations

import bisect
import hashlib
import json
import re
from collections import defaultdict
from collections.abc import Iterator

from sextant.functions.predicates import ADDERS, LINQ
from sextant.operators.metrics import NODE_KINDS
from sextant.sources.csharp import Decl, TypeRef, parse

#: fixed values: owners of static calls that source files use without declaring them
KNOWN_NAMESPACES = {"File": "System.IO", "Directory": "System.IO", "Path": "System.IO", "Stream": "System.IO", "StreamReader": "System.IO", "StreamWriter": "System.IO", "FileInfo": "System.IO", "HttpClient": "System.Net.Http"}
_ITEM = {"First", "FirstOrDefault", "Single", "SingleOrDefault", "Last", "LastOrDefault", "Find"}
_SAME = {"Where", "OrderBy", "OrderByDescending", "ThenBy", "ThenByDescending", "ToList", "ToArray", "AsReadOnly", "Distinct", "Skip", "Take", "Include", "ThenInclude", "AsNoTracking", "AsTracking", "AsQueryable", "AsEnumerable", "Reverse", "Concat"}
_NODE = {"if": "if", "cond": "conditional", "for": "for", "foreach": "foreach", "while": "while", "do": "do", "catch": "catch"}


def number(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "big") >> 1


#: literal -> type, and names in System -> keywords
LITERALS = {"number": "int", "string": "string", "char": "char", "true": "bool", "false": "bool"}
PLAIN_NAMES = {
    "Boolean": "bool", "Byte": "byte", "SByte": "sbyte", "Int16": "short", "UInt16": "ushort", "Int32": "int", "UInt32": "uint", "Int64": "long", "UInt64": "ulong",
    "Single": "float", "Double": "double", "Decimal": "decimal", "Char": "char", "String": "string", "Object": "object",
}


def lite(ref: TypeRef | None) -> list | None:
    return [ref.name, [lite(a) for a in ref.args], next((n[1] for n in ref.names if n[0] == ref.name and n[1].endswith(ref.name)), ref.name)] if ref else None


def display_of(d: Decl, outer: str | None) -> str:
    own = d.name
    return f"{outer}.{own}" if outer else f"{d.namespace}.{own}" if d.namespace else own


def member_display(type_display: str, m: Decl) -> str:
    if m.kind in ("method", "constructor", "operator"):
        return f"{type_display}.{m.name}({', '.join(p[0].text for p in m.params)})"
    return f"{type_display}.{m.name}"


def outline(text: str) -> list[dict]:
    """What other files need to know of this one."""
    out: list[dict] = []

    def add(d: Decl, outer: str | None) -> None:
        name = display_of(d, outer)
        members = [[m.name, m.kind, lite(m.type), number(m.kind + member_display(name, m)), "static" in m.mods, len(m.params), m.tparams, [p[0].name if p[0] else "?" for p in m.params]] for m in d.members if m.kind in ("method", "property", "field", "event")]
        out.append({"display": name, "name": d.name, "ns": d.namespace, "kind": d.kind, "tparams": d.tparams, "bases": [lite(b) for b in d.bases], "members": members})
        for m in d.members:
            if m.kind in ("class", "interface", "struct", "record", "enum", "delegate"):
                add(m, name)

    for d in parse(text)[0]:
        add(d, None)
    return out


def words(text: str) -> set[str]:
    """Every name that the text may look up by itself, attributes by their long names too."""
    own = set(re.findall(r"@?[^\W\d]\w*", text))
    own |= {w.removeprefix("@") for w in own}
    return own | {w + "Attribute" for w in own}


def leads(part: dict) -> set[tuple[str | None, str]]:
    """(member or None, type name): the names that an outline leads to, by a member or at once."""

    def names(t: list | None) -> Iterator[str]:
        if t:
            yield t[0]
            yield from t[2].split(".")
            for a in t[1]:
                yield from names(a)

    out = {(None, n) for n in part["display"].split(".")}
    out |= {(None, n) for b in part["bases"] for n in names(b)}
    return out | {(m[0], n) for m in part["members"] for n in names(m[2])}


class World:
    """The outline of all files, merged."""

    def __init__(self, parts: list[dict]):
        self.types: dict[str, dict] = {}
        self.simple: dict[str, list[str]] = defaultdict(list)
        for p in parts:
            have = self.types.get(p["display"])
            if have is None:
                self.types[p["display"]] = {**p, "members": list(p["members"]), "bases": list(p["bases"])}
                self.simple[p["name"]].append(p["display"])
            else:
                have["members"] += p["members"]
                have["bases"] += [b for b in p["bases"] if b not in have["bases"]]

    def find(self, name: str, namespace: str, usings: list[str], outer: str | None = None) -> str | None:
        """The display of the type that a possibly dotted name stands for."""
        last = name.rpartition(".")[2]
        found = self.simple.get(last)
        if not found:
            return None
        scopes = []
        while outer:
            scopes.append(outer)
            outer = outer.rpartition(".")[0] if outer in self.types else None
        ns = namespace
        while ns:
            scopes.append(ns)
            ns = ns.rpartition(".")[0]
        for s in [*scopes, "", *usings]:
            if (full := f"{s}.{name}" if s else name) in self.types:
                return full
        fit = [f for f in found if f == name or f.endswith("." + name)]
        return fit[0] if len(fit) == 1 and ("." in name or len(found) == 1 and not self.types[fit[0]]["ns"]) else None


class File:
    """Collects the rows of one file."""

    def __init__(self, world: World, text: str, path: str, project: str, project_ord: int, file_ord: int):
        self.w, self.text, self.path, self.project = world, text, path, project
        self.base = (project_ord * 100_000 + file_ord) * 100_000_000
        self.lines = [0, *(i + 1 for i, c in enumerate(text) if c == "\n")]
        self.rows: dict[str, list[dict]] = defaultdict(list)
        self.decls, self.usings = parse(text)

    def at(self, pos: int) -> dict:
        k = bisect.bisect_right(self.lines, pos) - 1
        end = self.lines[k + 1] if k + 1 < len(self.lines) else len(self.text)
        return {"path": self.path, "line": k + 1, "col": pos - self.lines[k] + 1, "context": self.text[self.lines[k] : end].strip(), "ord": self.base + pos}

    def run(self) -> dict[str, list[dict]]:
        for d in self.decls:
            self.type(d, None, 0)
        return self.rows

    def find(self, name: str, scope: Scope) -> str | None:
        return self.w.find(name, scope.ns, self.usings, scope.display)

    # declarations

    def type(self, d: Decl, outer: str | None, depth: int) -> None:
        name = display_of(d, outer)
        scope = Scope(self, d, name)
        mine = number("type" + name)
        access = next((a for a in ("public", "private", "protected", "internal") if a in d.mods), "private" if depth else "internal")
        methods = [m for m in d.members if m.kind == "method"]
        flags = self.flags(d, access)
        end = self.at(max(d.end - 1, d.pos))["line"]
        start = self.at(d.begin)
        head = self.at(d.pos)
        self.rows["types"].append({
            "type_id": mine, "project": self.project, "kind": d.kind, "name": d.name, "display": name, "namespace": d.namespace or None, "parent_id": number("type" + outer) if outer else None, "depth": depth,
            "end_line": end - start["line"] + head["line"], "all_abstract": "abstract" in d.mods and bool(methods) and all("abstract" in m.mods for m in methods), **flags, **head,
        })
        for k, b in enumerate(d.bases):
            full = self.find(lite(b)[2], scope)
            kind = self.w.types[full]["kind"] if full else ("interface" if b.name[:1] == "I" and b.name[1:2].isupper() else "class")
            self.rows["bases"].append({"type_id": mine, "super_id": number("type" + full) if full else None, "super_name": b.name, "edge": "interface" if kind == "interface" else "base", "ordinal": k})
            self.refs(b, scope, ["base", "type"], d.name, True)
        for c in d.constraints:
            if isinstance(c, TypeRef):
                self.refs(c, scope, ["constraint", "type"], d.name, True)
        self.attrs(d, mine, scope, d.name)
        for m in d.members:
            if m.kind in ("class", "interface", "struct", "record", "enum", "delegate"):
                self.type(m, name, depth + 1)
            else:
                self.member(m, d, name, scope)

    def flags(self, d: Decl, access: str) -> dict:
        has = lambda *x: any(m in d.mods for m in x)
        return {"accessibility": access, "is_static": has("static", "const"), "is_abstract": has("abstract"), "is_virtual": has("virtual"), "is_override": has("override"), "is_sealed": has("sealed"), "is_readonly": has("readonly")}

    def attrs(self, d: Decl, owner: int, scope: Scope, containing: str) -> None:
        for ref, args in d.attrs:
            self.rows["attrs"].append({"owner_id": owner, "name": ref.text})
            for _, dotted, pos in ref.names:
                full = self.find(dotted + "Attribute", scope) or self.find(dotted, scope)
                if full:
                    self.reference(number("type" + full), "type", pos, ["attribute", "method"], containing, scope.ns, True)
            Body(self, scope, None, containing, None).walk([a[1] for a in args], ["attribute"])

    def member(self, m: Decl, d: Decl, type_display: str, scope: Scope) -> None:
        show = member_display(type_display, m)
        mine = number(m.kind + show)
        default = "public" if d.kind == "interface" else "private"
        access = " ".join(a for a in ("public", "protected", "private", "internal") if a in m.mods) or default
        flags = self.flags(m, access)
        if d.kind == "interface" and not m.body:
            flags["is_abstract"] = True
        kind = m.kind if m.kind != "operator" else "method"
        callable_ = kind in ("method", "constructor")
        containing = d.name if kind == "field" else f"{d.name}.{m.name}"
        body = Body(self, scope, mine if callable_ else None, containing, m)
        value = m.type.text if m.type else None
        signature = f"{m.name}({', '.join(p[0].text for p in m.params)})" + (f" -> {value}" if value else "") if callable_ else f"{value} {m.name}"
        slot = {"method": "method:return", "property": "property:type"}.get(kind, kind)
        if m.type:
            self.refs(m.type, scope, [slot, "type"], containing, True, m.tparams)
            self.uses(m.type, scope, mine, {"method": "return"}.get(kind, kind))
        for k, (ref, name, at, _, default_value, _) in enumerate(m.params):
            full = self.find(lite(ref)[2], scope)
            type_kind = self.w.types[full]["kind"] if full else None
            exact = full and not ref.args and ref.text.rstrip("?") == lite(ref)[2]  # no array, no generic of it
            self.rows["params"].append({"member_id": mine, "ordinal": k, "name": name, "type_display": ref.text, "type_kind": type_kind, "declared_id": number("type" + full) if exact else None, **self.at(at)})
            self.refs(ref, scope, ["parameter", kind, "type"], containing, True, m.tparams)
            self.uses(ref, scope, mine, "ctor" if kind == "constructor" else "param")
            if default_value:
                body.walk(default_value, ["parameter"])
        for c in m.constraints:
            if isinstance(c, TypeRef):
                self.refs(c, scope, ["constraint", kind], containing, True, m.tparams)
            else:
                body.walk([a[1] for a in c[1]], [kind])
        self.attrs(m, mine, scope, containing)
        if m.body:
            body.walk(m.body, [kind, "type"])
        single = body.single(m)
        self.rows["members"].append({
            "member_id": mine, "type_id": number("type" + type_display), "kind": kind, "name": ".ctor" if kind == "constructor" else m.name, "display": show, "signature": signature, "value_type": value, "is_implicit": False, "is_accessor": False,
            "has_body": m.body is not None and callable_, "cyclomatic": 1 + body.branches, "n_calls": body.n_calls, "multi_init": body.multi_init, **single, **flags, **self.at(m.pos),
        })
        if callable_ and "static" not in m.mods:
            for f in sorted(body.fields):
                self.rows["field_uses"].append({"type_id": number("type" + type_display), "method_name": m.name if kind == "method" else ".ctor", "field": f})

    # references

    def refs(self, ref: TypeRef, scope: Scope, kinds: list[str], containing: str, in_type: bool, tparams: list[str] = ()) -> None:
        for simple, dotted, pos in ref.names:
            if simple in tparams or simple in scope.tparams:
                continue
            full = self.find(dotted, scope)
            if full:
                self.reference(number("type" + full), "type", pos, kinds, containing, scope.ns, in_type)

    def uses(self, ref: TypeRef, scope: Scope, member: int, role: str) -> None:
        for simple, dotted, _ in ref.names:
            full = self.find(dotted, scope)
            if full and simple not in scope.tparams:
                self.rows["type_uses"].append({"type_id": scope.id, "member_id": member, "role": role, "used_id": number("type" + full)})

    def reference(self, target: int, kind: str, pos: int, kinds: list[str], containing: str, ns: str, in_type: bool) -> None:
        self.rows["refs"].append({"target_id": target, "target_kind": kind, "containing": containing, "kinds": kinds, "namespace": ns or None, "in_type": in_type, **self.at(pos)})


class Scope:
    def __init__(self, file: File, d: Decl, display: str):
        self.display, self.ns, self.tparams, self.id, self.name = display, d.namespace, d.tparams, number("type" + display), d.name
        self.file = file

    def member(self, display: str, name: str, n_args: int | None = None, seen: tuple = (), types: tuple = ()) -> tuple | None:
        """(owner, row) of a member along the base types; the overload with as many parameters,
        else the first with at least as many; of several that whose parameters' types differ
        least from those of the arguments, as far as these are known."""
        w = self.file.w
        t = w.types.get(display)
        if t is None or display in seen:
            return None
        found = [m for m in t["members"] if m[0] == name]
        if found:
            if n_args is not None:
                other = lambda m: sum(a is not None and a != PLAIN_NAMES.get(b, b) for a, b in zip(types, m[7], strict=False))
                found.sort(key=lambda m: (m[5] < n_args, abs(m[5] - n_args), other(m)))
            return display, found[0]
        for b in t["bases"]:
            if (up := w.find(b[2], t["ns"], self.file.usings, display)) and (hit := self.member(up, name, n_args, (*seen, display), types)):
                return hit
        return None


class Body:
    """Walks statements and expressions, with the types of locals."""

    def __init__(self, file: File, scope: Scope, method: int | None, containing: str, m: Decl | None):
        self.f, self.scope, self.method, self.containing, self.decl = file, scope, method, containing, m
        self.locals: list[dict] = [{p[1]: (lite(p[0]), "param") for p in m.params} if m else {}]
        self.branches = self.n_calls = 0
        self.multi_init = False
        self.fields: set[str] = set()
        self.stack: list[tuple] = []
        self.types: dict[int, list | None] = {}
        self.call_ids: dict[int, int] = {}

    def local(self, name: str):
        for frame in reversed(self.locals):
            if name in frame:
                return frame[name]
        return None

    def find(self, name: str) -> str | None:
        return self.f.find(name, self.scope)

    def display(self, t: list | None) -> str | None:
        return self.f.find(t[2] if len(t) > 2 else t[0], self.scope) if t and t[0] not in self.scope.tparams else None

    def own_member(self, name: str):
        return self.scope.member(self.scope.display, name)

    # types of expressions

    def substitute(self, t: list | None, owner: str, receiver: list | None, tparams: list[str] = (), targs: list = ()) -> list | None:
        if t is None:
            return None
        have = self.f.w.types[owner]["tparams"]
        if t[0] in tparams and targs:
            return lite(targs[tparams.index(t[0])]) if tparams.index(t[0]) < len(targs) else None
        if t[0] in have and receiver and have.index(t[0]) < len(receiver[1]):
            return receiver[1][have.index(t[0])]
        return [t[0], [self.substitute(a, owner, receiver, tparams, targs) or ["?", [], "?"] for a in t[1]], t[2] if len(t) > 2 else t[0]]

    def of(self, e) -> list | None:
        """The static type, ["@", display] for a type name, or None."""
        if not isinstance(e, tuple):
            return None
        key = id(e)
        if key not in self.types:
            self.types[key] = self._of(e)
        return self.types[key]

    def _of(self, e) -> list | None:
        k = e[0]
        if k == "name":
            if loc := self.local(e[2]):
                return loc[0]
            if hit := self.own_member(e[2]):
                if hit[1][1] != "method":
                    return hit[1][2]
                return None
            if full := self.find(e[2]):
                return ["@", full]
            return None
        if k in ("this", "base"):
            return [self.scope.name, [], self.scope.display]
        if k == "member":
            return self._member_type(e)
        if k == "call":
            return self._call_type(e)
        if k == "await":
            t = self.of(e[2])
            return t[1][0] if t and t[0] in ("Task", "ValueTask") and t[1] else None
        if k == "paren":
            return self.of(e[2])
        if k in ("cast", "as"):
            return lite(e[2] if k == "cast" else e[3])
        if k == "new":
            return lite(e[2])
        if k == "cond":
            return self.of(e[3]) or self.of(e[4])
        if k == "bin" and e[2] == "??":
            return self.of(e[3])
        if k == "assign":
            return self.of(e[4])
        if k in ("interp",) or k == "lit" and e[2] == "string":
            return ["string", [], "string"]
        if k == "index":
            t = self.of(e[2])
            return t[1][-1] if t and t[1] else None
        return None

    def dotted(self, e) -> str | None:
        if e[0] == "name":
            return e[2] if not self.local(e[2]) else None
        if e[0] == "member" and (left := self.dotted(e[2])):
            return f"{left}.{e[3]}"
        return None

    def given(self, call) -> tuple:
        """The simple type names of a call's arguments, None where they are not known."""
        out = []
        for a in call[3]:
            e = a[1]
            t = self.of(e)
            name = t[0] if t and t[0] != "@" else LITERALS.get(e[2]) if isinstance(e, tuple) and e[0] == "lit" else None
            if name == "int" and e[0] == "lit" and not e[3].isdigit():
                name = None
            out.append(PLAIN_NAMES.get(name, name))
        return tuple(out)

    def bound(self, e, n_args: int | None = None, types: tuple = ()):
        """(owner, row, receiver type) of the member that a member access names."""
        t = self.of(e[2])
        if t is None:
            return None
        display = t[1] if t[0] == "@" else self.display(t)
        hit = self.scope.member(display, e[3], n_args, types=types) if display else None
        return (*hit, t) if hit else None

    def _member_type(self, e) -> list | None:
        if hit := self.bound(e):
            return self.substitute(hit[1][2], hit[0], hit[2]) if hit[1][1] != "method" else None
        if (name := self.dotted(e)) and (full := self.find(name)):
            return ["@", full]
        return None

    def target(self, call):
        """(owner, row, receiver type) of what a call names."""
        f, n = call[2], len(call[3])
        if f[0] == "name":
            if self.local(f[2]):
                return None
            hit = self.scope.member(self.scope.display, f[2], n, types=self.given(call))
            return (*hit, None) if hit and hit[1][1] == "method" else None
        if f[0] == "member":
            hit = self.bound(f, n, self.given(call))
            return hit if hit and hit[1][1] == "method" else None
        return None

    def _call_type(self, e) -> list | None:
        f = e[2]
        if hit := self.target(e):
            targs = f[3] if f[0] == "name" else f[4]
            t = self.substitute(hit[1][2], hit[0], hit[2], hit[1][6], targs)
            return t
        if f[0] == "member":
            if f[3] == "FromResult" and e[3]:
                return ["Task", [self.of(e[3][0][1]) or ["?", [], "?"]], "Task"]
            t = self.of(f[2])
            if t and t[0] != "@" and t[1]:
                base = f[3].removesuffix("Async")
                found = t[1][0] if base in _ITEM else t if base in _SAME else None
                return ["Task", [found], "Task"] if found and base != f[3] else found
        return None

    # walking

    def walk(self, node, kinds: list[str]) -> None:
        if node is None:
            return
        if isinstance(node, list):
            for x in node:
                self.walk(x, kinds)
            return
        if isinstance(node, TypeRef):
            tparams = self.decl.tparams if self.decl else ()
            self.f.refs(node, self.scope, kinds, self.containing, True, tparams)
            return
        if not isinstance(node, tuple):
            return
        if node and not isinstance(node[0], str):
            for x in node:
                self.walk(x, kinds)
            return
        if len(node) == 2 and node[0] not in ("this", "base"):
            self.walk(node[1], kinds)
            return
        self.stack.append(node)
        try:
            self._visit(node, kinds)
        finally:
            self.stack.pop()

    def _visit(self, n, kinds: list[str]) -> None:
        k = n[0]
        if k in _NODE and _NODE[k] in NODE_KINDS:
            self.branches += 1
        if k == "bin" and n[2] in ("&&", "||", "??"):
            self.branches += 1
        if k == "block":
            self.locals.append({})
            self.walk(n[2], kinds)
            self.locals.pop()
        elif k == "local":
            inner = ["local", *kinds]
            self.walk(n[2], inner)
            for name, _, value in n[3]:
                self.walk(value, inner)
                self.locals[-1][name] = (self.of(value) if n[2].name == "var" else lite(n[2]), "local")
        elif k == "foreach":
            self.walk(n[2], kinds)
            self.walk(n[4], kinds)
            t = self.of(n[4])
            self.locals.append({n[3]: ((t[1][0] if t and t[1] and t[0] != "@" else None) if n[2].name == "var" else lite(n[2]), "local")})
            self.walk(n[5], kinds)
            self.locals.pop()
        elif k == "catch":
            self.walk(n[2], ["catch", *kinds])
            self.locals.append({n[3]: (lite(n[2]), "local")} if n[3] else {})
            self.walk(n[4], kinds)
            self.walk(n[5], kinds)
            self.locals.pop()
        elif k == "case":
            self.branches += 1
            self.walk(n[2], kinds)
            self.walk(n[3], kinds)
        elif k == "pattern":
            for ref in n[2]:
                self.walk(ref, ["is", *kinds])
            for name, ref in n[3]:
                self.locals[-1][name] = (lite(ref), "local")
        elif k == "switchexpr":
            self.walk(n[2], kinds)
            for p, when, value in n[3]:
                self.branches += 1
                self.walk(p, kinds)
                self.walk(when, kinds)
                self.walk(value, kinds)
        elif k == "localfunc":
            d = n[2]
            self.walk(d.type, kinds)
            self.locals.append({p[1]: (lite(p[0]), "param") for p in d.params})
            for p in d.params:
                self.walk(p[0], ["parameter", *kinds])
            self.walk(d.body, kinds)
            self.locals.pop()
        elif k == "lambda":
            self._lambda(n, kinds)
        elif k == "outvar":
            self.walk(n[2], kinds)
            self.locals[-1][n[3]] = (lite(n[2]) if n[2].name != "var" else None, "local")
        elif k == "name":
            self._name(n, kinds)
        elif k == "member":
            self._member(n, kinds)
        elif k == "call":
            self._call(n, kinds)
        elif k == "new":
            inner = ["new", *kinds]
            self.walk(n[2], inner)
            self.walk([a[1] for a in n[3]], inner)
            self._initializer(n[4], inner, lite(n[2]))
            self.walk(n[5] if len(n) > 5 else None, inner)
        elif k == "anon":
            self._initializer(n[2], kinds, None)
        elif k == "assign":
            self._assign(n, kinds)
        elif k in ("cast", "typeof"):
            self.walk(n[2], [k, *kinds])
            self.walk(n[3] if k == "cast" else None, [k, *kinds])
        elif k == "is":
            self.walk(n[2], kinds)
            self.walk(n[3], kinds)
        elif k == "as":
            self.walk(n[2], kinds)
            self.walk(n[3], kinds)
        elif k == "index":
            self.walk(n[2], kinds)
            self.walk([a[1] for a in n[3]], kinds)
        elif k == "tuple":
            self.walk([a[1] for a in n[2]], kinds)
        elif k != "lit":
            for x in n[2:]:
                if not isinstance(x, str):
                    self.walk(x, kinds)

    def _lambda(self, n, kinds: list[str]) -> None:
        call = next((s for s in reversed(self.stack[:-1]) if s[0] == "call"), None)
        item = None
        if call is not None and call[2][0] == "member":
            t = self.of(call[2][2])
            item = t[1][0] if t and t[0] != "@" and t[1] else None
        self.locals.append({name: (lite(ref) if ref else item if k == 0 else None, "param") for k, (ref, name) in enumerate(n[2])})
        for ref, _ in n[2]:
            self.walk(ref, ["parameter", *kinds])
        self.walk(n[3], kinds)
        self.locals.pop()

    def _initializer(self, items, kinds: list[str], t: list | None) -> None:
        if items is None:
            return
        if len(items) >= 3:
            self.multi_init = True
        display = self.display(t)
        for e in items:
            if e[0] == "assign" and e[3][0] == "name":
                hit = self.scope.member(display, e[3][2]) if display else None
                if hit:
                    self.f.reference(hit[1][3], hit[1][1], e[3][1], kinds, self.containing, self.scope.ns, True)
                self.walk(e[4], kinds)
            else:
                self.walk(e, kinds)

    def _name(self, n, kinds: list[str]) -> None:
        for ref in n[3]:
            self.walk(ref, kinds)
        if self.local(n[2]):
            return
        if hit := self.own_member(n[2]):
            self.f.reference(hit[1][3], hit[1][1], n[1], kinds, self.containing, self.scope.ns, True)
            if hit[1][1] in ("field", "property") and not hit[1][4] and hit[0] == self.scope.display:
                self.fields.add(n[2])
            self._access(n, n[1], None, hit[1])
        elif full := self.find(n[2]):
            self.f.reference(number("type" + full), "type", n[1], kinds, self.containing, self.scope.ns, True)

    def _member(self, n, kinds: list[str]) -> None:
        if n[5]:
            self.branches += 1
        for ref in n[4]:
            self.walk(ref, kinds)
        call = self.stack[-2] if len(self.stack) > 1 and self.stack[-2][0] == "call" and self.stack[-2][2] is n else None
        if hit := self.bound(n, len(call[3]) if call else None, self.given(call) if call else ()):
            self.f.reference(hit[1][3], hit[1][1], n[6], kinds, self.containing, self.scope.ns, True)
            if n[2][0] == "this" and hit[1][1] in ("field", "property") and not hit[1][4]:
                self.fields.add(n[3])
            self._access(n, n[6], n[2], hit[1], hit[2])
        elif (name := self.dotted(n)) and (full := self.find(name)):
            self.f.reference(number("type" + full), "type", n[6], kinds, self.containing, self.scope.ns, True)
        self.walk(n[2], kinds)

    def receiver(self, e) -> tuple[str | None, str | None, bool, str | None]:
        """Text, type, whether it is an instance member of the class, and the root's type."""
        while e[0] in ("paren", "await"):
            e = e[2]
        t = self.of(e)
        name = None if t is None or t[0] == "@" else f"DbSet<{t[1][0][0]}>" if t[0] == "DbSet" and t[1] else t[0]
        simple = e[2] if e[0] == "name" else e[3] if e[0] == "member" and e[2][0] == "this" else None
        hit = self.own_member(simple) if simple else None
        member = bool(hit and hit[1][1] in ("field", "property") and not hit[1][4])
        root = e
        while root[0] in ("member", "call", "index", "paren", "await"):
            root = root[2]
        rt = self.of(root) if root[0] == "name" else None
        text = "this" if e[0] == "this" else f"this.{simple}" if e[0] == "member" and simple else simple
        return text, name, member, None if rt is None or rt[0] == "@" else rt[0]

    def _access(self, n, pos: int, receiver, row, t=None) -> None:
        value = self.of(n)
        if row[1] not in ("field", "property") or not value or value[0] != "DbSet":
            return
        links = []
        for s in reversed(self.stack[:-1]):
            if s[0] in ("exprstmt", "local", "return", "if", "block", "foreach", "while", "lambda"):
                break
            if s[0] == "call":
                links.append(s[2][3] if s[2][0] == "member" else s[2][2] if s[2][0] == "name" else "")
        text, name, member, _ = self.receiver(receiver) if receiver else ("this", self.scope.name, False, None)
        self.f.rows["accesses"].append({"type_id": self.scope.id, "method_id": self.method, "receiver": text, "receiver_type": name, "receiver_member": member, "table_name": row[0], "member_type": "DbSet", "links": links, **self.f.at(n[1])})

    def _call(self, n, kinds: list[str]) -> None:
        f, args = n[2], n[3]
        if f[0] == "name" and f[2] == "nameof":
            self.walk([a[1] for a in args], kinds)
            return
        self.n_calls += 1
        hit = self.target(n)
        if self.method is not None and f[0] in ("name", "member"):
            name, targs = (f[2], f[3]) if f[0] == "name" else (f[3], f[4])
            form = "bare" if f[0] == "name" and not targs else "member" if f[0] == "member" and not f[5] else "other"
            text = kind = root = None
            member = False
            owner = self.f.w.types[hit[0]] if hit else None
            owner_name, owner_ns = (owner["name"], owner["ns"]) if owner else (None, None)
            chain_root = None
            if f[0] == "member":
                text, kind, member, root = self.receiver(f[2])
                t = self.of(f[2])
                if not hit and f[2][0] == "name" and t is None:
                    owner_name, owner_ns = f[2][2], KNOWN_NAMESPACES.get(f[2][2])
                elif not hit and t and t[0] != "@":
                    owner_name, owner_ns = t[0], KNOWN_NAMESPACES.get(t[0])
                e = f[2]
                while e[0] == "call" and e[2][0] == "member":
                    e = e[2][2]
                rt = self.of(e)
                chain_root = f"DbSet<{rt[1][0][0]}>" if rt and rt[0] == "DbSet" and rt[1] else None
            lits = [(a[1][2] if a[1][0] == "lit" else a[1][0], a[1][3] if a[1][0] == "lit" else "") for a in args]
            call = number(f"{self.f.path}:{n[1]}:{name}:{f[6] if f[0] == 'member' else f[1]}")
            self.call_ids[id(n)] = call
            place = self.f.at(n[1])
            place["ord"] = self.f.base + (f[6] if f[0] == "member" else f[1])
            self.f.rows["calls"].append({
                "call_id": call, "caller_id": self.method, "callee_id": hit[1][3] if hit else None, "form": form, "name": name, "receiver": text, "receiver_root": root, "receiver_type": kind, "receiver_member": member,
                "owner_name": owner_name, "owner_namespace": owner_ns, "callee_static": bool(hit and hit[1][4]) or bool(owner_ns and not hit and f[2][0] == "name"), "same_type": bool(hit and hit[0] == self.scope.display),
                "type_args": [t.text for t in targs], "arg_kinds": [a for a, _ in lits], "arg_texts": [b for _, b in lits], "lambda_interp": any(a[1][0] == "lambda" and _has(a[1], "interp") for a in args),
                "chain_root_type": chain_root, "containing": self.containing, **place,
            })
        self.walk(f, kinds)
        self.walk([a[1] for a in args], kinds)

    def _assign(self, n, kinds: list[str]) -> None:
        left = n[3]
        if left[0] == "member" and left[2][0] in ("name", "member"):
            t = self.of(left[2])
            if t and t[0] != "@" and self.method is not None:
                inside = any(s[0] == "call" and s[2][0] == "member" and s[2][3] in ADDERS for s in self.stack) and any(s[0] == "new" for s in self.stack)
                self.f.rows["assigns"].append({"method_id": self.method, "receiver_type": t[0], "in_add_init": inside, "target": left[3], **self.f.at(n[1])})
        self.walk(left, kinds)
        self.walk(n[4], kinds)

    def single(self, m: Decl) -> dict:
        """The call that is all of the body, and the query methods at the end of its chain."""
        e, out = None, {"single_call": None, "single_root": None, "single_links": []}
        b = m.body
        if b and m.kind == "method":
            if b[0] == "expr":
                e = b[2]
            elif b[0] == "block" and len(b[2]) == 1 and b[2][0][0] in ("return", "exprstmt"):
                e = b[2][0][2]
        while e and e[0] in ("await", "paren"):
            e = e[2]
        if not e or e[0] != "call":
            return out
        out["single_call"] = self.call_ids.get(id(e))
        while e[0] == "call" and e[2][0] == "member" and e[2][3] in LINQ:
            out["single_links"].append(e[2][3])
            e = e[2][2]
        while e[0] in ("member", "call", "index", "paren", "await"):
            e = e[2]
        self.locals = [{p[1]: (lite(p[0]), "param") for p in m.params}]
        t = self.of(e) if e[0] == "name" else None
        out["single_root"] = t[0] if t and t[0] != "@" else None
        return out


def _has(node, kind: str) -> bool:
    if isinstance(node, tuple):
        return bool(node) and node[0] == kind or any(_has(x, kind) for x in node)
    return isinstance(node, list) and any(_has(x, kind) for x in node)


def file_rows(world: World, text: str, path: str, project: str, project_ord: int, file_ord: int) -> list[tuple[str, str]]:
    rows = File(world, text, path, project, project_ord, file_ord).run()
    return [(table, json.dumps(r)) for table, many in rows.items() for r in many]
