"""A C# reader: tokens, declarations and bodies as plain nodes.

The parser covers what facts need and is forgiving: what it does not know is skipped to the next
statement or member. A node is a tuple (kind, begin, ...); begins are character offsets.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

_TOKEN = re.compile(
    r'(?P<skip>\s+|//[^\n]*|/\*.*?\*/|(?<![^\n])[ \t]*\#[^\n]*)|(?P<interp>\$@?"|@\$")|(?P<str>"""(?:.|\n)*?"""|@"(?:[^"]|"")*"|"(?:\\.|[^"\\\n])*")|(?P<chr>\'(?:\\.|[^\'\\\n])+\')'
    r"|(?P<num>\d[\w]*(?:\.\d\w*)?)|(?P<id>@?[^\W\d]\w*)|(?P<op>=>|\?\?=|\?\?|\?\.|&&|\|\||==|!=|<=|>=|\+\+|--|->|::|\+=|-=|\*=|/=|%=|&=|\|=|\^=|\.\.|.)",
    re.S,
)
MODIFIERS = set("public private protected internal static abstract virtual override sealed readonly async partial extern unsafe new const volatile required file ref".split())
TYPE_WORDS = {"class", "interface", "struct", "enum", "record"}
_STATEMENT_WORDS = set("if for foreach while do switch return throw try using lock break continue goto yield checked unchecked fixed await else case default".split())
_NO_TYPE = set("return throw new await if for foreach while do switch try using lock break continue goto yield is as in out case default else typeof nameof sizeof base this null true false when where".split())


@dataclass
class Token:
    kind: str
    text: str
    pos: int
    parts: list = field(default_factory=list)


def tokens(text: str, base: int = 0) -> list[Token]:
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            at += 1
            continue
        kind = m.lastgroup
        if kind == "interp":
            end, parts = _interpolated(text, m.end(), "@" in m.group())
            out.append(Token("interp", text[at:end], base + at, [(t, base + p) for t, p in parts]))
            at = end
            continue
        if kind != "skip":
            out.append(Token(kind, m.group(), base + at))
        at = m.end()
    return out


def _interpolated(text: str, at: int, verbatim: bool) -> tuple[int, list]:
    parts = []
    while at < len(text):
        c = text[at]
        if c == "\\" and not verbatim:
            at += 2
        elif c == '"':
            if verbatim and text[at + 1 : at + 2] == '"':
                at += 2
                continue
            return at + 1, parts
        elif c == "{" and text[at + 1 : at + 2] != "{":
            depth, begin = 1, at + 1
            at += 1
            while at < len(text) and depth:
                if text[at] == '"':
                    at = _TOKEN.match(text, at).end() - 1
                depth += (text[at] in "{([") - (text[at] in "})]")
                at += 1
            parts.append((text[begin : at - 1], begin))
        else:
            at += 2 if text[at : at + 2] in ("{{", "}}") else 1
    return at, parts


@dataclass
class TypeRef:
    text: str
    name: str
    args: list
    names: list  # (simple name, dotted name, pos)
    pos: int


@dataclass
class Decl:
    kind: str
    name: str
    pos: int
    begin: int
    end: int
    mods: list
    attrs: list
    type: TypeRef | None = None
    tparams: list = field(default_factory=list)
    params: list = field(default_factory=list)
    bases: list = field(default_factory=list)
    constraints: list = field(default_factory=list)
    members: list = field(default_factory=list)
    body: tuple | None = None
    expression: bool = False
    namespace: str = ""


class Stop(Exception):
    pass


class Parser:
    def __init__(self, text: str, toks: list[Token] | None = None):
        self.text, self.t, self.i = text, tokens(text) if toks is None else toks, 0
        self.usings: list[str] = []

    def peek(self, k: int = 0) -> str:
        return self.t[self.i + k].text if self.i + k < len(self.t) else ""

    def kind(self, k: int = 0) -> str:
        return self.t[self.i + k].kind if self.i + k < len(self.t) else ""

    def pos(self) -> int:
        return self.t[self.i].pos if self.i < len(self.t) else len(self.text)

    def next(self) -> Token:
        if self.i >= len(self.t):
            raise Stop
        self.i += 1
        return self.t[self.i - 1]

    def take(self, text: str) -> bool:
        if self.peek() == text:
            self.i += 1
            return True
        return False

    def need(self, text: str) -> None:
        if not self.take(text):
            raise Stop

    def end(self) -> int:
        t = self.t[self.i - 1]
        return t.pos + len(t.text)

    def skip_group(self, close: dict = {"(": ")", "[": "]", "{": "}"}) -> None:  # noqa: B006
        depth = 0
        while self.i < len(self.t):
            x = self.next().text
            depth += (x in close) - (x in close.values())
            if depth <= 0:
                return

    # types

    def type(self) -> TypeRef:
        begin = self.pos()
        if self.peek() == "(":
            self.next()
            args = []
            while not self.take(")"):
                args.append(self.type())
                if self.kind() == "id":
                    self.next()
                self.take(",")
            ref = TypeRef("(" + ", ".join(a.text for a in args) + ")", "", args, [n for a in args for n in a.names], begin)
        else:
            if self.kind() != "id" or self.peek() in _NO_TYPE:
                raise Stop
            dotted, names, args, text = "", [], [], ""
            while True:
                t = self.next()
                if t.kind != "id":
                    raise Stop
                dotted = f"{dotted}.{t.text}" if dotted else t.text
                text += t.text
                names.append((t.text, dotted, t.pos))
                if self.peek() == "<":
                    self.next()
                    args = []
                    while not self.take(">"):
                        if self.peek() == ",":
                            self.next()
                            continue
                        args.append(self.type())
                        if self.peek() not in (",", ">"):
                            raise Stop
                    text += "<" + ", ".join(a.text for a in args) + ">"
                    names += [n for a in args for n in a.names]
                if self.peek() in (".", "::") and self.kind(1) == "id":
                    text += self.next().text
                    continue
                break
            last = [n for n in names if n[1] == dotted][-1:] or names[:1]
            ref = TypeRef(text, last[0][0], args, names, begin)
        while True:
            if self.peek() == "?" and self.peek(1) not in (".",):
                self.next()
                ref.text += "?"
            elif self.peek() == "[" and self.peek(1) in ("]", ","):
                while not self.take("]"):
                    self.next()
                ref = TypeRef(ref.text + "[]", "[]", [ref], ref.names, begin)
            elif self.peek() == "*":
                self.next()
            else:
                return ref

    def attempt(self, f):
        at = self.i
        try:
            return f()
        except (Stop, IndexError):
            self.i = at
            return None

    # declarations

    def unit(self) -> list[Decl]:
        out: list[Decl] = []
        self._scope(out, "", None)
        return out

    def _scope(self, out: list[Decl], namespace: str, close: str | None) -> None:
        while self.i < len(self.t):
            at = self.i
            try:
                if close and self.take(close):
                    return
                if self.peek() == "global" and self.peek(1) == "using" or self.peek() == "using":
                    self.take("global")
                    self.next()
                    name = []
                    while not self.take(";"):
                        name.append(self.next().text)
                    self.usings.append("".join(name).split("=")[-1].removeprefix("static"))
                elif self.take("namespace"):
                    name = ""
                    while self.peek() not in ("{", ";"):
                        name += self.next().text
                    full = f"{namespace}.{name}" if namespace else name
                    if self.next().text == ";":
                        namespace = full
                    else:
                        self._scope(out, full, "}")
                else:
                    d = self.member(None)
                    if d:
                        d.namespace = namespace
                        out.append(d)
            except (Stop, IndexError):
                pass
            if self.i == at:
                self.i += 1

    def attributes(self) -> list:
        out = []
        while self.peek() == "[":
            self.next()
            if self.peek(1) == ":":
                self.i += 2
            while not self.take("]"):
                ref = self.type()
                args = self.arguments() if self.peek() == "(" else []
                out.append((ref, args))
                self.take(",")
        return out

    def member(self, owner: str | None) -> Decl | None:
        begin = self.pos()
        attrs = self.attributes()
        mods = []
        while self.peek() in MODIFIERS and not (self.peek() in ("file", "required", "async", "partial") and self.peek(1) in ("=", ";", "(")):
            mods.append(self.next().text)
        make = lambda kind, tok, **kw: Decl(kind, tok.text, tok.pos, begin, 0, mods, attrs, **kw)
        if self.peek() in TYPE_WORDS and self.kind(1) == "id":
            kind = self.next().text
            if kind == "record" and self.peek() in ("class", "struct"):
                self.next()
            return self._type_decl(make(kind, self.next()))
        if self.take("delegate"):
            ref = self.type()
            d = make("delegate", self.next(), type=ref)
            d.tparams = self._tparams()
            d.params = self.parameters()
            while not self.take(";"):
                self.next()
            d.end = self.end()
            return d
        is_event = self.take("event")
        if self.peek() == "~" or (self.kind() == "id" and self.peek() == owner and self.peek(1) == "("):
            self.take("~")
            d = make("constructor", self.next())
            d.params = self.parameters()
            if self.take(":"):
                self.next()
                d.constraints.append(("init", self.arguments()))
            self._body(d)
            return d
        ref = self.type()
        if self.take("operator"):
            t = self.next()
            while self.peek() != "(":
                self.next()
            d = Decl("operator", "operator " + t.text, t.pos, begin, 0, mods, attrs, type=ref)
            d.params = self.parameters()
            self._body(d)
            return d
        name = self.next()
        while self.peek() == "." or (self.peek() == "<" and self._explicit()):
            if self.peek() == "<":
                self._tparams()
            self.next()
            name = self.next()
        if name.text == "this" and self.peek() == "[":
            d = Decl("indexer", "this[]", name.pos, begin, 0, mods, attrs, type=ref)
            self.skip_group()
            self._property(d)
            return d
        if self.peek() in ("(", "<"):
            d = make("method", name, type=ref)
            d.tparams = self._tparams()
            d.params = self.parameters()
            self._constraints(d)
            self._body(d)
            return d
        if self.peek() in ("{", "=>") and not is_event:
            d = make("property", name, type=ref)
            self._property(d)
            return d
        d = make("event" if is_event else "field", name, type=ref)
        if self.take("="):
            d.body = ("expr", self.pos(), self.expression())
        if self.peek() == "{":
            self.skip_group()
        else:
            while not self.take(";"):
                self.next()
        d.end = self.end()
        return d

    def _explicit(self) -> bool:
        at = self.i
        ok = self.attempt(lambda: (self._tparams(), self.need("."))) is not None
        self.i = at
        return ok

    def _tparams(self) -> list[str]:
        out = []
        if self.take("<"):
            while not self.take(">"):
                t = self.next()
                if t.kind == "id" and t.text not in ("in", "out"):
                    out.append(t.text)
        return out

    def _constraints(self, d: Decl) -> None:
        while self.take("where"):
            self.next()
            self.need(":")
            while True:
                if self.take("new"):
                    self.skip_group()
                elif self.peek() in ("class", "struct", "notnull", "unmanaged"):
                    self.next()
                    self.take("?")
                else:
                    d.constraints.append(self.type())
                if not self.take(","):
                    break

    def _type_decl(self, d: Decl) -> Decl:
        d.tparams = self._tparams()
        if self.peek() == "(":
            d.params = self.parameters()
        if self.take(":"):
            while True:
                d.bases.append(self.type())
                if self.peek() == "(":
                    self.skip_group()
                if not self.take(","):
                    break
        self._constraints(d)
        if self.take(";"):
            d.end = self.end()
            return d
        self.need("{")
        if d.kind == "enum":
            self.i -= 1
            self.skip_group()
            d.end = self.end()
            return d
        while self.i < len(self.t) and not self.take("}"):
            at = self.i
            try:
                m = self.member(d.name)
                if m:
                    m.namespace = d.namespace
                    d.members.append(m)
            except (Stop, IndexError):
                self.i = max(self.i, at + 1)
                while self.i < len(self.t) and self.peek() not in (";", "}"):
                    self.skip_group() if self.peek() in ("{", "(", "[") else self.next()
                self.take(";")
        d.end = self.end()
        return d

    def _property(self, d: Decl) -> None:
        if self.take("=>"):
            d.body, d.expression = ("expr", self.pos(), self.expression()), True
            self.need(";")
        else:
            self.need("{")
            parts = []
            while not self.take("}"):
                self.attributes()
                while self.peek() in MODIFIERS:
                    self.next()
                self.next()
                if self.take("=>"):
                    parts.append(("expr", self.pos(), self.expression()))
                    self.need(";")
                elif self.peek() == "{":
                    parts.append(self.block())
                else:
                    self.need(";")
            if parts:
                d.body = ("block", d.pos, parts)
            if self.take("="):
                d.body = ("expr", self.pos(), self.expression())
                self.need(";")
        d.end = self.end()

    def _body(self, d: Decl) -> None:
        if self.take("=>"):
            d.body, d.expression = ("expr", self.pos(), self.expression()), True
            self.need(";")
        elif self.peek() == "{":
            d.body = self.block()
        else:
            self.need(";")
        d.end = self.end()

    def parameters(self) -> list:
        out = []
        self.need("(")
        while not self.take(")"):
            attrs = self.attributes()
            while self.peek() in ("ref", "out", "in", "params", "this", "scoped"):
                self.next()
            ref = self.type()
            name = self.next()
            default = None
            if self.take("="):
                default = self.expression()
            out.append((ref, name.text, name.pos, ref.pos, default, attrs))
            self.take(",")
        return out

    # statements

    def block(self) -> tuple:
        begin = self.pos()
        self.need("{")
        out = []
        while self.i < len(self.t) and not self.take("}"):
            at = self.i
            try:
                out.append(self.statement())
            except (Stop, IndexError):
                self.i = max(self.i, at + 1)
                while self.i < len(self.t) and self.peek() not in (";", "}"):
                    self.skip_group() if self.peek() in ("{", "(", "[") else self.next()
                self.take(";")
        return ("block", begin, out)

    def statement(self) -> tuple:
        begin, word = self.pos(), self.peek()
        if word == "{":
            return self.block()
        if self.take(";"):
            return ("block", begin, [])
        if word == "if":
            self.next()
            test = self._paren()
            yes = self.statement()
            no = self.statement() if self.take("else") else None
            return ("if", begin, test, yes, no)
        if word in ("while", "lock"):
            self.next()
            return (word, begin, self._paren(), self.statement())
        if word == "do":
            self.next()
            body = self.statement()
            self.need("while")
            test = self._paren()
            self.take(";")
            return ("do", begin, test, body)
        if word == "for":
            self.next()
            self.need("(")
            parts = []
            while not self.take(")"):
                if self.take(";") or self.take(","):
                    continue
                parts.append(self._declaration() or ("exprstmt", self.pos(), self.expression()))
            return ("for", begin, parts, self.statement())
        if word == "foreach" or word == "await" and self.peek(1) == "foreach":
            self.take("await")
            self.next()
            self.need("(")
            ref = self.type()
            name = self.next()
            self.need("in")
            source = self.expression()
            self.need(")")
            return ("foreach", begin, ref, name.text, source, self.statement())
        if word == "using" or word == "await" and self.peek(1) == "using":
            self.take("await")
            self.next()
            if self.take("("):
                what = self._declaration() or ("exprstmt", self.pos(), self.expression())
                self.need(")")
                return ("using", begin, what, self.statement())
            d = self._declaration()
            self.need(";")
            return d
        if word == "try":
            self.next()
            parts = [self.block()]
            while self.take("catch"):
                ref = name = when = None
                if self.take("("):
                    ref = self.type()
                    if self.kind() == "id":
                        name = self.next().text
                    self.need(")")
                if self.take("when"):
                    when = self._paren()
                parts.append(("catch", begin, ref, name, when, self.block()))
            if self.take("finally"):
                parts.append(self.block())
            return ("block", begin, parts)
        if word == "switch":
            self.next()
            subject = self._paren()
            self.need("{")
            parts = []
            while not self.take("}"):
                if self.take("case"):
                    pattern = self.pattern()
                    when = self.expression() if self.take("when") else None
                    self.need(":")
                    parts.append(("case", begin, pattern, when))
                elif self.peek() == "default" and self.peek(1) == ":":
                    self.i += 2
                else:
                    parts.append(self.statement())
            return ("switch", begin, subject, parts)
        if word in ("return", "throw") or word == "yield":
            self.next()
            if word == "yield":
                self.next()
            e = None if self.peek() == ";" else self.expression()
            self.need(";")
            return ("return" if word == "return" else "throw", begin, e)
        if word in ("break", "continue", "goto"):
            while not self.take(";"):
                self.next()
            return ("block", begin, [])
        local = self.attempt(self._local_function)
        if local:
            return local
        d = self.attempt(self._declaration_statement)
        if d:
            return d
        e = self.expression()
        self.need(";")
        return ("exprstmt", begin, e)

    def _paren(self):
        self.need("(")
        e = self.expression()
        self.need(")")
        return e

    def _local_function(self):
        begin = self.pos()
        while self.peek() in ("static", "async"):
            self.next()
        ref = self.type()
        name = self.next()
        if name.kind != "id" or self.peek() not in ("(", "<"):
            raise Stop
        d = Decl("local", name.text, name.pos, begin, 0, [], [], type=ref)
        d.tparams = self._tparams()
        d.params = self.parameters()
        self._constraints(d)
        if self.peek() not in ("{", "=>"):
            raise Stop
        self._body(d)
        return ("localfunc", begin, d)

    def _declaration_statement(self):
        self.take("const")
        d = self._declaration()
        if not d:
            raise Stop
        self.need(";")
        return d

    def _declaration(self):
        def parse():
            begin = self.pos()
            ref = self.type()
            if self.kind() != "id" or self.peek(1) not in ("=", ";", ",", ")") or self.peek() in _NO_TYPE:
                raise Stop
            items = []
            while True:
                name = self.next()
                items.append((name.text, name.pos, self.expression() if self.take("=") else None))
                if not (self.peek() == "," and self.kind(1) == "id"):
                    return ("local", begin, ref, items)
                self.next()

        return self.attempt(parse)

    # expressions

    def expression(self):
        begin = self.pos()
        lam = self.attempt(self._lambda)
        if lam:
            return lam
        left = self._ternary()
        op = self.peek()
        if op in ("=", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "??="):
            self.next()
            return ("assign", begin, op, left, self.expression())
        return left

    def _lambda(self):
        begin = self.pos()
        while self.peek() in ("async", "static"):
            self.next()
        params = []
        if self.kind() == "id" and self.peek(1) == "=>":
            params.append((None, self.next().text))
        elif self.peek() == "(":
            self.next()
            while not self.take(")"):
                while self.peek() in ("ref", "out", "in"):
                    self.next()
                if self.kind() == "id" and self.peek(1) in (",", ")"):
                    params.append((None, self.next().text))
                else:
                    ref = self.type()
                    params.append((ref, self.next().text))
                if self.peek() not in (",", ")"):
                    raise Stop
                self.take(",")
        else:
            raise Stop
        self.need("=>")
        return ("lambda", begin, params, self.block() if self.peek() == "{" else self.expression())

    def _ternary(self):
        begin = self.pos()
        test = self._binary(0)
        if self.peek() == "?" :
            self.next()
            yes = self.expression()
            self.need(":")
            return ("cond", begin, test, yes, self.expression())
        return test

    _LEVELS = [["??"], ["||"], ["&&"], ["|"], ["^"], ["&"], ["==", "!="], ["<", ">", "<=", ">=", "is", "as"], ["+", "-"], ["*", "/", "%"], [".."]]

    def _binary(self, level: int):
        if level == len(self._LEVELS):
            return self._unary()
        begin = self.pos()
        left = self._binary(level + 1) if not (level == 10 and self.peek() == "..") else ("lit", begin, "range", "")
        while self.peek() in self._LEVELS[level]:
            op = self.next().text
            if op == "is":
                left = ("is", begin, left, self.pattern())
            elif op == "as":
                left = ("as", begin, left, self.type())
            elif op == "??":
                left = ("bin", begin, op, left, ("throw", self.pos(), self.expression()) if self.take("throw") else self._binary(level))
            else:
                if op == ">" and self.peek() == ">":
                    self.next()
                left = ("bin", begin, op, left, self._binary(level + 1))
        while level == 0 and self.peek() == "switch" and self.peek(1) == "{":
            self.i += 2
            arms = []
            while not self.take("}"):
                p = self.pattern()
                when = self.expression() if self.take("when") else None
                self.need("=>")
                arms.append((p, when, ("throw", self.pos(), self.expression()) if self.take("throw") else self.expression()))
                self.take(",")
            left = ("switchexpr", begin, left, arms)
        if level == 0 and self.peek() == "with" and self.peek(1) == "{":
            self.next()
            left = ("new", begin, None, [], self._initializer(), left)
        return left

    def pattern(self):
        begin, refs, values = self.pos(), [], []
        depth = 0
        while self.i < len(self.t):
            x = self.peek()
            if depth == 0 and (x in (")", ";", ",", "&&", "||", "?", "=>", "when", "]", "}") or x == ":" or x in ("==", "!=")):
                break
            if x in ("(", "{", "["):
                depth += 1
            elif x in (")", "}", "]"):
                depth -= 1
            elif self.kind() == "id" and x not in ("not", "and", "or", "null", "var", "true", "false", "is"):
                ref = self.attempt(self.type)
                if ref:
                    if self.peek() != ":":
                        refs.append(ref)
                    if depth == 0 and self.kind() == "id" and self.peek() not in ("and", "or", "when"):
                        values.append((self.next().text, ref))
                    continue
            self.next()
        return ("pattern", begin, refs, values)

    def _unary(self):
        begin, x = self.pos(), self.peek()
        if x in ("!", "-", "+", "~", "++", "--", "&", "*", "^"):
            self.next()
            return ("unary", begin, x, self._unary())
        if x == "await":
            self.next()
            return ("await", begin, self._unary())
        if x == "throw":
            self.next()
            return ("throw", begin, self.expression())
        if x == "(":
            cast = self.attempt(self._cast)
            if cast:
                return cast
        return self._postfix(self._primary())

    def _cast(self):
        begin = self.pos()
        self.need("(")
        ref = self.type()
        self.need(")")
        n, k = self.peek(), self.kind()
        if not (k in ("num", "str", "chr", "interp") or k == "id" and n not in ("is", "as", "switch", "with", "and", "or") or n in ("(", "!", "~")):
            raise Stop
        if n == "(" and not (ref.name[:1].isupper() or ref.name in ("int", "long", "double", "string", "bool", "object", "decimal", "float")):
            raise Stop
        return ("cast", begin, ref, self._unary())

    def _primary(self):
        begin, k, x = self.pos(), self.kind(), self.peek()
        if k == "interp":
            t = self.next()
            parts = []
            for text, at in t.parts:
                sub = Parser(text, tokens(text, at))
                e = sub.attempt(sub.expression)
                if e:
                    parts.append(e)
            return ("interp", begin, parts, t.text)
        if k in ("num", "str", "chr"):
            return ("lit", begin, {"num": "number", "str": "string", "chr": "char"}[k], self.next().text)
        if x in ("true", "false", "null"):
            self.next()
            return ("lit", begin, x, x)
        if x == "default":
            self.next()
            if self.take("("):
                self.type()
                self.need(")")
            return ("lit", begin, "default", "default")
        if x in ("typeof", "sizeof"):
            self.next()
            self.need("(")
            ref = self.type()
            self.need(")")
            return ("typeof", begin, ref)
        if x in ("this", "base"):
            self.next()
            return (x, begin)
        if x == "new":
            self.next()
            if self.peek() == "{":
                return ("anon", begin, self._initializer())
            if self.peek() == "[":
                self.skip_group()
                return ("new", begin, None, [], self._initializer() if self.peek() == "{" else None, None)
            ref = None if self.peek() == "(" else self.type()
            args = self.arguments() if self.peek() == "(" else []
            while self.peek() == "[":
                self.skip_group()
            return ("new", begin, ref, args, self._initializer() if self.peek() == "{" else None, None)
        if x == "(":
            self.next()
            items = [self._argument()]
            while self.take(","):
                items.append(self._argument())
            self.need(")")
            return ("paren", begin, items[0][1]) if len(items) == 1 else ("tuple", begin, items)
        if x == "[":
            self.next()
            items = []
            while not self.take("]"):
                self.take("..")
                items.append(self._argument())
                self.take(",")
            return ("tuple", begin, items)
        if x == "{":
            return ("anon", begin, self._initializer())
        if k == "id":
            name = self.next().text
            return ("name", begin, name, self._type_args())
        raise Stop

    def _type_args(self):
        def parse():
            self.need("<")
            out = [self.type()]
            while self.take(","):
                out.append(self.type())
            self.need(">")
            if self.peek() not in ("(", ")", "]", "}", ":", ";", ",", ".", "?", "==", "!=", "?."):
                raise Stop
            return out

        return (self.attempt(parse) or []) if self.peek() == "<" else []

    def _postfix(self, e):
        while True:
            begin, x = e[1], self.peek()
            if x in (".", "?.", "->", "::") and self.kind(1) == "id":
                self.next()
                at = self.pos()
                name = self.next().text
                e = ("member", begin, e, name, self._type_args(), x == "?.", at)
            elif x == "(":
                e = ("call", begin, e, self.arguments())
            elif x == "[" or x == "?" and self.peek(1) == "[" and self._indexes():
                self.take("?")
                self.next()
                items = []
                while not self.take("]"):
                    items.append(self._argument())
                    self.take(",")
                e = ("index", begin, e, items)
            elif x in ("++", "--"):
                self.next()
                e = ("unary", begin, x, e)
            elif x == "!" and self.peek(1) not in ("=",) and self.kind(1) != "id" and self.kind(1) not in ("num", "str"):
                self.next()
            else:
                return e

    def _indexes(self) -> bool:
        return False

    def _argument(self):
        name = None
        if self.kind() == "id" and self.peek(1) == ":" and self.peek(2) != ":":
            name = self.next().text
            self.next()
        if self.peek() in ("ref", "out", "in"):
            self.next()
            declared = self.attempt(self._out_declaration)
            if declared:
                return (name, declared)
        return (name, self.expression())

    def _out_declaration(self):
        begin = self.pos()
        ref = self.type()
        if self.kind() != "id" or self.peek(1) not in (",", ")"):
            raise Stop
        return ("outvar", begin, ref, self.next().text)

    def arguments(self) -> list:
        out = []
        self.need("(")
        while not self.take(")"):
            out.append(self._argument())
            if self.peek() not in (",", ")"):
                raise Stop
            self.take(",")
        return out

    def _initializer(self) -> list:
        out = []
        self.need("{")
        while not self.take("}"):
            if self.peek() == "{":
                out.append(("anon", self.pos(), self._initializer()))
            elif self.peek() == "[":
                self.skip_group()
                self.take("=")
                out.append(self.expression())
            else:
                e = self.expression()
                if e[0] == "assign" and self.peek() == "{":
                    out.append(("anon", self.pos(), self._initializer()))
                out.append(e)
            if self.peek() not in (",", "}"):
                raise Stop
            self.take(",")
        return out


def parse(text: str) -> tuple[list[Decl], list[str]]:
    p = Parser(text)
    return p.unit(), p.usings
