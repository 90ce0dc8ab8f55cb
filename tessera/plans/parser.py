"""Text of a rule program -> syntax tree."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Any

from tessera.errors import ParseError


@dataclass(frozen=True)
class Lit:
    value: Any


@dataclass(frozen=True)
class Var:
    name: str


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple


@dataclass(frozen=True)
class Read:
    """How a stored relation is read: current, at (valid, system), spans, delta or delta_sys."""
    kind: str = "current"
    args: tuple = ()
    var: str | None = None


@dataclass(frozen=True)
class RuleAtom:
    name: str
    args: tuple


@dataclass(frozen=True)
class StoredAtom:
    name: str
    args: tuple  # positional expressions, or (column, expression) pairs
    named: bool
    read: Read = Read()


@dataclass(frozen=True)
class SearchAtom:
    relation: str
    index: str
    binds: tuple
    options: tuple


@dataclass(frozen=True)
class Unify:
    var: str
    expr: Any
    many: bool = False


@dataclass(frozen=True)
class Cond:
    expr: Any


@dataclass(frozen=True)
class Not:
    atom: Any


@dataclass(frozen=True)
class Or:
    sides: tuple


@dataclass(frozen=True)
class And:
    parts: tuple


@dataclass(frozen=True)
class HeadArg:
    var: str
    aggr: str | None = None
    extra: tuple = ()


@dataclass
class Rule:
    name: str
    head: list[HeadArg]
    body: Any = None          # And
    rows: Any = None          # expression of a constant rule
    algo: str | None = None
    inputs: list = field(default_factory=list)
    options: dict = field(default_factory=dict)


@dataclass(frozen=True)
class ColumnSpec:
    name: str
    type: str = "Any?"
    default: Any = None
    source: str | None = None


@dataclass
class Write:
    op: str
    name: str
    keys: list[ColumnSpec] | None = None
    values: list[ColumnSpec] | None = None
    at: Any = None


@dataclass
class Program:
    rules: list[Rule] = field(default_factory=list)
    order: list[tuple[str, bool]] = field(default_factory=list)
    limit: int | None = None
    offset: int = 0
    check: str | None = None
    timeout: float | None = None
    write: Write | None = None
    returning: bool = False
    options: dict = field(default_factory=dict)


@dataclass
class System:
    op: str
    args: list


TOKEN = re.compile(r"""
    (?P<space>\s+|\#[^\n]*|/\*.*?\*/)
  | (?P<float>(?:0|[1-9][0-9_]*)(?:(?:\.[0-9_]*)?[eE][+-]?[0-9_]+|\.(?!\.)[0-9_]*))
  | (?P<int>0x[0-9a-fA-F][0-9a-fA-F_]*|0o[0-7][0-7_]*|0b[01][01_]*|[0-9][0-9_]*)
  | (?P<string>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')
  | (?P<param>\$[\w.]+)
  | (?P<name>[^\W\d][\w.]*)
  | (?P<at>@(?:spans|delta_sys|delta)\b)
  | (?P<op>:=|<-|<~|=>|::|:[a-z_]+|->|\+\+|\|\||&&|==|!=|>=|<=|[?\[\](){},;:=<>+\-*/%^~!|@])
""", re.VERBOSE | re.DOTALL)
ESCAPES = {"b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t"}
BINARY = [("||",), ("&&",), (">", "<", ">=", "<="), ("==", "!="), ("%",), ("+", "-", "++"), ("*", "/"), ("^",), ("~",)]
NAMES = {"||": "or", "&&": "and", ">": "gt", "<": "lt", ">=": "ge", "<=": "le", "==": "eq", "!=": "neq", "%": "mod",
         "+": "add", "-": "sub", "++": "concat", "*": "mul", "/": "div", "^": "pow", "~": "coalesce"}
WRITES = {":create", ":replace", ":insert", ":put", ":update", ":rm", ":delete", ":ensure", ":ensure_not"}


def _unescape(s: str) -> str:
    return re.sub(r"\\(u[0-9a-fA-F]{4}|.)", lambda m: chr(int(m[1][1:], 16)) if m[1][0] == "u" and len(m[1]) == 5 else ESCAPES.get(m[1], m[1]), s, flags=re.DOTALL)


def tokens(text: str) -> list[tuple[str, Any, int]]:
    out, at = [], 0
    raw = re.compile(r'(_+)"(.*?)"\1', re.DOTALL)
    while at < len(text):
        if (m := raw.match(text, at)):
            out.append(("string", m[2], at))
            at = m.end()
            continue
        m = TOKEN.match(text, at)
        if not m or m.end() == at:
            raise ParseError(f"unexpected text at {at}: {text[at:at + 20]!r}")
        kind = m.lastgroup
        s = m[0]
        if kind == "float":
            out.append(("float", float(s.replace("_", "")), at))
        elif kind == "int":
            out.append(("int", int(s.replace("_", ""), 0) if s[:2] in ("0x", "0o", "0b") else int(s.replace("_", "")), at))
        elif kind == "string":
            out.append(("string", _unescape(s[1:-1]), at))
        elif kind != "space":
            if kind == "op" and s[0] == ":" and len(s) > 1 and s not in (":=", "::") and s not in WRITES | {
                    ":limit", ":offset", ":sort", ":order", ":returning", ":assert", ":timeout", ":sleep", ":disable_magic_rewrite"}:
                out.append(("op", ":", at))
                at += 1
                continue
            out.append((kind, s, at))
        at = m.end()
    out.append(("end", None, len(text)))
    return out


class Parser:
    def __init__(self, text: str, params: dict | None = None):
        self.text, self.t, self.i, self.params = text, tokens(text), 0, params or {}

    # -- helpers
    def peek(self, *values) -> bool:
        kind, v, _ = self.t[self.i]
        return kind not in ("string", "int", "float") and v in values

    def take(self, *values):
        if values and not self.peek(*values):
            self.fail(" or ".join(values))
        self.i += 1
        return self.t[self.i - 1][1]

    def maybe(self, *values) -> bool:
        if self.peek(*values):
            self.i += 1
            return True
        return False

    def name(self) -> str:
        kind, v, _ = self.t[self.i]
        if kind != "name":
            self.fail("a name")
        self.i += 1
        return v

    def fail(self, want: str):
        kind, v, at = self.t[self.i]
        raise ParseError(f"expected {want} at {at}, found {v!r}: ...{self.text[max(0, at - 20):at + 20]!r}")

    def list_of(self, item, end: str) -> list:
        out = []
        while not self.maybe(end):
            out.append(item())
            if not self.maybe(","):
                self.take(end)
                break
        return out

    # -- expressions
    def expr(self, level: int = 0):
        if level == len(BINARY):
            return self.unary()
        left = self.expr(level + 1)
        if "^" in BINARY[level]:
            if self.maybe("^"):
                return Call("pow", (left, self.expr(level)))
            return left
        while self.peek(*BINARY[level]):
            left = Call(NAMES[self.take()], (left, self.expr(level + 1)))
        return left

    def unary(self):
        if self.maybe("-"):
            x = self.unary()
            return Lit(-x.value) if isinstance(x, Lit) and isinstance(x.value, (int, float)) and not isinstance(x.value, bool) else Call("minus", (x,))
        if self.maybe("!"):
            return Call("negate", (self.unary(),))
        x = self.term()
        while self.maybe("->"):
            x = Call("maybe_get", (x, self.term()))
        return x

    def term(self):
        kind, v, _ = self.t[self.i]
        if kind in ("int", "float", "string"):
            self.i += 1
            return Lit(v)
        if kind == "param":
            self.i += 1
            if v[1:] not in self.params:
                raise ParseError(f"no value given for {v}")
            return Lit(self.params[v[1:]])
        if self.maybe("("):
            x = self.expr()
            self.take(")")
            return x
        if self.maybe("["):
            return Call("list", tuple(self.list_of(self.expr, "]")))
        if self.maybe("{"):
            pairs = self.list_of(self.pair, "}")
            return Call("json_object", tuple(x for p in pairs for x in p))
        name = self.name()
        if name in ("true", "false", "null"):
            return Lit({"true": True, "false": False, "null": None}[name])
        if self.maybe("("):
            return Call(name, tuple(self.list_of(self.expr, ")")))
        return Var(name)

    def pair(self):
        k = self.expr()
        self.take(":")
        return k, self.expr()

    # -- atoms
    def body(self) -> And:
        parts = []
        while self.starts_atom():
            parts.append(self.disjunction())
            if not self.maybe(","):
                break
        return And(tuple(parts))

    def starts_atom(self) -> bool:
        kind, v, _ = self.t[self.i]
        return kind in ("name", "string", "int", "float", "param") or v in ("*", "~", "(", "[", "{", "!", "-")

    def disjunction(self):
        sides = [self.atom()]
        while self.maybe("or"):
            sides.append(self.atom())
        return sides[0] if len(sides) == 1 else Or(tuple(sides))

    def relation_name(self) -> str:
        name = self.name()
        while self.peek(":") and self.t[self.i + 1][0] == "name":
            self.i += 1
            name += ":" + self.name()
        return name

    def atom(self):
        if self.maybe("not"):
            return Not(self.atom())
        if self.maybe("*"):
            name = self.relation_name()
            if self.maybe("{"):
                args, read = self.relation_args(self.named_arg, "}")
                return StoredAtom(name, args, True, read)
            self.take("[")
            args, read = self.relation_args(self.expr, "]")
            return StoredAtom(name, args, False, read)
        if self.maybe("~"):
            rel = self.name()
            self.take(":")
            index = self.name()
            self.take("{")
            binds = []
            while not self.maybe("|"):
                binds.append(self.named_arg())
                if not self.maybe(","):
                    self.take("|")
                    break
            return SearchAtom(rel, index, tuple(binds), tuple(self.list_of(self.option_pair, "}")))
        kind, v, _ = self.t[self.i]
        if kind == "name" and v not in ("true", "false", "null"):
            nxt = self.t[self.i + 1][1] if self.t[self.i + 1][0] != "string" else None
            if nxt == "[":
                self.i += 2
                return RuleAtom(v, tuple(self.list_of(self.expr, "]")))
            if nxt in ("=", "in"):
                self.i += 2
                return Unify(v, self.expr(), nxt == "in")
        start = self.i
        try:
            return Cond(self.expr())
        except ParseError:
            if self.t[start][1] != "(" or self.t[start][0] == "string":
                raise
            self.i = start + 1
            inner = self.body()
            self.take(")")
            return inner

    def named_arg(self):
        name = self.name()
        return (name, self.expr()) if self.maybe(":") else (name, Var(name))

    def option_pair(self):
        name = self.name()
        self.take(":")
        return name, self.expr()

    def relation_args(self, item, end: str):
        out, read = [], Read()
        while not self.maybe(end):
            if self.peek("@", "@spans", "@delta", "@delta_sys"):
                read = self.read_clause()
                self.take(end)
                break
            out.append(item())
            self.maybe(",")
        return tuple(out), read

    def read_clause(self) -> Read:
        kind = self.take()
        if kind == "@":
            args = [self.expr()]
            if self.maybe(","):
                args.append(self.expr())
            return Read("at", tuple(args))
        if kind == "@spans":
            var = self.name()
            return Read("spans", (self.expr(),) if self.maybe(",") else (), var)
        self.take("(")
        a = self.expr()
        self.take(",")
        b = self.expr()
        self.take(")")
        return Read(kind[1:], (a, b), self.name())

    # -- programs
    def program(self, end: str | None = None) -> Program:
        p = Program()
        while not (self.peek(end) if end else self.t[self.i][0] == "end"):
            if self.t[self.i][0] == "op" and str(self.t[self.i][1]).startswith(":"):
                self.option(p)
            else:
                p.rules.append(self.rule())
            self.maybe(";")
        return p

    def rule(self) -> Rule:
        name = "?" if self.maybe("?") else self.name()
        self.take("[")
        head = self.list_of(self.head_arg, "]")
        how = self.take(":=", "<-", "<~")
        if how == ":=":
            return Rule(name, head, body=self.body())
        if how == "<-":
            return Rule(name, head, rows=self.expr())
        r = Rule(name, head, algo=self.name())
        self.take("(")
        for x in self.list_of(self.algo_arg, ")"):
            if isinstance(x, tuple):
                r.options[x[0]] = x[1]
            else:
                r.inputs.append(x)
        return r

    def algo_arg(self):
        if self.peek("*"):
            return self.atom()
        if self.t[self.i + 1][1] == ":" and self.t[self.i + 1][0] == "op":
            return self.option_pair()
        return self.atom()

    def head_arg(self) -> HeadArg:
        name = self.name()
        if not self.maybe("("):
            return HeadArg(name)
        var = self.name()
        extra = []
        while self.maybe(","):
            extra.append(self.expr())
        self.take(")")
        return HeadArg(var, name, tuple(extra))

    def option(self, p: Program) -> None:
        op = self.take()
        if op in (":limit", ":offset", ":timeout", ":sleep", ":disable_magic_rewrite"):
            v = constant(self.expr())
            if op == ":limit":
                p.limit = int(v)
            elif op == ":offset":
                p.offset = int(v)
            elif op == ":timeout":
                p.timeout = float(v)
            else:
                p.options[op[1:]] = v
        elif op in (":sort", ":order"):
            while True:
                down = self.peek("-")
                self.maybe("+", "-")
                name = self.name()
                if self.maybe("("):
                    name = f"{name}({self.name()})"
                    self.take(")")
                p.order.append((name, down))
                if not self.maybe(","):
                    break
        elif op == ":assert":
            p.check = self.take("none", "some")
        elif op == ":returning":
            p.returning = True
        elif op in WRITES:
            p.write = Write(op[1:], self.name())
            if self.maybe("{"):
                p.write.keys = self.columns("=>", "}")
                p.write.values = self.columns("}") if self.t[self.i - 1][1] == "=>" else []
            if self.maybe("@"):
                p.write.at = self.expr()
        else:
            self.fail("an option")

    def columns(self, *ends: str) -> list[ColumnSpec]:
        out = []
        while not self.maybe(*ends):
            name, type_, default, source = self.name(), "Any?", None, None
            if self.maybe(":"):
                type_ = self.type_()
            if self.maybe("default"):
                default = self.expr()
            elif self.maybe("="):
                source = self.name()
                if self.maybe("("):
                    source = f"{source}({self.name()})"
                    self.take(")")
            out.append(ColumnSpec(name, type_, default, source))
            self.maybe(",")
        return out

    def type_(self) -> str:
        if self.maybe("["):
            inner = self.type_()
            size = f";{constant(self.expr())}" if self.maybe(";") else ""
            self.take("]")
            t = f"[{inner}{size}]"
        elif self.maybe("("):
            t = "(" + ",".join(self.list_of(self.type_, ")")) + ")"
        elif self.maybe("<"):
            el = self.name()
            self.take(";")
            size = self.take()
            self.take(">")
            t = f"<{el};{size}>"
        else:
            t = self.name()
        if self.maybe("?"):
            t += "?"
        return t

    def system(self) -> System:
        self.take("::")
        op = self.name()
        args: list = []
        if op in ("hnsw", "fts", "lsh", "index"):
            args.append(self.take("create", "drop"))
            args += [self.name(), self.take(":") and self.name()]
            if args[0] == "create":
                self.take("{")
                args.append(self.list_of(self.name if op == "index" else self.option_pair, "}"))
        elif op in ("columns", "indices", "show_triggers"):
            args.append(self.relation_name())
        elif op == "describe":
            args.append(self.relation_name())
            if self.t[self.i][0] == "string":
                args.append(self.take())
        elif op == "remove":
            args = self.names()
        elif op == "rename":
            while True:
                a = self.name()
                self.take("->")
                args.append((a, self.name()))
                if not self.maybe(","):
                    break
        elif op == "access_level":
            args = [self.take("normal", "protected", "read_only", "hidden"), *self.names()]
        elif op == "set_triggers":
            args.append(self.name())
            while self.maybe("on"):
                kind = self.take("put", "rm", "replace")
                args.append((kind, self.block_text()))
        elif op == "constraint":
            args.append(self.take("create", "drop", "list"))
            if args[0] != "list":
                args.append(self.name())
            if args[0] == "create":
                args.append(self.block_text())
        elif op in ("explain", "verify"):
            args.append(self.block_text())
        elif op == "kill":
            args.append(self.expr())
        elif op not in ("relations", "fixed_rules", "running", "compact"):
            self.fail("a system operation")
        return System(op, args)

    def names(self) -> list[str]:
        out = [self.name()]
        while self.maybe(","):
            out.append(self.name())
        return out

    def block_text(self) -> str:
        """Source of a braced program, kept as text until it runs."""
        a = self.t[self.i][2] + 1
        self.take("{")
        depth = 1
        while depth:
            if self.t[self.i][0] == "end":
                self.fail("}")
            depth += self.peek("{") - self.peek("}")
            self.i += 1
        return self.text[a:self.t[self.i - 1][2]]


def constant(e) -> Any:
    """Value of an expression made of literals."""
    if isinstance(e, Lit):
        return e.value
    if isinstance(e, Call) and e.name == "list":
        return [constant(x) for x in e.args]
    if isinstance(e, Call) and e.name == "json_object":
        return {constant(k): constant(v) for k, v in zip(e.args[::2], e.args[1::2])}
    if isinstance(e, Call) and e.name in ("minus", "add", "sub", "mul", "div"):
        a = [constant(x) for x in e.args]
        return -a[0] if e.name == "minus" else {"add": lambda x, y: x + y, "sub": lambda x, y: x - y, "mul": lambda x, y: x * y, "div": lambda x, y: x / y}[e.name](*a)
    raise ParseError(f"a constant is wanted, not {e}")


def parse(text: str, params: dict | None = None):
    if re.search(r"(?m)^\s*%", re.sub(r"#[^\n]*", "", text)):
        raise ParseError("imperative blocks are refused")
    p = Parser(text, params)
    if p.peek("::"):
        s = p.system()
        if p.t[p.i][0] != "end":
            p.fail("the end")
        return s
    return p.program()
