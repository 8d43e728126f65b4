"""A subset of the Common Expression Language, compiled to Spark columns.

Literals, identifiers, `m['k']`, `m.k`, `in`, `size()`, comparisons, `&& || !`, the ternary,
`+ - * / %`, `startsWith endsWith contains matches`, `has()`, and conversions `int double
string`. An error at run time is null: `&&` and `||` absorb it as SQL's three-valued logic
does. Indexing a map by an absent key gives '' (maps are lenient); `in` tells the truth.
Anything else is refused when the expression is compiled.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


class CelError(ValueError):
    pass


_TOKEN = re.compile(r"""\s*(?:(?P<num>\d+\.\d*(?:[eE][+-]?\d+)?|\d+[eE][+-]?\d+|\d+)|(?P<str>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<id>[A-Za-z_]\w*)|(?P<op>&&|\|\||==|!=|<=|>=|[-+*/%!<>?:.,()\[\]]))""")
_BINDING = {"||": 1, "&&": 2, "==": 3, "!=": 3, "<": 3, "<=": 3, ">": 3, ">=": 3, "in": 3, "+": 4, "-": 4, "*": 5, "/": 5, "%": 5}
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}
_NUMBERS = ("int", "double")


def _tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while text[at:].strip():
        m = _TOKEN.match(text, at)
        if not m:
            raise CelError(f"cannot read {text[at:]!r}")
        out.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    return [*out, ("end", "")]


class _Compiler:
    def __init__(self, text: str, env: dict[str, tuple[str, Column]]):
        self.toks, self.at, self.env = _tokens(text), 0, env

    def take(self, value: str | None = None) -> str:
        kind, got = self.toks[self.at]
        if value is not None and got != value:
            raise CelError(f"expected {value!r}, found {got!r}")
        self.at += 1
        return got

    def peek(self) -> str:
        kind, value = self.toks[self.at]
        return "" if kind == "str" else value

    def whole(self):
        found = self.ternary()
        if self.toks[self.at][0] != "end":
            raise CelError(f"unexpected {self.toks[self.at][1]!r}")
        return found

    def ternary(self):
        cond = self.binary(1)
        if self.peek() != "?":
            return cond
        self.take("?")
        yes = self.ternary()
        self.take(":")
        no = self.ternary()
        self.need(cond, "bool")
        kind = self.same(yes, no)
        return kind, F.when(cond[1].isNull(), F.lit(None)).when(cond[1], yes[1]).otherwise(no[1])

    def need(self, value, *kinds: str) -> None:
        if value[0] not in kinds:
            raise CelError(f"{value[0]} where {' or '.join(kinds)} is needed")

    def same(self, a, b) -> str:
        if a[0] == b[0]:
            return a[0]
        if a[0] in _NUMBERS and b[0] in _NUMBERS:
            return "double"
        raise CelError(f"{a[0]} and {b[0]} do not go together")

    def binary(self, least: int):
        left = self.unary()
        while (power := _BINDING.get(self.peek(), 0)) >= least and self.toks[self.at][0] != "str":
            op = self.take()
            right = self.binary(power + 1)
            left = self.apply(op, left, right)
        return left

    def apply(self, op: str, a, b):
        x, y = a[1], b[1]
        if op in ("&&", "||"):
            self.need(a, "bool")
            self.need(b, "bool")
            return "bool", (x & y) if op == "&&" else (x | y)
        if op == "in":
            if b[0] == "map":
                return "bool", F.coalesce(F.map_contains_key(y, x), F.lit(False))
            self.need(b, "list")
            return "bool", F.coalesce(F.array_contains(y, x), F.lit(False))
        if op in ("==", "!=", "<", "<=", ">", ">="):
            self.same(a, b)
            return "bool", {"==": x == y, "!=": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]
        kind = self.same(a, b)
        if op == "+" and kind == "string":
            return kind, F.concat(x, y)
        if kind not in _NUMBERS:
            raise CelError(f"{op} on {kind}")
        if kind == "int":
            x, y = x.cast("long"), y.cast("long")
        else:
            x, y = x.cast("double"), y.cast("double")
        if op == "+":
            return kind, F.try_add(x, y)
        if op == "-":
            return kind, F.try_subtract(x, y)
        if op == "*":
            return kind, F.try_multiply(x, y)
        if op == "%":
            self.need((kind,), "int")
            return kind, F.try_mod(x, y)
        # whole numbers are cut towards zero; the remainder leaves an exact quotient
        return (kind, F.try_divide(x - F.try_mod(x, y), y).cast("long")) if kind == "int" else (kind, F.try_divide(x, y))

    def unary(self):
        if self.peek() == "!":
            self.take()
            v = self.unary()
            self.need(v, "bool")
            return "bool", ~v[1]
        if self.peek() == "-":
            self.take()
            v = self.unary()
            self.need(v, *_NUMBERS)
            return v[0], -v[1]
        return self.postfix(self.primary())

    def primary(self):
        kind, text = self.toks[self.at]
        self.at += 1
        if kind == "num":
            return ("int", F.lit(int(text)).cast("long")) if text.isdigit() else ("double", F.lit(float(text)))
        if kind == "str":
            return "string", F.lit(re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), text[1:-1]))
        if text == "(":
            v = self.ternary()
            self.take(")")
            return v
        if text == "[":
            items = []
            while self.peek() != "]":
                items.append(self.ternary())
                if self.peek() != "]":
                    self.take(",")
            self.take("]")
            return "list", F.array(*[v for _, v in items])
        if kind == "id":
            if text in ("true", "false"):
                return "bool", F.lit(text == "true")
            if self.peek() == "(":
                return self.call(text)
            if text in self.env:
                return self.env[text]
        raise CelError(f"unknown {text!r}")

    def arguments(self) -> list:
        self.take("(")
        out = []
        while self.peek() != ")":
            out.append(self.ternary())
            if self.peek() != ")":
                self.take(",")
        self.take(")")
        return out

    def call(self, name: str):
        if name == "has":
            self.take("(")
            owner = self.take()
            self.take(".")
            key = self.take()
            self.take(")")
            if owner not in self.env or self.env[owner][0] != "map":
                raise CelError("has() needs a key of a map")
            return "bool", F.coalesce(F.map_contains_key(self.env[owner][1], F.lit(key)), F.lit(False))
        args = self.arguments()
        if len(args) != 1:
            raise CelError(f"{name}() takes one argument")
        kind, x = args[0]
        if name == "size":
            self.need(args[0], "string", "map", "list")
            return "int", (F.length(x) if kind == "string" else F.greatest(F.size(x), F.lit(0))).cast("long")
        if name in ("int", "double", "string"):
            return name, x.cast("string") if name == "string" else F.expr("NULL") if kind in ("map", "list") else _number(x, kind, name)
        raise CelError(f"unknown function {name!r}")

    def postfix(self, v):
        while True:
            if self.peek() == "[":
                self.take()
                key = self.ternary()
                self.take("]")
                if v[0] == "map":
                    self.need(key, "string")
                    v = "string", F.coalesce(F.try_element_at(v[1], key[1]), F.lit(""))
                else:
                    self.need(v, "list")
                    v = "string", F.get(v[1], key[1].cast("int"))
            elif self.peek() == ".":
                self.take()
                name = self.take()
                if self.peek() == "(":
                    args = self.arguments()
                    if name == "size" and not args:
                        v = "int", F.length(v[1]).cast("long") if v[0] == "string" else F.size(v[1]).cast("long")
                        continue
                    self.need(v, "string")
                    if len(args) != 1:
                        raise CelError(f"{name}() takes one argument")
                    self.need(args[0], "string")
                    made = {"startsWith": F.startswith, "endsWith": F.endswith, "contains": F.contains, "matches": F.regexp_like}.get(name)
                    if not made:
                        raise CelError(f"unknown method {name!r}")
                    v = "bool", made(v[1], args[0][1])
                else:
                    self.need(v, "map")
                    v = "string", F.coalesce(F.try_element_at(v[1], F.lit(name)), F.lit(""))
            else:
                return v


def _number(x: Column, kind: str, name: str) -> Column:
    if name == "int" and kind == "double":
        return F.when(F.abs(x) < 9.2e18, x.cast("long"))
    return x.try_cast("long" if name == "int" else "double")


def compile_cel(text: str, env: dict[str, tuple[str, Column]]) -> tuple[str, Column]:
    """(type, column) of an expression over env: name to (bool, int, double, string, map or list; column)."""
    return _Compiler(text, env).whole()


def compile_rule(text: str, env: dict[str, tuple[str, Column]]) -> Column:
    kind, column = compile_cel(text, env)
    if kind != "bool":
        raise CelError(f"{text!r} is {kind}, not bool")
    return column
