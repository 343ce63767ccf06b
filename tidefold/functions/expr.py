"""The closed scalar expression language: lexer, parser, admission, and compilation to columns.

expr    := or;  or := and ('or' and)*;  and := not ('and' not)*;  not := 'not' not | test
test    := sum (cmp sum | [not] in (list) | is [not] null)?;  sum := term (('+'|'-') term)*
term    := unary (('*'|'/') unary)*;  unary := '-' unary | atom
atom    := number | 'text' | true | false | null | path | f(args) | (expr)

Numbers are exact decimals. A quotient must stand under round, trunc or a comparison. Errors in data
(no number where one is needed, a zero divisor) make the value null and set ``err``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scope import MONEY, Scope, Value, narrowed

TOKEN = re.compile(r"\s*(?:(?P<num>\d+(?:\.\d+)?)|(?P<str>'(?:[^']|'')*')|(?P<path>\$(?:parent)?(?:\.[A-Za-z_]\w*|\[\d+\]|\['(?:[^']|'')*'\])*)|(?P<op><>|<=|>=|[-+*/=<>(),])|(?P<word>[A-Za-z_]\w*))")
ARITY = {"coalesce": (2, 16), "nullif": (2, 2), "round": (2, 2), "trunc": (1, 2)}
WORDS = {"and", "or", "not", "in", "is", "null", "true", "false"}


class ExprError(ValueError):
    """The expression is refused."""


@dataclass(frozen=True)
class Node:
    op: str
    args: tuple = ()


def tokens(text: str) -> list[tuple[str, str]]:
    out, at, text = [], 0, text.rstrip()
    while at < len(text):
        m = TOKEN.match(text, at)
        if not m or m.end() == at:
            raise ExprError(f"not understood at {text[at:at + 12]!r}")
        kind = m.lastgroup
        out.append((kind, m[kind].lower() if kind == "word" else m[kind]))
        at = m.end()
    return out


class Parser:
    def __init__(self, text: str):
        self.t, self.i = tokens(text), 0

    def peek(self, *values: str) -> bool:
        return self.i < len(self.t) and self.t[self.i][1] in values and self.t[self.i][0] in ("op", "word")

    def take(self, *values: str) -> str | None:
        if self.peek(*values):
            self.i += 1
            return self.t[self.i - 1][1]
        return None

    def need(self, value: str) -> None:
        if not self.take(value):
            raise ExprError(f"{value!r} is missing")

    def parse(self) -> Node:
        out = self.either()
        if self.i < len(self.t):
            raise ExprError(f"{self.t[self.i][1]!r} is left over")
        return out

    def chain(self, below, *ops: str) -> Node:
        out = below()
        while op := self.take(*ops):
            out = Node(op, (out, below()))
        return out

    def either(self) -> Node:
        return self.chain(self.both, "or")

    def both(self) -> Node:
        return self.chain(self.negated, "and")

    def negated(self) -> Node:
        return Node("not", (self.negated(),)) if self.take("not") else self.test()

    def test(self) -> Node:
        left = self.sum()
        if op := self.take("=", "<>", "<", "<=", ">", ">="):
            return Node(op, (left, self.sum()))
        if self.take("is"):
            no = self.take("not")
            self.need("null")
            return Node("isnotnull" if no else "isnull", (left,))
        no = self.take("not")
        if no or self.peek("in"):
            self.need("in")
            self.need("(")
            members = [self.sum()]
            while self.take(","):
                members.append(self.sum())
            self.need(")")
            out = Node("in", (left, *members))
            return Node("not", (out,)) if no else out
        return left

    def sum(self) -> Node:
        return self.chain(self.term, "+", "-")

    def term(self) -> Node:
        return self.chain(self.unary, "*", "/")

    def unary(self) -> Node:
        return Node("neg", (self.unary(),)) if self.take("-") else self.atom()

    def atom(self) -> Node:
        if self.take("("):
            out = self.either()
            self.need(")")
            return out
        if self.i >= len(self.t):
            raise ExprError("the expression ends early")
        kind, value = self.t[self.i]
        self.i += 1
        if kind == "num":
            return Node("num", (Decimal(value),))
        if kind == "str":
            return Node("str", (value[1:-1].replace("''", "'"),))
        if kind == "path":
            return Node("path", (value,))
        if kind == "word" and value in ("true", "false"):
            return Node("bool", (value == "true",))
        if kind == "word" and value == "null":
            return Node("null")
        if kind == "word" and value in ARITY:
            self.need("(")
            args = [self.either()]
            while self.take(","):
                args.append(self.either())
            self.need(")")
            lo, hi = ARITY[value]
            if not lo <= len(args) <= hi:
                raise ExprError(f"{value} takes {lo} to {hi} arguments")
            if value in ("round", "trunc") and len(args) == 2 and not (args[1].op == "num" and args[1].args[0] == int(args[1].args[0]) and args[1].args[0] <= 12):
                raise ExprError(f"{value} takes a literal scale from 0 to 12")
            return Node(value, tuple(args))
        raise ExprError(f"{value!r} is unknown")


def admitted(n: Node, rounded: bool = False) -> None:
    """Refuses a quotient that nothing rounds or compares."""
    if n.op == "/" and not rounded:
        raise ExprError("a quotient stands under round, trunc or a comparison")
    for x in n.args:
        if isinstance(x, Node):
            admitted(x, n.op in ("round", "trunc", "=", "<>", "<", "<=", ">", ">=") or (rounded and n.op in ("+", "-", "*", "/", "neg")))


def parse(text: str) -> Node:
    out = Parser(text).parse()
    admitted(out)
    return out


def paths(n: Node) -> set[str]:
    return {n.args[0]} if n.op == "path" else set().union(*(paths(x) for x in n.args if isinstance(x, Node)), set())


def _err(*values: Value, more: Column | None = None) -> Column | None:
    parts = [v.err for v in values if v.err is not None] + ([more] if more is not None else [])
    return reduce(lambda a, b: a | b, parts) if parts else None


def _guard(col: Column, err: Column | None) -> Column:
    return col if err is None else F.when(~err, col)


def compiled(n: Node, scope: Scope) -> Value:
    """The value of an expression in a scope."""
    c = lambda x: compiled(x, scope)
    dec, boolean = T.DecimalType(38, 12), T.BooleanType()
    if n.op == "num":
        d = n.args[0]
        places = max(0, -d.as_tuple().exponent)
        return Value(F.lit(d).cast(f"decimal({max(len(d.as_tuple().digits), places + 1)},{places})"), "num", T.DecimalType(38, places))
    if n.op == "str":
        return Value(F.lit(n.args[0]), "str")
    if n.op == "bool":
        return Value(F.lit(n.args[0]), "bool", boolean)
    if n.op == "null":
        return Value(F.lit(None).cast("string"), "null", T.NullType())
    if n.op == "path":
        return scope.get(n.args[0])
    if n.op in ("isnull", "isnotnull"):
        v = c(n.args[0])
        gone = F.coalesce(F.is_variant_null(v.col), F.lit(True)) | v.col.isNull() if v.fam == "any" else v.col.isNull()
        return Value(gone if n.op == "isnull" else ~gone, "bool", boolean, v.err)
    if n.op in ("+", "-", "*", "/", "neg"):
        vs = [c(x) for x in n.args]
        xs, bad = [], []
        for v in vs:
            x, is_num = narrowed(v, "num")
            xs.append(F.when(is_num, x) if v.fam == "any" else x)
            if v.fam not in ("num", "null"):
                bad.append(~is_num & v.col.isNotNull() & (~F.is_variant_null(v.col) if v.fam == "any" else F.lit(True)))
        more = reduce(lambda a, b: a | b, bad) if bad else None
        if n.op == "neg":
            out = -xs[0]
        elif n.op == "/":
            zero = F.coalesce(xs[1] == 0, F.lit(False))
            more = zero if more is None else more | zero
            out = F.try_divide(xs[0].cast(MONEY), xs[1].cast(MONEY))
        else:
            out = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[n.op](*xs)
        err = _err(*vs, more=more)
        return Value(_guard(out, err), "num", dec, err)
    if n.op in ("=", "<>", "<", "<=", ">", ">="):
        a, b = (c(x) for x in n.args)
        return _compare(n.op, a, b)
    if n.op in ("and", "or", "not"):
        vs = [c(x) for x in n.args]
        xs = [F.when(narrowed(v, "bool")[1], narrowed(v, "bool")[0]) for v in vs]
        bad = [~narrowed(v, "bool")[1] & v.col.isNotNull() for v in vs if v.fam not in ("bool", "null")]
        err = _err(*vs, more=reduce(lambda a, b: a | b, bad) if bad else None)
        out = ~xs[0] if n.op == "not" else xs[0] & xs[1] if n.op == "and" else xs[0] | xs[1]
        return Value(_guard(out, err), "bool", boolean, err)
    if n.op == "in":
        left, *members = (c(x) for x in n.args)
        tests = [_compare("=", left, m) for m in members]
        out = reduce(lambda a, b: a | b, [t.col for t in tests])
        return Value(F.when(left.col.isNotNull(), out), "bool", boolean, _err(*tests))
    if n.op == "coalesce":
        vs = [v for v in map(c, n.args) if v.fam != "null"]
        if not vs:
            return Value(F.lit(None).cast("string"), "null", T.NullType())
        fams = {v.fam for v in vs}
        if len(fams) > 1:
            raise ExprError("coalesce takes values of one family")
        num = fams == {"num"}
        return Value(F.coalesce(*(v.number() if num else v.col for v in vs)), vs[0].fam, dec if num else vs[0].kind, _err(*vs))
    if n.op == "nullif":
        a, b = (c(x) for x in n.args)
        same = _compare("=", a, b)
        return Value(F.when(F.coalesce(same.col, F.lit(False)), F.lit(None)).otherwise(a.number() if a.fam == "num" else a.col), a.fam, dec if a.fam == "num" else a.kind, _err(a, b))
    if n.op in ("round", "trunc"):
        v = c(n.args[0])
        scale = int(n.args[1].args[0]) if len(n.args) > 1 else 0
        x, is_num = narrowed(v, "num")
        err = _err(v, more=None if v.fam in ("num", "null") else ~is_num & v.col.isNotNull())
        out = F.round(x, scale) if n.op == "round" else F.when(x >= 0, F.floor(x, F.lit(scale))).otherwise(F.ceil(x, F.lit(scale)))
        return Value(_guard(out.cast(f"decimal(38,{scale})"), err), "num", T.DecimalType(38, scale), err)
    raise ExprError(n.op)


def _compare(op: str, a: Value, b: Value) -> Value:
    boolean = T.BooleanType()
    both = a.col.isNotNull() & b.col.isNotNull()
    if op in ("=", "<>"):
        if "any" in (a.fam, b.fam):
            hits = []
            for fam in ("num", "str", "bool"):
                (x, xs), (y, ys) = narrowed(a, fam), narrowed(b, fam)
                hits.append(xs & ys & F.coalesce(x == y, F.lit(False)))
            same = F.when(both, reduce(lambda p, q: p | q, hits))
        elif "null" in (a.fam, b.fam):
            same = F.lit(None).cast("boolean")
        elif a.fam != b.fam or a.fam == "obj":
            same = F.when(both, F.lit(False))
        else:
            same = (a.number() if a.fam == "num" else narrowed(a, a.fam)[0]) == (b.number() if b.fam == "num" else narrowed(b, b.fam)[0])
        return Value(~same if op == "<>" else same, "bool", boolean, _err(a, b))
    (x, xs), (y, ys) = narrowed(a, "num"), narrowed(b, "num")
    bad = [~s & v.col.isNotNull() for v, s in ((a, xs), (b, ys)) if v.fam not in ("num", "null")]
    err = _err(a, b, more=reduce(lambda p, q: p | q, bad) if bad else None)
    out = {"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]
    return Value(_guard(out, err), "bool", boolean, err)


def evaluate(text: str, scope: Scope) -> Value:
    return compiled(parse(text), scope)
