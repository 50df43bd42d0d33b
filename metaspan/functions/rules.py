"""The rule language: an expression over profile columns, compiled once to a Column.

Grammar: and, or, not, & | ~, + - * / // %, chained comparisons, in / not in, len(x) or size(x), count(x),
x.count('c'), validators is_tel(x), is_email(x) and so on, literals, and names: profile columns, value lists
(top10, first1..3 top10, last1..3 top10) and named sets of valid values. Nothing is evaluated in Python: the text is parsed
to a syntax tree whose nodes a whitelist turns into Catalyst expressions; anything else is an error.

`x in y`: for lists the share of x's elements that y holds must reach the threshold; a text in a text is a substring; a list
in a text is the share of its elements that are substrings. Comparisons are numeric if both sides are numbers, else textual.
Each rule also yields the ratios of its `in` tests for scoring.
"""

from __future__ import annotations

import ast
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import validators

THRESHOLD = 0.30


class RuleError(ValueError):
    """The text is no rule."""


@dataclass
class Value:
    """A compiled subexpression: its kind is 'bool', 'number', 'text', 'list' or 'literal list'."""

    column: Column
    kind: str


@dataclass
class Compiled:
    holds: Column
    ratios: list[Column] = field(default_factory=list)


_FUNCTIONS = {
    "is_tel": validators.telephone, "is_datechar": validators.date, "is_yearmonth": validators.year_month, "is_yymmdd": validators.yymmdd, "is_timestamp": validators.timestamp,
    "is_time": validators.time, "is_latitude": validators.latitude, "is_longitude": validators.longitude, "is_email": validators.email, "is_url": validators.url,
}


def balanced(text: str) -> str:
    """The text with parentheses that lack a partner closed at the end or dropped."""
    out, depth = [], 0
    for ch in text:
        if ch == ")" and not depth:
            continue
        depth += (ch == "(") - (ch == ")")
        out.append(ch)
    return "".join(out) + ")" * depth


class _Compiler(ast.NodeVisitor):
    def __init__(self, names: dict[str, Value], sets: dict[str, list[str]], threshold: float, strict: bool):
        self.names, self.sets, self.threshold, self.strict = names, sets, threshold, strict
        self.ratios: list[Column] = []

    def generic_visit(self, node):
        raise RuleError(f"not allowed in a rule: {type(node).__name__}")

    def visit_Expression(self, node):
        return self.visit(node.body)

    def visit_Constant(self, node) -> Value:
        if isinstance(node.value, bool):
            return Value(F.lit(node.value), "bool")
        if isinstance(node.value, (int, float)):
            return Value(F.lit(float(node.value)), "number")
        if isinstance(node.value, str):
            return Value(F.lit(node.value), "text")
        raise RuleError("not allowed in a rule: this constant")

    def visit_Name(self, node) -> Value:
        if node.id in self.names:
            return self.names[node.id]
        if node.id in self.sets:
            return Value(F.array(*[F.lit(v) for v in self.sets[node.id]]).cast("array<string>"), "list")
        raise RuleError(f"unknown name: {node.id}")

    def visit_List(self, node) -> Value:
        return Value(F.array(*[self.text(self.visit(e)) for e in node.elts]).cast("array<string>"), "list")

    visit_Tuple = visit_Set = visit_List

    def truth(self, v: Value) -> Column:
        if v.kind == "bool":
            return F.coalesce(v.column, F.lit(False))
        if v.kind == "number":
            return F.coalesce(v.column != 0, F.lit(False))
        if v.kind == "list":
            return F.coalesce(F.size(v.column) > 0, F.lit(False))
        return F.coalesce(v.column != "", F.lit(False))

    def number(self, v: Value) -> Column:
        if v.kind == "number":
            return v.column
        if v.kind == "bool":
            return v.column.cast("int").cast("double")
        if v.kind == "list":
            raise RuleError("a list is no number")
        t = F.trim(v.column)
        return F.when(t.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\z"), t.try_cast("double"))

    def text(self, v: Value) -> Column:
        return v.column.cast("string")

    def visit_BoolOp(self, node) -> Value:
        parts = [self.truth(self.visit(v)) for v in node.values]
        out = parts[0]
        for p in parts[1:]:
            out = out & p if isinstance(node.op, ast.And) else out | p
        return Value(out, "bool")

    def visit_UnaryOp(self, node) -> Value:
        v = self.visit(node.operand)
        if isinstance(node.op, (ast.Not, ast.Invert)):
            return Value(~self.truth(v), "bool")
        if isinstance(node.op, ast.USub):
            return Value(-self.number(v), "number")
        return Value(self.number(v), "number")

    def visit_BinOp(self, node) -> Value:
        a, b = self.visit(node.left), self.visit(node.right)
        if isinstance(node.op, ast.BitAnd):
            return Value(self.truth(a) & self.truth(b), "bool")
        if isinstance(node.op, ast.BitOr):
            return Value(self.truth(a) | self.truth(b), "bool")
        x, y = self.number(a), self.number(b)
        by = {
            ast.Add: lambda: x + y, ast.Sub: lambda: x - y, ast.Mult: lambda: x * y, ast.Div: lambda: F.try_divide(x, y),
            ast.FloorDiv: lambda: F.floor(F.try_divide(x, y)).cast("double"), ast.Mod: lambda: x - y * F.floor(F.try_divide(x, y)),
        }.get(type(node.op))
        if by is None:
            raise RuleError("not allowed in a rule: this operator")
        return Value(by(), "number")

    def visit_Compare(self, node) -> Value:
        left, out = self.visit(node.left), None
        for op, right in zip(node.ops, map(self.visit, node.comparators)):
            test = self.member(left, right, isinstance(op, ast.NotIn)) if isinstance(op, (ast.In, ast.NotIn)) else self.compare(op, left, right)
            out = test if out is None else out & test
            left = right
        return Value(out, "bool")

    def compare(self, op, a: Value, b: Value) -> Column:
        if "list" in (a.kind, b.kind):
            if a.kind == b.kind and isinstance(op, (ast.Eq, ast.NotEq)):
                return (a.column == b.column) if isinstance(op, ast.Eq) else (a.column != b.column)
            raise RuleError("lists only compare with in")
        tests = {ast.Eq: "__eq__", ast.NotEq: "__ne__", ast.Lt: "__lt__", ast.LtE: "__le__", ast.Gt: "__gt__", ast.GtE: "__ge__"}
        name = tests.get(type(op))
        if name is None:
            raise RuleError("not allowed in a rule: this comparison")
        x, y, s, t = self.number(a), self.number(b), self.text(a), self.text(b)
        return F.coalesce(F.when(x.isNotNull() & y.isNotNull(), getattr(x, name)(y)).otherwise(getattr(s, name)(t)), F.lit(False))

    def member(self, a: Value, b: Value, negated: bool) -> Column:
        if b.kind == "list":
            items = a.column if a.kind == "list" else F.array(self.text(a))
            share = F.try_divide(F.size(F.filter(items, lambda x: F.array_contains(b.column, x))), F.size(items))
        elif b.kind == "text":
            if a.kind == "list":
                share = F.try_divide(F.size(F.filter(a.column, lambda x: F.contains(b.column, x))), F.size(a.column))
            else:
                share = F.contains(b.column, self.text(a)).cast("double")
        elif self.strict:
            share = F.lit(0.0)  # a membership in something that holds nothing never reaches the threshold
        else:
            raise RuleError("in needs a list or a text on its right side")
        share = F.coalesce(share.cast("double"), F.lit(0.0))
        self.ratios.append(share)
        return ~(share >= self.threshold) if negated else share >= self.threshold

    def visit_Call(self, node) -> Value:
        if node.keywords:
            raise RuleError("not allowed in a rule: named arguments")
        args = [self.visit(a) for a in node.args]
        if isinstance(node.func, ast.Attribute) and node.func.attr == "count" and len(args) == 1:
            return self.count(self.visit(node.func.value), args[0])
        if isinstance(node.func, ast.Name):
            name = node.func.id
            if name in ("len", "size", "count") and len(args) == 1:
                v = args[0]
                return Value((F.size(v.column) if v.kind == "list" else F.length(self.text(v))).cast("double"), "number")
            if name == "count" and len(args) == 2:
                return self.count(*args)
            if name in _FUNCTIONS and len(args) == 1:
                v = args[0]
                if v.kind == "list":
                    return Value(F.coalesce(F.try_divide(F.size(F.filter(v.column, _FUNCTIONS[name])), F.size(v.column)) >= self.threshold, F.lit(False)), "bool")
                return Value(_FUNCTIONS[name](self.text(v)), "bool")
        raise RuleError("not allowed in a rule: this call")

    def count(self, v: Value, what: Value) -> Value:
        if v.kind == "list":
            return Value(F.size(F.filter(v.column, lambda x: x == self.text(what))).cast("double"), "number")
        t, w = self.text(v), self.text(what)
        return Value(F.try_divide(F.length(t) - F.length(F.replace(t, w, F.lit(""))), F.length(w)), "number")


def compile_rule(text: str, names: dict[str, Value], sets: dict[str, list[str]] | None = None, threshold: float = THRESHOLD, strict: bool = True) -> Compiled:
    """The rule as a boolean Column (never null) with the ratios of its memberships.

    strict keeps the grammar in which & binds tighter than in and ==; else it is read as `and`.
    """
    text = balanced(text.strip())
    if not strict:
        text = text.replace("&", " and ").replace("|", " or ")
    try:
        tree = ast.parse(text, mode="eval")
    except SyntaxError as error:
        raise RuleError(str(error)) from error
    compiler = _Compiler(names, sets or {}, threshold, strict)
    holds = compiler.truth(compiler.visit(tree))
    return Compiled(holds, compiler.ratios)
