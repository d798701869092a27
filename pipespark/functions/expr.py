"""The expression language of filters and projections: text -> tree -> Spark column.

Grammar, loosest first: OR, AND, NOT, comparison or IS [NOT] NULL, + and -, * and /, sign, atom.  AND binds tighter
than OR, operators of one level group to the left, parentheses group.  Comparison is ``= == != <> < <= > >=``; words
may be in either case, and ``&&``, ``||`` and ``!`` stand for AND, OR and NOT.  Literals are whole numbers, decimals
(double), quoted text (a doubled quote stands for itself), true, false and null; a name may be put in backticks.

Columns are typed by the input's schema: whole number by whole number divides to a whole number, text plus text joins.
A comparison with null is null, and null isn't kept by a filter.  In ``compat`` mode comparisons never give null: null is
equal to null and smaller than everything else.
"""

from __future__ import annotations

import dataclasses
import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ExpressionError, missing_column
from .types import FLOATS, INTEGERS, is_number


@dataclasses.dataclass(frozen=True)
class Name:
    name: str


@dataclasses.dataclass(frozen=True)
class Literal:
    value: object


@dataclasses.dataclass(frozen=True)
class Binary:
    op: str
    left: Expr
    right: Expr


@dataclasses.dataclass(frozen=True)
class Unary:
    op: str  # NOT, NEG, IS NULL, IS NOT NULL
    of: Expr


Expr = Name | Literal | Binary | Unary

_TOKEN = re.compile(
    r"""\s*(?:
    (?P<number>(?:\d+\.\d*|\.\d+|\d+)(?:[eE][+-]?\d+)?)
  | (?P<text>'(?:[^']|'')*'|"(?:[^"]|"")*")
  | (?P<tick>`[^`]+`)
  | (?P<op>==|!=|<>|<=|>=|&&|\|\||[=<>+\-*/()!])
  | (?P<word>[^\W\d][\w.]*)
    )""",
    re.VERBOSE,
)
_WORDS = {"and": "AND", "or": "OR", "not": "NOT", "is": "IS", "null": "NULL", "true": "TRUE", "false": "FALSE", "isnull": "ISNULL", "isnotnull": "ISNOTNULL"}
_SAME = {"=": "==", "<>": "!=", "&&": "AND", "||": "OR", "!": "NOT"}
COMPARISONS = ("==", "!=", "<", "<=", ">", ">=")


def _tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while text[at:].strip():
        m = _TOKEN.match(text, at)
        if not m:
            raise ExpressionError(f"can't read '{text[at:].strip()[:20]}' in '{text}'", hints=["quote text with ' or \""])
        kind, got = m.lastgroup, m[m.lastgroup]
        if kind == "word" and got.lower() in _WORDS:
            kind, got = "op", _WORDS[got.lower()]
        out.append((kind, _SAME.get(got, got) if kind == "op" else got))
        at = m.end()
    return out


class _Parser:
    def __init__(self, text: str):
        self.text, self.tokens, self.at = text, _tokens(text), 0

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def take(self, *ops: str) -> str | None:
        kind, got = self.peek()
        if kind == "op" and got in ops:
            self.at += 1
            return got
        return None

    def fail(self, what: str) -> ExpressionError:
        return ExpressionError(f"expected {what} before '{self.peek()[1] or 'the end'}' in '{self.text}'")

    def chain(self, below, *ops: str) -> Expr:
        left = below()
        while op := self.take(*ops):
            left = Binary(op, left, below())
        return left

    def either(self) -> Expr:
        return self.chain(self.both, "OR")

    def both(self) -> Expr:
        return self.chain(self.negated, "AND")

    def negated(self) -> Expr:
        return Unary("NOT", self.negated()) if self.take("NOT") else self.compared()

    def compared(self) -> Expr:
        left = self.added()
        while True:
            if op := self.take(*COMPARISONS):
                left = Binary(op, left, self.added())
            elif self.take("IS"):
                no = self.take("NOT")
                if not self.take("NULL"):
                    raise self.fail("NULL")
                left = Unary("IS NOT NULL" if no else "IS NULL", left)
            elif op := self.take("ISNULL", "ISNOTNULL"):
                left = Unary("IS NULL" if op == "ISNULL" else "IS NOT NULL", left)
            else:
                return left

    def added(self) -> Expr:
        return self.chain(self.multiplied, "+", "-")

    def multiplied(self) -> Expr:
        return self.chain(self.signed, "*", "/")

    def signed(self) -> Expr:
        if self.take("-"):
            of = self.signed()
            return Literal(-of.value) if isinstance(of, Literal) and isinstance(of.value, (int, float)) and not isinstance(of.value, bool) else Unary("NEG", of)
        return self.signed() if self.take("+") else self.atom()

    def atom(self) -> Expr:
        if self.take("("):
            inner = self.either()
            if not self.take(")"):
                raise self.fail("')'")
            return inner
        if op := self.take("TRUE", "FALSE", "NULL"):
            return Literal({"TRUE": True, "FALSE": False, "NULL": None}[op])
        kind, got = self.peek()
        if kind in ("end", "op"):
            raise self.fail("a value")
        self.at += 1
        if kind == "number":
            return Literal(int(got) if got.isdigit() else float(got))
        if kind == "text":
            return Literal(got[1:-1].replace(got[0] * 2, got[0]))
        return Name(got.strip("`"))


def parse(text: str) -> Expr:
    p = _Parser(text)
    tree = p.either()
    if p.at < len(p.tokens):
        raise p.fail("an operator")
    return tree


def columns_of(tree: Expr) -> set[str]:
    if isinstance(tree, Name):
        return {tree.name}
    if isinstance(tree, Binary):
        return columns_of(tree.left) | columns_of(tree.right)
    return columns_of(tree.of) if isinstance(tree, Unary) else set()


def _field(schema: T.StructType, name: str) -> T.StructField:
    found = next((f for f in schema.fields if f.name == name), None)
    if found is None:
        raise missing_column(name, schema.names)
    return found


def type_of(tree: Expr, schema: T.StructType) -> T.DataType:
    if isinstance(tree, Name):
        return _field(schema, tree.name).dataType
    if isinstance(tree, Literal):
        kinds = {bool: T.BooleanType(), float: T.DoubleType(), str: T.StringType(), type(None): T.NullType()}
        if type(tree.value) is int:
            return T.IntegerType() if -(2**31) <= tree.value < 2**31 else T.LongType()
        return kinds[type(tree.value)]
    if isinstance(tree, Unary):
        return type_of(tree.of, schema) if tree.op == "NEG" else T.BooleanType()
    if tree.op not in "+-*/":
        return T.BooleanType()
    left, right = type_of(tree.left, schema), type_of(tree.right, schema)
    if tree.op == "+" and isinstance(left, T.StringType) and isinstance(right, T.StringType):
        return left
    known = [t for t in (left, right) if not isinstance(t, T.NullType)]
    for t in known:
        if not is_number(t):
            raise ExpressionError(f"'{tree.op}' needs numbers, not {t.simpleString()}", hints=["text + text joins; other mixtures have no meaning"])
    if any(isinstance(t, T.DecimalType) for t in known) and not any(isinstance(t, FLOATS) for t in known):
        return next(t for t in known if isinstance(t, T.DecimalType))
    if any(isinstance(t, FLOATS) for t in known):
        return T.FloatType() if all(isinstance(t, T.FloatType) for t in known) else T.DoubleType()
    return T.LongType() if any(isinstance(t, T.LongType) for t in known) else T.IntegerType()


def _truth(tree: Expr, schema: T.StructType, compat: bool) -> Column:
    """A value as a condition: numbers other than zero and texts that aren't empty hold."""
    c, t = to_column(tree, schema, compat), type_of(tree, schema)
    if isinstance(t, T.NullType):
        c = F.lit(None).cast("boolean")
    elif is_number(t):
        c = c != F.lit(0)
    elif isinstance(t, (T.StringType, T.BinaryType)):
        c = F.length(c) > 0
    return F.coalesce(c, F.lit(False)) if compat else c


def _compare(op: str, a: Column, b: Column, compat: bool) -> Column:
    plain = {"==": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]
    if not compat:
        return plain
    same = a.eqNullSafe(b)
    if op in ("==", "!="):
        return same if op == "==" else ~same
    less, more = a.isNull() & b.isNotNull(), a.isNotNull() & b.isNull()
    return F.coalesce(plain, {"<": less, ">": more, "<=": less | same, ">=": more | same}[op])


def to_column(tree: Expr, schema: T.StructType, compat: bool = False) -> Column:
    if isinstance(tree, Name):
        _field(schema, tree.name)
        return F.col(f"`{tree.name}`")
    if isinstance(tree, Literal):
        return F.lit(tree.value)
    if isinstance(tree, Unary):
        if tree.op == "NOT":
            return ~_truth(tree.of, schema, compat)
        of = to_column(tree.of, schema, compat)
        if tree.op == "NEG":
            type_of(Binary("-", Literal(0), tree.of), schema)  # numbers only
            return -of
        return of.isNull() if tree.op == "IS NULL" else of.isNotNull()
    if tree.op in ("AND", "OR"):
        a, b = _truth(tree.left, schema, compat), _truth(tree.right, schema, compat)
        return a & b if tree.op == "AND" else a | b
    a, b = to_column(tree.left, schema, compat), to_column(tree.right, schema, compat)
    if tree.op in COMPARISONS:
        kinds = type_of(tree.left, schema), type_of(tree.right, schema)
        if is_number(kinds[0]) != is_number(kinds[1]) and not any(isinstance(t, T.NullType) for t in kinds):
            raise ExpressionError(f"can't compare {kinds[0].simpleString()} with {kinds[1].simpleString()}", hints=["put text in quotes, numbers without"])
        return _compare(tree.op, a, b, compat)
    out = type_of(tree, schema)
    if isinstance(out, T.StringType):
        return F.concat(a, b)
    if tree.op == "/" and isinstance(out, INTEGERS):
        # Spark's `div` truncates, and raises for zero as `/` does.
        return F.call_function("div", a.cast("bigint"), b.cast("bigint")).cast(out)
    return {"+": a + b, "-": a - b, "*": a * b, "/": a / b}[tree.op].cast(out) if isinstance(out, (*INTEGERS, *FLOATS)) else {"+": a + b, "-": a - b, "*": a * b, "/": a / b}[tree.op]


def condition(text: str, schema: T.StructType, compat: bool = False) -> Column:
    """A filter's text as a boolean column."""
    return _truth(parse(text), schema, compat)


def value(text: str, schema: T.StructType, compat: bool = False) -> Column:
    return to_column(parse(text), schema, compat)
