"""Typed expressions and their lowering to Spark columns.

An expression knows nothing of a table until it meets a Scope, which resolves
names and kinds. Lowering checks types first and then builds one Column, so
Catalyst sees ordinary built-in expressions.
"""

from __future__ import annotations

from collections.abc import Collection, Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.errors import AmbiguousNameError, PlanningError, UnsupportedError
from quern.functions import aggregates
from quern.functions.arithmetic import arithmetic, lenient_cast, unpushed, widened
from quern.types import FLOATS, SPARK_TYPES, Kind, common_numeric, require_numeric

COMPARISONS = {"=", "<>", "<", "<=", ">", ">="}
LOGICAL = {"AND", "OR"}
ARITHMETIC = {"+", "-", "*", "/"}
AGGREGATES = {"COUNT", "SUM", "AVG", "MIN", "MAX"}


class Expr:
    """Base of all expressions; operators build new ones."""

    def children(self) -> tuple[Expr, ...]:
        return ()

    @property
    def name(self) -> str:
        """The name of the output column."""
        return str(self)

    def bare(self) -> Expr:
        """The expression without its alias."""
        return self

    def walk(self) -> Iterator[Expr]:
        yield self
        for child in self.children():
            yield from child.walk()

    def has_aggregate(self) -> bool:
        return any(isinstance(x, Agg) for x in self.walk())

    def alias(self, name: str) -> Expr:
        return Named(self, name)

    def cast(self, kind: Kind) -> Expr:
        return CastTo(self, kind)

    def is_null(self) -> Expr:
        return NullTest(self, False)

    def is_not_null(self) -> Expr:
        return NullTest(self, True)

    def eq(self, other: object) -> Expr:
        return Binary(self, "=", as_expr(other))

    def ne(self, other: object) -> Expr:
        return Binary(self, "<>", as_expr(other))

    def __lt__(self, other: object) -> Expr:
        return Binary(self, "<", as_expr(other))

    def __le__(self, other: object) -> Expr:
        return Binary(self, "<=", as_expr(other))

    def __gt__(self, other: object) -> Expr:
        return Binary(self, ">", as_expr(other))

    def __ge__(self, other: object) -> Expr:
        return Binary(self, ">=", as_expr(other))

    def __and__(self, other: object) -> Expr:
        return Binary(self, "AND", as_expr(other))

    def __or__(self, other: object) -> Expr:
        return Binary(self, "OR", as_expr(other))

    def __add__(self, other: object) -> Expr:
        return Binary(self, "+", as_expr(other))

    def __sub__(self, other: object) -> Expr:
        return Binary(self, "-", as_expr(other))

    def __mul__(self, other: object) -> Expr:
        return Binary(self, "*", as_expr(other))

    def __truediv__(self, other: object) -> Expr:
        return Binary(self, "/", as_expr(other))


@dataclass(frozen=True)
class Col(Expr):
    """A column, by its name or qualifier.name."""

    path: str

    @property
    def name(self) -> str:
        return self.path.rpartition(".")[2]

    def __str__(self) -> str:
        return self.path


@dataclass(frozen=True)
class Lit(Expr):
    """NULL, a boolean, a 64-bit integer, a double or a string."""

    value: bool | int | float | str | None

    def kind(self) -> Kind:
        for python, kind in ((type(None), Kind.NULL), (bool, Kind.BOOLEAN), (int, Kind.INT64), (float, Kind.FLOAT64), (str, Kind.UTF8)):
            if isinstance(self.value, python):
                return kind
        raise UnsupportedError(f"literal {self.value!r}")

    def __str__(self) -> str:
        if isinstance(self.value, str):
            return "'" + self.value.replace("'", "''") + "'"
        return "NULL" if self.value is None else str(self.value).upper() if isinstance(self.value, bool) else str(self.value)


@dataclass(frozen=True)
class Named(Expr):
    expr: Expr
    label: str

    def children(self) -> tuple[Expr, ...]:
        return (self.expr,)

    @property
    def name(self) -> str:
        return self.label

    def bare(self) -> Expr:
        return self.expr.bare()

    def __str__(self) -> str:
        return f"{self.expr} AS {self.label}"


@dataclass(frozen=True)
class Binary(Expr):
    left: Expr
    op: str
    right: Expr

    def children(self) -> tuple[Expr, ...]:
        return self.left, self.right

    def __str__(self) -> str:
        return f"({self.left} {self.op} {self.right})"


@dataclass(frozen=True)
class NullTest(Expr):
    expr: Expr
    negated: bool

    def children(self) -> tuple[Expr, ...]:
        return (self.expr,)

    def __str__(self) -> str:
        return f"({self.expr} IS {'NOT ' * self.negated}NULL)"


@dataclass(frozen=True)
class CastTo(Expr):
    expr: Expr
    kind: Kind

    def children(self) -> tuple[Expr, ...]:
        return (self.expr,)

    def __str__(self) -> str:
        return f"CAST({self.expr} AS {self.kind.value})"


@dataclass(frozen=True)
class Star(Expr):
    def __str__(self) -> str:
        return "*"


@dataclass(frozen=True)
class Agg(Expr):
    function: str
    expr: Expr
    distinct: bool = False

    def children(self) -> tuple[Expr, ...]:
        return (self.expr,)

    def __str__(self) -> str:
        return f"{self.function}({'DISTINCT ' * self.distinct}{self.expr})"


def as_expr(value: object) -> Expr:
    return value if isinstance(value, Expr) else Lit(value)


def col(path: str) -> Col:
    return Col(path)


def lit(value: bool | int | float | str | None) -> Lit:
    return Lit(value)


def count_star() -> Agg:
    return Agg("COUNT", Star())


def agg(function: str, expr: Expr | str, distinct: bool = False) -> Agg:
    return Agg(function.upper(), Col(expr) if isinstance(expr, str) else expr, distinct)


@dataclass(frozen=True)
class Field:
    """A visible column: its qualifier (if any), its name, the DataFrame's own name for it, kind and Spark type."""

    qualifier: str | None
    name: str
    inner: str
    kind: Kind
    spark: T.DataType

    @property
    def path(self) -> str:
        return f"{self.qualifier}.{self.name}" if self.qualifier else self.name


@dataclass(frozen=True)
class Typed:
    column: Column
    kind: Kind
    spark: T.DataType


class Scope:
    """The columns that an expression may name."""

    def __init__(self, fields: Sequence[Field]) -> None:
        self.fields = list(fields)

    def find(self, path: str) -> Field:
        """Exact (case-sensitive) names win; otherwise the last part decides, unless both sides are qualified."""
        qualifier, _, name = path.rpartition(".")
        found = [f for f in self.fields if f.path == path]
        if not found and not (qualifier and any(f.qualifier for f in self.fields)):
            found = [f for f in self.fields if f.name == name]
        if len(found) > 1:
            raise AmbiguousNameError(f"more than one column is called {path}; say which table is meant")
        if not found:
            raise PlanningError(f"no column is called {path}")
        return found[0]

    def knows(self, expr: Expr) -> bool:
        """Whether every column of the expression is found here; one that fits several raises."""
        try:
            for x in expr.walk():
                if isinstance(x, Col):
                    self.find(x.path)
        except AmbiguousNameError:
            raise
        except PlanningError:
            return False
        return True

    def lower(self, expr: Expr) -> Typed:
        """A row expression as a Spark column with its kind."""
        match expr:
            case Named(inner, _):
                return self.lower(inner)
            case Col(path):
                field = self.find(path)
                return Typed(F.col(f"`{field.inner}`"), field.kind, field.spark)
            case Lit(value):
                kind = expr.kind()
                if kind is Kind.INT64 and not -(1 << 63) <= value < 1 << 63:
                    raise PlanningError(f"{value} does not fit in 64 bits")
                column = F.lit(value)
                return Typed(column if kind is Kind.NULL else column.cast(SPARK_TYPES[kind]), kind, SPARK_TYPES[kind])
            case NullTest(inner, negated):
                value = self.lower(inner).column
                return _of(value.isNotNull() if negated else value.isNull(), Kind.BOOLEAN)
            case CastTo(inner, kind):
                value = self.lower(inner)
                if value.kind is Kind.OTHER and kind is not Kind.UTF8:
                    raise UnsupportedError(f"CAST of {value.spark.simpleString()} to {kind.value}")
                return _of(lenient_cast(value.column, value.kind, kind), kind)
            case Binary(left, op, right):
                return self._binary(op, self.lower(left), self.lower(right))
            case Agg():
                raise UnsupportedError(f"aggregate {expr} is only allowed as an item of the SELECT list")
            case Star():
                raise PlanningError("* is only allowed as a SELECT item or in COUNT(*)")
        raise UnsupportedError(f"expression {expr}")

    def _binary(self, op: str, left: Typed, right: Typed) -> Typed:
        kinds = left.kind, right.kind
        if op in LOGICAL:
            if not set(kinds) <= {Kind.BOOLEAN, Kind.NULL}:
                raise PlanningError(f"{op} joins truth values, not {kinds[0].value} and {kinds[1].value}")
            a, b = (widened(x.column, Kind.BOOLEAN) for x in (left, right))
            return _of(a & b if op == "AND" else a | b, Kind.BOOLEAN)
        common = common_numeric(*kinds)
        if op in ARITHMETIC:
            if common is None:
                raise PlanningError(f"{op} can't be worked out for {kinds[0].value} and {kinds[1].value}")
            return _of(arithmetic(op, widened(left.column, common), widened(right.column, common), common), common)
        if op not in COMPARISONS:
            raise UnsupportedError(f"operator {op}")
        a, b = left.column, right.column
        if Kind.NULL in kinds:
            return _of(F.lit(None).cast("boolean"), Kind.BOOLEAN)
        if kinds[0] is kinds[1]:
            if kinds[0] is Kind.OTHER and left.spark != right.spark:
                raise PlanningError(f"{left.spark.simpleString()} and {right.spark.simpleString()} can't be compared")
        elif common is None:
            raise PlanningError(f"{kinds[0].value} and {kinds[1].value} can't be compared")
        else:
            a, b = widened(a, common), widened(b, common)
        # a side of which NaN can make the comparison true
        if kinds[0] in FLOATS and op in (">", ">=", "<>"):
            a = unpushed(a)
        if kinds[1] in FLOATS and op in ("<", "<=", "<>"):
            b = unpushed(b)
        return _of({"=": a == b, "<>": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op], Kind.BOOLEAN)

    def lower_aggregate(self, expr: Expr, summed: Collection[Expr] = ()) -> Typed:
        """An aggregate, by itself or under an alias; ``summed``: arguments of the query's SUM and AVG over distinct values."""
        found = expr.bare()
        if not isinstance(found, Agg):
            raise UnsupportedError(f"an aggregate must stand alone as an item, unlike in {expr}")
        if found.function not in AGGREGATES:
            raise UnsupportedError(f"function {found.function}")
        if isinstance(found.expr, Star):
            if found.function != "COUNT":
                raise PlanningError(f"{found.function}(*) has no meaning")
            if found.distinct:
                raise UnsupportedError("COUNT(DISTINCT *)")
            return _of(aggregates.count_rows(), Kind.INT64)
        value = self.lower(found.expr)
        if found.function == "COUNT":
            return _of(aggregates.count(value.column, value.kind, found.distinct, found.expr in summed), Kind.INT64)
        if found.function in ("MIN", "MAX"):
            column = aggregates.smallest(value.column) if found.function == "MIN" else aggregates.largest(value.column)
            return Typed(column, value.kind, value.spark)
        require_numeric(found.function, value.kind)
        build = aggregates.total if found.function == "SUM" else aggregates.mean
        return _of(build(value.column, value.kind, found.distinct), Kind.FLOAT64)


def _of(column: Column, kind: Kind) -> Typed:
    return Typed(column, kind, SPARK_TYPES[kind])
