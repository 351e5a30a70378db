"""The seven relational operators over DataFrames, with checked names and types."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.errors import PlanningError, UnsupportedError
from quern.expr import Agg, Col, Expr, Field, Scope, Star, Typed, as_expr
from quern.types import UNSIGNED, UNSIGNED_MARK, Kind, kind_of


@dataclass(frozen=True)
class SortKey:
    """NULLs come last in ascending and first in descending order, unless said otherwise."""

    expr: Expr
    ascending: bool = True
    nulls_first: bool | None = None

    def __str__(self) -> str:
        first = not self.ascending if self.nulls_first is None else self.nulls_first
        return f"{self.expr} {'ASC' if self.ascending else 'DESC'} NULLS {'FIRST' if first else 'LAST'}"


class Relation:
    """A DataFrame with named, typed columns. Every operator gives a new one; nothing runs.

    The DataFrame's own column names are positions, so equal names from two
    tables never clash before the result is handed out.
    """

    def __init__(self, frame: DataFrame, fields: Sequence[Field], text: str, inputs: Sequence[Relation] = ()) -> None:
        self.frame, self.scope = frame, Scope(fields)
        self._text, self._inputs = text, tuple(inputs)

    @property
    def fields(self) -> list[Field]:
        return self.scope.fields

    @property
    def columns(self) -> list[str]:
        """Names of the result's columns; a name taken already becomes ``right.<name>``."""
        names: list[str] = []
        for field in self.fields:
            name = field.name
            while name in names:
                name = f"right.{name}"
            names.append(name)
        return names

    def to_df(self) -> DataFrame:
        """The result as an ordinary DataFrame."""
        return self.frame.select(*(self._out(f, name) for f, name in zip(self.fields, self.columns, strict=True)))

    @staticmethod
    def _out(field: Field, name: str):
        marked = {"metadata": {UNSIGNED_MARK: True}} if field.kind in UNSIGNED else {}
        return F.col(f"`{field.inner}`").alias(name, **marked)

    def explain(self, indent: int = 0) -> str:
        """The operators as written, one a line, inputs below."""
        return "\n".join(["  " * indent + self._text, *(x.explain(indent + 1) for x in self._inputs)])

    @classmethod
    def scan(cls, frame: DataFrame, table: str, qualifier: str | None = None) -> Relation:
        """A table; its columns can be named with or without the qualifier."""
        label = qualifier or table
        fields = [Field(label, f.name, f"c{i}", kind_of(f), f.dataType) for i, f in enumerate(frame.schema.fields)]
        return cls(frame.toDF(*(f.inner for f in fields)), fields, f"Scan: {table}" + (f" AS {label}" if label != table else ""))

    def _made(self, items: Sequence[tuple[str, Typed]]) -> list[Field]:
        return [Field(None, name, f"c{i}", x.kind, x.spark) for i, (name, x) in enumerate(items)]

    def project(self, *exprs: Expr | str) -> Relation:
        items: list[tuple[str, Typed]] = []
        for expr in (Col(e) if isinstance(e, str) and e != "*" else Star() if e == "*" else e for e in exprs):
            if isinstance(expr.bare(), Star):
                items += [(name, Typed(F.col(f"`{f.inner}`"), f.kind, f.spark)) for f, name in zip(self.fields, self.columns, strict=True)]
            else:
                items.append((expr.name, self.scope.lower(expr)))
        if not items:
            raise PlanningError("a projection needs at least one expression")
        fields = self._made(items)
        frame = self.frame.select(*(x.column.alias(f.inner) for f, (_, x) in zip(fields, items, strict=True)))
        return Relation(frame, fields, "Select: " + ", ".join(map(str, exprs)), [self])

    def filter(self, predicate: Expr) -> Relation:
        """Rows for which the predicate is true; NULL is not."""
        found = self.scope.lower(predicate)
        if found.kind is not Kind.BOOLEAN:
            raise PlanningError(f"a filter needs a truth value, not {found.kind.value}")
        return Relation(self.frame.filter(found.column), self.fields, f"Filter: {predicate}", [self])

    def aggregate(self, keys: Sequence[Expr | str], aggregates: Sequence[Expr]) -> Relation:
        """Groups by any expressions, NULL being a group; without keys one row, also over no rows.

        Without aggregates it gives the distinct keys.
        """
        keys = [Col(k) if isinstance(k, str) else k for k in keys]
        if not keys and not aggregates:
            raise PlanningError("an aggregation needs keys or aggregates")
        lowered = [(k.name, self.scope.lower(k)) for k in keys]
        found = [a.bare() for a in aggregates]
        summed = [a.expr for a in found if isinstance(a, Agg) and a.distinct and a.function in ("SUM", "AVG")]
        measures = [(a.name, self.scope.lower_aggregate(a, summed)) for a in aggregates]
        fields = self._made([*lowered, *measures])
        # keys become columns first: then each is computed once and any type can be grouped on
        made = [f"k{i}" for i in range(len(keys))]
        sources = self.frame.withColumns({name: x.column for name, (_, x) in zip(made, lowered, strict=True)}) if made else self.frame
        if measures:
            frame = sources.groupBy(*made).agg(*(x.column.alias(f.inner) for f, (_, x) in zip(fields[len(keys) :], measures, strict=True)))
        else:
            frame = sources.select(*made).distinct()
        frame = frame.select(*(F.col(m).alias(f.inner) for m, f in zip(made, fields, strict=False)), *(F.col(f.inner) for f in fields[len(keys) :]))
        text = f"Group by ({', '.join(map(str, keys))}) computing ({', '.join(map(str, aggregates))})"
        return Relation(frame, fields, text, [self])

    def sort(self, *keys: SortKey | Expr | str) -> Relation:
        keys = [k if isinstance(k, SortKey) else SortKey(Col(k) if isinstance(k, str) else k) for k in keys]
        if not keys:
            raise PlanningError("a sort needs at least one key")
        order = []
        for key in keys:
            column = self.scope.lower(key.expr).column
            first = not key.ascending if key.nulls_first is None else key.nulls_first
            if key.ascending:
                order.append(column.asc_nulls_first() if first else column.asc_nulls_last())
            else:
                order.append(column.desc_nulls_first() if first else column.desc_nulls_last())
        return Relation(self.frame.orderBy(*order), self.fields, "Sort: " + ", ".join(map(str, keys)), [self])

    def limit(self, rows: int) -> Relation:
        if isinstance(rows, bool) or not isinstance(rows, int) or rows < 0:
            raise PlanningError("a limit is a whole number from 0 on")
        if rows >= 1 << 31:  # Spark counts a limit in 32 bits
            raise UnsupportedError(f"a limit of {rows} rows")
        return Relation(self.frame.limit(rows), self.fields, f"Limit: {rows}", [self])

    def join(self, right: Relation, how: str, left_on: Sequence[Expr | str], right_on: Sequence[Expr | str]) -> Relation:
        """Inner or left equi-join on one or more key pairs of identical kinds; NULL keys never match."""
        if how not in ("inner", "left"):
            raise UnsupportedError(f"{how} join")
        if not left_on or len(left_on) != len(right_on):
            raise PlanningError("a join needs at least one pair of keys")
        left_keys, right_keys = ([Col(k) if isinstance(k, str) else as_expr(k) for k in side] for side in (left_on, right_on))
        n = len(self.fields)
        moved = [Field(f.qualifier, f.name, f"c{n + i}", f.kind, f.spark) for i, f in enumerate(right.fields)]
        left_frame = self.frame
        right_frame = right.frame.select(*(F.col(f"`{a.inner}`").alias(b.inner) for a, b in zip(right.fields, moved, strict=True)))
        right_scope, conditions = Scope(moved), []
        for a, b in zip(left_keys, right_keys, strict=True):
            x, y = self.scope.lower(a), right_scope.lower(b)
            if x.kind is not y.kind or (x.kind is Kind.OTHER and x.spark != y.spark):
                raise PlanningError(f"join keys {a} and {b} differ in type: {x.kind.value} and {y.kind.value}")
            conditions.append(x.column == y.column)
        taken = {f.path for f in self.fields}
        named = [Field(None, f"right.{f.name}", f.inner, f.kind, f.spark) if f.path in taken else f for f in moved]
        frame = left_frame.join(right_frame, reduce(lambda p, q: p & q, conditions), how)
        pairs = ", ".join(f"{a} = {b}" for a, b in zip(left_keys, right_keys, strict=True))
        return Relation(frame, [*self.fields, *named], f"{how.capitalize()} join: {pairs}", [self, right])

    def exchange(self, partitions: int, *keys: Expr | str) -> Relation:
        """Rows placed by a hash of the keys in so many partitions (some may be empty); equal keys, NULL included, meet in one."""
        if partitions < 1 or not keys:
            raise PlanningError("an exchange needs keys and at least one partition")
        columns = [self.scope.lower(Col(k) if isinstance(k, str) else k).column for k in keys]
        text = f"Hash exchange: {partitions} by {', '.join(map(str, keys))}"
        return Relation(self.frame.repartition(partitions, *columns), self.fields, text, [self])
