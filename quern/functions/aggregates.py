"""The five aggregates with the engine's result types."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.types import FLOATS, NUMERIC, Kind


def _exact(column: Column, kind: Kind) -> Column:
    """Integers are summed as decimals, so that sums neither overflow nor lose digits before the end."""
    return column.cast("double") if kind in FLOATS else column.cast("decimal(20,0)")


def count_rows() -> Column:
    return F.count(F.lit(1))


def count(column: Column, kind: Kind, distinct: bool, summed: bool = False) -> Column:
    """``summed``: the distinct values are summed too; one common expression for both keeps Spark from expanding every row."""
    if not distinct:
        return F.count(column)
    return F.count_distinct(_exact(column, kind) if summed and kind in NUMERIC else column)


#: Integers are summed in parts of so many bits, so that sums of longs stay exact for 2^41 rows of a group
#: (with more, a part may overflow, which is an error and never a wrong sum).
PART_BITS = 22


def _total_in_parts(column: Column) -> Column:
    """The exact sum of bigints from three sums of longs, which cost less than one of decimals; put together once a group."""
    mask = (1 << PART_BITS) - 1
    parts = [column.bitwiseAND(F.lit(mask)), F.shiftright(column, PART_BITS).bitwiseAND(F.lit(mask)), F.shiftright(column, 2 * PART_BITS)]
    low, middle, high = (F.sum(p).cast("decimal(20,0)") for p in parts)
    return low + middle * F.lit(Decimal(1 << PART_BITS)) + high * F.lit(Decimal(1 << 2 * PART_BITS))


def total(column: Column, kind: Kind, distinct: bool) -> Column:
    """A double whatever is summed; NULL where there is no value."""
    if kind in (Kind.INT32, Kind.INT64, Kind.UINT32) and not distinct:
        return _total_in_parts(column.cast("bigint")).cast("double")
    values = _exact(column, kind)
    return (F.sum_distinct(values) if distinct else F.sum(values)).cast("double")


def mean(column: Column, kind: Kind, distinct: bool) -> Column:
    if not distinct:
        return F.avg(column.cast("double"))
    n = count(column, kind, True, summed=True)
    return F.when(n > 0, total(column, kind, True) / F.when(n > 0, n))


def smallest(column: Column) -> Column:
    return F.min(column)


def largest(column: Column) -> Column:
    return F.max(column)
