"""Arithmetic and casts with the engine's semantics, as Spark columns (all stay in generated code)."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.types import FLOATS, SPARK_TYPES, UNSIGNED, Kind

UINT32_MAX = (1 << 32) - 1
UINT64_MAX = (1 << 64) - 1


def widened(column: Column, kind: Kind) -> Column:
    """The column in the Spark type that stands for ``kind``."""
    return column.cast(SPARK_TYPES[kind])


def unpushed(column: Column) -> Column:
    """The same float in a form that no scan takes as a filter.

    Parquet's statistics leave NaN out, so a scan that goes by them skips row
    groups whose NaN, the largest value, would pass.
    """
    return column + F.lit(0.0).cast("float")


def ieee_divide(n: Column, d: Column) -> Column:
    """Division of doubles that gives infinities and NaN where the divisor is zero, also under ANSI rules."""
    by_zero = F.when((n == 0) | F.isnan(n), float("nan")).when(n > 0, float("inf")).otherwise(float("-inf"))
    return F.when(n.isNull() | d.isNull(), None).when(d != 0, n / F.when(d != 0, d)).otherwise(by_zero)


def integer_divide(n: Column, d: Column) -> Column:
    """Division of bigints that truncates towards zero; division by zero is an error."""
    return F.call_function("div", n, d)


def _checked_unsigned(value: Column) -> Column:
    wide = SPARK_TYPES[Kind.UINT64]
    return F.when((value >= 0) & (value <= F.lit(Decimal(UINT64_MAX)).cast(wide)), value.cast(wide)).when(value.isNotNull(), F.raise_error(F.lit("unsigned integer overflow")).cast(wide))


def arithmetic(op: str, left: Column, right: Column, kind: Kind) -> Column:
    """left op right, both already of ``kind`` (bigint, unsigned 64-bit or double)."""
    if op == "/":
        if kind in FLOATS:
            return ieee_divide(left, right)
        if kind is Kind.INT64:
            return integer_divide(left, right)
        return _checked_unsigned(((left - left % right) / right).cast("decimal(38,0)"))
    value = {"+": left + right, "-": left - right, "*": left * right}[op]
    return _checked_unsigned(value) if kind in UNSIGNED else value


def lenient_cast(column: Column, source: Kind, target: Kind) -> Column:
    """A cast that gives NULL where the value has no counterpart; fractions are cut towards zero."""
    spark = SPARK_TYPES[target]
    if target not in UNSIGNED:
        return column.cast(spark) if source is Kind.NULL else column.try_cast(spark)
    if source is Kind.NULL:
        return column.cast(spark)
    if source in FLOATS:
        column = F.when(column < 0, F.ceil(column.try_cast("decimal(38,6)"))).otherwise(F.floor(column.try_cast("decimal(38,6)")))
    whole = column.cast("int").cast("decimal(20,0)") if source is Kind.BOOLEAN else column.try_cast("decimal(20,0)")
    if source is Kind.UTF8:  # digits only, as for any integer
        whole = F.when(column.rlike(r"^\s*\+?[0-9]+\s*$"), whole)
    most = F.lit(Decimal(UINT32_MAX if target is Kind.UINT32 else UINT64_MAX)).cast("decimal(20,0)")
    return F.when((whole >= 0) & (whole <= most), whole.cast(spark))
