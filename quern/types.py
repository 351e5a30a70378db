"""The engine's value kinds and their coercion rules, on top of Spark's types."""

from __future__ import annotations

from enum import Enum

from pyspark.sql import types as T

from quern.errors import PlanningError, UnsupportedError


class Kind(Enum):
    """What a value is to the type rules. Unsigned integers live in wider Spark types."""

    NULL = "Null"
    BOOLEAN = "Boolean"
    INT32 = "Int32"
    INT64 = "Int64"
    UINT32 = "UInt32"
    UINT64 = "UInt64"
    FLOAT32 = "Float32"
    FLOAT64 = "Float64"
    UTF8 = "Utf8"
    OTHER = "Other"  # dates, decimals, nested types and so on: Spark's own rules


SIGNED = {Kind.INT32, Kind.INT64}
UNSIGNED = {Kind.UINT32, Kind.UINT64}
FLOATS = {Kind.FLOAT32, Kind.FLOAT64}
NUMERIC = SIGNED | UNSIGNED | FLOATS

#: Key under which a column's metadata says that it is unsigned.
UNSIGNED_MARK = "quern.unsigned"

SPARK_TYPES: dict[Kind, T.DataType] = {
    Kind.NULL: T.NullType(),
    Kind.BOOLEAN: T.BooleanType(),
    Kind.INT32: T.IntegerType(),
    Kind.INT64: T.LongType(),
    Kind.UINT32: T.LongType(),
    Kind.UINT64: T.DecimalType(20, 0),
    Kind.FLOAT32: T.FloatType(),
    Kind.FLOAT64: T.DoubleType(),
    Kind.UTF8: T.StringType(),
}

# The accepted spellings of CAST targets.
CAST_TARGETS: dict[str, Kind] = {
    "BOOLEAN": Kind.BOOLEAN, "BOOL": Kind.BOOLEAN,
    "TINYINT": Kind.INT32, "SMALLINT": Kind.INT32, "MEDIUMINT": Kind.INT32, "INT2": Kind.INT32, "INT": Kind.INT32,
    "INT4": Kind.INT32, "INTEGER": Kind.INT32, "INT16": Kind.INT32, "INT32": Kind.INT32,
    "BIGINT": Kind.INT64, "INT8": Kind.INT64, "INT64": Kind.INT64, "SIGNED": Kind.INT64, "SIGNED INTEGER": Kind.INT64,
    "TINYINT UNSIGNED": Kind.UINT32, "SMALLINT UNSIGNED": Kind.UINT32, "MEDIUMINT UNSIGNED": Kind.UINT32,
    "INT2 UNSIGNED": Kind.UINT32, "INT UNSIGNED": Kind.UINT32, "INT4 UNSIGNED": Kind.UINT32, "INTEGER UNSIGNED": Kind.UINT32,
    "UTINYINT": Kind.UINT32, "USMALLINT": Kind.UINT32, "UINT8": Kind.UINT32, "UINT16": Kind.UINT32, "UINT32": Kind.UINT32,
    "BIGINT UNSIGNED": Kind.UINT64, "INT8 UNSIGNED": Kind.UINT64, "UBIGINT": Kind.UINT64, "UINT64": Kind.UINT64,
    "UNSIGNED": Kind.UINT64, "UNSIGNED INTEGER": Kind.UINT64,
    "FLOAT4": Kind.FLOAT32, "FLOAT32": Kind.FLOAT32, "REAL": Kind.FLOAT32,
    "FLOAT": Kind.FLOAT64, "FLOAT8": Kind.FLOAT64, "FLOAT64": Kind.FLOAT64, "DOUBLE": Kind.FLOAT64, "DOUBLE PRECISION": Kind.FLOAT64,
    "CHAR": Kind.UTF8, "CHARACTER": Kind.UTF8, "CHAR VARYING": Kind.UTF8, "CHARACTER VARYING": Kind.UTF8, "VARCHAR": Kind.UTF8,
    "NVARCHAR": Kind.UTF8, "TEXT": Kind.UTF8, "STRING": Kind.UTF8,
}


def cast_target(spelling: str) -> Kind:
    try:
        return CAST_TARGETS[" ".join(spelling.upper().split())]
    except KeyError:
        raise UnsupportedError(f"casting to {spelling}") from None


def kind_of(field: T.StructField) -> Kind:
    """The kind of a column, by its Spark type and metadata."""
    kind = field.dataType
    if field.metadata.get(UNSIGNED_MARK):
        return Kind.UINT32 if isinstance(kind, T.LongType) else Kind.UINT64
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType)):
        return Kind.INT32
    if isinstance(kind, (T.CharType, T.VarcharType)):
        return Kind.UTF8
    for known, spark in SPARK_TYPES.items():
        if type(kind) is type(spark) and known not in UNSIGNED:
            return known
    return Kind.OTHER


def common_numeric(left: Kind, right: Kind) -> Kind | None:
    """The kind in which two numbers are computed and compared; None where they don't mix."""
    if left is Kind.NULL and right is Kind.NULL:
        return None
    if left is Kind.NULL:
        left = right
    if right is Kind.NULL:
        right = left
    if not {left, right} <= NUMERIC:
        return None
    if {left, right} & FLOATS:
        return Kind.FLOAT64
    if {left, right} <= SIGNED:
        return Kind.INT64
    if {left, right} <= UNSIGNED:
        return Kind.UINT64
    return None


def require_numeric(what: str, kind: Kind) -> None:
    if kind not in NUMERIC:
        raise PlanningError(f"{what} is for numbers, not {kind.value}")
