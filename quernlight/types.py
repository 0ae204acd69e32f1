"""Value types: names in SQL, Spark's types, and inference from Python values."""

from __future__ import annotations

import datetime
from collections.abc import Iterable
from decimal import Decimal

from pyspark.sql import types as T

#: Type names of the dialect and the type that each means; unknown names mean text.
NAMES = {
    "BOOLEAN": "boolean",
    "BOOL": "boolean",
    "INT32": "int",
    "INT": "int",
    "INTEGER": "int",
    "INT64": "bigint",
    "BIGINT": "bigint",
    "LONG": "bigint",
    "FLOAT64": "double",
    "FLOAT": "double",
    "DOUBLE": "double",
    "REAL": "double",
    "DECIMAL": "decimal",
    "NUMERIC": "decimal",
    "VARCHAR": "string",
    "TEXT": "string",
    "CHAR": "string",
    "STRING": "string",
    "DATE": "date",
    "TIMESTAMP": "timestamp",
    "DATETIME": "timestamp",
}
#: Decimals have two digits after the point, whatever a declaration says.
DECIMAL = T.DecimalType(18, 2)
SPARK = {"boolean": T.BooleanType(), "int": T.IntegerType(), "bigint": T.LongType(), "double": T.DoubleType(), "decimal": DECIMAL, "string": T.StringType(), "date": T.DateType(), "timestamp": T.TimestampNTZType()}
NUMERIC = ("int", "bigint", "decimal", "double")  # from narrow to wide
TEMPORAL = ("date", "timestamp")


def named(name: str) -> str:
    return NAMES.get(name.split("(")[0].strip().upper(), "string")


def of_spark(kind: T.DataType) -> str:
    """The dialect's type of a Spark type; "other" for those that it lacks."""
    if isinstance(kind, T.DecimalType):
        return "decimal"
    for spark_type, name in (
        ((T.BooleanType,), "boolean"),
        ((T.ByteType, T.ShortType, T.IntegerType), "int"),
        ((T.LongType,), "bigint"),
        ((T.FloatType, T.DoubleType), "double"),
        ((T.StringType, T.CharType, T.VarcharType), "string"),
        ((T.DateType,), "date"),
        ((T.TimestampType, T.TimestampNTZType), "timestamp"),
        ((T.NullType,), "null"),
    ):
        if isinstance(kind, spark_type):
            return name
    return "other"


def group(kind: str) -> str:
    """Types of one group compare and combine without a CAST."""
    return "number" if kind in NUMERIC else "time" if kind in TEMPORAL else kind


def wider(a: str, b: str) -> str:
    if a in NUMERIC and b in NUMERIC:
        return NUMERIC[max(NUMERIC.index(a), NUMERIC.index(b))]
    return a if b == "null" or a == b else b if a == "null" else "timestamp" if group(a) == group(b) == "time" else "string"


def of_value(value: object) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, int):
        return "int" if -(2**31) <= value < 2**31 else "bigint"
    for kinds, name in (((float,), "double"), ((Decimal,), "decimal"), ((datetime.datetime,), "timestamp"), ((datetime.date,), "date")):
        if isinstance(value, kinds):
            return name
    return "string"


def of_values(values: Iterable[object]) -> str:
    """The widest type of all values: numbers widen, mixtures and nothing but nulls are text."""
    kind = "null"
    for value in values:
        kind = wider(kind, of_value(value))
    return "string" if kind == "null" else kind


def schema(columns: Iterable[tuple[str, str]]) -> T.StructType:
    return T.StructType([T.StructField(name, SPARK[named(kind)], True) for name, kind in columns])


def fitted(value: object, kind: T.DataType) -> object:
    """A Python value as Spark takes it for a column of that type."""
    if value is None:
        return None
    if isinstance(kind, T.StringType) and not isinstance(value, str):
        return str(value).lower() if isinstance(value, bool) else str(value)
    if isinstance(kind, T.DoubleType):
        return float(value)
    if isinstance(kind, T.DecimalType):
        return Decimal(str(value)).quantize(Decimal(1).scaleb(-kind.scale))
    if isinstance(kind, (T.IntegerType, T.LongType)) and not isinstance(value, int):
        return int(value)
    if isinstance(kind, T.DateType) and isinstance(value, str):
        return datetime.date.fromisoformat(value)
    if isinstance(kind, T.TimestampNTZType) and isinstance(value, str):
        return datetime.datetime.fromisoformat(value)
    return value
