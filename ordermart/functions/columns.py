"""Column expressions: typed defaults, null flags, tolerant parsing.

All are built-in expressions, give the same result with ANSI on or off, and do
not depend on the session time zone.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ordermart.schemas import TIMESTAMP_PATTERN


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def named(name: str) -> Column:
    return F.col(quoted(name))


def _zero_sql(dtype: T.DataType) -> str:
    if isinstance(dtype, T.TimestampNTZType):
        return "TIMESTAMP_NTZ'1970-01-01 00:00:00'"
    if isinstance(dtype, T.TimestampType):
        return "timestamp_seconds(0)"
    if isinstance(dtype, T.DateType):
        return "DATE'1970-01-01'"
    if isinstance(dtype, T.BooleanType):
        return "false"
    if isinstance(dtype, (T.StringType, T.CharType, T.VarcharType)):
        return "'0'"
    if isinstance(dtype, T.NumericType):
        return f"CAST(0 AS {dtype.simpleString()})"
    raise TypeError(f"no default for a column of type {dtype.simpleString()}")


def typed_zero(dtype: T.DataType) -> Column:
    """The value that stands for a missing cell: 0 in the column's own type."""
    return F.expr(_zero_sql(dtype))


def _filled_sql(name: str, dtype: T.DataType) -> str:
    value = quoted(name)
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        value = f"nanvl({value}, CAST(NULL AS {dtype.simpleString()}))"
    return f"coalesce({value}, {_zero_sql(dtype)}) AS {quoted(name)}"


def fill_defaults(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """Replace nulls (and NaN) by the typed zero, in one projection."""
    schema = df.schema
    wanted = set(schema.names if columns is None else columns)
    return df.selectExpr(
        [
            _filled_sql(f.name, f.dataType) if f.name in wanted else quoted(f.name)
            for f in schema
        ]
    )


def null_flags(df: DataFrame) -> DataFrame:
    """0/1 per cell: is it null?"""
    return df.select([named(c).isNull().cast("int").alias(c) for c in df.columns])


def parse_timestamp(value: Column, dtype: T.DataType = T.StringType()) -> Column:
    """Text to a wall-clock time, null where the text is not one, whatever the session's
    zone. Timestamps pass through, dates become midnight."""
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return value
    if isinstance(dtype, T.DateType):
        return value.cast("timestamp_ntz")
    text = value.cast("string")
    return F.when(text.rlike(TIMESTAMP_PATTERN), text.try_cast("timestamp_ntz"))


def parse_score(value: Column) -> Column:
    """Text to float, null where the text is not a number."""
    return value.try_cast("float")


def has_time(value: Column, dtype: T.DataType) -> Column:
    """Neither null nor the epoch that a filled timestamp would hold."""
    return value.isNotNull() & (value != typed_zero(dtype))
