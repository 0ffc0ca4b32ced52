"""The warehouse tables' rules as checks that return the offending rows."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ordermart.functions.columns import named, parse_timestamp
from ordermart.schemas import TABLES, Table


def storage_type(dtype: T.DataType) -> T.DataType:
    """The Spark type a target type is held in: varchar and char are strings."""
    return T.StringType() if isinstance(dtype, (T.VarcharType, T.CharType)) else dtype


def storage_schema(table: Table) -> T.StructType:
    return T.StructType(
        [T.StructField(f.name, storage_type(f.dataType)) for f in table.columns]
    )


def schema_frame(df: DataFrame) -> DataFrame:
    """A frame's columns as rows: position, column, type."""
    rows = [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema)]
    return df.sparkSession.createDataFrame(rows, "position int, column string, type string")


_WHOLE = {T.ShortType: 2**15 - 1, T.IntegerType: 2**31 - 1, T.LongType: 2**63 - 1}


def _in_range(value: Column, target: T.DataType) -> Column | None:
    """Does a number fit the target type? None where any number does. A range
    test costs less than a failing cast."""
    if type(target) in _WHOLE:
        top = _WHOLE[type(target)]
        return value.between(-top - 1, top)
    if isinstance(target, T.DecimalType):
        # Below the first value that would round up to one digit too many.
        return F.abs(value) < 10 ** (target.precision - target.scale) - 0.5 * 10**-target.scale
    return None


def _converted(field: T.StructField, source: T.DataType) -> Column:
    target = storage_type(field.dataType)
    value = named(field.name)
    if source == target:
        return value
    if isinstance(target, T.TimestampNTZType) and isinstance(source, T.StringType):
        return parse_timestamp(value, source)
    if isinstance(source, T.NumericType):
        if type(target) in _WHOLE and not isinstance(source, T.IntegralType):
            value = F.round(value)  # as the target does; a cast would truncate
        fits = _in_range(value, target)
        if fits is not None:
            return F.when(fits, value.cast(target))
    return value.try_cast(target)


def conform(df: DataFrame, table: Table) -> DataFrame:
    """The table's columns in its order and types. Values a type cannot hold
    become null; `type_rejects` lists them."""
    return df.select(
        [_converted(f, df.schema[f.name].dataType).alias(f.name) for f in table.columns]
    )


def key_text(columns) -> Column:
    r"""A key's values with | between them. In a key of several columns | and \ within a
    value follow a \ and a null is \N, so that different keys have different texts."""
    values = [named(c).cast("string") for c in columns]
    if len(values) == 1:
        return F.coalesce(values[0], F.lit(""))
    escaped = [F.regexp_replace(v, r"([|\\])", r"\\$1") for v in values]
    return F.concat_ws("|", *[F.coalesce(v, F.lit(r"\N")) for v in escaped])


def _rejects(df: DataFrame, table: Table, tests: list[tuple[str, str, Column]]) -> DataFrame:
    """One row per failed cell, out of a single scan. Rows without a failure,
    mostly all, leave at a plain filter."""
    cells = [
        F.when(
            failed,
            F.struct(
                F.lit(rule).alias("rule"),
                F.lit(column).alias("column"),
                named(column).cast("string").alias("value"),
            ),
        )
        for rule, column, failed in tests
    ]
    any_failed = reduce(Column.__or__, [failed for *_, failed in tests], F.lit(False))
    return df.filter(any_failed).select(
        F.lit(table.name).alias("table"),
        key_text(table.key).alias("key"),
        F.inline(F.array_compact(F.array(*cells))),
    )


def _lost(field: T.StructField, source: T.DataType) -> Column:
    """Is a cell that isn't null by `_converted`? A number that fits a decimal is not made
    one for that."""
    target = storage_type(field.dataType)
    if isinstance(target, T.DecimalType) and isinstance(source, T.NumericType):
        return ~_in_range(named(field.name), target)
    return _converted(field, source).isNull()


def _type_tests(df: DataFrame, table: Table) -> list[tuple[str, str, Column]]:
    return [("type", table.key[0], F.lit(False))] + [
        ("type", f.name, named(f.name).isNotNull() & _lost(f, df.schema[f.name].dataType))
        for f in table.columns
        if df.schema[f.name].dataType != storage_type(f.dataType)
    ]


def _length_tests(table: Table) -> list[tuple[str, str, Column]]:
    return [
        ("length", f.name, F.char_length(named(f.name)) > F.lit(f.dataType.length))
        for f in table.columns
        if isinstance(f.dataType, (T.VarcharType, T.CharType))
    ]


def type_rejects(df: DataFrame, table: Table) -> DataFrame:
    """Cells that hold a value which the target type cannot."""
    return _rejects(df, table, _type_tests(df, table)).drop("rule")


def length_rejects(df: DataFrame, table: Table) -> DataFrame:
    """Text longer than its varchar or char column."""
    return _rejects(df, table, _length_tests(table)).drop("rule")


def value_rejects(df: DataFrame, table: Table) -> DataFrame:
    """Both in one scan, with the rule, `type` or `length`."""
    return _rejects(df, table, _type_tests(df, table) + _length_tests(table))


def pk_violations(df: DataFrame, table: Table) -> DataFrame:
    """Primary keys that are null or held by more than one row."""
    has_null = reduce(Column.__or__, [named(k).isNull() for k in table.key])
    groups = df.groupBy(*table.key).agg(F.count("*").alias("n"))
    return groups.filter((F.col("n") > 1) | has_null).select(
        F.lit(table.name).alias("table"), key_text(table.key).alias("key"), "n"
    )


def _keys(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """Key values in long form, (column, key), null ones left out."""
    cells = [
        F.struct(F.lit(column).alias("column"), named(source).cast("string").alias("key"))
        for column, source in columns.items()
    ]
    return df.select(F.inline(F.array(*cells))).filter(F.col("key").isNotNull())


def fk_violations(
    child: DataFrame, table: Table, parents: Mapping[str, DataFrame]
) -> DataFrame:
    """Foreign key values without a parent row, with how many rows hold them, for
    all references of a table in one scan of it. Null is exempt. The child is
    counted per key before the join, so that a key with many rows weighs as much
    as any other. `parents` holds frames by table name."""
    used = (
        _keys(child, {c: c for c in table.references})
        .groupBy("column", "key")
        .agg(F.count("*").alias("n"))
    )
    known = [
        _keys(parents[parent], {column: TABLES[parent].key[0]})
        for column, parent in table.references.items()
    ]
    known = reduce(DataFrame.unionAll, known).distinct()
    parent_of = F.create_map(*[F.lit(v) for ref in table.references.items() for v in ref])
    return used.join(known, ["column", "key"], "left_anti").select(
        F.lit(table.name).alias("table"),
        "column",
        parent_of[F.col("column")].alias("parent"),
        "key",
        "n",
    )
