"""Duplicate and null checks over whole rows, and the cleansing step."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ordermart.functions.columns import fill_defaults, named
from ordermart.operators.keyfilter import key_filter, may_hold

_N = "__n"
_HASH = "__hash"
_NULLS = "__nulls"
#: Columns whose null flags share a number.
_FLAGS = 62


def row_groups(df: DataFrame, count: str = _N) -> DataFrame:
    """Each different row with how often it occurs. Copies are counted up before
    the shuffle, so a row repeated without end is one row per map task."""
    return df.groupBy(*[named(c) for c in df.columns]).agg(F.count("*").alias(count))


def duplicate_rows(df: DataFrame, count: str = "n") -> DataFrame:
    """The rows that occur more than once, each shown once."""
    return row_groups(df, count).filter(F.col(count) > 1)


def distinct_rows(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def clean(df: DataFrame) -> DataFrame:
    """Distinct rows, then typed defaults. In this order: rows that differ only
    by null against the default both stay."""
    return fill_defaults(distinct_rows(df))


def duplicate_report(df: DataFrame) -> DataFrame:
    """One row: rows, distinct rows, groups of copies, copies beyond the first."""
    n, zero = F.col(_N), F.lit(0)
    return row_groups(df).agg(
        F.coalesce(F.sum(n), zero).alias("rows"),
        F.count("*").alias("distinct_rows"),
        F.count_if(n > 1).alias("dup_groups"),
        F.coalesce(F.sum(n - 1), zero).alias("extra_rows"),
    )


def null_profile(df: DataFrame) -> DataFrame:
    """Nulls per column, in one scan that shuffles only counts."""
    cells = [
        F.struct(F.lit(c).alias("column"), F.count_if(named(c).isNull()).alias("nulls"))
        for c in df.columns
    ]
    return df.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))


def filled_cells(df: DataFrame) -> DataFrame:
    """Cells per column that `fill_defaults` replaces, by what they hold: null, or NaN in
    a column of fractions. One scan."""

    def nan(field: T.StructField) -> Column:
        if isinstance(field.dataType, (T.FloatType, T.DoubleType)):
            return F.count_if(F.isnan(named(field.name)))
        return F.lit(0).cast("bigint")

    cells = [
        F.struct(
            F.lit(f.name).alias("column"),
            F.count_if(named(f.name).isNull()).alias("nulls"),
            nan(f).alias("nans"),
        )
        for f in df.schema
    ]
    return df.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))


def repeated_rows(df: DataFrame, count: str = _N) -> DataFrame:
    """`duplicate_rows` without a shuffle of rows that occur once. Equal rows have
    equal hashes, so only hashes are counted; a filter of bounded size over the repeated
    ones then leaves their rows (and a few others) to be compared in full. Without a
    repeated hash adaptive execution drops the second scan."""
    hashed = df.withColumn(_HASH, F.xxhash64(*[named(c) for c in df.columns]))
    hashes = hashed.groupBy(_HASH).agg(F.count("*").alias(_N)).filter(F.col(_N) > 1)
    suspects = may_hold(hashed, [_HASH], key_filter(hashes, [_HASH]))
    return duplicate_rows(suspects.drop(_HASH), count)


def row_digests(df: DataFrame) -> DataFrame:
    """Each different row as a digest of 128 bits and flags of its null cells, with how
    often it occurs. Only numbers are shuffled, however wide the rows are. Among 10^12 rows
    two different ones share a digest with a probability below 10^-14."""
    zero = F.lit(0).cast("bigint")
    cells = [named(c) for c in df.columns]
    flags = [F.when(c.isNull(), F.lit(1 << i % _FLAGS).cast("bigint")).otherwise(zero)
             for i, c in enumerate(cells)]
    words = [
        reduce(Column.bitwiseOR, flags[at : at + _FLAGS]).alias(f"{_NULLS}{at // _FLAGS}")
        for at in range(0, len(flags), _FLAGS)
    ]
    hashes = [F.xxhash64(F.lit(salt), *cells).alias(f"{_HASH}{salt}") for salt in (1, 2)]
    digests = df.select(*hashes, *words)
    return digests.groupBy(*digests.columns).agg(F.count("*").alias(_N))


def quality_profile(df: DataFrame) -> DataFrame:
    """`duplicate_report` with the nulls per column of the distinct rows, as one
    row per column. One scan and one shuffle of digests."""
    n, zero = F.col(_N), F.lit(0)
    nulls = [
        F.count_if(
            F.col(f"{_NULLS}{i // _FLAGS}").bitwiseAND(F.lit(1 << i % _FLAGS).cast("bigint")) != 0
        ).alias(f"m{i}")
        for i in range(len(df.columns))
    ]
    total = row_digests(df).agg(
        F.coalesce(F.sum(n), zero).alias("rows"),
        F.count("*").alias("distinct_rows"),
        F.count_if(n > 1).alias("dup_groups"),
        F.coalesce(F.sum(n - 1), zero).alias("extra_rows"),
        *nulls,
    )
    cells = [
        F.struct(F.lit(c).alias("column"), F.col(f"m{i}").alias("nulls"))
        for i, c in enumerate(df.columns)
    ]
    return total.select(
        "rows", "distinct_rows", "dup_groups", "extra_rows", F.inline(F.array(*cells))
    )


def quality_report(tables: Mapping[str, DataFrame]) -> DataFrame:
    """`quality_profile` of several tables, one below the other."""
    parts = [
        quality_profile(df).select(F.lit(name).alias("table"), "*") for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def preview(df: DataFrame, key: list[str], n: int = 5) -> DataFrame:
    """The first n rows by key: a top-n per partition, merged."""
    ties = [c for c in df.columns if c not in key]
    return df.orderBy(*[named(c) for c in key + ties]).limit(n)
