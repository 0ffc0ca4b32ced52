"""Column types out of raw text: how many cells of a column each type could hold, in one
aggregate, and the narrowest type that holds enough of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ordermart.functions.columns import named

# The types of a CSV cell, narrowest first, and how each is written.
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
SPELLINGS: dict[str, str] = {
    "int": r"^[+-]?\d+$",
    "bigint": r"^[+-]?\d+$",
    "double": NUMBER,
    "boolean": r"^(?i:true|false)$",
    "date": r"^\d{4}-\d{2}-\d{2}$",
    "timestamp_ntz": r"^\d{4}-\d{2}-\d{2}([ T]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?)?$",
}
#: Rows of a raw table have no other types than these and text.
TYPES = {
    "int": T.IntegerType(),
    "bigint": T.LongType(),
    "double": T.DoubleType(),
    "boolean": T.BooleanType(),
    "date": T.DateType(),
    "timestamp_ntz": T.TimestampNTZType(),
}


def as_type(text: Column, name: str) -> Column:
    """The cell in a type, null where it isn't written as one or is out of range."""
    return F.when(text.rlike(SPELLINGS[name]), text.try_cast(name))


def _kind(text: Column, whole: Column) -> Column:
    """The narrowest type of a cell, by its place in SPELLINGS, and the place after them for
    text. A whole number is any number, and a number is written as nothing else, so most
    cells meet one or two patterns."""

    def held(name: str) -> Column:
        return text.rlike(SPELLINGS[name]) & text.try_cast(name).isNotNull()

    found = F.when(whole.between(-(2**31), 2**31 - 1), 0).when(whole.isNotNull(), 1)
    for place, name in list(enumerate(SPELLINGS))[2:]:
        found = found.when(held(name), place)
    return found.otherwise(len(SPELLINGS))


#: Narrower types whose cells a type holds as well.
NARROWER = {"bigint": ["int"], "double": ["int", "bigint"], "timestamp_ntz": ["date"]}


def type_counts(text: DataFrame) -> DataFrame:
    """One row per column of a table of text: its cells that aren't null, and how many of
    them each type can hold. One scan, of which only counts are shuffled.

    Each cell becomes a row, so that its tests are one piece of code for all columns; a
    row of counts per column is left of them, which the last step puts in order.
    """
    cell, code, n = F.col("cell"), F.col("code"), F.col("n")
    places, kinds = list(SPELLINGS), len(SPELLINGS) + 1
    # a column and a kind as one number, which groups faster than two
    pairs = [
        F.struct(F.lit(i * kinds).alias("at"), named(c).alias("cell"))
        for i, c in enumerate(text.columns)
    ]
    cells = text.select(F.inline(F.array(*pairs))).filter(cell.isNotNull())
    whole = cells.withColumn("whole", as_type(cell, "bigint"))
    coded = whole.select((F.col("at") + _kind(cell, F.col("whole"))).alias("code"))
    counts = coded.groupBy("code").agg(F.count("*").alias("n"))

    def total(i: int, kinds_held: list[int], name: str) -> Column:
        held = code.isin([i * kinds + k for k in kinds_held])
        return F.coalesce(F.sum(F.when(held, n)), F.lit(0)).alias(name)

    found = [
        F.struct(
            F.lit(c).alias("column"),
            total(i, list(range(kinds)), "cells"),
            *[total(i, [places.index(k) for k in [t, *NARROWER.get(t, ())]], t) for t in places],
        )
        for i, c in enumerate(text.columns)
    ]
    return counts.agg(F.array(*found).alias("cells")).select(F.inline("cells"))


def infer_schema(text: DataFrame, junk: float = 0.0) -> T.StructType:
    """For each column the narrowest type that holds all its cells but a share of `junk`;
    text if none does, or if it has no cell. One row per column comes to the driver."""
    found = {row["column"]: row for row in type_counts(text).collect()}

    def narrowest(column: str) -> T.DataType:
        row = found[column]
        enough = row["cells"] * (1 - junk)
        held = [TYPES[t] for t in SPELLINGS if row["cells"] and row[t] >= enough]
        return held[0] if held else T.StringType()

    return T.StructType([T.StructField(c, narrowest(c)) for c in text.columns])


def typed(text: DataFrame, schema: T.StructType) -> tuple[list[Column], Column]:
    """The columns of `schema` out of a table of text, and whether a row has a cell that
    its type can't hold."""
    columns, failed = [], F.lit(False)
    for f in schema:
        value = named(f.name)
        if not isinstance(f.dataType, T.StringType):
            value = as_type(value, f.dataType.simpleString())
            failed = failed | (named(f.name).isNotNull() & value.isNull())
        columns.append(value.alias(f.name))
    return columns, failed
