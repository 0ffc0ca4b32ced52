"""Warehouse targets: Parquet folders or JDBC tables, filled by append or by month."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ordermart.functions.columns import named
from ordermart.operators.constraints import storage_schema
from ordermart.operators.keyfilter import key_filter, may_hold
from ordermart.schemas import TABLES, Table
from ordermart.session import empty_table, remove_folder

#: The one table that grows by time: its folder has a partition per month.
FACT = "Orders"
MONTH = "purchase_month"
#: The folder that Spark gives rows without a partition value.
NO_MONTH = "__HIVE_DEFAULT_PARTITION__"


def month_of(table: Table) -> Column:
    """The month a row is filed under, null where the table has none. By way of the date,
    which no time zone can move."""
    if table.name != FACT:
        return F.lit(None).cast("string")
    return F.date_format(F.to_date("order_purchase_timestamp"), "yyyy-MM")


@dataclass(frozen=True)
class ParquetWarehouse:
    """One folder per table; the fact is partitioned by purchase month."""

    spark: SparkSession
    root: str

    def path(self, table: Table) -> str:
        return f"{self.root}/{table.name}"

    def read(self, table: Table) -> DataFrame:
        """The table as loaded so far, empty before its first load."""
        schema = storage_schema(table)
        try:
            return self.spark.read.schema(schema).parquet(self.path(table)).select(
                *schema.names
            )
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return empty_table(self.spark, schema)

    def rows(self, table: Table) -> int:
        """The rows loaded so far, by the files' footers."""
        return self.read(table).count()

    def months(self, table: Table, names: Sequence[str | None]) -> DataFrame:
        """The rows of these months; no other folder is scanned."""
        schema = storage_schema(table)
        dated = T.StructType([*schema.fields, T.StructField(MONTH, T.StringType())])
        try:
            rows = self.spark.read.schema(dated).parquet(self.path(table))
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return empty_table(self.spark, schema)
        wanted = F.col(MONTH).isin([n for n in names if n is not None])
        if None in names:
            wanted = wanted | F.col(MONTH).isNull()
        return rows.filter(wanted).select(*schema.names)

    def drop_month(self, table: Table, name: str | None) -> None:
        """Remove a month that has no row left."""
        folder = NO_MONTH if name is None else name
        remove_folder(self.spark, f"{self.path(table)}/{MONTH}={folder}")

    def append(self, table: Table, df: DataFrame) -> None:
        self._write(table, df, "append")

    def overwrite_months(self, table: Table, df: DataFrame) -> None:
        """Put the rows of `df` in place of the months they belong to; other months stay.
        `df` must not read the table itself."""
        if table.name != FACT:
            raise ValueError(f"{table.name} has no months")
        self._write(table, df, "overwrite")

    def _write(self, table: Table, df: DataFrame, mode: str) -> None:
        if table.name != FACT:
            df.write.mode(mode).parquet(self.path(table))
            return
        # Rebalancing gathers each month into few files, and splits a large one.
        dated = df.withColumn(MONTH, month_of(table)).hint("rebalance", MONTH)
        writer = dated.write.mode(mode).option("partitionOverwriteMode", "dynamic")
        writer.partitionBy(MONTH).parquet(self.path(table))


def key_ranges(column: str, bounds: Sequence[str | int]) -> list[str]:
    """SQL conditions that part all rows at these key values, null first; none without
    bounds. They needn't be even: each is one connection's share."""
    if not bounds:
        return []
    cuts = sorted(set(bounds))
    spelled = [str(c) if isinstance(c, int) else "'" + c.replace("'", "''") + "'" for c in cuts]
    inner = [f"{column} >= {a} AND {column} < {b}" for a, b in zip(spelled, spelled[1:])]
    first, last = f"{column} < {spelled[0]} OR {column} IS NULL", f"{column} >= {spelled[-1]}"
    return [first, *inner, last]


@dataclass(frozen=True)
class JdbcWarehouse:
    """Tables of a database. `options` holds url, driver, user and password. Tables named
    in `key_bounds` are read over several connections, each a range of the first key
    column between the given values; others over one."""

    spark: SparkSession
    options: Mapping[str, str]
    batch_size: int = 10_000
    connections: int = 16
    read_options: Mapping[str, str] = field(default_factory=dict)
    key_bounds: Mapping[str, Sequence[str | int]] = field(default_factory=dict)

    def read(self, table: Table) -> DataFrame:
        options = {
            "fetchsize": str(self.batch_size),
            "preferTimestampNTZ": "true",
            **self.options,
            **self.read_options,
        }
        ranges = key_ranges(table.key[0], self.key_bounds.get(table.name, ()))
        if not ranges:
            return self.spark.read.format("jdbc").options(**options, dbtable=table.name).load()
        url = options.pop("url")
        return self.spark.read.jdbc(url, table.name, predicates=ranges, properties=options)

    def rows(self, table: Table) -> None:
        """Not known without a scan."""

    def write_options(self, table: Table) -> dict[str, str]:
        # Long text is left to the database's own type for it.
        types = [
            f"{f.name} {f.dataType.simpleString()}"
            for f in table.columns
            if not isinstance(f.dataType, T.StringType)
        ]
        return {
            **self.options,
            "dbtable": table.name,
            "batchsize": str(self.batch_size),
            "numPartitions": str(self.connections),
            "createTableColumnTypes": ", ".join(types),
        }

    def append(self, table: Table, df: DataFrame) -> None:
        writer = df.write.format("jdbc").mode("append")
        writer.options(**self.write_options(table)).save()


def _by_key(left: DataFrame, right: DataFrame, key: tuple[str, ...], how: str) -> DataFrame:
    """A semi or anti join in which null keys equal each other, so that a row
    without its key is not loaded again either."""
    left, right = left.alias("l"), right.alias("r")
    equal = [F.col(f"l.`{k}`").eqNullSafe(F.col(f"r.`{k}`")) for k in key]
    return left.join(right, reduce(Column.__and__, equal), how)


def loaded_rows(
    df: DataFrame,
    target: DataFrame,
    key: tuple[str, ...],
    columns: Sequence[str] | None = None,
    thin: bool = True,
) -> DataFrame:
    """Columns (the key's by default) of the target's rows whose key `df` may have: all
    that it has, and few others. A filter over the keys of `df` thins the target in its
    scan, so that what is shuffled later grows with `df`, not with the target. Without
    `thin` all the target's rows, which a target no larger than the batch is better left with."""
    rows = target.select(*[named(c) for c in columns or key])
    return may_hold(rows, key, key_filter(df, key)) if thin else rows


def new_rows(
    df: DataFrame, target: DataFrame, key: tuple[str, ...], thin: bool = True
) -> DataFrame:
    """The rows whose key is not loaded yet: what a repeated load may append.
    Of the target only the key columns are read."""
    return _by_key(df, loaded_rows(df, target, key, thin=thin), key, "left_anti")


def worth_thinning(warehouse, table: Table, batch: int) -> bool:
    """Is the target more than twice a batch of so many rows, or of unknown size? Only then
    does a filter over the batch's keys spare more than it costs."""
    rows = warehouse.rows(table)
    return rows is None or rows > 2 * batch


def load_table(warehouse, table: Table, df: DataFrame, thin: bool = True) -> None:
    """Append the rows that are new."""
    warehouse.append(table, new_rows(df, warehouse.read(table), table.key, thin))


def load_warehouse(warehouse, frames: Mapping[str, DataFrame], order: list[str]) -> None:
    """Load the tables one after the other, referenced tables first."""
    for name in order:
        load_table(warehouse, TABLES[name], frames[name])


def replace_rows(warehouse: ParquetWarehouse, table: Table, df: DataFrame, work: str) -> None:
    """Load a re-delivery: rows of `df` take the place of the target's rows of their keys,
    in whatever month those are, and new ones are added.

    Only months that gain or lose a row are read in full and written anew, from a copy
    in `work`, so that a run that is stopped and started again ends with the same rows.
    Every month of the batch is one of them; months that a moved order leaves are found by
    a scan of the target's keys, thinned by the batch's.
    """
    target = warehouse.read(table)
    month = month_of(table)
    held = loaded_rows(df, target, table.key, [*table.key, "order_purchase_timestamp"])
    left = _by_key(held, df, table.key, "left_semi")
    months = df.select(month.alias(MONTH)).unionAll(left.select(month.alias(MONTH))).distinct()
    # A batch's months, of which a calendar has twelve a year, name the folders to scan.
    names = [row[MONTH] for row in months.collect()]
    kept = _by_key(warehouse.months(table, names), df, table.key, "left_anti")
    merged = kept.unionByName(df.select(*kept.columns))
    merged.write.mode("overwrite").parquet(work)
    warehouse.overwrite_months(table, warehouse.spark.read.schema(merged.schema).parquet(work))
    found = warehouse.spark.read.parquet(work).select(month.alias(MONTH)).distinct()
    for gone in set(names) - {row[MONTH] for row in found.collect()}:
        warehouse.drop_month(table, gone)


def key_audit(written: DataFrame, target: DataFrame, table: Table) -> DataFrame:
    """One row: rows written, rows the target has of their keys, how many of the
    written are missing there, and how many the target has too often. Keys are
    netted in one grouping, which counts copies of a key as well."""
    keys = [named(k) for k in table.key]
    held = loaded_rows(written, target, table.key)
    sides = written.select(*keys, F.lit(1).alias("w"), F.lit(0).alias("t")).unionAll(
        held.select(*keys, F.lit(0).alias("w"), F.lit(1).alias("t"))
    )
    per_key = sides.groupBy(*keys).agg(F.sum("w").alias("w"), F.sum("t").alias("t"))
    return per_key.agg(*_counts(F.col("w"), F.col("t"))).select(F.lit(table.name).alias("table"), "*")


def _counts(w: Column, t: Column) -> list[Column]:
    """Sums over keys with w rows written and t rows in the target."""
    zero = F.lit(0)
    sums = {
        "written": w,
        "in_target": F.when(w > 0, t).otherwise(0),
        "missing": F.greatest(w - t, zero),
        "surplus": F.when(w > 0, F.greatest(t - w, zero)).otherwise(0),
    }
    return [F.coalesce(F.sum(value), zero).alias(name) for name, value in sums.items()]


def row_hashes(table: Table) -> list[Column]:
    """Two independent hashes of a row's cells. Which cells are null counts as well, as a
    hash passes over null."""
    cells = [named(c) for c in table.columns.names]
    nulls = F.concat(*[c.isNull().cast("int").cast("string") for c in cells])
    return [F.xxhash64(F.lit(salt), nulls, *cells) for salt in (1, 2)]


def _halves(hashes: list[Column]) -> list[Column]:
    """Hashes in signed halves, which can be summed as 64 bits. A grouping that sums wider
    numbers, or compares text, sorts all its rows."""
    low = [F.shiftright(F.shiftleft(h, 32), 32) for h in hashes]
    return [*[F.shiftright(h, 32) for h in hashes], *low]


def content_digest(df: DataFrame, table: Table) -> DataFrame:
    """Per month (one, null, for a table without): rows and a digest of them as a
    multiset. Digests of disjoint sets of rows add up, whatever the rows' order."""
    wide = [h.cast("decimal(20,0)").alias(f"h{i}") for i, h in enumerate(row_hashes(table), 1)]
    rows = df.select(month_of(table).alias("month"), *wide)
    return rows.groupBy("month").agg(
        F.count("*").alias("rows"), F.sum("h1").alias("digest1"), F.sum("h2").alias("digest2")
    )


def content_audit(
    written: DataFrame, target: DataFrame, table: Table, thin: bool = True
) -> DataFrame:
    """Per month of the written rows: rows written, rows the target has of their keys,
    rows missing there, rows it has too often, keys with as many rows but other cells
    (`changed`), and whether the digests of both sides are the same.

    The target's rows are hashed in their scan, where a filter over the written keys has
    thinned them; one grouping by key nets both sides' counts and hashes. A key that the
    target has in another month counts for the month it was written under, and of several
    for the last. Months are days until the keys are netted, as a day is a number.
    """
    keys = [named(k) for k in table.key]
    none = F.lit(None)
    first = F.trunc(F.to_date("order_purchase_timestamp"), "MM") if table.name == FACT else none
    halves = _halves(row_hashes(table))
    sums = [f"h{i}" for i in range(len(halves))]

    def side(df: DataFrame, w: int, t: int) -> DataFrame:
        return df.select(
            *keys, (first if w else none).cast("date").alias("first"),
            F.lit(w).alias("w"), F.lit(t).alias("t"),
            *[(h * (w - t)).alias(name) for name, h in zip(sums, halves)],
        )

    held = loaded_rows(written, target, table.key, table.columns.names, thin)
    per_key = (
        side(written, 1, 0)
        .unionAll(side(held, 0, 1))
        .groupBy(*keys)
        .agg(*[F.sum(c).alias(c) for c in ("w", "t", *sums)], F.max("first").alias("first"))
        .filter("w > 0")
        .withColumn("month", F.date_format("first", "yyyy-MM"))
    )
    w, t = F.col("w"), F.col("t")
    other = reduce(Column.__or__, [F.col(h) != 0 for h in sums])
    same = reduce(Column.__and__, [F.coalesce(F.sum(h), F.lit(0)) == 0 for h in sums])
    return per_key.groupBy("month").agg(
        *_counts(w, t), F.count_if((w == t) & other).alias("changed"), same.alias("same")
    ).select(F.lit(table.name).alias("table"), "*")
