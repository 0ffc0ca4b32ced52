"""Landing raw files under their keys, and checking that they landed.

What a scan can't read of a file, cells of another type and rows with too many or few
cells, is written beside what landed, below `rejects`, so that a later check sees it.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ordermart.schemas import LANDING_JSON_KEY, LANDING_KEYS, MULTILINE, RAW
from ordermart.session import empty_table, put_folder, remove_folder, shared_dir
from ordermart.sources.files import (
    CSV_OPTIONS,
    MALFORMED,
    list_objects,
    read_table,
    scan_rejects,
    table_name,
)

REJECTS = "table string, column string, text string"
#: Partition of landed rows by the file they came from, and the list of files loaded.
SOURCE = "source"
MANIFEST = "_files"
FILES = "path string, length bigint, modificationTime timestamp, name string"


def land_csv(df: DataFrame, path: str) -> None:
    """Write a frame as CSV that `read_table` reads back unchanged, but for empty
    text, which a CSV read takes for null. Timestamps go out as
    `yyyy-MM-dd HH:mm:ss`, with a fraction only where there is one."""
    times = [
        f.name
        for f in df.schema
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType))
    ]
    text = df.withColumns({c: F.col(c).cast("string") for c in times})
    text.write.mode("overwrite").options(**CSV_OPTIONS).csv(path)


def land_json(df: DataFrame, root: str, key: str = LANDING_JSON_KEY) -> str:
    """Write a frame as JSON lines under its key; nulls keep their field."""
    path = f"{root}/{key}"
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)
    return path


def _staged(df: DataFrame, path: str | None = None) -> DataFrame:
    """Parsed once and read from there."""
    path = path or shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _rejects_of(staged: DataFrame, name: str) -> DataFrame:
    return scan_rejects(staged, MALFORMED).select(F.lit(name).alias("table"), "column", "text")


def land_files(
    spark: SparkSession, sources: Mapping[str, str], root: str, parquet: bool = False
) -> dict[str, str]:
    """Land each named CSV table under `root` and return where.

    CSV keeps every field as text. `parquet` types the columns: later scans are
    then columnar and splittable, and take pushed filters. `landed_rejects` has what
    could not be read.
    """
    landed = {}
    for name, source in sources.items():
        key = LANDING_KEYS[name]
        schema = RAW[name] if parquet else None
        multiline = name in MULTILINE
        work = shared_dir(spark)
        read = read_table(spark, source, schema, multiline=multiline, malformed=MALFORMED)
        staged = _staged(read, work)
        _rejects_of(staged, name).write.mode("overwrite").parquet(f"{root}/rejects/{name}")
        if parquet:
            path = f"{root}/{key.removesuffix('.csv')}.parquet"
            staged.drop(MALFORMED).write.mode("overwrite").parquet(path)
        else:
            path = f"{root}/{key}"
            land_csv(staged.drop(MALFORMED), path)
        remove_folder(spark, work)
        landed[name] = path
    return landed


def _read(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A written table, empty where there is none yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        if isinstance(schema, str):
            schema = T.StructType.fromDDL(schema)
        return empty_table(spark, schema)


def landed_rejects(spark: SparkSession, root: str) -> DataFrame:
    """table, column, text of what could not be read of the landed files; a row with too
    many or few cells has no column."""
    parts = [_read(spark, f"{root}/rejects/{name}", REJECTS) for name in RAW]
    return reduce(DataFrame.unionByName, parts)


# Landing only what is new.


@dataclass(frozen=True)
class NewFiles:
    """Files of one run: their list, and what could not be read of them."""

    files: DataFrame
    rejects: DataFrame


def _source_id(path: Column) -> Column:
    """A file's partition; listings and scans spell the same path with one or three slashes."""
    return F.left(F.sha1(F.regexp_replace(path, r"^(\w+):/+", "$1:/")), F.lit(16))


def new_files(spark: SparkSession, source: str, root: str) -> DataFrame:
    """The CSV files of known tables below `source` that no run has finished with, told by
    path, size and time: path, length, modificationTime, name. No content is read."""
    found = list_objects(spark, source).withColumn("name", table_name(F.col("path")))
    known = _read(spark, f"{root}/{MANIFEST}", FILES)
    keys = ["path", "length", "modificationTime"]
    return found.filter(F.col("name").isin(*RAW)).join(known, keys, "left_anti")


def land_new(spark: SparkSession, source: str, root: str) -> NewFiles | None:
    """Land the new files below `source` as typed Parquet, or None without any. Each file's
    rows are a partition of its own, so a file that is delivered again takes
    the place of its last delivery, once it is parsed. Rows are written once, with what
    could not be read of them. `mark_loaded` ends the run."""
    files = _staged(new_files(spark, source, root))
    # The files of one run come to the driver, as they do in any scan of them.
    new = files.select("name", "path", _source_id(F.col("path")).alias(SOURCE)).collect()
    if not new:
        return None
    rejects = []
    for name in sorted({row["name"] for row in new}):
        mine = [row for row in new if row["name"] == name]
        read = read_table(
            spark,
            [row["path"] for row in mine],
            RAW[name],
            multiline=name in MULTILINE,
            malformed=MALFORMED,
        )
        rows = read.withColumn(SOURCE, _source_id(F.col("_metadata.file_path")))
        path, work = f"{root}/{name}.parquet", shared_dir(spark)
        rows.write.partitionBy(SOURCE).parquet(work)
        ids = [row[SOURCE] for row in mine]
        for i in ids:
            put_folder(spark, f"{work}/{SOURCE}={i}", f"{path}/{SOURCE}={i}")
        remove_folder(spark, work)
        landed = _read(spark, path, rows.schema).filter(F.col(SOURCE).isin(ids))
        rejects.append(_rejects_of(landed.drop(SOURCE), name))
    return NewFiles(files, reduce(DataFrame.unionByName, rejects))


def landed_tables(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """All raw tables as landed so far by `land_new`, empty before their first file."""
    return {
        name: _read(spark, f"{root}/{name}.parquet", schema).select(*schema.names)
        for name, schema in RAW.items()
    }


def mark_loaded(new: NewFiles, root: str) -> None:
    """No later run takes these files again."""
    new.files.write.mode("append").parquet(f"{root}/{MANIFEST}")


def has_landed(spark: SparkSession, path: str, suffix: str = ".csv") -> bool:
    """Is there at least one such file at `path`?"""
    return bool(list_objects(spark, path, suffix).limit(1).collect())
