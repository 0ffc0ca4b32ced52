"""CSV tables and JSON documents below a folder."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ordermart.functions.columns import named
from ordermart.schemas import MULTILINE, RAW
from ordermart.session import shared_dir
from ordermart.sources.inference import infer_schema, typed

# Doubled quotes, untrimmed text, line breaks within quotes: plain RFC 4180.
CSV_OPTIONS = {
    "header": "true",
    "escape": '"',
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}

#: Column of raw tables with the text of rows that the scan could not read in full.
MALFORMED = "_malformed"

# A table's object: its own CSV file, or the part files of a folder named like one.
_OBJECT = r"^(.*?/([^/]+\.csv))(/part-[^/]*)?$"


def read_table(
    spark: SparkSession,
    path: str | Sequence[str],
    schema: T.StructType | None = None,
    infer: bool = False,
    multiline: bool = False,
    malformed: str | None = None,
    junk: float = 0.0,
) -> DataFrame:
    """A CSV table with a header row, its columns found by their header names.

    `schema` types the columns it knows, in whatever order the file has them; any
    other is text. A file whose header differs from the first one's raises. `multiline`
    allows line breaks inside quotes, at the price of one task per file, so it belongs to
    tables with free text only. With `infer` the types come from the cells; see
    `inferred_table`. With `malformed`, a column of that name holds the text of a row
    that has a cell its type cannot hold, or too many or few cells; `scan_rejects`
    tells which.
    """
    paths = [path] if isinstance(path, str) else list(path)

    def reader(**options) -> DataFrameReader:
        return spark.read.options(**CSV_OPTIONS, multiLine=multiline, **options)

    text = reader().csv(paths)
    types = {} if schema is None or infer else {f.name: f.dataType for f in schema}
    if not types and not malformed:
        return inferred_table(text, None, junk) if infer else text
    in_file = [T.StructField(c, types.get(c, T.StringType())) for c in text.columns]
    options = {"enforceSchema": False}
    if malformed:
        in_file.append(T.StructField(malformed, T.StringType()))
        options["columnNameOfCorruptRecord"] = malformed
    read = reader(**options).schema(T.StructType(in_file)).csv(paths)
    return inferred_table(read, malformed, junk) if infer else read


def inferred_table(text: DataFrame, malformed: str | None, junk: float) -> DataFrame:
    """A table of text with each column in the narrowest type that holds all its cells but
    a share of `junk`; cells beyond the type become null and their rows malformed.

    The files are parsed once, into a written table that the types are counted in and
    that the result reads.
    """
    spark, path = text.sparkSession, shared_dir(text.sparkSession)
    text.write.parquet(path)
    text = spark.read.schema(text.schema).parquet(path)
    cells = text.drop(malformed) if malformed else text
    schema = infer_schema(cells, junk)
    columns, failed = typed(cells, schema)
    if malformed:
        options = {k: v for k, v in CSV_OPTIONS.items() if k != "header"}
        row = F.to_csv(F.struct(*[named(c) for c in cells.columns]), options)
        columns.append(F.coalesce(named(malformed), F.when(failed, row)).alias(malformed))
    return text.select(*columns)


def scan_rejects(df: DataFrame, malformed: str) -> DataFrame:
    """What a typed scan could not read, of a table that keeps `malformed`: column and
    text of each such cell, and, with no column, the text of each row that has too many or
    few cells. A row may be both. Read the table from written files, as a scan of fewer
    columns sees less."""
    cells = [f.name for f in df.schema if f.name != malformed]
    # positions as names, so that the file's own names need no quoting
    as_text = [f"c{i} string" for i in range(len(cells))] + ["uneven string"]
    options = {k: v for k, v in CSV_OPTIONS.items() if k != "header"}
    options["columnNameOfCorruptRecord"] = "uneven"
    text = F.from_csv(named(malformed), ", ".join(as_text), options)
    found = df.filter(named(malformed).isNotNull()).withColumn("__text", text)

    def reject(column: Column, value: Column) -> Column:
        return F.struct(column.alias("column"), value.alias("text"))

    raw = [F.col("__text").getField(f"c{i}") for i in range(len(cells))]
    bad = [
        F.when(named(c).isNull() & value.isNotNull(), reject(F.lit(c), value))
        for c, value in zip(cells, raw)
    ]
    rejects = F.array_compact(F.array(*bad))
    uneven = F.col("__text").getField("uneven").isNotNull() | (F.size(rejects) == 0)
    whole = F.array(reject(F.lit(None).cast("string"), named(malformed)))
    return found.select(F.inline(F.when(uneven, F.concat(rejects, whole)).otherwise(rejects)))


def list_objects(spark: SparkSession, root: str, suffix: str = ".csv") -> DataFrame:
    """Every file below `root` with that suffix: path, length, modificationTime.
    No content is read."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", f"*{suffix}")
        .load(root)
        .select("path", "length", "modificationTime")
    )


def table_name(path: Column) -> Column:
    """The table an object belongs to: its base name, or its folder's."""
    return F.regexp_replace(F.regexp_extract(path, _OBJECT, 2), r"\.csv$", "")


def table_objects(spark: SparkSession, root: str) -> DataFrame:
    """Table name and object path per CSV table below `root`. Where two objects
    have one base name, the last path wins."""
    path = F.col("path")
    return (
        list_objects(spark, root)
        .select(
            table_name(path).alias("name"),
            F.regexp_extract(path, _OBJECT, 1).alias("object"),
        )
        .groupBy("name")
        .agg(F.max("object").alias("object"))
    )


def read_tables(
    spark: SparkSession,
    root: str,
    schemas: Mapping[str, T.StructType] = RAW,
    infer: bool = False,
    malformed: str | None = None,
    junk: float = 0.0,
) -> dict[str, DataFrame]:
    """The known tables found below `root`, by base name; the rest as in read_table."""
    known = table_objects(spark, root).filter(F.col("name").isin(*schemas))
    # At most one row per known table comes to the driver.
    return {
        row["name"]: read_table(
            spark,
            row["object"],
            schemas[row["name"]],
            infer,
            row["name"] in MULTILINE,
            malformed,
            junk,
        )
        for row in known.collect()
    }


def read_json(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str | None = None,
    document: bool = False,
) -> DataFrame:
    """JSON lines, or with `document` one JSON value per file. Broken input raises."""
    reader = spark.read.option("mode", "FAILFAST").option("multiLine", document)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.json(path)


def read_json_any(spark: SparkSession, path: str, document: bool = False) -> DataFrame:
    """JSON of unknown layout: `text` and `doc`, a variant that fields of any type are taken
    from by path. JSON lines, or with `document` one value per file, of which an array is
    one row for each element. Blank lines are left out; `doc` is null where the text doesn't
    begin with a JSON value, which `json_rejects` lists; what follows a value is passed
    over, as Spark's parser does."""
    text = spark.read.text(path, wholetext=document).withColumnRenamed("value", "text")
    parsed = text.filter(~F.col("text").rlike(r"^\s*$")).withColumn(
        "doc", F.try_parse_json("text")
    )
    if not document:
        return parsed
    # anything but an array is not split
    elements = F.coalesce(F.try_variant_get("doc", "$", "array<variant>"), F.array("doc"))
    return parsed.select("text", F.explode(elements).alias("doc"))


def json_rejects(df: DataFrame) -> DataFrame:
    """The texts that aren't JSON, as they stand."""
    return df.filter("doc IS NULL").select("text")
