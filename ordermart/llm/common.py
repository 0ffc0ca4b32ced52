"""What the operators share: tables, batches in Python workers, a shared folder."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ordermart.session import shared_dir

#: Rows that one call of a batch function gets; bounds a worker's memory.
SLICE_ROWS = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_slices(
    df: DataFrame,
    fn: Callable[[pa.RecordBatch], dict],
    schema: str,
    rows: int = SLICE_ROWS,
) -> DataFrame:
    """`fn` over slices of a frame's Arrow batches; it returns columns by name."""
    arrow = to_arrow_schema(T.StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                yield pa.RecordBatch.from_pydict(fn(batch.slice(at, rows)), schema=arrow)

    return df.mapInArrow(run, schema)


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """A text column; null counts as empty."""
    return [t or "" for t in batch.column(column).to_pylist()]


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only what a text operator needs, under fixed names, so no other column can clash."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))


def fresh(name: str, columns: Sequence[str]) -> str:
    """A name like this one that no column has."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def saved(df: DataFrame) -> DataFrame:
    """The frame written to the shared folder and read back: lineage ends here, and
    a lost executor costs nothing that was done before."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Remove the files of a saved frame that nothing needs any more."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)
