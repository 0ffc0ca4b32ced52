"""Sharding along a Hilbert curve over several metadata columns.

Each column is cut into cells that hold about equally many rows, so a skewed column
still spreads over the curve. A row's cells are a point on a grid; the rows are sorted
by the point's index on the Hilbert curve and the sequence is cut into runs. As the
curve stays near itself, each shard spans a narrow part of every column, and a reader
with a filter on any of them skips most files by their minima and maxima.

The sequence is cut by law `bytes` (each shard within one row of an equal share of all
bytes) or `rows` (numbers of rows at most one apart). A size is the text's UTF-8 bytes
plus `overhead`, so rows without a text count too.

Null (and NaN) in a column is its lowest cell. Rows of one cell are ordered by checksum
of the text, id, size and a number of the row, so that copies of a text in a cell lie
next to each other, and a cell, text or repeated row that holds a third of all rows is
cut like any other part of the sequence. Null ids and repeated rows are rows of their
own. A table with fewer rows than shards leaves shards empty; an empty table gives no
rows. Other columns of the table don't matter, whatever their names.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ordermart.llm.common import map_slices, saved
from ordermart.llm.ordering import numbered, placed

LAWS = ("bytes", "rows")
DIMENSIONS = ("lang", "source", "n_chars")


def curve_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """The index on the Hilbert curve of each row of grid coordinates below 2^bits.

    From the highest bit down, the part of the grid that a point lies in is turned so
    that the curve within it runs as the whole does; what is left is the Gray code of
    the index, bit by bit over the coordinates.
    """
    x = [np.array(c, dtype=np.int64) for c in cells.T]
    last = len(x) - 1
    for bit in range(bits - 1, 0, -1):
        below = (1 << bit) - 1
        for i in range(len(x)):
            there = (x[i] >> bit) & 1 == 1
            swap = np.where(there, 0, (x[0] ^ x[i]) & below)
            x[0] = np.where(there, x[0] ^ below, x[0] ^ swap)
            x[i] = x[i] ^ swap if i else x[0]
    for i in range(1, len(x)):
        x[i] = x[i] ^ x[i - 1]
    flip = np.zeros_like(x[0])
    for bit in range(bits - 1, 0, -1):
        flip ^= np.where((x[last] >> bit) & 1 == 1, (1 << bit) - 1, 0)
    index = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for c in x:
            index = (index << 1) | (((c ^ flip) >> bit) & 1)
    return index


def comparable(column: Column, dtype: T.DataType) -> Column:
    """The value, NaN as null."""
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return F.when(~F.isnan(column), column)
    return column


def cell_bounds(rows: DataFrame, column: str, bits: int) -> tuple[list, list[int]]:
    """The highest value of each cell that has rows, and the cell's number. Cells are
    equal parts of the rows in order of value; a value lies where its middle row does.
    At most 2^bits values come to the driver."""
    values = rows.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    spread = placed(values, [column], weight="n")
    total = spread.agg(F.sum("n")).first()[0]
    if not total:
        return [], []
    cell = F.expr(f"((2 * before + n) * {1 << bits}L) div {2 * total}L").cast("int")
    bounds = spread.groupBy(cell.alias("cell")).agg(F.max(column).alias("top")).collect()
    bounds.sort(key=lambda r: r["cell"])
    return [r["top"] for r in bounds], [r["cell"] for r in bounds]


def with_curve(rows: DataFrame, dims: Sequence[str], bits: int) -> DataFrame:
    """The rows with `curve`, their index, in place of the dimensions."""
    if len(dims) * bits > 62:
        raise ValueError("dimensions times bits may be 62 at most")
    bounds = {c: cell_bounds(rows, c, bits) for c in dims}
    kept = [c for c in rows.columns if c not in dims]
    schema = T.StructType([rows.schema[c] for c in kept] + [T.StructField("curve", T.LongType())])

    def index(batch: pa.RecordBatch) -> dict:
        cells = []
        for c in dims:
            tops, numbers = bounds[c]
            codes, different = pd.factorize(np.array([*batch.column(c).to_pylist(), None], object))
            found = [numbers[bisect_left(tops, v)] for v in different] + [0]  # code -1 is null
            cells.append(np.array(found, dtype=np.int64)[codes[:-1]])
        columns = {c: batch.column(c) for c in kept}
        return {**columns, "curve": curve_index(np.stack(cells, axis=1), bits)}

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    return map_slices(rows, index, ddl, rows=10_000)


def light_rows(docs: DataFrame, dims: Sequence[str], id_col: str, text_col: str, overhead: int):
    """Columns that decide a row's place: no text is sorted."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    named = [
        comparable(F.col(c), docs.schema[c].dataType).alias(f"dim{i}") for i, c in enumerate(dims)
    ]
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text) + overhead).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        *named,
        *([F.col("uid")] if "uid" in docs.columns else []),
    )


def cut(light: DataFrame, n_dims: int, shards: int, law: str, bits: int) -> DataFrame:
    """Shard and slot of numbered light rows."""
    if law not in LAWS:
        raise ValueError(f"law is one of {LAWS}")
    dims = [f"dim{i}" for i in range(n_dims)]
    order = ["curve", "text_crc32", "doc_id", "size", "uid"]
    rows = placed(with_curve(light, dims, bits), order, weight="size")
    total = light.agg(F.count("*").alias("rows"), F.sum("size").alias("bytes")).first()
    if law == "rows":
        shard = F.expr(f"(place * {shards}L) div {max(1, total['rows'])}L")
    else:
        shard = F.expr(f"((2 * before + size) * {shards}L) div {2 * max(1, total['bytes'] or 0)}L")
    rows = saved(rows.withColumn("shard", shard.cast("int")))
    first = rows.groupBy("shard").agg(F.min("place").alias("first"))
    met = rows.join(F.broadcast(first), "shard")  # one row per shard
    return met.withColumn("slot", F.col("place") - F.col("first")).drop("first", "place", "before", "members")


def assign(
    docs: DataFrame,
    shards: int = 24,
    law: str = "bytes",
    dims: Sequence[str] = DIMENSIONS,
    bits: int = 8,
    id_col: str = "doc_id",
    text_col: str = "text",
    overhead: int = 8,
) -> DataFrame:
    """doc_id, size, text_crc32, curve, shard, slot of every row."""
    light = numbered(light_rows(docs, dims, id_col, text_col, overhead))
    return cut(light, len(dims), shards, law, bits).drop("uid")


def write_shards(
    docs: DataFrame,
    path: str,
    shards: int = 24,
    law: str = "bytes",
    dims: Sequence[str] = DIMENSIONS,
    bits: int = 8,
    id_col: str = "doc_id",
    text_col: str = "text",
    overhead: int = 8,
    files: int = 1,
) -> None:
    """The whole table as `path/shard=N`, each shard in up to `files` files of neighbours on
    the curve. Full rows are shuffled once, to their files."""
    named = docs.select("*", F.monotonically_increasing_id().alias("uid"))
    clash = {"uid", "shard", "slot"} & {c.lower() for c in docs.columns}
    if clash:
        raise ValueError(f"columns of these names can't be written: {sorted(clash)}")
    rows = saved(named)
    light = light_rows(rows, dims, id_col, text_col, overhead)
    places = cut(saved(light), len(dims), shards, law, bits).select("uid", "shard", "slot")
    sizes = places.groupBy("shard").agg(F.count("*").alias("n"))
    part = F.floor(F.col("slot") * files / F.col("n")).cast("int")
    places = places.join(F.broadcast(sizes), "shard").withColumn("part", part)
    full = rows.join(places.drop("n"), "uid")
    dealt = full.repartitionByRange(shards * files, "shard", "part")
    ordered = dealt.sortWithinPartitions("shard", "slot").drop("uid", "slot", "part")
    ordered.write.partitionBy("shard").parquet(path)


def shard_digest(docs: DataFrame, shards: int = 24, law: str = "bytes") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, curve."""
    return assign(docs, shards, law).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit(law).alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "curve",
    )
