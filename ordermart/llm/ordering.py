"""Places of rows in a total order, over a cluster: no task sees more than one range of
the order, however many rows share a key."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ordermart.llm.common import saved


def numbered(df: DataFrame, name: str = "uid") -> DataFrame:
    """The rows written with a number of their own, by which equal rows differ."""
    return saved(df.withColumn(name, F.monotonically_increasing_id()))


def placed(
    rows: DataFrame, by: Sequence[str], group: str | None = None, weight: str | None = None
) -> DataFrame:
    """The rows with `place`, how many rows of their group stand before them in the order
    of `by`, `before`, the weight of those rows, and `members`, the group's rows.

    `group`, if given, is the first of `by`. Nulls stand first. For rows to be told apart
    the last of `by` should be a number as from `numbered`; then the sort is cut into
    ranges of even size even where all rows are copies. Each range counts on its own in
    one pass; what stands before a range is added from a table of one row per range and
    group.
    """
    added = [("__run", T.IntegerType()), ("__place", T.LongType()), ("__before", T.LongType())]
    schema = T.StructType(rows.schema.fields + [T.StructField(n, t) for n, t in added])
    arrow = to_arrow_schema(schema)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = TaskContext.get().partitionId()
        last, place, load = None, 0, 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            weights = np.ones(n, np.int64)
            if weight:
                weights = batch.column(weight).to_numpy(zero_copy_only=False).astype(np.int64)
            before = np.cumsum(weights) - weights
            at = np.arange(n, dtype=np.int64)
            starts = np.zeros(1, np.int64)
            if group:
                keys = batch.column(group).to_pylist()
                starts = np.array([0] + [i for i in range(1, n) if keys[i] != keys[i - 1]])
                if last is None or keys[0] != last[0]:
                    place, load = 0, 0
                last = (keys[-1],)
            lengths = np.diff(np.append(starts, n))
            at -= np.repeat(starts, lengths)
            before -= np.repeat(before[starts], lengths)
            at[: lengths[0]] += place
            before[: lengths[0]] += load
            place, load = int(at[-1]) + 1, int(before[-1] + weights[-1])
            columns = [*batch.columns, pa.array([run] * n, pa.int32()), at, before]
            yield pa.RecordBatch.from_arrays(
                [c if isinstance(c, pa.Array) else pa.array(c) for c in columns], schema=arrow
            )

    ordered = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    runs = saved(ordered.mapInArrow(count, schema))
    keys = ["__run"] + ([group] if group else [])
    parts = runs.groupBy(*keys).agg(
        F.count("*").alias("__n"), F.sum(F.col(weight) if weight else F.lit(1)).alias("__w")
    )
    of_group = Window.partitionBy(*keys[1:])
    earlier = of_group.orderBy("__run").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(
        *keys,
        F.sum("__n").over(of_group).alias("members"),
        F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__n"),
        F.coalesce(F.sum("__w").over(earlier), F.lit(0)).alias("__w"),
    )
    met = runs.alias("r").join(
        parts.alias("p"), [F.col(f"r.{k}").eqNullSafe(F.col(f"p.{k}")) for k in keys]
    )
    return met.select(
        *[F.col(f"r.{c}") for c in rows.columns],
        (F.col("__place") + F.col("__n")).alias("place"),
        (F.col("__before") + F.col("__w")).alias("before"),
        "members",
    )
