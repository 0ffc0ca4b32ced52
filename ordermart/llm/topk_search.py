"""Exact top-k search by inner product: tiled matrix products and a merge tree.

Vectors become integers, floor(scale * x). Queries and rows are dealt into tiles of
bounded size; every pair of tiles is one matrix product, of which each query keeps
its best k. These short lists are merged over a tree of shards, so that no task sees
more than a few lists of a query.

Rows without an id, and vectors that are null, empty or hold null or non-finite
components, take no part. Only vectors of equal length are compared. A query's own
row is any with its id. Equal scores go to the smaller id. Repeated queries each get
their results; an empty table gives no rows. Components beyond a long count as its
bound, and so do scores.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ordermart.llm.common import saved

#: Shards whose lists of a query are merged at once.
FAN_IN = 16
#: Queries in one matrix product; bounds the scores held at once.
ROWS_AT_ONCE = 256
LONG = 2**63 - 1


def usable(vector: Column) -> Column:
    """Neither null nor empty, all components finite numbers."""
    bad = F.exists(
        vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == math.inf)
    )
    return vector.isNotNull() & (F.size(vector) > 0) & ~bad


def scores(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products: in doubles while every sum stays below 2^53."""
    bound = int(np.abs(queries.astype(object)).max()) * int(np.abs(rows.astype(object)).max())
    bound *= queries.shape[1]
    if bound < 2**53:
        return queries.astype(np.float64) @ rows.astype(np.float64).T
    if bound < 2**63:
        return queries @ rows.T
    return queries.astype(object) @ rows.astype(object).T


def best(found: np.ndarray, ids: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest scores without the query's own; `ids` grow, so equal scores keep
    the order of ids."""
    others = ids != own
    if not others.all():
        found, ids = found[others], ids[others]
    if len(ids) > k:
        if found.dtype == object:
            least = sorted(found, reverse=True)[k - 1]
        else:
            least = np.partition(found, len(ids) - k)[len(ids) - k]
        near = np.flatnonzero(found >= least)
        found, ids = found[near], ids[near]
    order = np.argsort(-found, kind="stable")[:k]
    return found[order], ids[order]


def search(
    vectors: DataFrame,
    is_query: Column,
    k: int = 5,
    scale: int = 256,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    shard_rows: int = 8192,
    query_rows: int = 2048,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best rows of each query."""
    rows = vectors.filter(F.col(id_col).isNotNull() & usable(F.col(vector_col))).select(
        F.col(id_col).cast("long").alias("vec_id"),
        F.transform(
            F.col(vector_col), lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))
        ).alias("v"),
        F.coalesce(is_query, F.lit(False)).alias("is_query"),
    )
    rows = saved(rows.withColumn("uid", F.monotonically_increasing_id()))
    n = rows.agg(F.count("*").alias("rows"), F.count_if("is_query").alias("queries")).first()
    shards = max(1, math.ceil(n["rows"] / shard_rows))
    groups = max(1, math.ceil(n["queries"] / query_rows))

    def dealt(tiles: int) -> Column:
        return F.pmod(F.xxhash64("uid"), F.lit(tiles)).cast("int")

    def each(tiles: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(tiles - 1)))

    tiled = rows.select("vec_id", "v", dealt(shards).alias("shard"), each(groups).alias("qgroup"))
    asked = rows.filter("is_query").select(
        F.col("uid").alias("quid"),
        F.col("vec_id").alias("query_id"),
        F.col("v").alias("asked"),
        dealt(groups).alias("qgroup"),
        each(shards).alias("shard"),
    )

    def product(queries: pd.DataFrame, tile: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(queries) and len(tile):
            shard = int(tile["shard"].iloc[0])
            tile = tile.sort_values("vec_id", kind="stable")
            for size, same in tile.groupby(tile["v"].map(len)):
                asking = queries[queries["asked"].map(len) == size]
                if not len(asking):
                    continue
                matrix = np.stack(same["v"].to_numpy()).astype(np.int64)
                ids = same["vec_id"].to_numpy()
                for at in range(0, len(asking), ROWS_AT_ONCE):
                    some = asking.iloc[at : at + ROWS_AT_ONCE]
                    found = scores(np.stack(some["asked"].to_numpy()).astype(np.int64), matrix)
                    for uid, own, row in zip(some["quid"], some["query_id"], found):
                        s, i = best(row, ids, own, k)
                        top = [
                            {"worse": -max(-LONG, min(LONG, int(a))), "vec_id": int(b)}
                            for a, b in zip(s, i)
                        ]
                        out.append((uid, own, shard, top))
        return pd.DataFrame(out, columns=["uid", "query_id", "shard", "top"])

    keys = ["qgroup", "shard"]
    lists = (
        asked.groupBy(keys)
        .cogroup(tiled.groupBy(keys))
        .applyInPandas(
            product,
            "uid long, query_id long, shard int, top array<struct<worse:long, vec_id:long>>",
        )
    )
    # one more merge than needed if all rows are in one shard: vectors of several
    # lengths give no second list for a query
    while True:
        lists = lists.withColumn("shard", F.floor(F.col("shard") / FAN_IN).cast("int"))
        lists = lists.groupBy("uid", "query_id", "shard").agg(
            F.slice(F.array_sort(F.flatten(F.collect_list("top"))), 1, k).alias("top")
        )
        shards = math.ceil(shards / FAN_IN)
        if shards <= 1:
            break
    placed = lists.select("query_id", F.posexplode("top").alias("place", "hit"))
    return placed.select(
        "query_id",
        (F.col("place") + 1).alias("rank"),
        F.col("hit.vec_id").alias("vec_id"),
        (-F.col("hit.worse")).alias("score"),
    )
