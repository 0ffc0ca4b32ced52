"""Equi-joins to a side with one row per key that hold when a few keys hold
most of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordermart.functions.columns import quoted

_TAG = "__tag"


def lookup_join(
    rows: DataFrame, lookup: DataFrame, key: str, how: str = "inner"
) -> DataFrame:
    """`rows` inner or left-semi joined to `lookup`, which has one row per key.

    One plain join and one scan of either side, whatever their sizes. A lookup that
    turns out small is broadcast at run time by its measured size. Else adaptive
    execution cuts the partition of a hot key into pieces, each of which meets the
    lookup's few rows of it. It does so only for a side that is shuffled for the join
    itself, and a lookup mostly comes partitioned by its key already, from being brought
    to one row per key. So the join is on the key and a hash of it, which no side is
    partitioned by: both are shuffled here, and the lookup, the smaller side, once more.
    """
    if how not in ("inner", "left_semi"):
        raise ValueError(f"lookup_join does not do {how} joins")
    tag = F.expr(f"xxhash64({quoted(key)})")
    met = rows.withColumn(_TAG, tag).join(lookup.withColumn(_TAG, tag), [key, _TAG], how)
    return met.drop(_TAG)
