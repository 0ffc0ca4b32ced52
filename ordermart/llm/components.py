"""Connected components of links that are spread over the cluster.

Alternating stars: each node's larger neighbours are tied to its smallest one, then
its smaller ones. No task needs all neighbours of a node, and the number of links
never grows. Each round is written to the shared folder; the one before goes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordermart.llm.common import discard, saved


def large_star(links: DataFrame) -> DataFrame:
    both = links.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(
        links.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
    )
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    least = least.select("u", F.least("u", "m").alias("m"))
    return (
        both.join(least, "u")
        .filter("v > u")
        .select(F.col("v").alias("hi"), F.col("m").alias("lo"))
        .distinct()
    )


def small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("hi").agg(F.min("lo").alias("m"))
    moved = (
        links.join(least, "hi")
        .filter("lo > m")
        .select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    )
    return moved.union(least.select("hi", F.col("m").alias("lo"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """node and root (the component's smallest node) for every node of a link that
    is not itself a root. `links` has long columns a and b; links to itself and
    repeated ones don't matter."""

    def state(df: DataFrame) -> tuple:
        total = F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))
        return tuple(df.agg(F.count("*"), total).first())

    now = saved(
        links.filter("a != b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    )
    was = state(now)
    while was[0]:
        new = saved(small_star(large_star(now)))
        discard(now)
        now, is_ = new, state(new)
        if is_ == was:
            break
        was = is_
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
