import pytest
from conftest import rows
from pyspark.sql import functions as F

from ordermart.operators.lookup import lookup_join


def skewed(spark):
    """A third of 900 rows on one key, exact copies among them; some keys unknown."""
    data = spark.range(900).selectExpr(
        "CASE WHEN id % 3 = 0 THEN '0' ELSE CAST(id % 40 AS STRING) END AS k",
        "id DIV 2 AS v",
    )
    return data.unionAll(data.filter("k = '0'"))


def lookup(spark):
    return spark.range(30).selectExpr("CAST(id AS STRING) AS k", "id * 10 AS w")


NO_BROADCAST = {
    "spark__sql__autoBroadcastJoinThreshold": "-1",
    "spark__sql__adaptive__autoBroadcastJoinThreshold": "-1",
}


@pytest.mark.parametrize("how", ["inner", "left_semi"])
@pytest.mark.parametrize("options", [{}, NO_BROADCAST])
def test_same_rows_as_a_plain_join(spark, settings, how, options):
    with settings(**options):
        got = lookup_join(skewed(spark), lookup(spark), "k", how)
        want = skewed(spark).join(lookup(spark), "k", how)
        assert got.columns == want.columns
        assert rows(got) == rows(want)


def test_a_small_lookup_is_broadcast_at_run_time(spark):
    grouped = lookup(spark).groupBy("k").agg(F.min("w").alias("w"))
    df = lookup_join(skewed(spark), grouped, "k")
    df.collect()
    assert "BroadcastHashJoin" in df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("how", ["inner", "left_semi"])
def test_a_hot_key_is_cut_into_pieces(spark, settings, tmp_path, how):
    """Half of the rows, from many files, on one key, with a lookup that is grouped by its
    key first: one join, one scan of the rows, and no task has the whole key."""
    path = str(tmp_path / "rows")
    data = spark.range(0, 400_000, 1, 16).selectExpr(
        "CASE WHEN id % 2 = 0 THEN 0L ELSE id END AS k", "id AS v", "uuid() AS wide"
    )
    data.write.parquet(path)
    one_each = spark.range(200_000).selectExpr("id * 2 AS k", "id AS w")
    one_each = one_each.unionAll(one_each).groupBy("k").agg(F.min("w").alias("w"))
    with settings(
        **NO_BROADCAST,
        spark__sql__shuffle__partitions="8",
        spark__sql__adaptive__coalescePartitions__enabled="false",
        spark__sql__adaptive__advisoryPartitionSizeInBytes="256k",
        spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes="256k",
        spark__sql__adaptive__skewJoin__skewedPartitionFactor="2",
        spark__sql__files__maxPartitionBytes="1m",
    ):
        df = lookup_join(spark.read.parquet(path), one_each, "k", how)
        tasks = df.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n"), F.max("wide"))
        sizes = [r["n"] for r in tasks.collect()]
        plan = tasks._jdf.queryExecution().executedPlan().toString()
    assert sum(sizes) == 200_000 and max(sizes) < 100_000
    final = plan.split("Initial Plan")[0]
    assert "skew=true" in final
    assert final.count("FileScan parquet") == 1 and final.count("Join") == 1


def test_refuses_other_joins(spark):
    with pytest.raises(ValueError):
        lookup_join(lookup(spark), lookup(spark), "k", "left")


def test_key_of_several_types(spark):
    numbers = spark.range(10).select(F.col("id").alias("k"))
    assert lookup_join(numbers, numbers.filter("k < 3"), "k", "left_semi").count() == 3
