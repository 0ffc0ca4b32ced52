import pytest
from conftest import rows
from hypothesis import HealthCheck, given
from hypothesis import settings as examples
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ordermart.operators.dedup import keep_one


@pytest.mark.parametrize("partitions", [1, 8])
def test_row_order_and_partitions_do_not_matter(spark, partitions):
    df = spark.createDataFrame(
        [(k, n, v) for k in "abc" for n in (2, 1, 3) for v in ("y", "x", "z")],
        "k string, n int, v string",
    )
    for seed in (1, 2):
        shuffled = df.orderBy(F.rand(seed)).repartition(partitions)
        assert rows(keep_one(shuffled, ["k"], ["n"])) == [(k, 1, "x") for k in "abc"]


def test_descending_order_then_all_other_columns(spark):
    df = spark.createDataFrame(
        [("a", 1, "p"), ("a", 2, "q"), ("a", 2, "o"), (None, 1, "n")], "k string, n int, v string"
    )
    assert rows(keep_one(df, ["k"], ["n"], descending=["n"])) == [("a", 2, "o"), (None, 1, "n")]


def test_frame_of_keys_only(spark):
    df = spark.createDataFrame([(1, 2), (1, 2), (1, 3)], "a int, b int")
    assert rows(keep_one(df, ["a", "b"])) == [(1, 2), (1, 3)]


def test_one_row_per_key_leaves_each_map_task(spark):
    df = spark.range(1000).selectExpr("id % 3 AS k", "id AS v")
    plan = keep_one(df, ["k"])._jdf.queryExecution().executedPlan().toString()
    partial, shuffled = plan.index("Partial"), plan.index("Exchange")
    assert "WindowGroupLimit" in plan and partial > shuffled  # deeper in the tree


@examples(
    max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)
@given(
    st.lists(
        st.tuples(st.sampled_from("ab"), st.integers(0, 2), st.sampled_from(["x", None])),
        min_size=1,
        max_size=12,
    )
)
def test_deduplicating_twice_is_once(spark, data):
    df = spark.createDataFrame(data, "k string, n int, v string")
    once = keep_one(df, ["k"], ["n"])
    assert rows(keep_one(once, ["k"], ["n"])) == rows(once)
    assert {r[0] for r in rows(once)} == {k for k, _, _ in data}
    assert set(rows(once)) <= set(data)
