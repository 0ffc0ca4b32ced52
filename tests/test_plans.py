"""What the plans must and must not contain."""

import pytest
from conftest import rows

import __spark_entry__ as contract
from ordermart.plans.fact import order_fact, timed_orders
from ordermart.schemas import RAW

LAZY = [
    "order_fact",
    "order_fact_conformed",
    "join_fanout",
    "customer_dim",
    "order_items_dim",
    "order_reviews_dim",
    "quality_report",
    "pk_violations",
    "type_rejects",
]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def stored(spark, tmp_path, make_raw):
    """Raw tables in Parquet."""
    raw = {}
    for name, df in make_raw().items():
        df.write.parquet(str(tmp_path / name))
        raw[name] = spark.read.schema(RAW[name]).parquet(str(tmp_path / name))
    return raw


@pytest.mark.parametrize("name", LAZY)
def test_no_python_and_no_pair_joins(spark, name):
    plan = plan_of(contract.queries()[name](spark, "/root/testdata/sf0.001"))
    for word in ("Python", "Cartesian", "NestedLoop", "Pandas", "collect_list"):
        assert word not in plan


def test_time_filter_reaches_the_scan(stored, settings):
    with settings(spark__sql__maxMetadataStringLength="5000"):
        plan = plan_of(timed_orders(stored["orders"]))
    assert "IsNotNull(order_purchase_timestamp)" in plan
    assert "Not(EqualTo(order_approved_at,1970-01-01" in plan


def test_scans_read_only_needed_columns(stored):
    plan = plan_of(order_fact(stored))
    assert "review_comment_message" not in plan
    assert "geolocation_lat" not in plan and "freight_value" not in plan


def test_large_joins_on_order_id_share_one_partitioning(stored, settings):
    with settings(spark__sql__autoBroadcastJoinThreshold="-1"):
        plan = plan_of(order_fact(stored))
    # Each of orders, payments, items and reviews is sent by order_id once.
    assert plan.count("Exchange hashpartitioning(order_id#") == 4
    assert rows(order_fact(stored))[0][0] == "o1"
