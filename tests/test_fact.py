import pytest
from checks.longway import all_combinations, order_fact_after_joins
from conftest import DAY, item, order, payment, review, rows
from hypothesis import HealthCheck, given
from hypothesis import settings as examples
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ordermart.operators.quality import distinct_rows
from ordermart.plans.dimensions import order_reviews_dim
from ordermart.plans.fact import join_fanout, order_fact, order_fact_conformed

NO_BROADCAST = {
    "spark__sql__autoBroadcastJoinThreshold": "-1",
    "spark__sql__adaptive__autoBroadcastJoinThreshold": "-1",
}
ALL = ["o1", "no_item", "no_payment", "no_review", "bad_seller", "bad_zip", "bad_customer"]


def incomplete(make_raw):
    """One complete order, and six that each lack one thing."""
    customer = {"bad_zip": "c2", "bad_customer": "nobody"}
    return make_raw(
        customers=[("c1", 1000, "town", "SP"), ("c2", 9999, "town", "SP")],
        orders=[order(o, customer.get(o, "c1")) for o in ALL],
        order_items=[
            item(o, seller="nobody" if o == "bad_seller" else "s1") for o in ALL if o != "no_item"
        ],
        order_payments=[payment(o) for o in ALL if o != "no_payment"],
        order_reviews=[review(f"r_{o}", o) for o in ALL if o != "no_review"],
    )


def ids(df):
    return sorted(r.order_id for r in df.select("order_id").collect())


@pytest.mark.parametrize("options", [{}, NO_BROADCAST])
def test_only_complete_orders(make_raw, settings, options):
    raw = incomplete(make_raw)
    with settings(**options):
        assert ids(order_fact(raw)) == ["o1"]
        assert rows(join_fanout(raw)) == [("o1", 1)]


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_the_row(make_raw, settings, ansi):
    with settings(spark__sql__ansi__enabled=ansi):
        row = order_fact(make_raw()).first().asDict()
    assert row == {
        "order_id": "o1",
        "customer_id": "c1",
        "seller_id": "s1",
        "zip_code_prefix": 1000,
        "review_id": "r1",
        "order_status": "delivered",
        "order_purchase_timestamp": DAY,
        "order_approved_at": DAY,
        "order_delivered_carrier_date": DAY,
        "order_delivered_customer_date": DAY,
        "order_estimated_delivery_date": DAY,
        "payment_sequential": 1,
        "payment_type": "credit_card",
        "payment_installments": 1,
        "payment_value": 11.5,
    }


@pytest.mark.parametrize("zone", ["UTC", "Europe/Kyiv", "America/Sao_Paulo"])
def test_a_missing_time_keeps_the_order_out(make_raw, settings, zone):
    def with_gap(i):
        return tuple(None if j == i else DAY for j in range(5))

    with settings(spark__sql__session__timeZone=zone):
        raw = make_raw(
            orders=[order(f"o{i}", times=with_gap(i)) for i in range(6)],
            order_items=[item(f"o{i}") for i in range(6)],
            order_payments=[payment(f"o{i}") for i in range(6)],
            order_reviews=[review(f"r{i}", f"o{i}") for i in range(6)],
        )
        assert ids(order_fact(raw)) == ["o5"]
        epoch = raw["orders"].withColumn(
            "order_approved_at", F.timestamp_seconds(F.lit(0))
        )
        assert ids(order_fact({**raw, "orders": epoch})) == []


def test_times_as_text(make_raw):
    raw = make_raw()
    text = raw["orders"].withColumn(
        "order_approved_at", F.date_format("order_approved_at", "yyyy-MM-dd HH:mm:ss")
    )
    assert order_fact({**raw, "orders": text}).first().order_approved_at == DAY
    junk = raw["orders"].withColumn("order_approved_at", F.lit("soon"))
    assert ids(order_fact({**raw, "orders": junk})) == []


def test_first_payment_first_known_seller_lowest_review(make_raw):
    raw = make_raw(
        sellers=[("s1", 1, "x", "SP"), ("s3", 1, "x", "SP")],
        order_items=[item("o1", 1, "unknown"), item("o1", 2, "s3"), item("o1", 3, "s1")],
        order_payments=[payment("o1", 3, 1.0), payment("o1", 2, 7.0), payment("o1", 2, 5.0)],
        order_reviews=[review("r2", "o1"), review("r1", "o1")],
    )
    row = order_fact(raw).first()
    assert (row.seller_id, row.payment_sequential, row.payment_value) == ("s3", 2, 5.0)
    assert row.review_id == "r1"
    assert rows(join_fanout(raw)) == [("o1", 2 * 3 * 2)]


def test_missing_keys_meet_each_other(make_raw):
    raw = make_raw(
        sellers=[(None, 1, "x", "SP")],
        order_items=[item("o1", seller=None)],
        customers=[(None, None, "x", "SP")],
        geolocation=[(None, 1.0, 1.0, "x", "SP")],
        orders=[order("o1", None)],
    )
    row = order_fact(raw).first()
    assert (row.customer_id, row.seller_id, row.zip_code_prefix) == ("0", "0", 0)


def test_repeated_orders_and_customers_give_one_row(make_raw):
    """An order id twice, once for a customer nobody knows; a customer id twice."""
    raw = make_raw(
        orders=[order("o1", "aaa"), order("o1", "c1"), order("o1", "c1", status="zzz")],
        customers=[("c1", 2000, "x", "SP"), ("c1", 1000, "y", "SP")],
        geolocation=[(1000, 1.0, 1.0, "x", "SP"), (2000, 1.0, 1.0, "x", "SP")],
    )
    assert rows(order_fact(raw).select("order_id", "customer_id", "zip_code_prefix")) == [
        ("o1", "c1", 1000)
    ]
    assert rows(order_fact(raw)) == rows(order_fact_after_joins(raw))


def test_conformed_fact_has_only_reviews_of_the_dimension(make_raw):
    raw = make_raw(
        orders=[order("o1"), order("o2")],
        order_items=[item("o1"), item("o2")],
        order_payments=[payment("o1"), payment("o2")],
        order_reviews=[review("r1", "o1", created="bad"), review("r2", "o2")],
    )
    assert ids(order_fact(raw)) == ["o1", "o2"]
    assert ids(order_fact_conformed(raw, order_reviews_dim(raw["order_reviews"]))) == ["o2"]


@pytest.mark.parametrize("partitions", [1, 8])
def test_row_order_and_partitions_do_not_matter(spark, partitions):
    from checks.standins import raw_tables

    raw = raw_tables(spark, "/root/testdata/sf0.001")
    shuffled = {n: df.orderBy(F.rand(3)).repartition(partitions) for n, df in raw.items()}
    assert rows(order_fact(shuffled)) == rows(order_fact(raw))


@pytest.mark.parametrize("options", [{}, NO_BROADCAST])
def test_same_as_the_long_way(spark, settings, options):
    from checks.standins import raw_tables

    raw = raw_tables(spark, "/root/testdata/sf0.001")
    with settings(**options):
        fact = order_fact(raw)
        assert rows(fact) == rows(order_fact_after_joins(raw))
        combinations = all_combinations(raw)
        assert set(rows(fact)) <= set(rows(combinations.drop("order_item_id")))
        counts = rows(combinations.groupBy("order_id").count())
        distinct = {n: distinct_rows(df) for n, df in raw.items()}
        assert rows(join_fanout(distinct)) == counts


KEYS = st.sampled_from(["o1", "o2", None])


@examples(
    max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)
@given(
    orders=st.lists(st.tuples(KEYS, st.sampled_from(["c1", "c2", None])), min_size=1, max_size=4),
    customers=st.lists(
        st.tuples(st.sampled_from(["c1", "c2", None]), st.sampled_from([1, 2, None])),
        min_size=1,
        max_size=4,
    ),
    items=st.lists(
        st.tuples(KEYS, st.integers(1, 3), st.sampled_from(["s1", "s2", None])),
        min_size=1,
        max_size=5,
    ),
    payments=st.lists(st.tuples(KEYS, st.integers(1, 3)), min_size=1, max_size=4),
    reviews=st.lists(st.tuples(st.sampled_from(["r1", "r2"]), KEYS), min_size=1, max_size=4),
)
def test_any_data_gives_what_the_long_way_gives(
    make_raw, orders, customers, items, payments, reviews
):
    raw = make_raw(
        orders=[order(o, c) for o, c in orders],
        customers=[(c, z, "t", "SP") for c, z in customers],
        geolocation=[(1, 1.0, 1.0, "t", "SP"), (1, 2.0, 1.0, "t", "SP"), (None, 1.0, 1.0, "t", "SP")],
        sellers=[("s1", 1, "t", "SP"), (None, 1, "t", "SP")],
        order_items=[item(o, n, s) for o, n, s in items],
        order_payments=[payment(o, n) for o, n in payments],
        order_reviews=[review(r, o) for r, o in reviews],
    )
    assert rows(order_fact(raw)) == rows(order_fact_after_joins(raw))
