import pytest
from conftest import item, review, rows
from pyspark.sql import functions as F

from ordermart.plans import dimensions as dims


def test_customers_products_sellers(make_raw):
    raw = make_raw(
        customers=[("c1", None, None, "SP")] * 2 + [("c1", 0, "0", "SP")],
        products=[("p1", None, None, None, 1, 2, 3)],
        sellers=[(None, 7, "x", None)],
    )
    # The last row equals the first only after the fill, so both stay.
    assert rows(dims.customer_dim(raw["customers"])) == [("c1", 0, "0", "SP")] * 2
    assert rows(dims.product_dim(raw["products"])) == [("p1", "0", 0, 0, 1, 2, 3)]
    assert rows(dims.seller_dim(raw["sellers"])) == [("0", 7, "x", "0")]


def test_further_columns_stay_out(make_raw):
    wide = make_raw()["customers"].withColumn("extra", F.lit(1))
    assert dims.customer_dim(wide).columns == [
        "customer_id", "customer_zip_code_prefix", "customer_city", "customer_state",
    ]


def test_item_grain(make_raw):
    items = make_raw(order_items=[item("o1", 2), item("o1", 1), item("o1", 1), item("o2", 5)])[
        "order_items"
    ]
    by_order = dims.order_items_dim(items).select("order_id", "order_item_id")
    assert rows(by_order) == [("o1", 1), ("o2", 5)]
    by_item = dims.order_items_dim(items, "item").select("order_id", "order_item_id")
    assert rows(by_item) == [("o1", 1), ("o1", 2), ("o2", 5)]
    with pytest.raises(ValueError):
        dims.order_items_dim(items, "page")


def test_reviews_with_missing_or_junk_dates_go(make_raw):
    reviews = make_raw(
        order_reviews=[
            review("r1", "o1", created="bad"),
            review("r2", "o1", answered=None),
            review("r3", "o1", created=""),
            review("r4", "o1", score="bom"),
            review("r5", "o2", answered="2018-05-01 00:00:00"),
            review("r5", "o9", answered="2018-05-02 00:00:00"),
            review("r5", "o3", answered="2018-05-02 00:00:00"),
        ]
    )["order_reviews"]
    got = dims.order_reviews_dim(reviews).select("review_id", "order_id", "review_score")
    assert rows(got) == [("r4", "o1", None), ("r5", "o3", 5.0)]


def test_reviews_without_a_date_leave_whatever_its_type(spark, make_raw):
    reviews = make_raw(order_reviews=[review("r1", "o1", answered=None)])["order_reviews"]
    typed = reviews.withColumn(
        "review_answer_timestamp", F.col("review_answer_timestamp").cast("timestamp")
    )
    assert dims.order_reviews_dim(typed).count() == 0
    assert dims.order_reviews_dim(reviews).count() == 0


def test_geolocation(make_raw):
    places = make_raw(
        geolocation=[(1, 2.0, 3.0, "b", "SP"), (1, 2.0, 3.0, "a", "SP"), (None, None, None, None, None)]
    )["geolocation"]
    dim = dims.geolocation_dim(places)
    assert dim.columns == ["zip_code_prefix", "latitude", "longitude", "city", "state"]
    assert rows(dim) == [(0, 0.0, 0.0, "0", "0"), (1, 2.0, 3.0, "a", "SP")]


def test_missing_shipping_date_is_loaded_as_the_epoch(make_raw):
    late = [("o1", 1, "p1", "s1", None, 1.0, None)]
    dim = dims.order_items_dim(make_raw(order_items=late)["order_items"])
    assert rows(dim.select(F.col("shipping_limit_date").cast("string"), "freight_value")) == [("1970-01-01 00:00:00", 0.0)]
