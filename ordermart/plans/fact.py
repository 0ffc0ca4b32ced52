"""The order fact: one row per order out of a six-way star join.

Joining first and keeping one row per order afterwards would build payments x
items x reviews x places rows per order. Here every input is brought to one row
per key before it is joined, which leaves the same orders and a row that the
long way could have kept, but never more rows than the inputs have.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ordermart.functions.columns import fill_defaults, has_time, parse_timestamp
from ordermart.operators.dedup import keep_one
from ordermart.operators.lookup import lookup_join
from ordermart.schemas import ORDER_TIMES, TABLES

ZIP = "customer_zip_code_prefix"
GEO_ZIP = "geolocation_zip_code_prefix"


def timed_orders(orders: DataFrame) -> DataFrame:
    """Orders that have all five timestamps. The filter stands before the fill,
    where a columnar source can use it."""
    types = {c: orders.schema[c].dataType for c in ORDER_TIMES}
    parsed = orders.withColumns(
        {c: parse_timestamp(F.col(c), types[c]) for c in ORDER_TIMES}
    )
    types = {c: parsed.schema[c].dataType for c in ORDER_TIMES}
    return parsed.filter(
        reduce(Column.__and__, [has_time(F.col(c), types[c]) for c in ORDER_TIMES])
    )


def located_customers(customers: DataFrame, geolocation: DataFrame) -> DataFrame:
    """customer_id and zip code of the customers whose zip code is known, one
    row per customer. Of the places only the key matters, so this is a semi-join; it
    needs no distinct, behind which adaptive execution would not split a hot key."""
    zips = fill_defaults(geolocation.select(F.col(GEO_ZIP).alias(ZIP)))
    filled = fill_defaults(customers.select("customer_id", ZIP))
    located = filled.join(zips, ZIP, "left_semi")
    return located.groupBy("customer_id").agg(F.min(ZIP).alias("zip_code_prefix"))


def sold_items(items: DataFrame, sellers: DataFrame) -> DataFrame:
    """order_id and seller_id of each order's first item with a known seller.
    The seller is checked before the choice: the first item may lack one."""
    known = fill_defaults(sellers.select("seller_id"))
    filled = fill_defaults(items.select("order_id", "order_item_id", "seller_id"))
    sold = filled.join(known, "seller_id", "left_semi")
    return keep_one(sold, ["order_id"], ["order_item_id"]).drop("order_item_id")


def order_fact(
    raw: Mapping[str, DataFrame],
    reviews: DataFrame | None = None,
) -> DataFrame:
    """One row per order that has all timestamps, a payment, a located customer,
    an item with a known seller, and a review.

    Reviews are the raw ones unless given; see `order_fact_conformed`.
    """
    orders = fill_defaults(
        timed_orders(raw["orders"]).select(
            "order_id", "customer_id", "order_status", *ORDER_TIMES
        )
    )
    customers = located_customers(raw["customers"], raw["geolocation"])
    placed = keep_one(
        lookup_join(orders, customers, "customer_id"), ["order_id"]
    )
    payments = keep_one(
        fill_defaults(
            raw["order_payments"].select(
                "order_id",
                "payment_sequential",
                "payment_type",
                "payment_installments",
                "payment_value",
            )
        ),
        ["order_id"],
        ["payment_sequential"],
    )
    items = sold_items(raw["order_items"], raw["sellers"])
    if reviews is None:
        reviews = raw["order_reviews"]
    reviewed = (
        fill_defaults(reviews.select("order_id", "review_id"))
        .groupBy("order_id")
        .agg(F.min("review_id").alias("review_id"))
    )
    # All four are one row per order_id and already partitioned by it.
    joined = (
        placed.join(payments, "order_id").join(items, "order_id").join(reviewed, "order_id")
    )
    return joined.select(*TABLES["Orders"].columns.names)


def order_fact_conformed(
    raw: Mapping[str, DataFrame], order_reviews_dim: DataFrame
) -> DataFrame:
    """The fact with reviews out of the reviews dimension only, so that every
    review_id in it refers to a row there."""
    return order_fact(raw, order_reviews_dim)


def join_fanout(tables: Mapping[str, DataFrame]) -> DataFrame:
    """How many rows the six-way join of these tables has per order, worked out
    from counts per key without building the rows."""

    def counted(name: str, count: str, *columns: str) -> DataFrame:
        filled = fill_defaults(tables[name].select(*columns))
        return filled.groupBy(*columns).agg(F.count("*").alias(count))

    def total(df: DataFrame, key: str, a: str, b: str, name: str) -> DataFrame:
        return df.groupBy(key).agg(F.sum(F.col(a) * F.col(b)).alias(name))

    places = counted("geolocation", "n_places", GEO_ZIP).withColumnRenamed(GEO_ZIP, ZIP)
    customers = counted("customers", "n_customers", "customer_id", ZIP)
    located = total(
        lookup_join(customers, places, ZIP),
        "customer_id", "n_customers", "n_places", "n_located",
    )
    orders = (
        fill_defaults(timed_orders(tables["orders"]).select("order_id", "customer_id"))
        .groupBy("order_id", "customer_id")
        .agg(F.count("*").alias("n_orders"))
    )
    placed = total(
        lookup_join(orders, located, "customer_id"),
        "order_id", "n_orders", "n_located", "n_placed",
    )
    sellers = counted("sellers", "n_sellers", "seller_id")
    items = counted("order_items", "n_items", "order_id", "seller_id")
    sold = total(
        lookup_join(items, sellers, "seller_id"),
        "order_id", "n_items", "n_sellers", "n_sold",
    )
    payments = counted("order_payments", "n_payments", "order_id")
    reviews = counted("order_reviews", "n_reviews", "order_id")
    joined = placed.join(sold, "order_id").join(payments, "order_id").join(reviews, "order_id")
    product = F.col("n_placed") * F.col("n_sold") * F.col("n_payments") * F.col("n_reviews")
    return joined.select("order_id", product.alias("n_rows"))
