"""The six dimension tables. Each takes raw tables and returns a lazy frame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordermart.functions.columns import fill_defaults, has_time, parse_score, parse_timestamp
from ordermart.operators.dedup import keep_one
from ordermart.operators.quality import clean
from ordermart.schemas import TABLES


def _columns(table: str) -> list[str]:
    return TABLES[table].columns.names


def customer_dim(customers: DataFrame) -> DataFrame:
    return clean(customers).select(*_columns("Customers"))


def product_dim(products: DataFrame) -> DataFrame:
    return clean(products).select(*_columns("Products"))


def seller_dim(sellers: DataFrame) -> DataFrame:
    return clean(sellers).select(*_columns("Sellers"))


# The next three keep one row per key out of a total order over the row. That
# removes copies of a row too, so they do without the shuffle of `clean`.


def order_items_dim(items: DataFrame, grain: str = "order") -> DataFrame:
    """One item per order, the one with the lowest number; with grain "item" one
    row per (order, item number), the key the warehouse table declares."""
    filled = fill_defaults(items.select(*_columns("Order_Items")))
    if grain == "item":
        return keep_one(filled, ["order_id", "order_item_id"])
    if grain == "order":
        return keep_one(filled, ["order_id"], ["order_item_id"])
    raise ValueError(f"unknown grain {grain!r}")


def order_reviews_dim(reviews: DataFrame) -> DataFrame:
    """Reviews with two readable dates, the latest answer per review id. A missing date
    is the epoch once it is filled, whatever the column's type."""
    dates = ["review_creation_date", "review_answer_timestamp"]
    types = {c: reviews.schema[c].dataType for c in dates}
    parsed = fill_defaults(reviews.select(*_columns("Order_Reviews"))).withColumns(
        {
            "review_score": parse_score(F.col("review_score")),
            **{c: parse_timestamp(F.col(c), types[c]) for c in dates},
        }
    )
    there = [has_time(F.col(c), parsed.schema[c].dataType) for c in dates]
    return keep_one(
        parsed.filter(there[0] & there[1]),
        ["review_id"],
        ["review_answer_timestamp", "order_id"],
        descending=["review_answer_timestamp"],
    )


# The geolocation columns' warehouse names.
GEOLOCATION_NAMES = {
    "geolocation_zip_code_prefix": "zip_code_prefix",
    "geolocation_lat": "latitude",
    "geolocation_lng": "longitude",
    "geolocation_city": "city",
    "geolocation_state": "state",
}


def geolocation_dim(geolocation: DataFrame) -> DataFrame:
    """One place per zip code prefix, the lowest."""
    renamed = fill_defaults(geolocation).withColumnsRenamed(GEOLOCATION_NAMES)
    return keep_one(renamed.select(*_columns("Geolocation")), ["zip_code_prefix"])
