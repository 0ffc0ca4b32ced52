"""Input layouts and warehouse tables, kept as data."""

from __future__ import annotations

from dataclasses import dataclass, field
from graphlib import TopologicalSorter

from pyspark.sql import types as T

STRING = T.StringType()
INT = T.IntegerType()
SMALLINT = T.ShortType()
FLOAT = T.FloatType()
DOUBLE = T.DoubleType()
TIMESTAMP = T.TimestampNTZType()  # wall-clock times, the same in every session zone
VARCHAR_255 = T.VarcharType(255)
VARCHAR_100 = T.VarcharType(100)
CHAR_2 = T.CharType(2)
DECIMAL_10_2 = T.DecimalType(10, 2)


def _layout(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, dtype) for name, dtype in columns.items()])


# The input files and their columns. Review dates and scores are
# text, so that junk and missing values reach the cleansing step as they are.
RAW: dict[str, T.StructType] = {
    "customers": _layout(
        customer_id=STRING,
        customer_zip_code_prefix=INT,
        customer_city=STRING,
        customer_state=STRING,
    ),
    "geolocation": _layout(
        geolocation_zip_code_prefix=INT,
        geolocation_lat=DOUBLE,
        geolocation_lng=DOUBLE,
        geolocation_city=STRING,
        geolocation_state=STRING,
    ),
    "order_items": _layout(
        order_id=STRING,
        order_item_id=INT,
        product_id=STRING,
        seller_id=STRING,
        shipping_limit_date=TIMESTAMP,
        price=DOUBLE,
        freight_value=DOUBLE,
    ),
    "order_payments": _layout(
        order_id=STRING,
        payment_sequential=INT,
        payment_type=STRING,
        payment_installments=INT,
        payment_value=DOUBLE,
    ),
    "order_reviews": _layout(
        review_id=STRING,
        order_id=STRING,
        review_score=STRING,
        review_comment_title=STRING,
        review_comment_message=STRING,
        review_creation_date=STRING,
        review_answer_timestamp=STRING,
    ),
    "orders": _layout(
        order_id=STRING,
        customer_id=STRING,
        order_status=STRING,
        order_purchase_timestamp=TIMESTAMP,
        order_approved_at=TIMESTAMP,
        order_delivered_carrier_date=TIMESTAMP,
        order_delivered_customer_date=TIMESTAMP,
        order_estimated_delivery_date=TIMESTAMP,
    ),
    "products": _layout(
        product_id=STRING,
        product_category_name=STRING,
        product_photos_qty=INT,
        product_weight_g=INT,
        product_length_cm=INT,
        product_height_cm=INT,
        product_width_cm=INT,
    ),
    "sellers": _layout(
        seller_id=STRING,
        seller_zip_code_prefix=INT,
        seller_city=STRING,
        seller_state=STRING,
    ),
}

# The files whose quoted text may hold line breaks. Only these are
# read with multiLine, which makes a file unsplittable.
MULTILINE = {"order_reviews"}

# Where landed files go below the landing root.
LANDING_KEYS = {name: f"csv_data/{name}.csv" for name in RAW}
LANDING_JSON_KEY = "json_data/countries.json"

# The timestamp format of the files, and the five order
# timestamps without which an order stays out of the fact table.
TIMESTAMP_PATTERN = r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$"
ORDER_TIMES = [
    "order_purchase_timestamp",
    "order_approved_at",
    "order_delivered_carrier_date",
    "order_delivered_customer_date",
    "order_estimated_delivery_date",
]


@dataclass(frozen=True)
class Table:
    """A warehouse table: columns with target types, primary key, foreign keys."""

    name: str
    key: tuple[str, ...]
    columns: T.StructType
    references: dict[str, str] = field(default_factory=dict)


# The warehouse tables.
TABLES: dict[str, Table] = {
    table.name: table
    for table in [
        Table(
            "Customers",
            ("customer_id",),
            _layout(
                customer_id=VARCHAR_255,
                customer_zip_code_prefix=INT,
                customer_city=VARCHAR_100,
                customer_state=CHAR_2,
            ),
        ),
        Table(
            "Products",
            ("product_id",),
            _layout(
                product_id=VARCHAR_255,
                product_category_name=VARCHAR_255,
                product_photos_qty=SMALLINT,
                product_weight_g=INT,
                product_length_cm=INT,
                product_height_cm=INT,
                product_width_cm=INT,
            ),
        ),
        Table(
            "Order_Reviews",
            ("review_id",),
            _layout(
                review_id=VARCHAR_255,
                order_id=VARCHAR_255,
                review_score=FLOAT,
                review_comment_title=VARCHAR_255,
                review_comment_message=STRING,
                review_creation_date=TIMESTAMP,
                review_answer_timestamp=TIMESTAMP,
            ),
        ),
        Table(
            "Geolocation",
            ("zip_code_prefix",),
            _layout(
                zip_code_prefix=INT,
                latitude=DOUBLE,
                longitude=DOUBLE,
                city=VARCHAR_100,
                state=CHAR_2,
            ),
        ),
        Table(
            "Sellers",
            ("seller_id",),
            _layout(
                seller_id=VARCHAR_255,
                seller_zip_code_prefix=INT,
                seller_city=VARCHAR_100,
                seller_state=CHAR_2,
            ),
        ),
        Table(
            "Order_Items",
            ("order_id", "order_item_id"),
            _layout(
                order_item_id=SMALLINT,
                order_id=VARCHAR_255,
                product_id=VARCHAR_255,
                seller_id=VARCHAR_255,
                shipping_limit_date=TIMESTAMP,
                price=DECIMAL_10_2,
                freight_value=DECIMAL_10_2,
            ),
            references={"product_id": "Products", "seller_id": "Sellers"},
        ),
        Table(
            "Orders",
            ("order_id",),
            _layout(
                order_id=VARCHAR_255,
                customer_id=VARCHAR_255,
                seller_id=VARCHAR_255,
                zip_code_prefix=INT,
                review_id=VARCHAR_255,
                order_status=VARCHAR_100,
                order_purchase_timestamp=TIMESTAMP,
                order_approved_at=TIMESTAMP,
                order_delivered_carrier_date=TIMESTAMP,
                order_delivered_customer_date=TIMESTAMP,
                order_estimated_delivery_date=TIMESTAMP,
                payment_sequential=SMALLINT,
                payment_type=VARCHAR_100,
                payment_installments=SMALLINT,
                payment_value=DECIMAL_10_2,
            ),
            references={
                "customer_id": "Customers",
                "seller_id": "Sellers",
                "zip_code_prefix": "Geolocation",
                "review_id": "Order_Reviews",
            },
        ),
    ]
}


def load_order() -> list[str]:
    """Table names with every referenced table before its referrer."""
    parents = {name: set(table.references.values()) for name, table in TABLES.items()}
    return list(TopologicalSorter(parents).static_order())
