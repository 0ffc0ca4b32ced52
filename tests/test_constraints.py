import decimal

import pytest
from conftest import DAY, rows
from pyspark.sql import functions as F

from ordermart.operators.constraints import (
    conform,
    fk_violations,
    key_text,
    length_rejects,
    pk_violations,
    schema_frame,
    storage_schema,
    type_rejects,
)
from ordermart.schemas import TABLES, load_order

ITEM = "order_item_id int, order_id string, product_id string, seller_id string, "
ITEM += "shipping_limit_date timestamp, price double, freight_value double"


def items(spark):
    data = [
        (40000, "o1", "p", "s", DAY, 1.005, 2.0),
        (1, "o2", "p", "s", DAY, 12345678901.5, 99999999.99),
        (2, "o3", "p", "s", None, float("nan"), 99999999.995),
        (-32768, "o4", None, "s", DAY, -99999999.99, None),
    ]
    return spark.createDataFrame(data, ITEM)


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_values_a_type_cannot_hold(spark, settings, ansi):
    with settings(spark__sql__ansi__enabled=ansi):
        rejected = rows(type_rejects(items(spark), TABLES["Order_Items"]).select("key", "column"))
        assert rejected == [
            ("o1|40000", "order_item_id"), ("o2|1", "price"),
            ("o3|2", "freight_value"), ("o3|2", "price"),
        ]
        typed = conform(items(spark), TABLES["Order_Items"])
        assert typed.schema == storage_schema(TABLES["Order_Items"])
        kept = {r.order_id: r for r in typed.collect()}
    assert kept["o1"].order_item_id is None and kept["o1"].price == decimal.Decimal("1.01")
    assert kept["o2"].price is None and kept["o2"].freight_value == decimal.Decimal("99999999.99")
    assert kept["o4"].order_item_id == -32768


def test_different_keys_have_different_texts(spark):
    keys = [("a", None), (None, "a"), ("a|b", "c"), ("a", "b|c"), ("\\N", "a"), ("a\\", "|"), ("", "")]
    df = spark.createDataFrame(keys, "a string, b string")
    found = [r.t for r in df.select(key_text(["a", "b"]).alias("t")).collect()]
    assert found[:3] == ["a|\\N", "\\N|a", "a\\|b|c"]
    assert len(set(found)) == len(keys)


def test_fractions_round_to_whole_numbers(spark):
    names = TABLES["Order_Items"].columns.names
    given = [3.7, -3.5, 32767.4, 32767.5, float("nan"), None]
    df = spark.createDataFrame([(v,) for v in given], "order_item_id double")
    df = df.select("order_item_id", *[F.lit(None).alias(c) for c in names if c != "order_item_id"])
    typed = conform(df, TABLES["Order_Items"])
    assert [r.order_item_id for r in typed.collect()] == [4, -4, 32767, None, None, None]
    assert type_rejects(df, TABLES["Order_Items"]).filter("column = 'order_item_id'").count() == 2


def test_text_in_a_number_column(spark):
    df = spark.createDataFrame(
        [("r1", "o", "x", None, None, "bad", "2018-01-01 00:00:00"),
         ("r2", "o", "4", None, None, None, "2018-01-01 00:00:00")],
        ", ".join(f"{c} string" for c in TABLES["Order_Reviews"].columns.names),
    )
    rejected = rows(type_rejects(df, TABLES["Order_Reviews"]).select("key", "column", "value"))
    assert rejected == [("r1", "review_creation_date", "bad"), ("r1", "review_score", "x")]
    assert [r.review_score for r in conform(df, TABLES["Order_Reviews"]).collect()] == [None, 4.0]


def test_nothing_to_convert_rejects_nothing(spark):
    typed = spark.createDataFrame([], storage_schema(TABLES["Customers"]))
    assert type_rejects(typed, TABLES["Customers"]).count() == 0


def test_text_too_long(spark):
    df = spark.createDataFrame(
        [("c1", 1, "x" * 101, "ABC"), ("c2", 1, "é" * 100, "SP"), ("c" * 256, 1, None, None)],
        "customer_id string, customer_zip_code_prefix int, customer_city string, "
        "customer_state string",
    )
    rejected = rows(length_rejects(df, TABLES["Customers"]).select("key", "column"))
    assert rejected == [
        ("c1", "customer_city"), ("c1", "customer_state"), ("c" * 256, "customer_id"),
    ]


def test_primary_keys(spark):
    df = spark.createDataFrame(
        [("a", 1), ("a", 2), ("b", 1), ("b", 1), (None, 1)], "order_id string, order_item_id int"
    )
    assert rows(pk_violations(df, TABLES["Order_Items"])) == [
        ("Order_Items", "\\N|1", 1), ("Order_Items", "b|1", 2),
    ]
    assert rows(pk_violations(df, TABLES["Orders"]).select("key", "n")) == [
        ("", 1), ("a", 2), ("b", 2),
    ]


def test_foreign_keys(spark):
    items = spark.createDataFrame(
        [("p1", "s1"), ("p1", "s9"), ("p2", "s9"), (None, None)],
        "product_id string, seller_id string",
    )
    parents = {
        "Products": spark.createDataFrame([("p1",), ("s9",)], "product_id string"),
        "Sellers": spark.createDataFrame([("s1",), ("s1",), (None,)], "seller_id string"),
    }
    found = fk_violations(items, TABLES["Order_Items"], parents)
    assert rows(found) == [
        ("Order_Items", "product_id", "Products", "p2", 1),
        ("Order_Items", "seller_id", "Sellers", "s9", 2),
    ]


def test_schema_frame(spark):
    typed = spark.createDataFrame([], storage_schema(TABLES["Order_Items"]))
    assert rows(schema_frame(typed))[0] == (0, "order_item_id", "smallint")
    assert rows(schema_frame(typed))[5] == (5, "price", "decimal(10,2)")


def test_referenced_tables_load_first():
    order = load_order()
    assert sorted(order) == sorted(TABLES)
    for name, table in TABLES.items():
        assert all(order.index(parent) < order.index(name) for parent in table.references.values())
        for column, parent in table.references.items():
            assert TABLES[parent].key == (column,)
