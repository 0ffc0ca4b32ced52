import contextlib
import datetime
import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from ordermart.schemas import RAW  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .appName("ordermart-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def settings(spark):
    """Set session options for the length of a with block."""

    @contextlib.contextmanager
    def changed(**options):
        names = {k.replace("__", "."): v for k, v in options.items()}
        before = {k: spark.conf.get(k, None) for k in names}
        for k, v in names.items():
            spark.conf.set(k, v)
        try:
            yield
        finally:
            for k, v in before.items():
                spark.conf.unset(k) if v is None else spark.conf.set(k, v)

    return changed


DAY = datetime.datetime(2018, 3, 1, 12, 0, 0)
REVIEW_DAY = "2018-03-09 00:00:00"


def order(order_id, customer_id="c1", times=(DAY,) * 5, status="delivered"):
    return (order_id, customer_id, status, *times)


def item(order_id, number=1, seller="s1", product="p1", price=10.0):
    return (order_id, number, product, seller, DAY, price, 1.5)


def payment(order_id, sequential=1, value=11.5, kind="credit_card"):
    return (order_id, sequential, kind, 1, value)


def review(review_id, order_id, created=REVIEW_DAY, answered=REVIEW_DAY, score="5", message="ok"):
    return (review_id, order_id, score, None, message, created, answered)


@pytest.fixture
def make_raw(spark):
    """Raw tables from rows; the tables not given hold one complete order's surroundings."""
    base = {
        "customers": [("c1", 1000, "town", "SP")],
        "geolocation": [(1000, -1.0, -2.0, "town", "SP")],
        "sellers": [("s1", 2000, "city", "RJ")],
        "products": [("p1", "toys", 1, 100, 10, 20, 30)],
        "orders": [order("o1")],
        "order_items": [item("o1")],
        "order_payments": [payment("o1")],
        "order_reviews": [review("r1", "o1")],
    }

    def build(**tables):
        rows = {**base, **tables}
        return {name: spark.createDataFrame(rows[name], RAW[name]) for name in RAW}

    return build


def rows(df, *by):
    """Rows as plain tuples in a fixed order."""
    return sorted((tuple(r) for r in df.collect()), key=repr)
