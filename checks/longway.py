"""The long way: for the order fact all six joins in full, then one row per order; for a
load all keys of the target. Only tests and the bench use it, to measure against."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.standins import raw_tables
from ordermart.operators.dedup import keep_one
from ordermart.operators.quality import clean
from ordermart.plans.fact import GEO_ZIP, ZIP, timed_orders
from ordermart.schemas import ORDER_TIMES, TABLES
from ordermart.session import shared_dir


def all_combinations(raw: Mapping[str, DataFrame]) -> DataFrame:
    """Every row of the six-way join, with the fact's columns and the item number."""
    cleaned = {name: clean(df) for name, df in raw.items()}
    places = cleaned["geolocation"].select(F.col(GEO_ZIP).alias(ZIP))
    joined = (
        timed_orders(cleaned["orders"])
        .join(cleaned["order_payments"], "order_id")
        .join(cleaned["customers"].select("customer_id", ZIP), "customer_id")
        .join(
            cleaned["order_items"].select("order_id", "order_item_id", "seller_id"),
            "order_id",
        )
        .join(cleaned["sellers"].select("seller_id"), "seller_id")
        .join(cleaned["order_reviews"].select("order_id", "review_id"), "order_id")
        .join(places, ZIP)
    )
    return joined.withColumnRenamed(ZIP, "zip_code_prefix").select(
        *TABLES["Orders"].columns.names, "order_item_id"
    )


def order_fact_after_joins(raw: Mapping[str, DataFrame]) -> DataFrame:
    order = [
        "customer_id",
        "order_status",
        *ORDER_TIMES,
        "zip_code_prefix",
        "payment_sequential",
        "payment_type",
        "payment_installments",
        "payment_value",
        "order_item_id",
        "seller_id",
        "review_id",
    ]
    return keep_one(all_combinations(raw), ["order_id"], order).drop("order_item_id")


def order_fact_any_row(raw: Mapping[str, DataFrame]) -> DataFrame:
    """With an arbitrary row kept per order, as a plain dropDuplicates does."""
    combinations = all_combinations(raw).drop("order_item_id")
    return combinations.dropDuplicates(["order_id"])


def increment(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A batch of payments, half of them loaded already, and a target of ten times its
    size; both written."""
    payments = raw_tables(spark, sf_dir)["order_payments"]
    root = shared_dir(spark)
    payments.write.parquet(f"{root}/batch")
    copy = F.explode(F.array(*[F.lit(i) for i in range(10)]))
    held = payments.withColumn("copy", copy).filter("copy > 0 OR payment_sequential % 2 = 0")
    key = F.when(F.col("copy") > 0, F.concat_ws("-", "order_id", "copy")).otherwise(F.col("order_id"))
    held.withColumn("order_id", key).drop("copy").write.parquet(f"{root}/target")
    return spark.read.parquet(f"{root}/batch"), spark.read.parquet(f"{root}/target")


PAYMENT_KEY = ("order_id", "payment_sequential")


def new_rows_by_full_keys(batch: DataFrame, target: DataFrame) -> DataFrame:
    """The rows to append, with all keys of the target shuffled."""
    return batch.join(target.select(*PAYMENT_KEY), list(PAYMENT_KEY), "left_anti")
