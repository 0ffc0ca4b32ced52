"""The eight raw tables, derived from the whole test tables, with missing cells,
junk and copies put in by expressions. A third of the items lack their seller and
a fifth of the orders their customer, so that after the fill one key holds them
all. `checks/oracle.py` states the same in SQL."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from ordermart.schemas import ORDER_TIMES, RAW


# The test tables' columns. A stated schema saves a job per read.
SCHEMAS = {
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, "
    "c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
    "p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, "
    "o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
    "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
    "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
    "value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def _with_copies(df: DataFrame, condition: str) -> DataFrame:
    return df.unionAll(df.filter(condition))


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = _with_copies(table(spark, sf_dir, "orders"), "o_totalprice > 450000")
    times = [
        f"CASE WHEN (o_orderkey + {k}) % 11 <> 0 THEN o_orderdate + INTERVAL {k} DAYS END AS {c}"
        for k, c in enumerate(ORDER_TIMES, start=1)
    ]
    return base.selectExpr(
        "CAST(o_orderkey AS STRING) AS order_id",
        "CASE WHEN o_orderpriority <> '5-LOW' THEN CAST(o_custkey AS STRING) END AS customer_id",
        "o_orderstatus AS order_status",
        *times,
    )


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = _with_copies(table(spark, sf_dir, "customer"), "c_acctbal > 9000")
    return base.selectExpr(
        "CAST(c_custkey AS STRING) AS customer_id",
        "c_nationkey AS customer_zip_code_prefix",
        "CASE WHEN c_acctbal >= 0 THEN c_mktsegment END AS customer_city",
        "lpad(CAST(c_nationkey AS STRING), 2, '0') AS customer_state",
    )


def geolocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").selectExpr(
        "s_nationkey AS geolocation_zip_code_prefix",
        "CAST(floor(s_acctbal / 2500) AS DOUBLE) * 2.5D AS geolocation_lat",
        "CAST(s_nationkey AS DOUBLE) AS geolocation_lng",
        "CASE WHEN s_acctbal >= 0 THEN concat('City ', s_nationkey) END AS geolocation_city",
        "lpad(CAST(s_nationkey AS STRING), 2, '0') AS geolocation_state",
    )


def order_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(
        "CAST(l_orderkey AS STRING) AS order_id",
        "l_linenumber AS order_item_id",
        "CASE WHEN l_discount > 0 THEN CAST(l_partkey AS STRING) END AS product_id",
        "CASE WHEN l_returnflag <> 'N' THEN CAST(l_suppkey AS STRING) END AS seller_id",
        "CASE WHEN l_returnflag <> 'R' THEN l_shipdate END AS shipping_limit_date",
        "l_extendedprice AS price",
        "l_quantity AS freight_value",
    )


def order_payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(
        "CAST(l_orderkey AS STRING) AS order_id",
        "l_linenumber AS payment_sequential",
        "l_returnflag AS payment_type",
        "CASE WHEN l_quantity <= 45 THEN CAST(l_quantity AS INT) END AS payment_installments",
        "l_extendedprice AS payment_value",
    )


def order_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = _with_copies(table(spark, sf_dir, "events"), "value > 200")
    written = "date_format({}, 'yyyy-MM-dd HH:mm:ss')"
    return base.selectExpr(
        "concat(user_id, '-', event_type) AS review_id",
        "CAST(event_id DIV 2 AS STRING) AS order_id",
        "CASE WHEN event_type = 'error' THEN 'n/a' "
        "ELSE CAST(CAST(floor(value) AS BIGINT) AS STRING) END AS review_score",
        "CASE WHEN value < 100 THEN event_type END AS review_comment_title",
        "props AS review_comment_message",
        "CASE WHEN event_id % 13 = 0 THEN 'bad' "
        f"ELSE {written.format('ts')} END AS review_creation_date",
        "CASE WHEN event_id % 17 <> 0 "
        f"THEN {written.format('ts + INTERVAL 1 DAY')} END AS review_answer_timestamp",
    )


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = _with_copies(table(spark, sf_dir, "part"), "p_size > 45")
    return base.selectExpr(
        "CAST(p_partkey AS STRING) AS product_id",
        "CASE WHEN p_size <= 30 THEN p_type END AS product_category_name",
        "CAST(p_partkey * 20 AS INT) AS product_photos_qty",
        "CAST(floor(p_retailprice) AS INT) AS product_weight_g",
        "p_size + 10 AS product_length_cm",
        "CASE WHEN p_size <= 40 THEN p_size * 2 END AS product_height_cm",
        "p_size AS product_width_cm",
    )


def sellers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").selectExpr(
        "CASE WHEN s_suppkey = 0 THEN NULL WHEN s_suppkey % 10 = 0 "
        "THEN concat('closed ', s_suppkey) ELSE CAST(s_suppkey AS STRING) END AS seller_id",
        "s_nationkey AS seller_zip_code_prefix",
        "CASE WHEN s_acctbal >= 0 THEN s_name END AS seller_city",
        "lpad(CAST(s_nationkey AS STRING), 2, '0') AS seller_state",
    )


RAW_TABLES = {
    "customers": customers,
    "geolocation": geolocation,
    "order_items": order_items,
    "order_payments": order_payments,
    "order_reviews": order_reviews,
    "orders": orders,
    "products": products,
    "sellers": sellers,
}


class _RawTables(Mapping):
    """The raw tables by name, each built when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._source, self._built = (spark, sf_dir), {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._built:
            self._built[name] = RAW_TABLES[name](*self._source)
        return self._built[name]

    def __iter__(self):
        return iter(RAW_TABLES)

    def __len__(self):
        return len(RAW_TABLES)


def raw_tables(spark: SparkSession, sf_dir: str) -> Mapping[str, DataFrame]:
    return _RawTables(spark, sf_dir)


def mixed_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineitem cells of every basic type, each missing somewhere, NaN included."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey AS id",
        "CASE WHEN l_linenumber <> 1 THEN l_linenumber END AS whole",
        "CASE WHEN l_quantity < 10 THEN CAST('NaN' AS DOUBLE) "
        "WHEN l_quantity < 20 THEN NULL ELSE l_extendedprice END AS real",
        "CASE WHEN l_returnflag <> 'R' THEN l_returnflag END AS text",
        "CASE WHEN l_linenumber <> 2 THEN l_linestatus = 'O' END AS flag",
        "CASE WHEN l_linenumber <> 3 THEN l_shipdate END AS moment",
        "CASE WHEN l_linenumber <> 4 THEN CAST(l_shipdate AS DATE) END AS day",
    )


def payment_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a payments file, header first in each part, with junk in some cells, cells
    too many or too few in some rows, and some rows that a line break splits in two."""
    first = "monotonically_increasing_id() & ((1L << 33) - 1) = 0"
    junk = "l_orderkey % 7 = 0"
    line = f"""concat(l_orderkey, ',', IF({junk}, 'x', ''), l_linenumber, ',', l_returnflag,
        CASE WHEN l_orderkey % 13 = 0 THEN '' ELSE concat(
            ',', IF(l_quantity <= 45, CAST(CAST(l_quantity AS INT) AS STRING), ''),
            ',', IF(l_orderkey % 17 = 0, 'R$ 5', CAST(l_extendedprice AS STRING))) END,
        IF(l_orderkey % 11 = 0, ',more', ''))"""
    split = """array(concat(l_orderkey, ',', l_linenumber, ',"', l_returnflag),
        concat(l_returnflag, '",', CAST(l_quantity AS INT), ',', CAST(l_extendedprice AS STRING)))"""
    lines = table(spark, sf_dir, "lineitem").selectExpr(
        f"{first} AS first",
        f"""CASE WHEN l_orderkey % 19 = 0 AND l_linenumber = 1 AND l_orderkey % 7 <> 0
                AND l_orderkey % 11 <> 0 AND l_orderkey % 13 <> 0 AND l_orderkey % 17 <> 0
            THEN {split} ELSE array({line}) END AS lines""",
    )
    header = ",".join(RAW["order_payments"].names)
    return lines.selectExpr(f"explode(IF(first, concat(array('{header}'), lines), lines)) AS line")
