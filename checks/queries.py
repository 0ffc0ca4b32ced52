"""The registered queries: each operator over whole stand-in tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from checks.standins import mixed_types, payment_lines, raw_tables, table
from ordermart.functions.columns import (
    fill_defaults as fill,
)
from ordermart.functions.columns import (
    null_flags as flags,
)
from ordermart.functions.columns import (
    parse_score,
    parse_timestamp,
)
from ordermart.operators import constraints, quality
from ordermart.operators.dedup import keep_one
from ordermart.operators.lookup import lookup_join
from ordermart.plans import dimensions as dims
from ordermart.plans import fact
from ordermart.plans.job import daily_job, dimensions, run_job
from ordermart.schemas import LANDING_KEYS, RAW, TABLES, load_order
from ordermart.session import shared_dir
from ordermart.sinks.landing import (
    has_landed,
    land_csv,
    land_files,
    land_json,
    landed_rejects,
)
from ordermart.sinks.warehouse import (
    ParquetWarehouse,
    key_audit,
    load_table,
    load_warehouse,
    replace_rows,
)
from ordermart.sinks.warehouse import content_audit as audit_of
from ordermart.sources import (
    json_rejects,
    read_json,
    read_json_any,
    read_table,
    read_tables,
)
from ordermart.sources.files import MALFORMED, scan_rejects
from ordermart.sources.inference import type_counts

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def plain(df: DataFrame) -> DataFrame:
    """Types that two engines show alike: wall-clock timestamps, doubles."""
    target = {T.TimestampType: "timestamp_ntz", T.DecimalType: "double", T.FloatType: "double"}
    return df.select(
        [
            F.col(f.name).cast(target[type(f.dataType)]).alias(f.name)
            if type(f.dataType) in target
            else F.col(f.name)
            for f in df.schema
        ]
    )


def query(build: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return plain(build(spark, sf_dir))

    QUERIES[build.__name__] = run
    return run


def stacked(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


# Sources and landing. What is written goes to the session's shared folder.


@query
def scan_csv_typed(spark, sf_dir):
    path = f"{shared_dir(spark)}/order_items.csv"
    land_csv(raw_tables(spark, sf_dir)["order_items"], path)
    return read_table(spark, path, RAW["order_items"])


@query
def scan_csv_inferred(spark, sf_dir):
    path = f"{shared_dir(spark)}/order_payments.csv"
    land_csv(raw_tables(spark, sf_dir)["order_payments"], path)
    inferred = read_table(spark, path, infer=True)
    return inferred.withColumn("order_id", F.col("order_id").cast("bigint"))


@query
def scan_csv_multiline(spark, sf_dir):
    path = f"{shared_dir(spark)}/documents.csv"
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    land_csv(documents, path)
    return read_table(spark, path, documents.schema, multiline=True)


def _source_files(spark, sf_dir, names) -> tuple[str, dict[str, str]]:
    """A folder, and below it the named raw tables as CSV sources."""
    root = shared_dir(spark)
    raw = raw_tables(spark, sf_dir)
    sources = {name: f"{root}/source/{name}.csv" for name in names}
    for name, path in sources.items():
        land_csv(raw[name], path)
    return root, sources


@query
def table_catalog(spark, sf_dir):
    root, sources = _source_files(spark, sf_dir, RAW)
    land_files(spark, sources, f"{root}/landing")
    tables = read_tables(spark, f"{root}/landing")
    return stacked(
        [
            df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), "n")
            for name, df in tables.items()
        ]
    )


@query
def land_parquet(spark, sf_dir):
    root, sources = _source_files(spark, sf_dir, ["orders"])
    landed = land_files(spark, sources, f"{root}/landing", parquet=True)
    if not has_landed(spark, landed["orders"], ".parquet"):
        raise RuntimeError("nothing landed")
    return spark.read.parquet(landed["orders"])


@query
def json_landing(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "value", "props")
    return read_json(spark, land_json(events, shared_dir(spark)), events.schema)


@query
def json_variant(spark, sf_dir):
    """Fields of JSON lines of several layouts, and the lines that are broken."""
    path = shared_dir(spark)
    whole = F.to_json(F.struct("event_id", "event_type", F.struct("value", "props").alias("more")))
    broken, other = F.col("event_id") % 10 == 0, F.col("event_id") % 4 == 1
    line = F.when(broken, F.left(whole, F.lit(20))).when(
        other, F.to_json(F.struct(F.col("event_id").cast("string").alias("event_id"), "user_id"))
    )
    events = table(spark, sf_dir, "events")
    events.select(F.coalesce(line, whole).alias("value")).write.text(path)
    read = read_json_any(spark, path)
    fields = {
        "event_id": ("$.event_id", "bigint"),
        "event_type": ("$.event_type", "string"),
        "value": ("$.more.value", "double"),
        "props": ("$.more.props", "string"),
        "user_id": ("$.user_id", "bigint"),
    }
    columns = [F.try_variant_get("doc", at, t).alias(name) for name, (at, t) in fields.items()]
    good = read.filter("doc IS NOT NULL").select(*columns, F.lit(None).cast("string").alias("reject"))
    bad = json_rejects(read).withColumnRenamed("text", "reject")
    return good.unionByName(bad, allowMissingColumns=True)


# What scans can't read.


def _broken_payments(spark, sf_dir) -> tuple[str, str]:
    """A folder, and in it a payments file with broken cells and rows."""
    root = shared_dir(spark)
    path = f"{root}/source/order_payments.csv"
    payment_lines(spark, sf_dir).write.text(path)
    return root, path


@query
def raw_type_rejects(spark, sf_dir):
    """Cells that their type can't hold, of a typed landing."""
    root, path = _broken_payments(spark, sf_dir)
    land_files(spark, {"order_payments": path}, root, parquet=True)
    return landed_rejects(spark, root).filter("column IS NOT NULL")


@query
def malformed_rows(spark, sf_dir):
    """Rows with too many or few cells, of a landing as text."""
    root, path = _broken_payments(spark, sf_dir)
    land_files(spark, {"order_payments": path}, root)
    return landed_rejects(spark, root)


@query
def inferred_rejects(spark, sf_dir):
    """Both, of a scan that finds the types itself."""
    _, path = _broken_payments(spark, sf_dir)
    read = read_table(spark, path, infer=True, malformed=MALFORMED, junk=0.2)
    return scan_rejects(read, MALFORMED)


@query
def inferred_types(spark, sf_dir):
    """How many cells of each raw column each type can hold."""
    _, sources = _source_files(spark, sf_dir, RAW)
    return stacked(
        [
            type_counts(
                read_table(spark, path, multiline=name == "order_reviews")
            ).select(F.lit(name).alias("table"), "*")
            for name, path in sources.items()
        ]
    )


# Quality.


@query
def null_flags(spark, sf_dir):
    return flags(raw_tables(spark, sf_dir)["products"])


@query
def null_profile(spark, sf_dir):
    return stacked(
        [
            quality.null_profile(df).select(F.lit(name).alias("table"), "*")
            for name, df in raw_tables(spark, sf_dir).items()
        ]
    )


@query
def fill_defaults(spark, sf_dir):
    return fill(mixed_types(spark, sf_dir))


@query
def filled_cells(spark, sf_dir):
    return quality.filled_cells(mixed_types(spark, sf_dir))


@query
def duplicate_rows(spark, sf_dir):
    return quality.duplicate_rows(raw_tables(spark, sf_dir)["geolocation"])


@query
def repeated_rows(spark, sf_dir):
    return quality.repeated_rows(raw_tables(spark, sf_dir)["order_reviews"], "n")


@query
def duplicate_report(spark, sf_dir):
    return stacked(
        [
            quality.duplicate_report(df).select(F.lit(name).alias("table"), "*")
            for name, df in raw_tables(spark, sf_dir).items()
        ]
    )


@query
def quality_report(spark, sf_dir):
    return quality.quality_report(raw_tables(spark, sf_dir))


@query
def distinct_rows(spark, sf_dir):
    return quality.distinct_rows(raw_tables(spark, sf_dir)["geolocation"])


@query
def preview_rows(spark, sf_dir):
    customers = raw_tables(spark, sf_dir)["customers"]
    return quality.preview(dims.customer_dim(customers), ["customer_id"], 10)


# Columns and filters.


def _parsed_reviews(spark, sf_dir):
    reviews = raw_tables(spark, sf_dir)["order_reviews"]
    dates = ["review_creation_date", "review_answer_timestamp"]
    return reviews.withColumns({c: parse_timestamp(F.col(c)) for c in dates})


@query
def parse_timestamps(spark, sf_dir):
    return _parsed_reviews(spark, sf_dir).select(
        "review_id", "order_id", "review_creation_date", "review_answer_timestamp"
    )


@query
def cast_score(spark, sf_dir):
    return raw_tables(spark, sf_dir)["order_reviews"].select(
        "review_id", "order_id", parse_score(F.col("review_score")).alias("review_score")
    )


@query
def drop_missing(spark, sf_dir):
    parsed = _parsed_reviews(spark, sf_dir)
    dated = parsed.na.drop(
        how="any", subset=["review_creation_date", "review_answer_timestamp"]
    )
    return dated.select("review_id", "order_id")


@query
def sentinel_filter(spark, sf_dir):
    return fact.timed_orders(quality.clean(raw_tables(spark, sf_dir)["orders"]))


@query
def rename_columns(spark, sf_dir):
    geolocation = raw_tables(spark, sf_dir)["geolocation"]
    return geolocation.withColumnsRenamed(dims.GEOLOCATION_NAMES)


# Joins, each on cleaned tables. Orders, customers, sellers and zip codes are the
# sides with one row per key.


def _cleaned(spark, sf_dir, *names):
    raw = raw_tables(spark, sf_dir)
    return [quality.clean(raw[name]) for name in names]


@query
def join_payments(spark, sf_dir):
    orders, payments = _cleaned(spark, sf_dir, "orders", "order_payments")
    return lookup_join(payments, orders, "order_id").select(
        "order_id",
        "order_status",
        "payment_sequential",
        "payment_type",
        "payment_installments",
        "payment_value",
    )


@query
def join_customers(spark, sf_dir):
    orders, customers = _cleaned(spark, sf_dir, "orders", "customers")
    return lookup_join(orders, customers, "customer_id").select(
        "order_id",
        "customer_id",
        "order_status",
        "customer_zip_code_prefix",
        "customer_city",
        "customer_state",
    )


@query
def join_items(spark, sf_dir):
    orders, items = _cleaned(spark, sf_dir, "orders", "order_items")
    return lookup_join(items, orders, "order_id").select(
        "order_id", "order_status", "order_item_id", "product_id", "seller_id", "price"
    )


@query
def join_sellers(spark, sf_dir):
    items, sellers = _cleaned(spark, sf_dir, "order_items", "sellers")
    known = sellers.select("seller_id").distinct()
    return lookup_join(items, known, "seller_id", "left_semi")


@query
def join_reviews(spark, sf_dir):
    orders, reviews = _cleaned(spark, sf_dir, "orders", "order_reviews")
    return lookup_join(reviews, orders, "order_id").select(
        "order_id", "order_status", "review_id", "review_score"
    )


@query
def join_geolocation(spark, sf_dir):
    customers, places = _cleaned(spark, sf_dir, "customers", "geolocation")
    zips = places.select(F.col(fact.GEO_ZIP).alias(fact.ZIP)).distinct()
    return lookup_join(customers, zips, fact.ZIP, "left_semi")


@query
def join_fanout(spark, sf_dir):
    raw = raw_tables(spark, sf_dir)
    return fact.join_fanout({name: quality.distinct_rows(df) for name, df in raw.items()})


# One row per key.


@query
def dedup_items(spark, sf_dir):
    items = raw_tables(spark, sf_dir)["order_items"]
    return keep_one(items, ["order_id"], ["order_item_id"])


@query
def dedup_reviews(spark, sf_dir):
    reviews = raw_tables(spark, sf_dir)["order_reviews"]
    latest = "review_answer_timestamp"
    return keep_one(reviews, ["review_id"], [latest, "order_id"], descending=[latest])


@query
def dedup_geolocation(spark, sf_dir):
    return keep_one(raw_tables(spark, sf_dir)["geolocation"], [fact.GEO_ZIP])


# Dimensions and the fact.


@query
def customer_dim(spark, sf_dir):
    return dims.customer_dim(raw_tables(spark, sf_dir)["customers"])


@query
def product_dim(spark, sf_dir):
    return dims.product_dim(raw_tables(spark, sf_dir)["products"])


@query
def order_items_dim(spark, sf_dir):
    return dims.order_items_dim(raw_tables(spark, sf_dir)["order_items"])


@query
def order_items_dim_by_item(spark, sf_dir):
    return dims.order_items_dim(raw_tables(spark, sf_dir)["order_items"], grain="item")


@query
def order_reviews_dim(spark, sf_dir):
    return dims.order_reviews_dim(raw_tables(spark, sf_dir)["order_reviews"])


@query
def geolocation_dim(spark, sf_dir):
    return dims.geolocation_dim(raw_tables(spark, sf_dir)["geolocation"])


@query
def seller_dim(spark, sf_dir):
    return dims.seller_dim(raw_tables(spark, sf_dir)["sellers"])


@query
def order_fact(spark, sf_dir):
    return fact.order_fact(raw_tables(spark, sf_dir))


@query
def order_fact_conformed(spark, sf_dir):
    raw = raw_tables(spark, sf_dir)
    return fact.order_fact_conformed(raw, dims.order_reviews_dim(raw["order_reviews"]))


# Rules of the warehouse tables.


@query
def type_rejects(spark, sf_dir):
    raw = raw_tables(spark, sf_dir)
    dear = raw["order_items"].withColumn("price", F.floor("price").cast("bigint") * 1500)
    return stacked(
        [
            constraints.type_rejects(raw["products"], TABLES["Products"]),
            constraints.type_rejects(dear, TABLES["Order_Items"]),
        ]
    )


@query
def length_rejects(spark, sf_dir):
    customers = raw_tables(spark, sf_dir)["customers"]
    long = customers.withColumns(
        {
            "customer_city": F.repeat("customer_city", F.lit(12)),
            "customer_state": F.left("customer_city", F.col("customer_zip_code_prefix")),
        }
    )
    return constraints.length_rejects(long, TABLES["Customers"])


@query
def pk_violations(spark, sf_dir):
    raw = raw_tables(spark, sf_dir)
    return stacked(
        [
            constraints.pk_violations(raw[name], TABLES[target])
            for name, target in (
                ("customers", "Customers"),
                ("sellers", "Sellers"),
                ("order_items", "Order_Items"),
            )
        ]
    )


def _star(spark, sf_dir) -> dict[str, DataFrame]:
    raw = raw_tables(spark, sf_dir)
    return {**dimensions(raw), "Orders": fact.order_fact(raw)}


@query
def fk_violations(spark, sf_dir):
    star = _star(spark, sf_dir)
    return stacked(
        [
            constraints.fk_violations(star[name], TABLES[name], star)
            for name in ("Order_Items", "Orders")
        ]
    )


# Loading.


@query
def append_new_only(spark, sf_dir):
    """A load of some reviews, then all of them twice: each must be there once."""
    raw = raw_tables(spark, sf_dir)
    reviews_table = TABLES["Order_Reviews"]
    reviews = constraints.conform(dims.order_reviews_dim(raw["order_reviews"]), reviews_table)
    warehouse = ParquetWarehouse(spark, shared_dir(spark))
    load_table(warehouse, reviews_table, reviews.filter("review_comment_title = '0'"))
    for _ in range(2):
        load_table(warehouse, reviews_table, reviews)
    return warehouse.read(reviews_table).select(
        "review_id", "order_id", "review_comment_title"
    )


def _written_star(spark, sf_dir) -> tuple[str, dict[str, DataFrame]]:
    """A run folder and the star schema in target types, written and read back."""
    root = shared_dir(spark)
    star = {}
    for name, df in _star(spark, sf_dir).items():
        path = f"{root}/{name}"
        constraints.conform(df, TABLES[name]).write.parquet(path)
        star[name] = spark.read.parquet(path)
    return root, star


@query
def load_twice(spark, sf_dir):
    root, star = _written_star(spark, sf_dir)
    warehouse = ParquetWarehouse(spark, f"{root}/warehouse")
    for _ in range(2):
        load_warehouse(warehouse, star, load_order())
    return stacked([_count(name, warehouse.read(TABLES[name])) for name in TABLES])


def _count(name: str, df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), "n")


@query
def load_audit(spark, sf_dir):
    root, star = _written_star(spark, sf_dir)
    warehouse = ParquetWarehouse(spark, f"{root}/warehouse")
    load_warehouse(warehouse, star, load_order())
    return stacked(
        [key_audit(star[n], warehouse.read(TABLES[n]), TABLES[n]) for n in TABLES]
    )


@query
def full_job(spark, sf_dir):
    """Raw CSV files in, run the job over them, count the target rows. The
    stand-ins break rules on purpose, so violations are only reported."""
    root = shared_dir(spark)
    for name, df in raw_tables(spark, sf_dir).items():
        land_csv(df, f"{root}/landing/{LANDING_KEYS[name]}")
    warehouse = ParquetWarehouse(spark, f"{root}/warehouse")
    raw = read_tables(spark, f"{root}/landing")
    run_job(
        spark, raw, warehouse, f"{root}/work", conformed=False, fail_on=(), stage_raw=True
    )
    return stacked([_count(name, warehouse.read(TABLES[name])) for name in TABLES])


# What a load leaves behind, cell by cell.


def _loaded(spark, sf_dir, name: str) -> DataFrame:
    """A table of the star schema in target types, loaded in two overlapping batches."""
    table = TABLES[name]
    df = constraints.conform(_star(spark, sf_dir)[name], table)
    root = shared_dir(spark)
    df.write.parquet(f"{root}/{name}")
    df = spark.read.parquet(f"{root}/{name}")
    warehouse = ParquetWarehouse(spark, f"{root}/warehouse")
    load_table(warehouse, table, df.filter(F.crc32(F.col(table.key[0])) % 3 == 0))
    load_table(warehouse, table, df)
    return warehouse.read(table)


@query
def loaded_orders(spark, sf_dir):
    return _loaded(spark, sf_dir, "Orders")


@query
def loaded_items(spark, sf_dir):
    return _loaded(spark, sf_dir, "Order_Items")


@query
def loaded_products(spark, sf_dir):
    return _loaded(spark, sf_dir, "Products").distinct()


@query
def loaded_reviews(spark, sf_dir):
    return _loaded(spark, sf_dir, "Order_Reviews")


@query
def content_audit(spark, sf_dir):
    """A target that lost rows, has some twice and others with a changed cell, found per
    table and month."""
    root, star = _written_star(spark, sf_dir)
    number = F.col("order_id").cast("bigint")
    changes = {"Orders": "order_status", "Order_Reviews": "review_comment_title"}
    audits = []
    for name, column in changes.items():
        kept = star[name].filter(number % 5 != 0)
        spoilt = kept.withColumn(column, F.when(number % 3 == 0, "other").otherwise(F.col(column)))
        warehouse = ParquetWarehouse(spark, f"{root}/warehouse")
        warehouse.append(TABLES[name], spoilt.unionAll(spoilt.filter(number % 7 == 0)))
        audits.append(audit_of(star[name], warehouse.read(TABLES[name]), TABLES[name]))
    audits.append(audit_of(star["Customers"], star["Customers"], TABLES["Customers"]))
    return stacked(audits)


@query
def replace_orders(spark, sf_dir):
    """A re-delivery of a quarter of the orders, some under another month, with new ones."""
    root, star = _written_star(spark, sf_dir)
    fact_table, orders = TABLES["Orders"], star["Orders"]
    warehouse = ParquetWarehouse(spark, f"{root}/warehouse")
    load_table(warehouse, fact_table, orders)
    number, bought = F.col("order_id").cast("bigint"), F.col("order_purchase_timestamp")
    later = F.when(number % 8 == 0, bought + F.expr("INTERVAL 40 DAYS")).otherwise(bought)
    again = orders.filter(number % 4 == 0).withColumns(
        {"order_status": F.lit("redelivered"), "order_purchase_timestamp": later}
    )
    new = orders.filter(number % 9 == 0).withColumn("order_id", F.concat(F.lit("n"), "order_id"))
    replace_rows(warehouse, fact_table, again.unionByName(new), f"{root}/months")
    return warehouse.read(fact_table)


@query
def daily_jobs(spark, sf_dir):
    """Three daily runs: the second finds a new orders file, the third nothing."""
    root = shared_dir(spark)
    for name, df in raw_tables(spark, sf_dir).items():
        if name == "orders":
            odd = F.col("order_id").cast("bigint") % 2 == 1
            land_csv(df.filter(~odd), f"{root}/source/1/{name}.csv")
            late = df.filter(odd)
        else:
            land_csv(df, f"{root}/source/1/{name}.csv")
    warehouse = ParquetWarehouse(spark, f"{root}/warehouse")
    counts = []
    for run in (1, 2, 3):
        if run == 2:
            land_csv(late, f"{root}/source/2/orders.csv")
        report = daily_job(
            spark, f"{root}/source", f"{root}/landing", warehouse, conformed=False, fail_on=()
        )
        if (report is None) != (run == 3):
            raise RuntimeError(f"run {run} read the wrong files")
        for name in TABLES:
            n = warehouse.read(TABLES[name]).count()
            counts.append((run, name, n))
    return spark.createDataFrame(counts, "run int, table string, n bigint")
