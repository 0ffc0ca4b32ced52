"""The whole run: land, read, profile, build, check, load, audit."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ordermart.operators.constraints import (
    conform,
    fk_violations,
    pk_violations,
    value_rejects,
)
from ordermart.operators.quality import quality_report
from ordermart.plans.dimensions import (
    customer_dim,
    geolocation_dim,
    order_items_dim,
    order_reviews_dim,
    product_dim,
    seller_dim,
)
from ordermart.plans.fact import order_fact, order_fact_conformed
from ordermart.schemas import TABLES, load_order
from ordermart.session import remove_folder, shared_dir
from ordermart.sinks.landing import land_new, landed_tables, mark_loaded
from ordermart.sinks.warehouse import (
    FACT,
    content_audit,
    load_table,
    replace_rows,
    worth_thinning,
)
from ordermart.sources.files import MALFORMED, scan_rejects

RULES = ("row", "type", "length", "primary key", "foreign key")


class RuleViolation(Exception):
    """Rows break a rule that the run was told to fail on."""


@dataclass(frozen=True)
class JobReport:
    """What the run found; each is a frame over a written table."""

    quality: DataFrame
    violations: DataFrame
    audit: DataFrame


def dimensions(
    raw: Mapping[str, DataFrame], item_grain: str = "order"
) -> dict[str, DataFrame]:
    """The six dimension tables before type conversion, lazily."""
    return {
        "Customers": customer_dim(raw["customers"]),
        "Products": product_dim(raw["products"]),
        "Order_Items": order_items_dim(raw["order_items"], item_grain),
        "Order_Reviews": order_reviews_dim(raw["order_reviews"]),
        "Geolocation": geolocation_dim(raw["geolocation"]),
        "Sellers": seller_dim(raw["sellers"]),
    }


def value_violations(star: Mapping[str, DataFrame]) -> DataFrame:
    """Cells that do not fit their column: rule, table, column, key, n."""
    parts = [
        value_rejects(df, TABLES[name]).select(
            "rule", "table", "column", "key", F.lit(1).cast("bigint").alias("n")
        )
        for name, df in star.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def reject_violations(rejects: DataFrame) -> DataFrame:
    """Rejects of scans (table, column, text) as violations: cells break rule `type`, rows
    rule `row`, with their text as key."""
    return rejects.select(
        F.when(F.col("column").isNull(), "row").otherwise("type").alias("rule"),
        "table",
        "column",
        F.col("text").alias("key"),
        F.lit(1).cast("bigint").alias("n"),
    )


def scan_violations(raw: Mapping[str, DataFrame]) -> list[DataFrame]:
    """Cells and rows of raw tables that the scan could not read."""
    return [
        reject_violations(
            scan_rejects(df, MALFORMED).select(F.lit(name).alias("table"), "column", "text")
        )
        for name, df in raw.items()
        if MALFORMED in df.columns
    ]


def key_violations(star: Mapping[str, DataFrame]) -> DataFrame:
    """Broken primary and foreign keys: rule, table, column, key, n."""
    parts = []
    for name, df in star.items():
        table = TABLES[name]
        parts.append(
            pk_violations(df, table).select(
                F.lit("primary key").alias("rule"),
                "table",
                F.lit(",".join(table.key)).alias("column"),
                "key",
                "n",
            )
        )
        if table.references:
            parts.append(
                fk_violations(df, table, star).select(
                    F.lit("foreign key").alias("rule"), "table", "column", "key", "n"
                )
            )
    return reduce(DataFrame.unionByName, parts)


def _written(df: DataFrame, path: str) -> DataFrame:
    """Write and read back: later steps start from files, so that losing an
    executor costs no more than the step at hand, and nothing is computed twice."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def run_job(
    spark: SparkSession,
    raw: Mapping[str, DataFrame],
    warehouse,
    work: str | None = None,
    item_grain: str = "order",
    conformed: bool = True,
    fail_on: tuple[str, ...] = RULES,
    stage_raw: bool = False,
    rejects: DataFrame | None = None,
    replace: bool = False,
) -> JobReport:
    """Build the star schema from raw tables and append what is new to the
    warehouse. Running it again changes nothing. With `replace` orders that the warehouse
    has already are replaced by these, month by month.

    Raw tables are scanned several times; with `stage_raw`, meant for CSV, they
    are parsed once into columnar files that all later scans read. Tables with a
    MALFORMED column always are, and what their scan could not read is a violation, as
    are `rejects`, the like of an earlier step.

    The fact takes its reviews from the dimension; with `conformed=False` from the raw
    ones, whose unreadable dates then break the fact's reference to the dimension.

    Raises RuleViolation before the load if rows break a rule in `fail_on`, and after it
    if a written row is missing from the target, or with `replace` is another one there.
    Without a `work` folder of the caller only the report's tables stay.
    """
    own, work = work is None, work or shared_dir(spark)
    raw = {
        name: _written(df, f"{work}/raw/{name}")
        if stage_raw or MALFORMED in df.columns
        else df
        for name, df in raw.items()
    }
    unread = scan_violations(raw) + ([] if rejects is None else [reject_violations(rejects)])
    raw = {name: df.drop(MALFORMED) for name, df in raw.items()}
    quality = _written(quality_report(raw), f"{work}/quality")

    staged = {
        name: _written(df, f"{work}/{name}")
        for name, df in dimensions(raw, item_grain).items()
    }
    fact = (
        order_fact_conformed(raw, staged["Order_Reviews"])
        if conformed
        else order_fact(raw)
    )
    staged["Orders"] = _written(fact, f"{work}/Orders")
    star = {name: conform(df, TABLES[name]) for name, df in staged.items()}

    violations = value_violations(staged).unionByName(key_violations(star))
    found = _written(reduce(DataFrame.unionByName, unread, violations), f"{work}/violations")
    # One row per rule, of which there are five.
    counts = found.groupBy("rule").agg(F.count("*").alias("n")).collect()
    broken = {row["rule"]: row["n"] for row in counts if row["rule"] in fail_on}
    if broken:
        raise RuleViolation(f"{broken}; see {work}/violations")

    order = load_order()
    batch = {name: df.count() for name, df in staged.items()}  # by the files' footers
    for name in order:
        if replace and name == FACT:
            replace_rows(warehouse, TABLES[name], star[name], f"{work}/months")
        else:
            thin = worth_thinning(warehouse, TABLES[name], batch[name])
            load_table(warehouse, TABLES[name], star[name], thin)
    audits = []
    for name in order:
        table = TABLES[name]
        thin = worth_thinning(warehouse, table, batch[name])
        audits.append(content_audit(star[name], warehouse.read(table), table, thin))
    audit = _written(reduce(DataFrame.unionByName, audits), f"{work}/audit")
    lost = F.col("missing") > 0
    if replace:
        lost = lost | ((F.col("table") == FACT) & (F.col("changed") > 0))
    # One row per table and month.
    wrong = audit.filter(lost).select("table", "month", "missing", "changed").collect()
    if wrong:
        raise RuleViolation(f"rows missing from the target: {wrong}")
    if own:
        for name in ["raw", "months", *order]:
            remove_folder(spark, f"{work}/{name}")
    return JobReport(quality, found, audit)


def daily_job(
    spark: SparkSession, source: str, landing: str, warehouse, **options
) -> JobReport | None:
    """Land the files below `source` that are new, and load from all that has landed. A
    run without new files reads none and returns None. Files whose rows break a rule stop
    the load and count as new until a delivery of them passes."""
    new = land_new(spark, source, landing)
    if new is None:
        return None
    report = run_job(
        spark, landed_tables(spark, landing), warehouse, rejects=new.rejects, **options
    )
    mark_loaded(new, landing)
    return report
