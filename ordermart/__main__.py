"""The whole job: python -m ordermart <raw folder> <warehouse folder or JDBC URL>"""

from __future__ import annotations

import argparse
import os
from collections.abc import Mapping

from pyspark.sql import SparkSession

from ordermart.plans.job import RULES, daily_job, run_job
from ordermart.session import build_session, object_store_conf
from ordermart.sinks.warehouse import JdbcWarehouse, ParquetWarehouse
from ordermart.sources import read_tables
from ordermart.sources.files import MALFORMED


def parser() -> argparse.ArgumentParser:
    args = argparse.ArgumentParser(prog="ordermart")
    args.add_argument("raw", help="folder with the eight CSV tables")
    args.add_argument("warehouse", help="folder, or jdbc: URL, the seven tables are loaded to")
    args.add_argument("--landing", help="folder to land new files in; only those are read")
    args.add_argument("--work", help="shared folder for intermediates")
    args.add_argument("--infer", action="store_true", help="infer column types")
    args.add_argument("--junk", type=float, default=0.0, help="with --infer: share of a column's cells that may not fit its type")
    args.add_argument("--item-grain", choices=["order", "item"], default="order")
    args.add_argument("--raw-reviews", action="store_true", help="the fact also uses reviews without dates")
    args.add_argument("--replace", action="store_true", help="orders delivered again replace their last delivery")
    args.add_argument("--fail-on", nargs="*", choices=RULES, default=list(RULES))
    args.add_argument("--s3a-package", help="coordinates of the S3A connector")
    args.add_argument("--jdbc-driver", help="class of the database's driver")
    args.add_argument("--jdbc-package", help="coordinates of the database's driver")
    args.add_argument("--batch-size", type=int, default=10_000, help="rows in one insert")
    args.add_argument("--connections", type=int, default=16, help="connections that write")
    args.add_argument("--key-bounds", nargs="+", action="append", default=[], metavar=("TABLE", "KEY"), help="key values that part a table's read; once per table")
    return args


def warehouse_of(
    spark: SparkSession, args: argparse.Namespace, env: Mapping[str, str] = os.environ
) -> ParquetWarehouse | JdbcWarehouse:
    """The target. A database's user and password come from the environment, as
    ORDERMART_DB_USER and ORDERMART_DB_PASSWORD."""
    if not args.warehouse.startswith("jdbc:"):
        return ParquetWarehouse(spark, args.warehouse)
    options = {"url": args.warehouse, "driver": args.jdbc_driver}
    options |= {"user": env.get("ORDERMART_DB_USER"), "password": env.get("ORDERMART_DB_PASSWORD")}
    return JdbcWarehouse(
        spark,
        {name: value for name, value in options.items() if value},
        batch_size=args.batch_size,
        connections=args.connections,
        key_bounds={table: keys for table, *keys in args.key_bounds},
    )


def main() -> None:
    args = parser().parse_args()
    packages = [p for p in (args.s3a_package, args.jdbc_package) if p]
    spark = build_session(conf=object_store_conf(package=",".join(packages) or None))
    warehouse = warehouse_of(spark, args)
    if args.replace and isinstance(warehouse, JdbcWarehouse):
        raise SystemExit("--replace needs a warehouse folder")
    options = {
        "work": args.work,
        "item_grain": args.item_grain,
        "conformed": not args.raw_reviews,
        "fail_on": tuple(args.fail_on),
        "replace": args.replace,
    }
    if args.landing:
        report = daily_job(spark, args.raw, args.landing, warehouse, **options)
    else:
        raw = read_tables(spark, args.raw, infer=args.infer, malformed=MALFORMED, junk=args.junk)
        report = run_job(spark, raw, warehouse, stage_raw=True, **options)
    if report is None:
        print("no new files")
    else:
        columns = report.quality.count()  # as many rows as the tables have columns
        report.quality.orderBy("table", "column").show(columns, truncate=False)
        months = report.audit.count()
        report.audit.orderBy("table", "month").show(months, truncate=False)
    spark.stop()


if __name__ == "__main__":
    main()
