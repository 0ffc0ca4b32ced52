"""Broken rows and cells from the files to the check, new files only, and time zones."""

import pytest
from conftest import item, order, payment, review, rows
from pyspark.sql import functions as F

from ordermart.plans.job import RuleViolation, daily_job, run_job
from ordermart.schemas import RAW, TABLES
from ordermart.sinks.landing import (
    land_csv,
    land_files,
    land_new,
    landed_rejects,
    landed_tables,
    new_files,
)
from ordermart.sinks.warehouse import ParquetWarehouse
from ordermart.sources import read_table, read_tables
from ordermart.sources.files import MALFORMED, scan_rejects
from ordermart.sources.inference import infer_schema, type_counts

SELLERS = "seller_id,seller_zip_code_prefix,seller_city,seller_state\n"
BROKEN = SELLERS + 's1,1,a,SP\ns2,zz,b,SP,more,cells\ns3,7\ns4,x,"q, ""u""",RJ\ns5,,,\n'
CELLS = [("seller_zip_code_prefix", "x"), ("seller_zip_code_prefix", "zz")]
ROWS = [(None, "s2,zz,b,SP,more,cells"), (None, "s3,7")]


def test_a_row_may_have_a_bad_cell_and_too_many(spark, tmp_path):
    path = tmp_path / "sellers.csv"
    path.write_text(BROKEN)
    read = read_table(spark, str(path), RAW["sellers"], malformed=MALFORMED)
    read.write.parquet(str(tmp_path / "t"))
    found = scan_rejects(spark.read.parquet(str(tmp_path / "t")), MALFORMED)
    assert rows(found) == sorted(CELLS + ROWS, key=repr)


@pytest.mark.parametrize("parquet", [True, False])
def test_landing_keeps_what_it_cannot_read(spark, tmp_path, parquet):
    path = tmp_path / "sellers.csv"
    path.write_text(BROKEN)
    root = str(tmp_path / "landing")
    landed = land_files(spark, {"sellers": str(path)}, root, parquet=parquet)
    want = [("sellers", *r) for r in (CELLS + ROWS if parquet else ROWS)]
    assert rows(landed_rejects(spark, root)) == sorted(want, key=repr)
    read = spark.read.parquet(landed["sellers"]) if parquet else read_tables(spark, root)["sellers"]
    assert read.columns == RAW["sellers"].names and read.count() == 5


def test_types_are_counted_cell_by_cell(spark):
    cells = ["1", "-2", "+3", "2147483648", "1.5", ".5e3", "1d", "true", "2018-01-01",
             "2018-01-01 10:00:00", "2018-13-01", "99999999999999999999", " 1", "x"]
    df = spark.createDataFrame([(c, None) for c in cells], "a string, b string")
    counts = {r["column"]: r for r in type_counts(df).collect()}
    assert counts["a"].asDict() == {
        "column": "a", "cells": 14, "int": 3, "bigint": 4, "double": 7, "boolean": 1, "date": 1,
        "timestamp_ntz": 2,
    }
    assert counts["b"]["cells"] == 0
    assert [f.dataType.simpleString() for f in infer_schema(df)] == ["string", "string"]
    some = df.limit(5)
    assert infer_schema(some, junk=0.3)["a"].dataType.simpleString() == "bigint"
    assert infer_schema(some)["a"].dataType.simpleString() == "double"


def test_inferred_scan_reports_rejects(spark, tmp_path):
    path = tmp_path / "sellers.csv"
    path.write_text(BROKEN)
    read = read_table(spark, str(path), infer=True, malformed=MALFORMED, junk=0.6)
    assert dict(read.dtypes)["seller_zip_code_prefix"] == "int"
    assert rows(scan_rejects(read, MALFORMED)) == sorted(CELLS + ROWS, key=repr)
    strict = read_table(spark, str(path), infer=True, malformed=MALFORMED)
    assert dict(strict.dtypes)["seller_zip_code_prefix"] == "string"
    assert rows(scan_rejects(strict, MALFORMED)) == ROWS



def scanned(spark, source, root):
    return rows(new_files(spark, source, root).select("name").distinct())


def test_a_daily_run_reads_only_new_files(spark, tmp_path, make_raw, monkeypatch):
    source, landing = str(tmp_path / "in"), str(tmp_path / "landing")
    warehouse = ParquetWarehouse(spark, str(tmp_path / "w"))
    for name, df in make_raw().items():
        land_csv(df, f"{source}/1/{name}.csv")
    assert len(scanned(spark, source, landing)) == len(RAW)
    assert daily_job(spark, source, landing, warehouse).audit.filter("NOT same").count() == 0
    assert warehouse.read(TABLES["Orders"]).count() == 1
    assert scanned(spark, source, landing) == []

    with monkeypatch.context() as m:
        m.setattr("ordermart.sinks.landing.read_table", None)  # any scan would fail
        assert daily_job(spark, source, landing, warehouse) is None

    more = make_raw(orders=[order("o2")], order_items=[item("o2")], order_payments=[payment("o2")],
                    order_reviews=[review("r2", "o2")])
    for name in ("orders", "order_items", "order_payments", "order_reviews"):
        land_csv(more[name], f"{source}/2/{name}.csv")
    assert len(scanned(spark, source, landing)) == 4
    daily_job(spark, source, landing, warehouse)
    assert rows(warehouse.read(TABLES["Orders"]).select("order_id")) == [("o1",), ("o2",)]


def test_a_broken_file_stops_the_run_until_it_is_delivered_again(spark, tmp_path, make_raw):
    source, landing = tmp_path / "in", str(tmp_path / "landing")
    warehouse = ParquetWarehouse(spark, str(tmp_path / "w"))
    for name, df in make_raw().items():
        if name != "sellers":
            land_csv(df, str(source / f"{name}.csv"))
    sellers = source / "sellers.csv"
    sellers.write_text(SELLERS + "s1,2000,city,RJ\ns2,zz,b,SP,more\n")
    for _ in range(2):
        with pytest.raises(RuleViolation, match="row"):
            daily_job(spark, str(source), landing, warehouse)
    assert warehouse.read(TABLES["Sellers"]).count() == 0

    sellers.write_text(SELLERS + "s1,2000,city,RJ\n")
    report = daily_job(spark, str(source), landing, warehouse)
    assert report.violations.count() == 0
    assert rows(landed_tables(spark, landing)["sellers"]) == [("s1", 2000, "city", "RJ")]
    assert rows(warehouse.read(TABLES["Sellers"]).select("seller_id")) == [("s1",)]


def test_midnight_that_a_zone_skips(spark, settings, tmp_path, make_raw):
    """On 2017-10-15 clocks in Sao Paulo went from 00:00 to 01:00."""
    skipped = "2017-10-15 00:00:00"

    def run(zone):
        root = tmp_path / zone.replace("/", "-")
        with settings(spark__sql__session__timeZone=zone):
            raw = make_raw(order_reviews=[review("r1", "o1", created=skipped, answered=skipped)])
            times = {c: F.lit(skipped).cast("timestamp_ntz") for c, t in raw["orders"].dtypes if t == "timestamp_ntz"}
            raw["orders"] = raw["orders"].withColumns(times)
            for name, df in raw.items():
                land_csv(df, str(root / "in" / f"{name}.csv"))
            warehouse = ParquetWarehouse(spark, str(root / "w"))
            run_job(spark, read_tables(spark, str(root / "in"), malformed=MALFORMED), warehouse)
            fact = warehouse.read(TABLES["Orders"]).selectExpr("CAST(order_purchase_timestamp AS STRING)")
            dim = warehouse.read(TABLES["Order_Reviews"]).selectExpr("CAST(review_creation_date AS STRING)")
            return rows(fact) + rows(dim)

    assert run("UTC") == run("America/Sao_Paulo") == [(skipped,), (skipped,)]


def test_new_rows_are_written_once(spark, tmp_path):
    """What lands is moved into place with what could not be read of it, in the place of an
    earlier delivery."""
    source, landing = tmp_path / "in", str(tmp_path / "landing")
    source.mkdir()
    for text, found in ((BROKEN, len(CELLS + ROWS)), (SELLERS + "s1,2000,city,RJ\n", 0)):
        (source / "sellers.csv").write_text(text)
        assert land_new(spark, str(source), landing).rejects.count() == found
        assert MALFORMED in spark.read.parquet(f"{landing}/sellers.parquet").columns
        assert landed_tables(spark, landing)["sellers"].count() == len(text.splitlines()) - 1
