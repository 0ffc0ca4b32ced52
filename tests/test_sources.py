import json

import pytest
from conftest import DAY, rows
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ordermart.schemas import RAW
from ordermart.session import build_session, object_store_conf, shared_dir
from ordermart.sinks.landing import has_landed, land_csv, land_files, land_json
from ordermart.sources import (
    json_rejects,
    list_objects,
    read_json,
    read_json_any,
    read_table,
    read_tables,
    table_objects,
)
from ordermart.sources.inference import SPELLINGS, as_type, type_counts

REVIEWS = (
    "review_id,order_id,review_score,review_comment_title,review_comment_message,"
    "review_creation_date,review_answer_timestamp\n"
    'r1,o1,5,,"two\nlines, and a comma",2018-01-01 00:00:00,2018-01-02 00:00:00\n'
    'r2,o2,4,"said ""yes""",  padded ,2018-01-01 00:00:00,\n'
)


def test_quoted_line_breaks_commas_and_quotes(spark, tmp_path):
    path = tmp_path / "order_reviews.csv"
    path.write_text(REVIEWS)
    got = rows(read_table(spark, str(path), RAW["order_reviews"], multiline=True))
    assert [r[4] for r in got] == ["two\nlines, and a comma", "  padded "]
    assert [r[3] for r in got] == [None, 'said "yes"']
    assert got[1][6] is None
    assert read_table(spark, str(path), RAW["order_reviews"]).count() == 3  # split in two


def test_columns_are_found_by_name(spark, tmp_path):
    path = tmp_path / "customers.csv"
    path.write_bytes(
        b"\xef\xbb\xbfcustomer_id,customer_unique_id,customer_state,customer_zip_code_prefix,"
        b"customer_city\r\nc1,u1,SP,01000,town\r\n"
    )
    got = read_table(spark, str(path), RAW["customers"])
    assert got.dtypes == [
        ("customer_id", "string"), ("customer_unique_id", "string"), ("customer_state", "string"),
        ("customer_zip_code_prefix", "int"), ("customer_city", "string"),
    ]
    assert rows(got) == [("c1", "u1", "SP", 1000, "town")]


def test_files_with_different_headers_raise(spark, tmp_path):
    folder = tmp_path / "t.csv"
    folder.mkdir()
    (folder / "part-0.csv").write_text("a,b\n1,2\n")
    (folder / "part-1.csv").write_text("b,a\n2,1\n")
    with pytest.raises(Exception, match="header"):
        read_table(spark, str(folder), T.StructType().add("a", "integer").add("b", "integer")).collect()


def test_inference_and_no_schema(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("a,b,c\n1,x,2018-01-01 00:00:00\n2,y,2018-01-01 10:00:00\n")
    inferred = read_table(spark, str(path), infer=True).dtypes
    assert inferred == [("a", "int"), ("b", "string"), ("c", "timestamp_ntz")]
    assert {t for _, t in read_table(spark, str(path)).dtypes} == {"string"}


def test_listing_keeps_csv_only_and_last_of_a_name_wins(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "b").mkdir()
    header = "seller_id,seller_zip_code_prefix,seller_city,seller_state\n"
    (tmp_path / "a" / "sellers.csv").write_text(header + "old,1,x,SP\n")
    (tmp_path / "b" / "sellers.csv").write_text(header + "new,2,y,RJ\n")
    (tmp_path / "b" / "sellers.txt").write_text(header)
    (tmp_path / "b" / "other.csv").write_text("z\n1\n")
    root = str(tmp_path)
    assert list_objects(spark, root).count() == 3
    names = dict((r["name"], r["object"]) for r in table_objects(spark, root).collect())
    assert names["sellers"].endswith("/b/sellers.csv") and set(names) == {"sellers", "other"}
    tables = read_tables(spark, root)
    assert set(tables) == {"sellers"}
    assert rows(tables["sellers"]) == [("new", 2, "y", "RJ")]


def test_landing_and_reading_back(spark, tmp_path, make_raw):
    raw = make_raw(customers=[("c1", None, "", "SP"), ("c2", 5, ' "q", \\ ', None)])
    raw["customers"] = raw["customers"].replace("", None)  # as read back
    sources = {}
    for name, df in raw.items():
        sources[name] = str(tmp_path / "in" / f"{name}.csv")
        land_csv(df, sources[name])
    landed = land_files(spark, sources, str(tmp_path / "landing"))
    assert landed["orders"].endswith("/landing/csv_data/orders.csv")
    assert all(has_landed(spark, path) for path in landed.values())
    back = read_tables(spark, str(tmp_path / "landing"))
    assert set(back) == set(RAW)
    for name, df in raw.items():
        assert rows(back[name]) == rows(df), name
        assert back[name].dtypes == df.dtypes

    typed = land_files(spark, sources, str(tmp_path / "typed"), parquet=True)
    for name, df in raw.items():
        assert rows(spark.read.parquet(typed[name])) == rows(df)


def test_fact_from_inferred_types(spark, tmp_path, make_raw):
    from ordermart.plans.fact import order_fact

    for name, df in make_raw().items():
        land_csv(df, str(tmp_path / f"{name}.csv"))
    raw = read_tables(spark, str(tmp_path), infer=True)
    assert dict(raw["order_reviews"].dtypes)["review_creation_date"] == "timestamp_ntz"
    row = order_fact(raw).first()
    assert (row.order_id, row.zip_code_prefix, row.order_approved_at) == ("o1", 1000, DAY)


def test_nothing_landed(spark, tmp_path):
    (tmp_path / "x.txt").write_text("1")
    assert not has_landed(spark, str(tmp_path))


def test_json_document_and_lines(spark, tmp_path):
    path = tmp_path / "countries.json"
    countries = [{"code": "BR", "name": "Brazil"}, {"code": "UA", "name": None}]
    path.write_text(json.dumps(countries, indent=2))
    document = read_json(spark, str(path), "code string, name string", document=True)
    assert rows(document) == [("BR", "Brazil"), ("UA", None)]
    landed = land_json(document, str(tmp_path / "landing"))
    assert landed.endswith("json_data/countries.json") and has_landed(spark, landed, ".json")
    assert rows(read_json(spark, landed, document.schema)) == rows(document)


def test_json_of_any_layout(spark, tmp_path):
    lines = ['{"a": 1, "b": {"c": "x"}}', "", "{broken", '{"a": "2"}', "[1, 2]", "null", "7"]
    (tmp_path / "lines.json").write_text("\n".join(lines))
    read = read_json_any(spark, str(tmp_path / "lines.json"))
    found = read.selectExpr("try_variant_get(doc, '$.a', 'int')", "try_variant_get(doc, '$.b.c', 'string')")
    assert rows(found) == sorted([(1, "x"), (2, None)] + [(None, None)] * 4, key=repr)
    assert rows(json_rejects(read)) == [("{broken",)]

    for name, text in (("a", '[{"code": "BR"},\n {"code": "UA"}]'), ("b", '{"code":\n "AR"}'), ("c", "[")):
        (tmp_path / f"{name}.json").write_text(text)
    read = read_json_any(spark, str(tmp_path / "[abc].json"), document=True)
    assert rows(read.selectExpr("try_variant_get(doc, '$.code', 'string')")) == [("AR",), ("BR",), ("UA",), (None,)]
    assert rows(json_rejects(read)) == [("[",)]


def test_broken_json_raises(spark, tmp_path):
    (tmp_path / "bad.json").write_text('{"code": "BR"\n{]')
    with pytest.raises(Exception, match="MALFORMED_RECORD"):
        read_json(spark, str(tmp_path / "bad.json"), "code string").collect()


def test_shared_dir_is_new_each_time_and_below_the_named_folder(spark):
    root = spark.conf.get("spark.checkpoint.dir")
    a, b = shared_dir(spark), shared_dir(spark)
    assert a != b and a.startswith(root) and b.startswith(root)


class Unset:
    """A session without a shared folder."""

    def __init__(self, master):
        self.conf = {"spark.master": master}


def test_only_a_local_master_goes_without_a_shared_folder():
    assert shared_dir(Unset("local[2]")) != shared_dir(Unset("local[2]"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Unset("yarn"))


def test_object_store_keys_come_from_the_environment():
    keys = {"AWS_ACCESS_KEY_ID": "id", "AWS_SECRET_ACCESS_KEY": "secret"}
    conf = object_store_conf(keys, package="org.example:connector:1")
    assert conf["spark.hadoop.fs.s3a.access.key"] == "id"
    assert conf["spark.hadoop.fs.s3a.secret.key"] == "secret"
    assert conf["spark.jars.packages"] == "org.example:connector:1"
    assert object_store_conf({}) == {}


def test_build_session_joins_the_running_one(spark):
    joined = build_session(conf={"spark.sql.adaptive.enabled": "true"})
    assert joined.sparkContext is spark.sparkContext


def test_type_counts_hold_each_cell_once(spark):
    """Columns of odd names and cells against each type's own pattern and cast; the plan has
    as many patterns for many columns as for one."""
    odd = ["5", "+5", "5\n", "5 ", "2147483648", "99999999999999999999", "5.", ".5", "1e400", "+", "",
           "TrUe", "2024-02-29", "2023-02-29", "2024-01-01T10:00:00", "2024-01-01 25:00:00", "x", None]
    df = spark.createDataFrame([(c, None, c) for c in odd], "a string, `b.c` string, `d``e` string")
    got = {row["column"]: row.asDict() for row in type_counts(df).collect()}
    each = df.agg(*[F.count(as_type(F.col("a"), t)).alias(t) for t in SPELLINGS]).first().asDict()
    for column in ("a", "d`e"):
        assert got[column] == {"column": column, "cells": len(odd) - 1, **each}
    assert got["b.c"] == {"column": "b.c", "cells": 0, **dict.fromkeys(SPELLINGS, 0)}
    assert [r["cells"] for r in type_counts(df.limit(0)).collect()] == [0, 0, 0]
    plans = [type_counts(d)._jdf.queryExecution().optimizedPlan().toString() for d in (df, df.select("a"))]
    assert plans[0].count("RLIKE") == plans[1].count("RLIKE")
