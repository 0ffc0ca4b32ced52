import datetime

import pytest
from pyspark.sql import functions as F

from ordermart.functions.columns import (
    fill_defaults,
    has_time,
    null_flags,
    parse_score,
    parse_timestamp,
    typed_zero,
)

ZONES = ["UTC", "Europe/Kyiv", "America/Sao_Paulo"]
ALL_TYPES = (
    "i int, l bigint, s smallint, d double, f float, m decimal(10,2), t string, b boolean, "
    "ts timestamp, n timestamp_ntz, day date"
)


def test_fill_is_typed_per_column(spark):
    df = spark.createDataFrame([(None,) * 11], ALL_TYPES)
    filled = fill_defaults(df).selectExpr("*", "unix_micros(ts) AS us").drop("ts").first()
    zero = datetime.datetime(1970, 1, 1)
    assert filled.asDict() == {
        "i": 0, "l": 0, "s": 0, "d": 0.0, "f": 0.0, "m": 0, "t": "0", "b": False,
        "n": zero, "day": zero.date(), "us": 0,
    }
    assert fill_defaults(df).dtypes == df.dtypes


def test_fill_replaces_nan_and_keeps_values(spark):
    df = spark.createDataFrame([(float("nan"), "a"), (1.5, ""), (None, None)], "d double, t string")
    assert [tuple(r) for r in fill_defaults(df).collect()] == [(0.0, "a"), (1.5, ""), (0.0, "0")]


def test_fill_only_named_columns(spark):
    df = spark.createDataFrame([(None, None)], "a int, `b.c` string")
    assert tuple(fill_defaults(df, ["b.c"]).first()) == (None, "0")


def test_fill_refuses_types_without_a_default(spark):
    with pytest.raises(TypeError):
        fill_defaults(spark.createDataFrame([([1],)], "a array<int>"))


def test_null_flags(spark):
    df = spark.createDataFrame([(None, "x"), (1, None)], "a int, b string")
    assert [tuple(r) for r in null_flags(df).collect()] == [(1, 0), (0, 1)]


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_junk_becomes_null_in_either_mode(spark, settings, ansi):
    with settings(spark__sql__ansi__enabled=ansi):
        df = spark.createDataFrame(
            [("bad", "bom"), ("0", "5"), ("", ""), ("2018-01-02 03:04:05", "4.5"), (None, None)],
            "t string, s string",
        )
        got = df.select(
            parse_timestamp(F.col("t")).cast("string"), parse_score(F.col("s"))
        ).collect()
    assert [r[0] for r in got] == [None, None, None, "2018-01-02 03:04:05", None]
    assert [r[1] for r in got] == [None, 5.0, None, 4.5, None]


@pytest.mark.parametrize("zone", ZONES)
@pytest.mark.parametrize("dtype", ["timestamp", "timestamp_ntz"])
def test_sentinel_in_any_zone(spark, settings, zone, dtype):
    with settings(spark__sql__session__timeZone=zone):
        df = spark.sql(
            f"SELECT id, CAST(t AS {dtype}) AS t FROM VALUES (1, NULL), "
            "(2, '2018-01-01 00:00:00'), (3, '1970-01-02 00:00:00') AS v(id, t)"
        )
        kind = df.schema["t"].dataType
        filled = fill_defaults(df)
        assert [r.id for r in filled.filter(has_time(F.col("t"), kind)).collect()] == [2, 3]
        assert [r.id for r in df.filter(has_time(F.col("t"), kind)).collect()] == [2, 3]
        zero = spark.range(1).select(typed_zero(kind).alias("t"))
        assert zero.filter(has_time(F.col("t"), kind)).count() == 0


def test_dates_become_midnight(spark):
    df = spark.sql("SELECT DATE'2018-01-02' AS t")
    parsed = df.select(parse_timestamp(F.col("t"), df.schema["t"].dataType)).first()[0]
    assert parsed == datetime.datetime(2018, 1, 2)


def test_timestamps_pass_through_parsing(spark):
    df = spark.sql("SELECT TIMESTAMP_NTZ'2018-01-02 03:04:05.6' AS t")
    assert df.select(parse_timestamp(F.col("t"), df.schema["t"].dataType)).first()[0].microsecond
