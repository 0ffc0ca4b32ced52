from conftest import rows
from pyspark.sql import functions as F

from ordermart.operators import quality
from ordermart.operators.keyfilter import key_filter, may_hold
from ordermart.operators.quality import (
    clean,
    distinct_rows,
    duplicate_report,
    duplicate_rows,
    null_profile,
    preview,
    quality_profile,
    quality_report,
    repeated_rows,
)


def sample(spark):
    data = [(1, "a")] * 3 + [(2, None)] * 2 + [(2, "0"), (None, "0"), (0, "0")]
    return spark.createDataFrame(data, "k int, v string")


def test_groups_and_extra_copies_differ(spark):
    report = duplicate_report(sample(spark)).first().asDict()
    assert report == {"rows": 8, "distinct_rows": 5, "dup_groups": 2, "extra_rows": 3}
    assert rows(duplicate_rows(sample(spark))) == [(1, "a", 3), (2, None, 2)]


def test_report_of_an_empty_table(spark):
    empty = sample(spark).limit(0)
    assert tuple(duplicate_report(empty).first()) == (0, 0, 0, 0)
    assert rows(null_profile(empty)) == [("k", 0), ("v", 0)]


def test_distinct_comes_before_fill(spark):
    assert distinct_rows(sample(spark)).count() == 5
    cleaned = rows(clean(sample(spark)))
    assert cleaned == [(0, "0"), (0, "0"), (1, "a"), (2, "0"), (2, "0")]


def test_null_profiles(spark):
    assert rows(null_profile(sample(spark))) == [("k", 1), ("v", 2)]
    profile = rows(quality_profile(sample(spark)))
    assert profile == [(8, 5, 2, 3, "k", 1), (8, 5, 2, 3, "v", 1)]
    report = quality_report({"a": sample(spark), "b": sample(spark).limit(0)})
    assert rows(report.select("table", "rows", "column")) == [
        ("a", 8, "k"), ("a", 8, "v"), ("b", 0, "k"), ("b", 0, "v"),
    ]


def test_profile_of_wide_and_signed_values(spark):
    df = sample(spark).withColumns({"m": F.lit(1), "x": F.expr("IF(k = 2, -0.0D, double('NaN'))")})
    df = df.withColumn("x", F.when(F.col("v").isNull(), 0.0).otherwise(F.col("x")))
    assert rows(repeated_rows(df).drop("m", "x")) == [(1, "a", 3), (2, None, 2)]
    report = tuple(duplicate_report(df).first())
    got = {tuple(r)[:4] for r in quality_profile(df).collect()}
    assert got == {report}
    empty = quality_profile(df.limit(0))
    assert rows(empty.select("rows", "nulls").distinct()) == [(0, 0)]


def test_signed_zeros_are_one_value(spark):
    df = spark.sql("SELECT * FROM VALUES (0.0D), (-0.0D), (double('NaN')), (-double('NaN')) AS v(x)")
    assert [n for _, n in rows(repeated_rows(df))] == [2, 2]


def test_strangers_in_the_filter_are_compared_in_full(spark, monkeypatch):
    """With a filter of one word all rows are suspects."""
    monkeypatch.setattr(quality, "key_filter", lambda df, keys: key_filter(df, keys, 1))
    monkeypatch.setattr(quality, "may_hold", lambda df, keys, held: may_hold(df, keys, held, 1))
    df = spark.range(500).selectExpr("id % 490 AS a", "CAST(id % 490 AS STRING) AS b")
    assert repeated_rows(df).count() == 10


def test_profile_of_many_columns_and_moved_nulls(spark):
    """More columns than a number has flags; rows that differ in where a null is."""
    names = [f"c{i}" for i in range(130)]
    data = [tuple(1 if i != j else None for i in range(130)) for j in (0, 61, 62, 129, 129)]
    df = spark.createDataFrame(data, ", ".join(f"{c} int" for c in names))
    got = {r["column"]: r for r in quality_profile(df).collect()}
    assert {tuple(r)[:4] for r in got.values()} == {(5, 4, 1, 1)}
    assert {c for c, r in got.items() if r["nulls"]} == {"c0", "c61", "c62", "c129"}


def test_rows_that_occur_once_are_not_shuffled(spark, tmp_path):
    spark.range(1000).selectExpr("id", "repeat('x', 50) AS wide").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    plan = repeated_rows(df)._jdf.queryExecution().executedPlan().toString()
    before, after = plan.split("BroadcastHashJoin", 1)
    assert "Exchange hashpartitioning(id" in before and "Exchange" not in after.split("BroadcastExchange")[0]


def test_columns_named_like_the_report(spark):
    df = spark.createDataFrame([(1, None), (1, None)], "rows int, `a.b` string")
    assert rows(quality_profile(df)) == [(2, 1, 1, 1, "a.b", 1), (2, 1, 1, 1, "rows", 0)]


def test_filled_cells_tell_null_from_nan(spark):
    df = spark.sql("SELECT * FROM VALUES (1.0D, 'a'), (double('NaN'), NULL), (NULL, NULL) AS v(x, t)")
    assert rows(quality.filled_cells(df)) == [("t", 2, 0), ("x", 1, 1)]
    assert rows(quality.filled_cells(df.limit(0))) == [("t", 0, 0), ("x", 0, 0)]


def test_preview_is_ordered(spark):
    df = spark.createDataFrame([(i, -i) for i in range(50)], "k int, v int").repartition(7)
    assert [r.k for r in preview(df, ["k"], 3).collect()] == [0, 1, 2]
