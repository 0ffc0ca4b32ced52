"""Loads at the batch's cost, audits by content, re-deliveries by month."""

import pytest
from conftest import rows
from pyspark.sql import functions as F

from ordermart.operators.constraints import conform
from ordermart.operators.keyfilter import key_filter, may_hold
from ordermart.plans.fact import order_fact
from ordermart.schemas import TABLES
from ordermart.sinks.warehouse import (
    JdbcWarehouse,
    ParquetWarehouse,
    content_audit,
    content_digest,
    key_ranges,
    load_table,
    new_rows,
    replace_rows,
    worth_thinning,
)

ORDERS = TABLES["Orders"]
REVIEWS = TABLES["Order_Reviews"]


def test_filter_loses_no_key_and_lets_few_strangers_pass(spark):
    keys = spark.range(20_000).selectExpr("CAST(id * 3 AS STRING) AS k", "IF(id % 5 = 0, NULL, id) AS n")
    others = spark.range(20_000).selectExpr("CONCAT('x', id) AS k", "id AS n")
    held = key_filter(keys, ["k", "n"], words=1 << 14)
    assert held.count() <= 1 << 14
    assert may_hold(keys, ["k", "n"], held, words=1 << 14).count() == 20_000
    assert may_hold(others, ["k", "n"], held, words=1 << 14).count() < 1500
    assert may_hold(others, ["k", "n"], held.limit(0), words=1 << 14).count() == 0
    assert may_hold(others, ["k", "n"], held, words=1 << 14).columns == ["k", "n"]


def test_the_target_is_thinned_before_it_is_shuffled(spark, settings, tmp_path):
    """A batch above any broadcast bound: only what passes its filter is shuffled of a
    target ten times its size."""
    for name, n in (("batch", 20_000), ("target", 200_000)):
        key = "id" if name == "batch" else "id + 19000"
        df = spark.range(n).selectExpr(f"CAST({key} AS STRING) AS k", "repeat('x', 20) AS v")
        df.write.parquet(str(tmp_path / name))
    batch, target = (spark.read.parquet(str(tmp_path / name)) for name in ("batch", "target"))
    with settings(
        spark__sql__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__autoBroadcastJoinThreshold="-1",
    ):
        df = new_rows(batch, target, ("k",))
        assert df.count() == 19_000
        plan = df._jdf.queryExecution().executedPlan().toString()
    anti = plan[plan.index("LeftAnti") :]
    target_side = anti[anti.index("BroadcastHashJoin") :]
    scan = target_side.index("/target")
    assert "Exchange hashpartitioning" not in target_side[:scan].split("BroadcastExchange")[0]
    assert "ReadSchema: struct<k:string>" in target_side[scan : scan + 400]


def orders(make_raw, *numbers, month="2018-03", status="delivered"):
    """Loadable facts of these numbers."""
    from conftest import DAY, item, order, payment, review

    ids = [f"o{n}" for n in numbers]
    raw = make_raw(
        orders=[order(i, status=status) for i in ids],
        order_items=[item(i) for i in ids],
        order_payments=[payment(i) for i in ids],
        order_reviews=[review(f"r{i}", i) for i in ids],
    )
    day = F.lit(f"{month}-0{DAY.day} 12:00:00").cast("timestamp_ntz")
    return conform(order_fact(raw), ORDERS).withColumn("order_purchase_timestamp", day)


def stored(spark, tmp_path, df):
    path = str(tmp_path / f"t{len(list(tmp_path.iterdir()))}")
    df.write.parquet(path)
    return spark.read.parquet(path)


def test_audit_finds_what_keys_do_not_show(spark, tmp_path, make_raw):
    written = stored(spark, tmp_path, orders(make_raw, 1, 2, 3, 4))
    two = written.filter("order_id IN ('o1', 'o2')")
    other = F.when(F.col("order_id") == "o2", "lost").otherwise(F.col("order_status"))
    changed = two.withColumn("order_status", other).unionAll(written.filter("order_id = 'o3'"))
    target = stored(spark, tmp_path, changed.unionAll(written.filter("order_id = 'o3'")))
    (found,) = content_audit(written, target, ORDERS).collect()
    assert found.asDict() == {
        "table": "Orders", "month": "2018-03", "written": 4, "in_target": 4, "missing": 1,
        "surplus": 1, "changed": 1, "same": False,
    }
    (found,) = content_audit(written, written.unionAll(orders(make_raw, 9)), ORDERS).collect()
    assert found.same and (found.missing, found.surplus, found.changed) == (0, 0, 0)
    assert content_audit(written.limit(0), target, ORDERS).count() == 0


def test_audit_sees_a_value_move_to_another_column(spark, make_raw):
    row = make_raw()["order_reviews"].limit(1)
    a = conform(row.withColumns({"review_comment_title": F.lit("x"), "review_comment_message": F.lit(None).cast("string")}), REVIEWS)
    b = conform(row.withColumns({"review_comment_title": F.lit(None).cast("string"), "review_comment_message": F.lit("x")}), REVIEWS)
    assert content_audit(a, b, REVIEWS).first()["changed"] == 1


def test_digests_of_disjoint_sets_add_up(spark, tmp_path, make_raw):
    a, b = orders(make_raw, 1, 2), orders(make_raw, 3, month="2018-04")
    both = {r["month"]: tuple(r) for r in content_digest(a.unionAll(b).repartition(3), ORDERS).collect()}
    assert set(both) == {"2018-03", "2018-04"}
    assert both["2018-03"] == tuple(content_digest(a, ORDERS).first())
    twice = content_digest(a.unionAll(a), ORDERS).first()
    assert (twice["rows"], twice["digest1"]) == (4, 2 * both["2018-03"][2])


def test_a_redelivery_replaces_its_months_only(spark, tmp_path, make_raw):
    warehouse = ParquetWarehouse(spark, str(tmp_path / "w"))
    for month, numbers in (("2018-01", (1, 2)), ("2018-02", (3,)), ("2018-03", (4, 5))):
        load_table(warehouse, ORDERS, stored(spark, tmp_path, orders(make_raw, *numbers, month=month)))
    untouched = sorted(p.name for p in (tmp_path / "w/Orders/purchase_month=2018-01").iterdir())

    def deliver(df):
        replace_rows(warehouse, ORDERS, stored(spark, tmp_path, df), str(tmp_path / "months"))
        found = warehouse.read(ORDERS).select(
            "order_id", "order_status", F.month("order_purchase_timestamp").alias("m")
        )
        return rows(found)

    # o3 moves from February, which is empty then, to March; o4 is changed; o6 is new
    batch = orders(make_raw, 3, 4, 6, month="2018-03", status="again")
    want = [("o1", "delivered", 1), ("o2", "delivered", 1), ("o3", "again", 3),
            ("o4", "again", 3), ("o5", "delivered", 3), ("o6", "again", 3)]
    assert deliver(batch) == want
    assert deliver(batch) == want  # a second time changes nothing
    assert sorted(p.name for p in (tmp_path / "w/Orders/purchase_month=2018-01").iterdir()) == untouched
    assert not (tmp_path / "w/Orders/purchase_month=2018-02").exists()
    assert deliver(batch.limit(0)) == want


def test_only_the_fact_has_months(spark, tmp_path, make_raw):
    with pytest.raises(ValueError, match="no months"):
        ParquetWarehouse(spark, str(tmp_path)).overwrite_months(REVIEWS, make_raw()["order_reviews"])


# A database may not run here: its reader is recorded.


class Reader:
    def __init__(self):
        self.calls = []

    @property
    def read(self):
        return self

    def __getattr__(self, name):
        def record(*args, **kwargs):
            self.calls.append((name, args, kwargs))
            return self

        return record


def test_key_ranges_part_all_keys(spark):
    assert key_ranges("k", ()) == []
    df = spark.createDataFrame([(k,) for k in ("", "a", "b'c", "b'd", "z", None)], "k string")
    found = [df.filter(r).count() for r in key_ranges("k", ["m", "b'c", "m"])]
    assert found == [3, 2, 1] and sum(found) == df.count()
    assert key_ranges("n", [10, 9]) == ["n < 9 OR n IS NULL", "n >= 9 AND n < 10", "n >= 10"]


def test_jdbc_reads_a_large_table_over_several_connections():
    spark = Reader()
    options = {"url": "jdbc:mysql://db/warehouse", "user": "u"}
    warehouse = JdbcWarehouse(spark, options, key_bounds={"Orders": ["4", "8", "c"]})
    warehouse.read(ORDERS)
    ((name, args, kwargs),) = spark.calls
    assert name == "jdbc" and args == ("jdbc:mysql://db/warehouse", "Orders")
    assert len(kwargs["predicates"]) == 4 and kwargs["predicates"][1] == "order_id >= '4' AND order_id < '8'"
    assert kwargs["properties"] == {"fetchsize": "10000", "preferTimestampNTZ": "true", "user": "u"}

    spark.calls.clear()
    warehouse.read(REVIEWS)
    assert [c[0] for c in spark.calls] == ["format", "options", "load"]
    assert spark.calls[1][2]["dbtable"] == "Order_Reviews"


def test_command_line_names_either_target(spark):
    from ordermart.__main__ import parser, warehouse_of

    args = parser().parse_args(["raw", "s3a://b/w", "--landing", "s3a://b/l", "--replace"])
    assert warehouse_of(spark, args) == ParquetWarehouse(spark, "s3a://b/w") and args.replace
    args = parser().parse_args(
        ["raw", "jdbc:mysql://db/w", "--jdbc-driver", "com.mysql.cj.jdbc.Driver", "--batch-size", "7",
         "--connections", "3", "--key-bounds", "Orders", "4", "8", "--key-bounds", "Sellers", "m"]
    )
    env = {"ORDERMART_DB_USER": "u", "ORDERMART_DB_PASSWORD": "p"}
    target = warehouse_of(spark, args, env)
    assert target.options == {
        "url": "jdbc:mysql://db/w", "driver": "com.mysql.cj.jdbc.Driver", "user": "u", "password": "p",
    }
    assert (target.batch_size, target.connections) == (7, 3)
    assert target.key_bounds == {"Orders": ["4", "8"], "Sellers": ["m"]}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_an_audit_sorts_no_rows(spark, tmp_path, make_raw):
    """Its grouping by key holds numbers only; one with text or wide numbers would sort."""
    written = stored(spark, tmp_path, orders(make_raw, 1, 2))
    plan = plan_of(content_audit(written, written, ORDERS))
    assert "HashAggregate" in plan and "SortAggregate" not in plan
    assert content_audit(written, written.unionAll(written), ORDERS).first()["surplus"] == 2


def test_only_a_larger_target_is_thinned(spark, tmp_path, make_raw):
    written = stored(spark, tmp_path, orders(make_raw, 1, 2))
    warehouse = ParquetWarehouse(spark, str(tmp_path / "w"))
    first = plan_of(new_rows(written, warehouse.read(ORDERS), ORDERS.key))
    assert "Join" not in first and "Exchange" not in first  # nothing is loaded yet
    load_table(warehouse, ORDERS, written)
    assert not worth_thinning(warehouse, ORDERS, 1) and worth_thinning(warehouse, ORDERS, 0)
    assert worth_thinning(JdbcWarehouse(spark, {}), ORDERS, 10**9)
    for batch in (orders(make_raw, 2, 3), orders(make_raw, 4)):
        thin, whole = (new_rows(batch, warehouse.read(ORDERS), ORDERS.key, t) for t in (True, False))
        assert rows(thin.select("order_id")) == rows(whole.select("order_id"))
        a, b = (content_audit(batch, written, ORDERS, t) for t in (True, False))
        assert rows(a) == rows(b)
