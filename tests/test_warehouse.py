from conftest import item, order, payment, review, rows

from ordermart.operators.constraints import conform, storage_schema
from ordermart.plans.dimensions import customer_dim
from ordermart.schemas import TABLES
from ordermart.sinks.warehouse import (
    JdbcWarehouse,
    ParquetWarehouse,
    key_audit,
    load_table,
    load_warehouse,
    new_rows,
)

CUSTOMERS = TABLES["Customers"]


def customers(make_raw, *ids):
    raw = make_raw(customers=[(i, 1, "t", "SP") for i in ids])
    return conform(customer_dim(raw["customers"]), CUSTOMERS)


def test_loading_again_appends_only_what_is_new(spark, tmp_path, make_raw):
    warehouse = ParquetWarehouse(spark, str(tmp_path))
    assert warehouse.read(CUSTOMERS).schema == storage_schema(CUSTOMERS)
    assert warehouse.read(CUSTOMERS).count() == 0
    for _ in range(2):
        load_table(warehouse, CUSTOMERS, customers(make_raw, "a", "b"))
    assert [r[0] for r in rows(warehouse.read(CUSTOMERS))] == ["a", "b"]
    load_table(warehouse, CUSTOMERS, customers(make_raw, "a", "b", "c"))
    assert [r[0] for r in rows(warehouse.read(CUSTOMERS))] == ["a", "b", "c"]


def stored(spark, tmp_path, df):
    path = str(tmp_path / f"t{len(list(tmp_path.iterdir()))}")
    df.write.parquet(path)
    return spark.read.parquet(path)


def test_new_rows_of_a_composite_key(spark, tmp_path):
    schema = "k string, n int, v string"
    new = stored(spark, tmp_path, spark.createDataFrame([("a", 1, "x"), ("a", 2, "y")], schema))
    old = spark.createDataFrame([("a", 1, "z"), ("b", 2, "z")], schema)
    assert rows(new_rows(new, old, ("k", "n"))) == [("a", 2, "y")]


def test_rows_without_their_key_are_loaded_once(spark, tmp_path):
    new = stored(spark, tmp_path, spark.createDataFrame([(None, 1), ("a", 1)], "k string, n int"))
    assert rows(new_rows(new, new.limit(0), ("k",))) == [("a", 1), (None, 1)]
    assert rows(new_rows(new, new, ("k",))) == []


def test_small_batch_leaves_the_target_unshuffled(spark, tmp_path, make_raw):
    batch = stored(spark, tmp_path, customers(make_raw, "a"))
    target = stored(spark, tmp_path, customers(make_raw, "a", "b"))
    plan = new_rows(batch, target, CUSTOMERS.key)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") >= 1 and "customer_city" in plan
    assert "hashpartitioning" not in plan.split("BuildRight")[0]


def test_audit_nets_keys(spark, tmp_path, make_raw):
    def audit(written, target):
        written = stored(spark, tmp_path, written)
        return tuple(key_audit(written, target, CUSTOMERS).first())

    written = customers(make_raw, "a", "b", "c")
    target = customers(make_raw, "b", "c", "d")
    assert audit(written, target) == ("Customers", 3, 2, 1, 0)
    assert audit(written, written) == ("Customers", 3, 3, 0, 0)
    assert audit(target, target.unionAll(target)) == ("Customers", 3, 6, 0, 3)
    assert audit(written.limit(0), target) == ("Customers", 0, 0, 0, 0)


def test_fact_is_partitioned_by_month(spark, tmp_path, make_raw):
    from ordermart.plans.fact import order_fact

    orders = ["o1", "o2"]
    raw = make_raw(
        orders=[order(o) for o in orders],
        order_items=[item(o) for o in orders],
        order_payments=[payment(o) for o in orders],
        order_reviews=[review(f"r{o}", o) for o in orders],
    )
    table = TABLES["Orders"]
    warehouse = ParquetWarehouse(spark, str(tmp_path))
    fact = conform(order_fact(raw), table)
    load_table(warehouse, table, fact)
    assert [p.name for p in (tmp_path / "Orders").glob("purchase_month=*")] == [
        "purchase_month=2018-03"
    ]
    assert warehouse.read(table).schema == storage_schema(table)
    assert rows(warehouse.read(table)) == rows(fact)


class Recorder:
    """Stands in for a frame's JDBC writer and reader, as no database may run here."""

    def __init__(self):
        self.calls = []

    def __getattr__(self, name):
        if name == "write":
            return self

        def record(*args, **kwargs):
            self.calls.append((name, args, kwargs))
            return self

        return record


def test_jdbc_append_options(spark):
    url = {"url": "jdbc:mysql://db/warehouse", "driver": "com.mysql.cj.jdbc.Driver"}
    warehouse = JdbcWarehouse(spark, url, batch_size=500, connections=4)
    frame = Recorder()
    warehouse.append(TABLES["Orders"], frame)
    assert [c[0] for c in frame.calls] == ["format", "mode", "options", "save"]
    assert frame.calls[0][1] == ("jdbc",) and frame.calls[1][1] == ("append",)
    options = frame.calls[2][2]
    assert options["dbtable"] == "Orders" and options["url"] == url["url"]
    assert options["batchsize"] == "500" and options["numPartitions"] == "4"
    assert "order_id varchar(255)" in options["createTableColumnTypes"]
    assert "payment_value decimal(10,2)" in options["createTableColumnTypes"]
    reviews = warehouse.write_options(TABLES["Order_Reviews"])["createTableColumnTypes"]
    assert "review_score float" in reviews and "review_comment_message" not in reviews


def test_tables_are_loaded_in_the_given_order(make_raw):
    loaded = []

    class Memory:
        def read(self, table):
            return frames[table.name].limit(0)

        def append(self, table, df):
            loaded.append((table.name, df.count()))

    frames = {"Customers": customers(make_raw, "a", "b"), "Sellers": make_raw()["sellers"]}
    load_warehouse(Memory(), frames, ["Sellers", "Customers"])
    assert loaded == [("Sellers", 1), ("Customers", 2)]
