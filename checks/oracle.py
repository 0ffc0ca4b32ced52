"""The registered queries in SQL over the test tables, written without regard
to how the library computes them: joins come first, choices last."""

from __future__ import annotations

from ordermart.schemas import ORDER_TIMES, RAW, TABLES

_EPOCH = "TIMESTAMP '1970-01-01 00:00:00'"

# The raw tables, as in checks/standins.py.
_COPIES = "(SELECT * FROM {0} UNION ALL SELECT * FROM {0} WHERE {1})"
RAW_SQL = {
    "customers": f"""
        SELECT CAST(c_custkey AS VARCHAR) AS customer_id,
               c_nationkey AS customer_zip_code_prefix,
               CASE WHEN c_acctbal >= 0 THEN c_mktsegment END AS customer_city,
               lpad(CAST(c_nationkey AS VARCHAR), 2, '0') AS customer_state
        FROM {_COPIES.format("customer", "c_acctbal > 9000")}""",
    "geolocation": """
        SELECT s_nationkey AS geolocation_zip_code_prefix,
               CAST(floor(s_acctbal / 2500) AS DOUBLE) * 2.5 AS geolocation_lat,
               CAST(s_nationkey AS DOUBLE) AS geolocation_lng,
               CASE WHEN s_acctbal >= 0 THEN 'City ' || s_nationkey END AS geolocation_city,
               lpad(CAST(s_nationkey AS VARCHAR), 2, '0') AS geolocation_state
        FROM supplier""",
    "order_items": """
        SELECT CAST(l_orderkey AS VARCHAR) AS order_id,
               l_linenumber AS order_item_id,
               CASE WHEN l_discount > 0 THEN CAST(l_partkey AS VARCHAR) END AS product_id,
               CASE WHEN l_returnflag <> 'N' THEN CAST(l_suppkey AS VARCHAR) END AS seller_id,
               CASE WHEN l_returnflag <> 'R' THEN l_shipdate END AS shipping_limit_date,
               l_extendedprice AS price,
               l_quantity AS freight_value
        FROM lineitem""",
    "order_payments": """
        SELECT CAST(l_orderkey AS VARCHAR) AS order_id,
               l_linenumber AS payment_sequential,
               l_returnflag AS payment_type,
               CASE WHEN l_quantity <= 45 THEN CAST(l_quantity AS INTEGER) END
                   AS payment_installments,
               l_extendedprice AS payment_value
        FROM lineitem""",
    "order_reviews": f"""
        SELECT user_id || '-' || event_type AS review_id,
               CAST(event_id // 2 AS VARCHAR) AS order_id,
               CASE WHEN event_type = 'error' THEN 'n/a'
                    ELSE CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) END AS review_score,
               CASE WHEN value < 100 THEN event_type END AS review_comment_title,
               props AS review_comment_message,
               CASE WHEN event_id % 13 = 0 THEN 'bad'
                    ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS review_creation_date,
               CASE WHEN event_id % 17 <> 0
                    THEN strftime(ts + INTERVAL 1 DAY, '%Y-%m-%d %H:%M:%S') END
                   AS review_answer_timestamp
        FROM {_COPIES.format("events", "value > 200")}""",
    "orders": f"""
        SELECT CAST(o_orderkey AS VARCHAR) AS order_id,
               CASE WHEN o_orderpriority <> '5-LOW' THEN CAST(o_custkey AS VARCHAR) END
                   AS customer_id,
               o_orderstatus AS order_status,
               {", ".join(
                   f"CASE WHEN (o_orderkey + {k}) % 11 <> 0 "
                   f"THEN o_orderdate + INTERVAL {k} DAY END AS {c}"
                   for k, c in enumerate(ORDER_TIMES, start=1)
               )}
        FROM {_COPIES.format("orders", "o_totalprice > 450000")}""",
    "products": f"""
        SELECT CAST(p_partkey AS VARCHAR) AS product_id,
               CASE WHEN p_size <= 30 THEN p_type END AS product_category_name,
               CAST(p_partkey * 20 AS INTEGER) AS product_photos_qty,
               CAST(floor(p_retailprice) AS INTEGER) AS product_weight_g,
               p_size + 10 AS product_length_cm,
               CASE WHEN p_size <= 40 THEN p_size * 2 END AS product_height_cm,
               p_size AS product_width_cm
        FROM {_COPIES.format("part", "p_size > 45")}""",
    "sellers": """
        SELECT CASE WHEN s_suppkey = 0 THEN NULL
                    WHEN s_suppkey % 10 = 0 THEN 'closed ' || s_suppkey
                    ELSE CAST(s_suppkey AS VARCHAR) END AS seller_id,
               s_nationkey AS seller_zip_code_prefix,
               CASE WHEN s_acctbal >= 0 THEN s_name END AS seller_city,
               lpad(CAST(s_nationkey AS VARCHAR), 2, '0') AS seller_state
        FROM supplier""",
}

# Columns of the raw tables that are not text or whole numbers here.
_KINDS = {
    "geolocation_lat": "0.0",
    "geolocation_lng": "0.0",
    "shipping_limit_date": _EPOCH,
    "price": "0.0",
    "freight_value": "0.0",
    "payment_value": "0.0",
    **{c: _EPOCH for c in ORDER_TIMES},
}


def _default(table: str, column: str) -> str:
    if column in _KINDS:
        return _KINDS[column]
    return "'0'" if RAW[table][column].dataType.simpleString() == "string" else "0"


def _clean_sql(table: str) -> str:
    cells = ", ".join(
        f"coalesce({c}, {_default(table, c)}) AS {c}" for c in RAW[table].names
    )
    return f"SELECT {cells} FROM (SELECT DISTINCT * FROM r_{table})"


def _with(body: str, *extra: tuple[str, str]) -> str:
    """`r_x` is raw table x, `c_x` the cleaned one; only those used are stated."""
    ctes: list[str] = []
    text = body + " ".join(sql for _, sql in extra)
    for table in RAW:
        if f"r_{table}" in text or f"c_{table}" in text:
            ctes.append(f"r_{table} AS ({RAW_SQL[table]})")
        if f"c_{table}" in text:
            ctes.append(f"c_{table} AS ({_clean_sql(table)})")
    ctes += [f"{name} AS ({sql})" for name, sql in extra]
    return f"WITH {', '.join(ctes)} {body}" if ctes else body


def _parsed(column: str) -> str:
    return f"try_strptime({column}, '%Y-%m-%d %H:%M:%S')"


_REVIEWS_DIM = f"""
    SELECT review_id, order_id, review_score, review_comment_title, review_comment_message,
           review_creation_date, review_answer_timestamp
    FROM (SELECT review_id, order_id,
                 CAST(TRY_CAST(review_score AS FLOAT) AS DOUBLE) AS review_score,
                 review_comment_title, review_comment_message,
                 {_parsed("review_creation_date")} AS review_creation_date,
                 {_parsed("review_answer_timestamp")} AS review_answer_timestamp
          FROM c_order_reviews)
    WHERE review_creation_date IS NOT NULL AND review_answer_timestamp IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY review_id
        ORDER BY review_answer_timestamp DESC, order_id, review_score NULLS FIRST,
                 review_comment_title, review_comment_message, review_creation_date) = 1"""

_ITEM_COLUMNS = (
    "order_item_id, order_id, product_id, seller_id, shipping_limit_date, price, freight_value"
)


def _items_dim(keys: str) -> str:
    return f"""
    SELECT {_ITEM_COLUMNS} FROM c_order_items
    QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY order_item_id, product_id,
        seller_id, shipping_limit_date, price, freight_value) = 1"""


_GEOLOCATION_DIM = """
    SELECT geolocation_zip_code_prefix AS zip_code_prefix, geolocation_lat AS latitude,
           geolocation_lng AS longitude, geolocation_city AS city, geolocation_state AS state
    FROM c_geolocation
    QUALIFY row_number() OVER (PARTITION BY geolocation_zip_code_prefix
        ORDER BY geolocation_lat, geolocation_lng, geolocation_city, geolocation_state) = 1"""

_HAS_TIMES = " AND ".join(f"o.{c} <> {_EPOCH}" for c in ORDER_TIMES)
_FACT_COLUMNS = ", ".join(TABLES["Orders"].columns.names)


def _star_join(reviews: str) -> str:
    """The six joins in full, with every combination they make."""
    return f"""
    FROM c_orders o
    JOIN c_order_payments p ON o.order_id = p.order_id
    JOIN c_customers c ON o.customer_id = c.customer_id
    JOIN c_order_items i ON o.order_id = i.order_id
    JOIN c_sellers s ON i.seller_id = s.seller_id
    JOIN {reviews} r ON o.order_id = r.order_id
    JOIN c_geolocation g ON g.geolocation_zip_code_prefix = c.customer_zip_code_prefix
    WHERE {_HAS_TIMES}"""


def _fact(reviews: str) -> str:
    return f"""
    SELECT {_FACT_COLUMNS} FROM (
        SELECT o.*, s.seller_id, g.geolocation_zip_code_prefix AS zip_code_prefix, r.review_id,
               p.payment_sequential, p.payment_type, p.payment_installments, p.payment_value,
               i.order_item_id
        {_star_join(reviews)})
    QUALIFY row_number() OVER (PARTITION BY order_id
        ORDER BY customer_id, order_status, {", ".join(ORDER_TIMES)}, zip_code_prefix,
                 payment_sequential, payment_type, payment_installments, payment_value,
                 order_item_id, seller_id, review_id) = 1"""


_ALL = {
    "Customers": "SELECT * FROM c_customers",
    "Products": "SELECT * FROM c_products",
    "Order_Reviews": _REVIEWS_DIM,
    "Geolocation": _GEOLOCATION_DIM,
    "Sellers": "SELECT * FROM c_sellers",
    "Order_Items": _items_dim("order_id"),
    "Orders": _fact("c_order_reviews"),
}
_DIMS = [(f"d_{name}", sql) for name, sql in _ALL.items()]


def _copies(table: str) -> str:
    names = ", ".join(RAW[table].names)
    return f"(SELECT {names}, count(*) AS n FROM r_{table} GROUP BY ALL)"


_DUPLICATE_COUNTS = (
    'CAST(sum(n) AS BIGINT) AS "rows", count(*) AS distinct_rows, '
    "count(*) FILTER (n > 1) AS dup_groups, CAST(sum(n - 1) AS BIGINT) AS extra_rows"
)
_DUPLICATE_REPORT = " UNION ALL ".join(
    f"SELECT '{t}' AS \"table\", {_DUPLICATE_COUNTS} FROM {_copies(t)}" for t in RAW
)
_NULL_PROFILE = " UNION ALL ".join(
    f"SELECT '{t}' AS \"table\", '{c}' AS \"column\", count(*) - count({c}) AS nulls FROM r_{t}"
    for t in RAW
    for c in RAW[t].names
)
_QUALITY_REPORT = " UNION ALL ".join(
    f"SELECT '{t}' AS \"table\", {_DUPLICATE_COUNTS}, '{c}' AS \"column\", "
    f"count(*) - count({c}) AS nulls FROM {_copies(t)}"
    for t in RAW
    for c in RAW[t].names
)


def _type_reject(table: str, key: str, column: str, target: str, source: str) -> str:
    return f"""
    SELECT '{table}' AS "table", {key} AS "key", '{column}' AS "column",
           CAST({column} AS VARCHAR) AS value
    FROM {source} WHERE {column} IS NOT NULL AND TRY_CAST({column} AS {target}) IS NULL"""


def _length_reject(column: str, n: int) -> str:
    return f"""
    SELECT 'Customers' AS "table", customer_id AS "key", '{column}' AS "column",
           {column} AS value
    FROM long_customers WHERE length({column}) > {n}"""


def _pk(table: str, key: str, source: str, keys: str) -> str:
    nulls = " OR ".join(f"{k.strip()} IS NULL" for k in keys.split(","))
    return f"""
    SELECT '{table}' AS "table", {key} AS "key", count(*) AS n FROM {source}
    GROUP BY {keys} HAVING count(*) > 1 OR {nulls}"""


def _fk(table: str, column: str, parent: str, parent_key: str) -> str:
    return f"""
    SELECT '{table}' AS "table", '{column}' AS "column", '{parent}' AS parent,
           CAST({column} AS VARCHAR) AS "key", count(*) AS n
    FROM d_{table} c
    WHERE NOT EXISTS (SELECT 1 FROM d_{parent} p WHERE p.{parent_key} = c.{column})
    GROUP BY {column}"""


# The lines of checks/standins.py, and what can't be read of them.
_SPLIT = (
    "l_orderkey % 19 = 0 AND l_linenumber = 1 AND l_orderkey % 7 <> 0 AND l_orderkey % 11 <> 0 "
    "AND l_orderkey % 13 <> 0 AND l_orderkey % 17 <> 0"
)
_QUANTITY = "CAST(CAST(l_quantity AS INTEGER) AS VARCHAR)"
_PRICE = "CAST(l_extendedprice AS VARCHAR)"
_LINE = f"""
    l_orderkey || ',' || CASE WHEN l_orderkey % 7 = 0 THEN 'x' ELSE '' END || l_linenumber || ','
    || l_returnflag || CASE WHEN l_orderkey % 13 = 0 THEN '' ELSE
        ',' || CASE WHEN l_quantity <= 45 THEN {_QUANTITY} ELSE '' END || ','
        || CASE WHEN l_orderkey % 17 = 0 THEN 'R$ 5' ELSE {_PRICE} END END
    || CASE WHEN l_orderkey % 11 = 0 THEN ',more' ELSE '' END"""
_BAD_CELLS = """
    SELECT 'payment_sequential' AS "column", 'x' || l_linenumber AS text
    FROM lineitem WHERE l_orderkey % 7 = 0
    UNION ALL
    SELECT 'payment_value', 'R$ 5' FROM lineitem
    WHERE l_orderkey % 17 = 0 AND l_orderkey % 13 <> 0
    UNION ALL
    SELECT 'payment_installments', 'more' FROM lineitem
    WHERE l_orderkey % 13 = 0 AND l_orderkey % 11 = 0"""
_BAD_ROWS = f"""
    SELECT NULL AS "column", {_LINE} AS text FROM lineitem
    WHERE l_orderkey % 11 = 0 OR l_orderkey % 13 = 0
    UNION ALL
    SELECT NULL, l_orderkey || ',' || l_linenumber || ',"' || l_returnflag FROM lineitem
    WHERE {_SPLIT}
    UNION ALL
    SELECT NULL, l_returnflag || '",' || {_QUANTITY} || ',' || {_PRICE} FROM lineitem
    WHERE {_SPLIT}"""


def _type_counts(table: str) -> str:
    """Cells of each column by the types that can hold them, from their text."""
    parts = []
    for f in RAW[table]:
        c = f.name
        shown = f"CAST({c} AS VARCHAR)"
        if f.dataType.simpleString() == "timestamp_ntz":
            shown = f"strftime({c}, '%Y-%m-%d %H:%M:%S')"
        whole = "regexp_full_match(x, '[+-]?[0-9]+')"
        number = "regexp_full_match(x, '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?')"
        time = "regexp_full_match(x, '[0-9]{4}-[0-9]{2}-[0-9]{2}( [0-9]{2}:[0-9]{2}:[0-9]{2})?')"
        parts.append(f"""
            SELECT '{table}' AS "table", '{c}' AS "column", count(x) AS cells,
                   count(*) FILTER ({whole} AND TRY_CAST(x AS INTEGER) IS NOT NULL) AS "int",
                   count(*) FILTER ({whole} AND TRY_CAST(x AS BIGINT) IS NOT NULL) AS "bigint",
                   count(*) FILTER ({number}) AS "double",
                   count(*) FILTER (lower(x) IN ('true', 'false')) AS "boolean",
                   count(*) FILTER (length(x) = 10 AND {time} AND TRY_CAST(x AS DATE) IS NOT NULL)
                       AS "date",
                   count(*) FILTER ({time} AND TRY_CAST(x AS TIMESTAMP) IS NOT NULL)
                       AS timestamp_ntz
            FROM (SELECT nullif({shown}, '') AS x FROM r_{table})""")
    return " UNION ALL ".join(parts)


def _target(table: str) -> str:
    """A table's cells as its columns hold them; decimals shown as doubles."""
    cells = []
    for f in TABLES[table].columns:
        kind = f.dataType.simpleString()
        if kind.startswith("decimal"):
            cells.append(f"CAST(TRY_CAST({f.name} AS {kind}) AS DOUBLE) AS {f.name}")
        elif kind == "smallint":
            cells.append(f"TRY_CAST({f.name} AS SMALLINT) AS {f.name}")
        else:
            cells.append(f.name)
    return f"SELECT {', '.join(cells)} FROM d_{table}"


def _audit(table: str, month: str, changed: str) -> str:
    return f"""
        SELECT '{table}' AS "table", month, count(*) AS written, CAST(sum(t) AS BIGINT) AS in_target,
               count(*) FILTER (t = 0) AS missing, count(*) FILTER (t = 2) AS surplus,
               count(*) FILTER (t = 1 AND {changed}) AS changed,
               count(*) FILTER (t <> 1 OR {changed}) = 0 AS same
        FROM (SELECT *, {month} AS month, CAST(order_id AS BIGINT) AS o,
                     CASE WHEN CAST(order_id AS BIGINT) % 5 = 0 THEN 0
                          WHEN CAST(order_id AS BIGINT) % 7 = 0 THEN 2 ELSE 1 END AS t
              FROM d_{table})
        GROUP BY month"""


def oracle_sql() -> dict[str, str]:
    row_counts = " UNION ALL ".join(
        f"SELECT '{name}' AS \"table\", count(*) AS n FROM d_{name}" for name in _ALL
    )
    audit = " UNION ALL ".join(
        f"SELECT '{name}' AS \"table\", count(*) AS written, count(*) AS in_target, "
        f"CAST(0 AS BIGINT) AS missing, CAST(0 AS BIGINT) AS surplus FROM d_{name}"
        for name in _ALL
    )
    return {
        "scan_csv_typed": _with("SELECT * FROM r_order_items"),
        "scan_csv_inferred": _with(
            "SELECT CAST(order_id AS BIGINT) AS order_id, payment_sequential, payment_type, "
            "payment_installments, payment_value FROM r_order_payments"
        ),
        "scan_csv_multiline": "SELECT doc_id, text FROM documents",
        "table_catalog": _with(
            " UNION ALL ".join(f"SELECT '{t}' AS \"table\", count(*) AS n FROM r_{t}" for t in RAW)
        ),
        "land_parquet": _with(
            "SELECT order_id, customer_id, order_status, "
            + ", ".join(ORDER_TIMES)
            + " FROM r_orders"
        ),
        "json_landing": "SELECT event_id, event_type, value, props FROM events",
        "json_variant": """
            SELECT CASE WHEN NOT broken THEN event_id END AS event_id,
                   CASE WHEN NOT broken AND NOT other THEN event_type END AS event_type,
                   CASE WHEN NOT broken AND NOT other THEN value END AS value,
                   CASE WHEN NOT broken AND NOT other THEN props END AS props,
                   CASE WHEN NOT broken AND other THEN user_id END AS user_id,
                   CASE WHEN broken
                        THEN left('{"event_id":' || event_id || ',"event_type":"', 20) END AS reject
            FROM (SELECT *, event_id % 10 = 0 AS broken, event_id % 4 = 1 AS other FROM events)""",
        "null_flags": _with(
            "SELECT "
            + ", ".join(
                f"CASE WHEN {c} IS NULL THEN 1 ELSE 0 END AS {c}" for c in RAW["products"].names
            )
            + " FROM r_products"
        ),
        "null_profile": _with(_NULL_PROFILE),
        "fill_defaults": f"""
            SELECT l_orderkey AS id,
                   CASE WHEN l_linenumber <> 1 THEN l_linenumber ELSE 0 END AS whole,
                   CASE WHEN l_quantity >= 20 THEN l_extendedprice ELSE 0.0 END AS real,
                   CASE WHEN l_returnflag <> 'R' THEN l_returnflag ELSE '0' END AS text,
                   CASE WHEN l_linenumber <> 2 THEN l_linestatus = 'O' ELSE false END AS flag,
                   CASE WHEN l_linenumber <> 3 THEN l_shipdate ELSE {_EPOCH} END AS moment,
                   CASE WHEN l_linenumber <> 4 THEN CAST(l_shipdate AS DATE)
                        ELSE DATE '1970-01-01' END AS day
            FROM lineitem""",
        "filled_cells": """
            SELECT unnest(['id', 'whole', 'real', 'text', 'flag', 'moment', 'day']) AS "column",
                   unnest([0, count(*) FILTER (l_linenumber = 1),
                           count(*) FILTER (l_quantity >= 10 AND l_quantity < 20),
                           count(*) FILTER (l_returnflag = 'R'), count(*) FILTER (l_linenumber = 2),
                           count(*) FILTER (l_linenumber = 3), count(*) FILTER (l_linenumber = 4)])
                       AS nulls,
                   unnest([0, 0, count(*) FILTER (l_quantity < 10), 0, 0, 0, 0]) AS nans
            FROM lineitem""",
        "duplicate_rows": _with(
            f"SELECT * FROM {_copies('geolocation')} WHERE n > 1"
        ),
        "repeated_rows": _with(f"SELECT * FROM {_copies('order_reviews')} WHERE n > 1"),
        "duplicate_report": _with(_DUPLICATE_REPORT),
        "quality_report": _with(_QUALITY_REPORT),
        "distinct_rows": _with("SELECT DISTINCT * FROM r_geolocation"),
        "parse_timestamps": _with(
            f"SELECT review_id, order_id, {_parsed('review_creation_date')} AS "
            f"review_creation_date, {_parsed('review_answer_timestamp')} AS "
            "review_answer_timestamp FROM r_order_reviews"
        ),
        "cast_score": _with(
            "SELECT review_id, order_id, CAST(TRY_CAST(review_score AS FLOAT) AS DOUBLE) "
            "AS review_score FROM r_order_reviews"
        ),
        "drop_missing": _with(
            f"SELECT review_id, order_id FROM r_order_reviews "
            f"WHERE {_parsed('review_creation_date')} IS NOT NULL "
            f"AND {_parsed('review_answer_timestamp')} IS NOT NULL"
        ),
        "sentinel_filter": _with(f"SELECT o.* FROM c_orders o WHERE {_HAS_TIMES}"),
        "rename_columns": _with(
            "SELECT geolocation_zip_code_prefix AS zip_code_prefix, geolocation_lat AS latitude, "
            "geolocation_lng AS longitude, geolocation_city AS city, geolocation_state AS state "
            "FROM r_geolocation"
        ),
        "join_payments": _with(
            "SELECT o.order_id, o.order_status, p.payment_sequential, p.payment_type, "
            "p.payment_installments, p.payment_value "
            "FROM c_orders o JOIN c_order_payments p ON o.order_id = p.order_id"
        ),
        "join_customers": _with(
            "SELECT o.order_id, o.customer_id, o.order_status, c.customer_zip_code_prefix, "
            "c.customer_city, c.customer_state "
            "FROM c_orders o JOIN c_customers c ON o.customer_id = c.customer_id"
        ),
        "join_items": _with(
            "SELECT o.order_id, o.order_status, i.order_item_id, i.product_id, i.seller_id, "
            "i.price FROM c_orders o JOIN c_order_items i ON o.order_id = i.order_id"
        ),
        "join_sellers": _with(
            "SELECT i.* FROM c_order_items i WHERE i.seller_id IN "
            "(SELECT seller_id FROM c_sellers)"
        ),
        "join_reviews": _with(
            "SELECT o.order_id, o.order_status, r.review_id, r.review_score "
            "FROM c_orders o JOIN c_order_reviews r ON o.order_id = r.order_id"
        ),
        "join_geolocation": _with(
            "SELECT c.* FROM c_customers c WHERE c.customer_zip_code_prefix IN "
            "(SELECT geolocation_zip_code_prefix FROM c_geolocation)"
        ),
        "join_fanout": _with(
            f"SELECT o.order_id, count(*) AS n_rows {_star_join('c_order_reviews')} "
            "GROUP BY o.order_id"
        ),
        "dedup_items": _with(
            "SELECT * FROM r_order_items QUALIFY row_number() OVER (PARTITION BY order_id "
            "ORDER BY order_item_id, product_id NULLS FIRST, seller_id NULLS FIRST, "
            "shipping_limit_date NULLS FIRST, price, freight_value) = 1"
        ),
        "dedup_reviews": _with(
            "SELECT * FROM r_order_reviews QUALIFY row_number() OVER (PARTITION BY review_id "
            "ORDER BY review_answer_timestamp DESC NULLS LAST, order_id, "
            "review_score NULLS FIRST, review_comment_title NULLS FIRST, "
            "review_comment_message, review_creation_date) = 1"
        ),
        "dedup_geolocation": _with(
            "SELECT * FROM r_geolocation QUALIFY row_number() OVER "
            "(PARTITION BY geolocation_zip_code_prefix ORDER BY geolocation_lat, "
            "geolocation_lng, geolocation_city NULLS FIRST, geolocation_state) = 1"
        ),
        "customer_dim": _with("SELECT * FROM c_customers"),
        "product_dim": _with("SELECT * FROM c_products"),
        "order_items_dim": _with(_items_dim("order_id")),
        "order_items_dim_by_item": _with(_items_dim("order_id, order_item_id")),
        "order_reviews_dim": _with(_REVIEWS_DIM),
        "geolocation_dim": _with(_GEOLOCATION_DIM),
        "seller_dim": _with("SELECT * FROM c_sellers"),
        "order_fact": _with(_fact("c_order_reviews")),
        "order_fact_conformed": _with(
            _fact("d_reviews"), ("d_reviews", _REVIEWS_DIM)
        ),
        "type_rejects": _with(
            _type_reject("Products", "product_id", "product_photos_qty", "SMALLINT", "r_products")
            + " UNION ALL "
            + _type_reject(
                "Order_Items",
                "order_id || '|' || order_item_id",
                "price",
                "DECIMAL(10, 2)",
                "dear_items",
            ),
            (
                "dear_items",
                "SELECT order_id, order_item_id, CAST(floor(price) AS BIGINT) * 1500 AS price FROM r_order_items",
            ),
        ),
        "length_rejects": _with(
            _length_reject("customer_city", 100)
            + " UNION ALL "
            + _length_reject("customer_state", 2),
            (
                "long_customers",
                "SELECT customer_id, repeat(customer_city, 12) AS customer_city, "
                "left(customer_city, customer_zip_code_prefix) AS customer_state "
                "FROM r_customers",
            ),
        ),
        "pk_violations": _with(
            _pk("Customers", "customer_id", "r_customers", "customer_id")
            + " UNION ALL "
            + _pk("Sellers", "coalesce(seller_id, '')", "r_sellers", "seller_id")
            + " UNION ALL "
            + _pk(
                "Order_Items",
                "order_id || '|' || order_item_id",
                "r_order_items",
                "order_id, order_item_id",
            )
        ),
        "fk_violations": _with(
            " UNION ALL ".join(
                [
                    _fk("Order_Items", "product_id", "Products", "product_id"),
                    _fk("Order_Items", "seller_id", "Sellers", "seller_id"),
                    _fk("Orders", "customer_id", "Customers", "customer_id"),
                    _fk("Orders", "seller_id", "Sellers", "seller_id"),
                    _fk("Orders", "zip_code_prefix", "Geolocation", "zip_code_prefix"),
                    _fk("Orders", "review_id", "Order_Reviews", "review_id"),
                ]
            ),
            *_DIMS,
        ),
        "append_new_only": _with(
            "SELECT review_id, order_id, review_comment_title FROM d_reviews",
            ("d_reviews", _REVIEWS_DIM),
        ),
        "load_twice": _with(row_counts, *_DIMS),
        "load_audit": _with(audit, *_DIMS),
        "preview_rows": _with(
            "SELECT * FROM c_customers ORDER BY customer_id LIMIT 10"
        ),
        "full_job": _with(row_counts, *_DIMS),
        "raw_type_rejects": f"SELECT 'order_payments' AS \"table\", * FROM ({_BAD_CELLS})",
        "malformed_rows": f"SELECT 'order_payments' AS \"table\", * FROM ({_BAD_ROWS})",
        "inferred_rejects": f"""
            {_BAD_CELLS} UNION ALL {_BAD_ROWS} UNION ALL
            SELECT 'order_id', l_returnflag || '"' FROM lineitem WHERE {_SPLIT}""",
        "inferred_types": _with(" UNION ALL ".join(_type_counts(t) for t in RAW)),
        "loaded_orders": _with(_target("Orders"), *_DIMS),
        "loaded_items": _with(_target("Order_Items"), *_DIMS),
        "loaded_products": _with(_target("Products"), *_DIMS),
        "loaded_reviews": _with(_target("Order_Reviews"), *_DIMS),
        "content_audit": _with(
            _audit("Orders", "strftime(order_purchase_timestamp, '%Y-%m')", "o % 3 = 0 AND order_status <> 'other'")
            + " UNION ALL "
            + _audit("Order_Reviews", "CAST(NULL AS VARCHAR)", "o % 3 = 0 AND review_comment_title <> 'other'")
            + " UNION ALL SELECT 'Customers', NULL, count(*), count(*), 0, 0, 0, true FROM d_Customers",
            *_DIMS,
        ),
        "replace_orders": _with(
            """SELECT * FROM d_Orders WHERE CAST(order_id AS BIGINT) % 4 <> 0
            UNION ALL SELECT * REPLACE (
                'redelivered' AS order_status,
                CASE WHEN CAST(order_id AS BIGINT) % 8 = 0
                     THEN order_purchase_timestamp + INTERVAL 40 DAY
                     ELSE order_purchase_timestamp END AS order_purchase_timestamp)
            FROM d_Orders WHERE CAST(order_id AS BIGINT) % 4 = 0
            UNION ALL SELECT * REPLACE ('n' || order_id AS order_id)
            FROM d_Orders WHERE CAST(order_id AS BIGINT) % 9 = 0""",
            *_DIMS,
        ),
        "daily_jobs": _with(
            f"""SELECT run, "table", CASE WHEN run = 1 AND "table" = 'Orders' THEN
                (SELECT count(*) FROM d_Orders WHERE CAST(order_id AS BIGINT) % 2 = 0)
                ELSE n END AS n
            FROM ({row_counts}), (SELECT unnest([1, 2, 3])::INTEGER AS run)""",
            *_DIMS,
        ),
    }
