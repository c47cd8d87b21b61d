"""The star-schema test tables read as the retail entities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from shelfmark.session import in_utc

AS_OF = "2001-06-30"
EVENTS_AS_OF = "2024-01-31"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return in_utc(spark).read.parquet(f"{folder}/{name}.parquet")


def products(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").selectExpr(
        "concat('store_', cast(p_partkey % 5 as string)) AS store_id",
        "cast(p_partkey as string) AS product_id",
        "p_name AS name",
        "p_type AS category",
        "cast(p_retailprice as decimal(18,2)) AS price",
        "cast(p_size - 1 as bigint) AS quantity_on_hand",
        "cast(p_partkey % 30 as bigint) AS reorder_threshold",
        "CASE WHEN p_partkey % 11 = 0 THEN NULL "
        "ELSE timestamp'2001-06-30 00:00:00' + INTERVAL '1' DAY * (p_partkey % 40 - 10) END AS expiry_date",
        "CASE WHEN p_partkey % 13 = 0 THEN 'INACTIVE' ELSE 'ACTIVE' END AS status",
        "timestamp'2001-06-30 00:00:00' - INTERVAL '1' DAY * (p_partkey % 400) AS created_at",
        "timestamp'2001-06-30 00:00:00' - INTERVAL '1' DAY * (p_partkey % 90) AS updated_at",
    )


def transactions(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").selectExpr(
        "concat('store_', cast(o_custkey % 5 as string)) AS store_id",
        "cast(o_orderkey as string) AS transaction_id",
        "CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE cast(o_custkey as string) END AS customer_id",
        "CASE WHEN o_orderstatus = 'F' THEN 'FAILED' ELSE 'COMPLETED' END AS status",
        "CASE o_orderkey % 3 WHEN 0 THEN 'cash' WHEN 1 THEN 'upi' ELSE 'card' END AS payment_method",
        "cast(o_totalprice as decimal(18,2)) AS total_amount",
        "cast(o_orderdate as timestamp) AS sale_timestamp",
    )


def items(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem")
    parts = table(spark, folder, "part").select("p_partkey", "p_name")
    return lines.join(parts, lines.l_partkey == parts.p_partkey).selectExpr(
        "concat('store_', cast(l_partkey % 5 as string)) AS store_id",
        "cast(l_orderkey as string) AS transaction_id",
        "l_linenumber AS pos",
        "cast(l_partkey as string) AS product_id",
        "p_name AS product_name",
        "cast(l_quantity as bigint) AS quantity",
        "cast(l_extendedprice as decimal(18,2)) AS line_total",
        "CASE WHEN l_linestatus = 'F' AND l_returnflag = 'R' THEN 'FAILED' ELSE 'COMPLETED' END AS status",
        "cast(l_shipdate as timestamp) AS sale_timestamp",
    )


def inventory_snapshots(spark: SparkSession, folder: str) -> DataFrame:
    """Every shipped line is a stock count of its product; ``tie`` orders counts of one instant."""
    lines = table(spark, folder, "lineitem").where("l_shipdate <= timestamp_ntz'2001-06-30 00:00:00'")
    parts = table(spark, folder, "part").select("p_partkey", "p_name")
    return lines.join(parts, lines.l_partkey == parts.p_partkey).selectExpr(
        "concat('store_', cast(l_partkey % 5 as string)) AS store_id",
        "cast(l_partkey as string) AS product_id",
        "p_name AS product_name",
        "cast(l_quantity as bigint) - 1 AS quantity_on_hand",
        "cast(l_partkey % 30 as bigint) AS reorder_threshold",
        "CASE WHEN l_partkey % 11 = 0 THEN NULL "
        "ELSE timestamp'2001-06-30 00:00:00' + INTERVAL '1' DAY * (l_partkey % 40 - 10) END AS expiry_date",
        "cast(l_shipdate as timestamp) AS captured_at",
        "struct(l_orderkey AS t1, l_linenumber AS t2, l_suppkey AS t3, l_extendedprice AS t4) AS tie",
    )


def customers(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").selectExpr(
        "concat('store_', cast(c_custkey % 5 as string)) AS store_id",
        "cast(c_custkey as string) AS customer_id",
        "c_name AS name",
        "concat('+91', cast(c_custkey % 1000 as string)) AS phone",
        "cast(c_acctbal as decimal(18,2)) AS total_spend",
        "cast(c_custkey % 17 as bigint) AS visit_count",
        "CASE WHEN c_custkey % 7 = 0 THEN NULL "
        "ELSE timestamp'2001-06-30 00:00:00' - INTERVAL '1' DAY * (c_custkey % 120) END AS last_purchase_at",
        "timestamp'2001-06-30 00:00:00' - INTERVAL '1' DAY * (c_custkey % 700) AS created_at",
    )


def customer_captures(spark: SparkSession, folder: str) -> DataFrame:
    """Every order is a capture of its customer's running figures."""
    orders = table(spark, folder, "orders")
    people = table(spark, folder, "customer").select("c_custkey", "c_name")
    return orders.join(people, orders.o_custkey == people.c_custkey).selectExpr(
        "concat('store_', cast(o_custkey % 5 as string)) AS store_id",
        "cast(o_custkey as string) AS customer_id",
        "c_name AS name",
        "cast(o_totalprice as decimal(18,2)) AS total_spend",
        "cast(o_orderkey % 17 as bigint) AS visit_count",
        "cast(o_orderdate as timestamp) AS last_purchase_at",
        "cast(o_orderdate as timestamp) AS captured_at",
        "o_orderkey AS tie",
    )


def alert_log(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").selectExpr(
        "concat('store_', cast(user_id % 5 as string)) AS store_id",
        "cast(user_id as string) AS alert_id",
        "event_id AS seq",
        "CASE event_id % 4 WHEN 0 THEN 'LOW_STOCK' WHEN 1 THEN 'EXPIRY_SOON' "
        "WHEN 2 THEN 'NOT_SELLING' ELSE 'HIGH_DEMAND' END AS alert_type",
        "CASE event_type WHEN 'error' THEN 'ACTIVE' WHEN 'signup' THEN 'ACTIVE' "
        "WHEN 'click' THEN 'ACKNOWLEDGED' ELSE 'RESOLVED' END AS status",
        "CASE WHEN value < 5 THEN 'LOW' WHEN value < 10 THEN 'MEDIUM' "
        "WHEN value < 50 THEN 'HIGH' ELSE 'CRITICAL' END AS severity",
        "cast(ts as timestamp) AS captured_at",
    )


def alerts(spark: SparkSession, folder: str) -> DataFrame:
    """Every event is one alert of the operational table, with its lifecycle instants."""
    return table(spark, folder, "events").selectExpr(
        "concat('store_', cast(user_id % 5 as string)) AS store_id",
        "cast(event_id as string) AS alert_id",
        "CASE event_id % 4 WHEN 0 THEN 'LOW_STOCK' WHEN 1 THEN 'EXPIRY_SOON' "
        "WHEN 2 THEN 'NOT_SELLING' ELSE 'HIGH_DEMAND' END AS alert_type",
        "CASE event_type WHEN 'error' THEN 'ACTIVE' WHEN 'signup' THEN 'ACTIVE' "
        "WHEN 'click' THEN 'ACKNOWLEDGED' ELSE 'RESOLVED' END AS status",
        "CASE WHEN value < 5 THEN 'LOW' WHEN value < 10 THEN 'MEDIUM' "
        "WHEN value < 50 THEN 'HIGH' ELSE 'CRITICAL' END AS severity",
        "concat('Alert ', cast(event_id as string)) AS title",
        "concat('Signal ', event_type) AS message",
        "cast(user_id as string) AS source_entity_id",
        "cast(ts as timestamp) AS created_at",
        "cast(ts as timestamp) + INTERVAL '1' HOUR * (event_id % 30) AS last_evaluated_at",
        "CASE WHEN event_type = 'click' THEN cast(ts as timestamp) + INTERVAL '1' DAY * (event_id % 3) END "
        "AS acknowledged_at",
        "CASE WHEN event_type IN ('view', 'purchase') THEN cast(ts as timestamp) + INTERVAL '1' DAY * (event_id % 5) END "
        "AS resolved_at",
    )


def embeddings(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").selectExpr(
        "concat('store_', cast(vec_id % 5 as string)) AS store_id",
        "cast(vec_id as string) AS product_id",
        "embedding",
    )


def messages(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "conversations").selectExpr(
        "concat('store_', cast(conv_id % 5 as string)) AS store_id",
        "cast(conv_id as string) AS chat_session_id",
        "turn",
        "role",
        "text",
        "timestamp'2024-01-01 00:00:00' + INTERVAL '1' HOUR * conv_id + INTERVAL '1' MINUTE * turn AS created_at",
    )


# What a shopkeeper asks about a product; the row's key picks the wording.
QUESTION_TEXT = """CASE p_partkey % 12
 WHEN 0 THEN 'How is my business doing?'
 WHEN 1 THEN concat('Should I reorder ', p_name, ' this week?')
 WHEN 2 THEN concat('What is the top selling product, is it ', p_name, '?')
 WHEN 3 THEN 'Who are my loyal customers?'
 WHEN 4 THEN concat('Show the last bill with ', p_name)
 WHEN 5 THEN concat('What needs attention, maybe ', p_name, '?')
 WHEN 6 THEN concat('Tell me about the product ', p_name, ' in ', p_type)
 WHEN 7 THEN concat('Why did ', p_name, ' slow down?')
 WHEN 8 THEN concat('What about stock of item ', cast(p_partkey AS VARCHAR(20)))
 WHEN 9 THEN 'hello there'
 WHEN 10 THEN p_name
 ELSE concat('any new ', p_type, ' products added') END"""


def questions(spark: SparkSession, folder: str) -> DataFrame:
    """One question per product row, and every user message of the conversations."""
    asked = table(spark, folder, "part").selectExpr(
        "concat('store_', cast(p_partkey % 5 as string)) AS store_id",
        "concat('q_', cast(p_partkey as string)) AS query_id",
        QUESTION_TEXT.replace("VARCHAR(20)", "STRING") + " AS query_text",
    )
    said = (
        messages(spark, folder)
        .where("role = 'user'")
        .select(
            "store_id",
            F.concat_ws("_", F.lit("m"), "chat_session_id", F.col("turn").cast("string")).alias("query_id"),
            F.col("text").alias("query_text"),
        )
    )
    return asked.unionByName(said)


# The same views for the SQL checks.
SQL_VIEWS: dict[str, str] = {
    "products": """SELECT concat('store_', CAST(p_partkey % 5 AS VARCHAR)) AS store_id, CAST(p_partkey AS VARCHAR) AS product_id,
  p_name AS name, p_type AS category, CAST(p_retailprice AS DECIMAL(18,2)) AS price,
  CAST(p_size - 1 AS BIGINT) AS quantity_on_hand, CAST(p_partkey % 30 AS BIGINT) AS reorder_threshold,
  CASE WHEN p_partkey % 11 = 0 THEN NULL
       ELSE TIMESTAMP '2001-06-30 00:00:00' + INTERVAL '1' DAY * (p_partkey % 40 - 10) END AS expiry_date,
  CASE WHEN p_partkey % 13 = 0 THEN 'INACTIVE' ELSE 'ACTIVE' END AS status,
  TIMESTAMP '2001-06-30 00:00:00' - INTERVAL '1' DAY * (p_partkey % 400) AS created_at,
  TIMESTAMP '2001-06-30 00:00:00' - INTERVAL '1' DAY * (p_partkey % 90) AS updated_at
 FROM part""",
    "transactions": """SELECT concat('store_', CAST(o_custkey % 5 AS VARCHAR)) AS store_id, CAST(o_orderkey AS VARCHAR) AS transaction_id,
  CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE CAST(o_custkey AS VARCHAR) END AS customer_id,
  CASE WHEN o_orderstatus = 'F' THEN 'FAILED' ELSE 'COMPLETED' END AS status,
  CASE o_orderkey % 3 WHEN 0 THEN 'cash' WHEN 1 THEN 'upi' ELSE 'card' END AS payment_method,
  CAST(o_totalprice AS DECIMAL(18,2)) AS total_amount, CAST(o_orderdate AS TIMESTAMP) AS sale_timestamp
 FROM orders""",
    "items": """SELECT concat('store_', CAST(l_partkey % 5 AS VARCHAR)) AS store_id, CAST(l_orderkey AS VARCHAR) AS transaction_id,
  l_linenumber AS pos, CAST(l_partkey AS VARCHAR) AS product_id, p_name AS product_name,
  CAST(l_quantity AS BIGINT) AS quantity, CAST(l_extendedprice AS DECIMAL(18,2)) AS line_total,
  CASE WHEN l_linestatus = 'F' AND l_returnflag = 'R' THEN 'FAILED' ELSE 'COMPLETED' END AS status,
  CAST(l_shipdate AS TIMESTAMP) AS sale_timestamp
 FROM lineitem JOIN part ON p_partkey = l_partkey""",
    "inventory_snapshots": """SELECT concat('store_', CAST(l_partkey % 5 AS VARCHAR)) AS store_id, CAST(l_partkey AS VARCHAR) AS product_id,
  p_name AS product_name, CAST(l_quantity AS BIGINT) - 1 AS quantity_on_hand, CAST(l_partkey % 30 AS BIGINT) AS reorder_threshold,
  CASE WHEN l_partkey % 11 = 0 THEN NULL
       ELSE TIMESTAMP '2001-06-30 00:00:00' + INTERVAL '1' DAY * (l_partkey % 40 - 10) END AS expiry_date,
  CAST(l_shipdate AS TIMESTAMP) AS captured_at,
  l_orderkey AS t1, l_linenumber AS t2, l_suppkey AS t3, l_extendedprice AS t4
 FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_shipdate <= TIMESTAMP '2001-06-30 00:00:00'""",
    "customers": """SELECT concat('store_', CAST(c_custkey % 5 AS VARCHAR)) AS store_id, CAST(c_custkey AS VARCHAR) AS customer_id,
  c_name AS name, concat('+91', CAST(c_custkey % 1000 AS VARCHAR)) AS phone, CAST(c_acctbal AS DECIMAL(18,2)) AS total_spend,
  CAST(c_custkey % 17 AS BIGINT) AS visit_count,
  CASE WHEN c_custkey % 7 = 0 THEN NULL
       ELSE TIMESTAMP '2001-06-30 00:00:00' - INTERVAL '1' DAY * (c_custkey % 120) END AS last_purchase_at,
  TIMESTAMP '2001-06-30 00:00:00' - INTERVAL '1' DAY * (c_custkey % 700) AS created_at
 FROM customer""",
    "customer_captures": """SELECT concat('store_', CAST(o_custkey % 5 AS VARCHAR)) AS store_id, CAST(o_custkey AS VARCHAR) AS customer_id,
  c_name AS name, CAST(o_totalprice AS DECIMAL(18,2)) AS total_spend, CAST(o_orderkey % 17 AS BIGINT) AS visit_count,
  CAST(o_orderdate AS TIMESTAMP) AS last_purchase_at, CAST(o_orderdate AS TIMESTAMP) AS captured_at, o_orderkey AS tie
 FROM orders JOIN customer ON o_custkey = c_custkey""",
    "alert_log": """SELECT concat('store_', CAST(user_id % 5 AS VARCHAR)) AS store_id, CAST(user_id AS VARCHAR) AS alert_id, event_id AS seq,
  CASE event_id % 4 WHEN 0 THEN 'LOW_STOCK' WHEN 1 THEN 'EXPIRY_SOON' WHEN 2 THEN 'NOT_SELLING' ELSE 'HIGH_DEMAND' END AS alert_type,
  CASE event_type WHEN 'error' THEN 'ACTIVE' WHEN 'signup' THEN 'ACTIVE' WHEN 'click' THEN 'ACKNOWLEDGED' ELSE 'RESOLVED' END AS status,
  CASE WHEN value < 5 THEN 'LOW' WHEN value < 10 THEN 'MEDIUM' WHEN value < 50 THEN 'HIGH' ELSE 'CRITICAL' END AS severity,
  CAST(ts AS TIMESTAMP) AS captured_at
 FROM events""",
    "alerts": """SELECT concat('store_', CAST(user_id % 5 AS VARCHAR)) AS store_id, CAST(event_id AS VARCHAR) AS alert_id,
  CASE event_id % 4 WHEN 0 THEN 'LOW_STOCK' WHEN 1 THEN 'EXPIRY_SOON' WHEN 2 THEN 'NOT_SELLING' ELSE 'HIGH_DEMAND' END AS alert_type,
  CASE event_type WHEN 'error' THEN 'ACTIVE' WHEN 'signup' THEN 'ACTIVE' WHEN 'click' THEN 'ACKNOWLEDGED' ELSE 'RESOLVED' END AS status,
  CASE WHEN value < 5 THEN 'LOW' WHEN value < 10 THEN 'MEDIUM' WHEN value < 50 THEN 'HIGH' ELSE 'CRITICAL' END AS severity,
  concat('Alert ', CAST(event_id AS VARCHAR)) AS title, concat('Signal ', event_type) AS message,
  CAST(user_id AS VARCHAR) AS source_entity_id,
  CAST(ts AS TIMESTAMP) AS created_at, CAST(ts AS TIMESTAMP) + INTERVAL '1' HOUR * (event_id % 30) AS last_evaluated_at,
  CASE WHEN event_type = 'click' THEN CAST(ts AS TIMESTAMP) + INTERVAL '1' DAY * (event_id % 3) END AS acknowledged_at,
  CASE WHEN event_type IN ('view', 'purchase') THEN CAST(ts AS TIMESTAMP) + INTERVAL '1' DAY * (event_id % 5) END AS resolved_at
 FROM events""",
    "product_embeddings": """SELECT concat('store_', CAST(vec_id % 5 AS VARCHAR)) AS store_id, CAST(vec_id AS VARCHAR) AS product_id, embedding
 FROM embeddings""",
    "messages": """SELECT concat('store_', CAST(conv_id % 5 AS VARCHAR)) AS store_id, CAST(conv_id AS VARCHAR) AS chat_session_id, turn, role, text,
  TIMESTAMP '2024-01-01 00:00:00' + INTERVAL '1' HOUR * conv_id + INTERVAL '1' MINUTE * turn AS created_at
 FROM conversations""",
    "questions": f"""SELECT concat('store_', CAST(p_partkey % 5 AS VARCHAR)) AS store_id, concat('q_', CAST(p_partkey AS VARCHAR)) AS query_id,
  {QUESTION_TEXT} AS query_text FROM part
 UNION ALL
 SELECT concat('store_', CAST(conv_id % 5 AS VARCHAR)), concat('m_', CAST(conv_id AS VARCHAR), '_', CAST(turn AS VARCHAR)), text
 FROM conversations WHERE role = 'user'""",
}


def sql_views(*names: str) -> str:
    """``WITH`` clause defining the named views; a query follows, or a comma and more definitions."""
    return "WITH " + ",\n".join(f"{name} AS ({SQL_VIEWS[name]})" for name in names)
