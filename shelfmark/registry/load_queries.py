"""Coercion, change windows, collapse, upsert, listings, customers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from shelfmark.functions import coerce, timing
from shelfmark.functions.coerce import for_output
from shelfmark.operators import customers as cust, listings
from shelfmark.plans import raw_load, refresh, repair
from shelfmark.registry import query
from shelfmark.session import scratch_path
from shelfmark.sources import testdata as td
from shelfmark.sources.tables import Warehouse, merge_rows
from shelfmark.sources.testdata import AS_OF, sql_views
from shelfmark.sources.windows import any_changed_between, changed_between

# The same loose spellings of a line's quantity for both engines.
LOOSE = """CASE l_orderkey % 7 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'bad' WHEN 3 THEN concat(CAST(CAST(l_quantity AS BIGINT) AS {t}), '.9')
 WHEN 4 THEN concat(' ', CAST(CAST(l_quantity AS BIGINT) AS {t})) WHEN 5 THEN concat('-', CAST(CAST(l_quantity AS BIGINT) AS {t}), '.5')
 ELSE CAST(CAST(l_quantity AS BIGINT) AS {t}) END"""
LOOSE_SQL = "WITH loose AS (SELECT l_orderkey, l_linenumber, " + LOOSE.format(t="VARCHAR") + " AS v FROM lineitem)"


def _loose(spark, d):
    return td.table(spark, d, "lineitem").selectExpr("l_orderkey", "l_linenumber", LOOSE.format(t="STRING") + " AS v")


@query("coerce_int", LOOSE_SQL + """ SELECT l_orderkey, l_linenumber, v AS raw,
 CAST(coalesce(trunc(try_cast(trim(v) AS DOUBLE)), 0) AS BIGINT) AS as_int,
 CASE WHEN regexp_matches(trim(v), '^-?[0-9]+$') THEN try_cast(trim(v) AS BIGINT) END AS whole_or_null FROM loose""")
def _(spark, d):
    return _loose(spark, d).select("l_orderkey", "l_linenumber", F.col("v").alias("raw"),
                                   coerce.int_or("v").alias("as_int"), coerce.int_or_null("v").alias("whole_or_null"))


@query("coerce_float", LOOSE_SQL + """ SELECT l_orderkey, l_linenumber, v AS raw, coalesce(try_cast(trim(v) AS DOUBLE), 0) AS as_float,
 try_cast(trim(v) AS DOUBLE) AS float_or_null FROM loose""")
def _(spark, d):
    return _loose(spark, d).select("l_orderkey", "l_linenumber", F.col("v").alias("raw"),
                                   coerce.float_or("v").alias("as_float"), coerce.float_or_null("v").alias("float_or_null"))


STAMPS = """CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'soon' WHEN 2 THEN concat({iso}, 'Z') ELSE {iso} END"""


@query("coerce_timestamp", "WITH loose AS (SELECT event_id, date_trunc('second', ts) AS t FROM events)" + """
 SELECT event_id, CASE WHEN event_id % 4 >= 2 THEN strftime(t, '%Y-%m-%dT%H:%M:%S') || '+00:00' END AS read_back FROM loose""")
def _(spark, d):
    iso = "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\")"
    rows = td.table(spark, d, "events").selectExpr("event_id", STAMPS.format(iso=iso) + " AS v")
    return rows.select("event_id", coerce.iso_utc(coerce.utc_timestamp("v")).alias("read_back"))


@query("expiry_status", sql_views("products") + """ SELECT store_id, product_id,
 CASE WHEN expiry_date IS NULL THEN 'OK' WHEN expiry_date < TIMESTAMP '2001-06-30 00:00:00' THEN 'EXPIRED'
  WHEN expiry_date <= TIMESTAMP '2001-07-07 00:00:00' THEN 'EXPIRING_SOON' ELSE 'OK' END AS expiry_status,
 CAST(date_diff('day', DATE '2001-06-30', CAST(expiry_date AS DATE)) AS INTEGER) AS calendar_days,
 CAST(floor((epoch_us(expiry_date) - epoch_us(TIMESTAMP '2001-06-30 00:00:00')) / 86400000000.0) AS BIGINT) AS whole_days,
 CASE WHEN age = 0 THEN 'added today' WHEN age = 1 THEN 'added 1 day ago' WHEN age < 7 THEN 'added ' || age || ' days ago'
  ELSE 'added on ' || strftime(created_at, '%b %d') END AS age_text
 FROM (SELECT *, date_diff('day', created_at, TIMESTAMP '2001-06-30 00:00:00') AS age FROM products)""")
def _(spark, d):
    expiry = F.col("expiry_date")
    return td.products(spark, d).select(
        "store_id", "product_id", timing.expiry_status(expiry, AS_OF).alias("expiry_status"),
        timing.calendar_days_to(expiry, AS_OF).alias("calendar_days"),
        timing.whole_days_to(expiry, AS_OF).alias("whole_days"),
        timing.product_age_text(F.col("created_at"), AS_OF).alias("age_text"),
    )


@query("freshness", """WITH m AS (SELECT event_id, ts, CASE event_id % 5 WHEN 0 THEN 'fresh' WHEN 1 THEN ' Delayed ' WHEN 2 THEN 'stale'
  WHEN 3 THEN 'unknown' END AS stored, epoch_us(TIMESTAMP '2024-01-30 23:00:00') - epoch_us(ts) AS age FROM events),
 r AS (SELECT event_id, CASE WHEN age <= 1800000000 THEN 0 WHEN age <= 7200000000 THEN 1 ELSE 2 END AS computed,
  CASE lower(trim(stored)) WHEN 'fresh' THEN 0 WHEN 'delayed' THEN 1 WHEN 'stale' THEN 2 ELSE -1 END AS s FROM m)
 SELECT event_id, CASE greatest(computed, s) WHEN 0 THEN 'fresh' WHEN 1 THEN 'delayed' ELSE 'stale' END AS freshness_status FROM r""")
def _(spark, d):
    rows = td.table(spark, d, "events").selectExpr(
        "event_id", "cast(ts as timestamp) AS at",
        "CASE event_id % 5 WHEN 0 THEN 'fresh' WHEN 1 THEN ' Delayed ' WHEN 2 THEN 'stale' WHEN 3 THEN 'unknown' END AS stored",
    )
    computed = timing.freshness_by_age(F.col("at"), "2024-01-30T23:00:00")
    return rows.select("event_id", timing.stricter_freshness(computed, F.col("stored")).alias("freshness_status"))


@query("change_window", sql_views("transactions") + """ SELECT store_id, transaction_id, status FROM transactions
 WHERE sale_timestamp >= TIMESTAMP '2001-01-01 00:00:00' AND sale_timestamp < TIMESTAMP '2001-04-01 00:00:00'""")
def _(spark, d):
    return changed_between(td.transactions(spark, d), "2001-01-01", "2001-04-01", on="sale_timestamp").select(
        "store_id", "transaction_id", "status")


@query("multi_ts_changes", sql_views("alerts") + """, hits AS (SELECT alert_id FROM alerts WHERE created_at >= TIMESTAMP '2024-01-10 00:00:00' AND created_at < TIMESTAMP '2024-01-12 00:00:00'
 UNION SELECT alert_id FROM alerts WHERE last_evaluated_at >= TIMESTAMP '2024-01-10 00:00:00' AND last_evaluated_at < TIMESTAMP '2024-01-12 00:00:00'
 UNION SELECT alert_id FROM alerts WHERE acknowledged_at >= TIMESTAMP '2024-01-10 00:00:00' AND acknowledged_at < TIMESTAMP '2024-01-12 00:00:00'
 UNION SELECT alert_id FROM alerts WHERE resolved_at >= TIMESTAMP '2024-01-10 00:00:00' AND resolved_at < TIMESTAMP '2024-01-12 00:00:00')
 SELECT store_id, alert_id, alert_type, status, severity FROM alerts WHERE alert_id IN (SELECT alert_id FROM hits)""")
def _(spark, d):
    return any_changed_between(td.alerts(spark, d), "2024-01-10", "2024-01-12", on=raw_load.ALERT_INSTANTS).select(
        "store_id", "alert_id", "alert_type", "status", "severity")


@query("collapse_lines", """WITH lines AS (SELECT CAST(l_orderkey AS VARCHAR) AS transaction_id,
  concat('store_', CAST(l_orderkey % 5 AS VARCHAR)) AS store_id,
  CASE WHEN l_partkey % 9 = 0 THEN '' ELSE CAST(l_suppkey AS VARCHAR) END AS product_id,
  CASE WHEN l_returnflag = 'A' THEN NULL ELSE p_name END AS product_name, CAST(l_quantity AS BIGINT) AS quantity,
  CASE WHEN l_returnflag = 'N' THEN NULL ELSE CAST(p_retailprice AS DECIMAL(18,2)) END AS unit_price,
  CAST(l_extendedprice AS DECIMAL(18,2)) AS line_total, l_linenumber, l_partkey, l_quantity, l_extendedprice
  FROM lineitem JOIN part ON p_partkey = l_partkey)
 SELECT transaction_id, store_id, product_id,
  (array_agg(product_name ORDER BY l_linenumber, l_partkey, l_quantity, l_extendedprice) FILTER (WHERE product_name IS NOT NULL))[1] AS product_name,
  CAST(SUM(quantity) AS BIGINT) AS quantity,
  CAST((array_agg(unit_price ORDER BY l_linenumber, l_partkey, l_quantity, l_extendedprice) FILTER (WHERE unit_price IS NOT NULL))[1] AS DOUBLE) AS unit_price,
  CAST(SUM(line_total) AS DOUBLE) AS line_total
 FROM lines WHERE product_id <> '' GROUP BY 1, 2, 3""")
def _(spark, d):
    lines = td.table(spark, d, "lineitem").join(
        td.table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_retailprice"), "l_partkey"
    ).selectExpr(
        "cast(l_orderkey as string) AS transaction_id", "concat('store_', cast(l_orderkey % 5 as string)) AS store_id",
        "CASE WHEN l_partkey % 9 = 0 THEN '' ELSE cast(l_suppkey as string) END AS product_id",
        "CASE WHEN l_returnflag = 'A' THEN NULL ELSE p_name END AS product_name", "cast(l_quantity as bigint) AS quantity",
        "CASE WHEN l_returnflag = 'N' THEN NULL ELSE cast(p_retailprice as decimal(18,2)) END AS unit_price",
        "cast(l_extendedprice as decimal(18,2)) AS line_total", "cast(l_shipdate as timestamp) AS sale_timestamp",
        "struct(l_linenumber, l_partkey, l_quantity, l_extendedprice) AS pos",
    )
    return for_output(raw_load.collapse_lines(lines).drop("sale_timestamp"))


@query("upsert_customers", sql_views("customers") + """, src AS (SELECT concat('store_', CAST(o_custkey % 5 AS VARCHAR)) AS store_id,
  CAST(o_custkey AS VARCHAR) AS customer_id, CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total_spend,
  CAST(COUNT(*) AS BIGINT) AS visit_count FROM orders WHERE o_orderdate >= TIMESTAMP '2001-01-01 00:00:00' GROUP BY 1, 2
  UNION ALL SELECT concat('store_', CAST(s_suppkey % 5 AS VARCHAR)), 'new_' || CAST(s_suppkey AS VARCHAR), CAST(CAST(s_acctbal AS DECIMAL(18,2)) AS DOUBLE), CAST(1 AS BIGINT) FROM supplier)
 SELECT coalesce(s.store_id, c.store_id) AS store_id, coalesce(s.customer_id, c.customer_id) AS customer_id, c.name, c.phone,
  coalesce(s.total_spend, CAST(c.total_spend AS DOUBLE)) AS total_spend, coalesce(s.visit_count, c.visit_count) AS visit_count
 FROM customers c FULL JOIN src s ON s.customer_id = c.customer_id""")
def _(spark, d):
    target = td.customers(spark, d).select("store_id", "customer_id", "name", "phone", "total_spend", "visit_count")
    bought = td.table(spark, d, "orders").where("o_orderdate >= timestamp_ntz'2001-01-01 00:00:00'").groupBy(
        F.expr("concat('store_', cast(o_custkey % 5 as string))").alias("store_id"),
        F.col("o_custkey").cast("string").alias("customer_id"),
    ).agg(coerce.money(F.sum(coerce.money("o_totalprice"))).alias("total_spend"), F.count(F.lit(1)).alias("visit_count"))
    fresh = td.table(spark, d, "supplier").selectExpr(
        "concat('store_', cast(s_suppkey % 5 as string)) AS store_id", "concat('new_', cast(s_suppkey as string)) AS customer_id",
        "cast(s_acctbal as decimal(18,2)) AS total_spend", "1L AS visit_count")
    source = bought.unionByName(fresh)
    return for_output(merge_rows(target, source, ["customer_id"], keep_stored=["name", "phone"]))


@query("customer_rollup", sql_views("customers", "transactions") + """, batch AS (SELECT store_id, customer_id, SUM(total_amount) AS spend,
  COUNT(*) AS visits, MAX(sale_timestamp) AS last FROM transactions WHERE customer_id IS NOT NULL GROUP BY 1, 2)
 SELECT c.store_id, c.customer_id, CAST(c.total_spend + b.spend AS DOUBLE) AS total_spend, CAST(c.visit_count + b.visits AS BIGINT) AS visit_count,
  strftime(b.last, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS last_purchase_at
 FROM customers c JOIN batch b ON b.store_id = c.store_id AND b.customer_id = c.customer_id""")
def _(spark, d):
    rolled = cust.customer_rollup(td.customers(spark, d), td.transactions(spark, d))
    return for_output(rolled.select("store_id", "customer_id", "total_spend", "visit_count", "last_purchase_at"))


@query("duplicate_phones", """WITH r AS (SELECT concat('store_', CAST(c_custkey % 5 AS VARCHAR)) AS store_id, CAST(c_custkey AS VARCHAR) AS customer_id,
  concat('+91', CAST(c_custkey % 90 AS VARCHAR)) AS phone, TIMESTAMP '2001-06-30 00:00:00' + INTERVAL '1' MINUTE * (c_custkey % 60) AS requested_at FROM customer),
 known AS (SELECT DISTINCT concat('store_', CAST(s_suppkey % 5 AS VARCHAR)) AS store_id, concat('+91', CAST(s_suppkey % 40 AS VARCHAR)) AS phone FROM supplier),
 n AS (SELECT *, row_number() OVER (PARTITION BY store_id, phone ORDER BY requested_at, customer_id) AS rn FROM r)
 SELECT n.store_id, customer_id, n.phone, CASE WHEN known.phone IS NOT NULL THEN 'PHONE_EXISTS' ELSE 'PHONE_REPEATED' END AS reason
 FROM n LEFT JOIN known ON known.store_id = n.store_id AND known.phone = n.phone WHERE known.phone IS NOT NULL OR rn > 1""")
def _(spark, d):
    requests = td.table(spark, d, "customer").selectExpr(
        "concat('store_', cast(c_custkey % 5 as string)) AS store_id", "cast(c_custkey as string) AS customer_id",
        "concat('+91', cast(c_custkey % 90 as string)) AS phone",
        "timestamp'2001-06-30 00:00:00' + INTERVAL '1' MINUTE * (c_custkey % 60) AS requested_at")
    existing = td.table(spark, d, "supplier").selectExpr(
        "concat('store_', cast(s_suppkey % 5 as string)) AS store_id", "concat('+91', cast(s_suppkey % 40 as string)) AS phone")
    return cust.duplicate_phones(requests, existing).select("store_id", "customer_id", "phone", "reason")


@query("purchase_history", sql_views("transactions", "customers") + """
 SELECT t.store_id, t.customer_id, t.transaction_id, CAST(t.total_amount AS DOUBLE) AS total_amount,
  strftime(t.sale_timestamp, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS sale_timestamp
 FROM transactions t WHERE EXISTS (SELECT 1 FROM customers c WHERE c.store_id = t.store_id AND c.customer_id = t.customer_id)""")
def _(spark, d):
    return for_output(cust.purchase_history(td.transactions(spark, d), td.customers(spark, d)))


@query("customer_list", sql_views("customers") + """
 SELECT store_id, customer_id, name, phone, CAST(total_spend AS DOUBLE) AS total_spend, visit_count,
  strftime(last_purchase_at, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS last_purchase_at,
  strftime(created_at, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS created_at FROM customers""")
def _(spark, d):
    return for_output(cust.list_customers(td.customers(spark, d)))


@query("low_stock_products", sql_views("products") + """ SELECT store_id, product_id, quantity_on_hand, reorder_threshold FROM products
 WHERE quantity_on_hand <= reorder_threshold AND expiry_date < TIMESTAMP '2001-07-10 00:00:00'""")
def _(spark, d):
    return listings.filter_products(td.products(spark, d), low_stock_only=True, expiry_before="2001-07-10").select(
        "store_id", "product_id", "quantity_on_hand", "reorder_threshold")


def _page_sql(source: str, order: str, columns: str) -> str:
    return f"""SELECT {columns}, CAST(rn AS INTEGER) AS position, CASE WHEN total > 100 THEN '100' END AS next_page_token
 FROM (SELECT *, row_number() OVER (PARTITION BY store_id ORDER BY {order}) AS rn, count(*) OVER (PARTITION BY store_id) AS total FROM {source})
 WHERE rn > 50 AND rn <= 100"""


@query("products_page", sql_views("products") + _page_sql("products", "product_id", "store_id, product_id, name"))
def _(spark, d):
    return listings.product_pages(td.products(spark, d), offset=50, limit=50).select(
        "store_id", "product_id", "name", "position", "next_page_token")


@query("transactions_page", sql_views("transactions") + _page_sql(
    "(SELECT * FROM transactions WHERE sale_timestamp BETWEEN TIMESTAMP '2000-01-01 00:00:00' AND TIMESTAMP '2000-12-31 00:00:00')",
    "sale_timestamp DESC, transaction_id", "store_id, transaction_id, customer_id, CAST(total_amount AS DOUBLE) AS total_amount, status"))
def _(spark, d):
    pages = listings.transaction_pages(td.transactions(spark, d), start="2000-01-01", end="2000-12-31", offset=50, limit=50)
    return for_output(pages.drop("sale_timestamp"))


def _entities(spark, d):
    sales = td.transactions(spark, d)
    none = F.lit(None).cast("string")
    people = td.customers(spark, d)
    return {
        "transactions": sales.select("*", none.alias("idempotency_key"), F.col("sale_timestamp").alias("created_at")),
        "lines": td.items(spark, d).withColumn("created_at", F.col("sale_timestamp")),
        "products": td.products(spark, d),
        "customers": people.withColumn("updated_at", F.col("created_at")),
        "alerts": td.alerts(spark, d),
    }


@query("sync_and_refresh", sql_views("transactions") + """ SELECT store_id, strftime(CAST(sale_timestamp AS DATE), '%Y-%m-%d') AS sales_date,
  CAST(SUM(total_amount) AS DOUBLE) AS total_sales, CAST(COUNT(*) AS BIGINT) AS transaction_count FROM transactions
 WHERE sale_timestamp >= TIMESTAMP '2001-04-01 00:00:00' AND sale_timestamp < TIMESTAMP '2001-07-01 00:00:00' GROUP BY 1, 2""")
def _(spark, d):
    """Two adjacent windows, then the marts."""
    warehouse = Warehouse(spark, scratch_path(spark, "warehouse"))
    source = _entities(spark, d)
    for since, until in (("2001-04-01", "2001-05-15"), ("2001-05-15", "2001-07-01")):
        raw_load.load_window(warehouse, source, since, until)
    refresh.refresh_marts(warehouse, as_of=AS_OF, run_id="run", window=("2001-04-01", "2001-07-01"))
    return for_output(warehouse.read("sales_daily").select("store_id", "sales_date", "total_sales", "transaction_count"))


@query("upsert_moved_rows", """SELECT concat('e_', CAST(event_id AS VARCHAR)) AS event_id, concat('store_', CAST(user_id % 5 AS VARCHAR)) AS store_id,
  strftime(CASE event_type WHEN 'click' THEN ts + INTERVAL '1' DAY ELSE ts END, '%Y-%m-%d') AS day FROM events""")
def _(spark, d):
    """All events, then the clicks once more, each a day later."""
    warehouse = Warehouse(spark, scratch_path(spark, "moved-warehouse"))
    rows = td.table(spark, d, "events").selectExpr(
        "concat('e_', cast(event_id as string)) AS event_id", "concat('store_', cast(user_id % 5 as string)) AS store_id",
        "cast(ts as timestamp) AS changed_at", "event_type")
    warehouse.upsert("alert_events", rows.drop("event_type"))
    moved = rows.where("event_type = 'click'").withColumn("changed_at", F.expr("changed_at + INTERVAL '1' DAY"))
    warehouse.upsert("alert_events", moved.drop("event_type"))
    return warehouse.read("alert_events").select("event_id", "store_id", F.date_format("changed_at", "yyyy-MM-dd").alias("day"))


#: Three syncs of half a month each; every store is due with the window of all three.
SYNC_ENDS = ("2001-05-01", "2001-05-16", "2001-05-31")


def _synced(spark, d, ends=SYNC_ENDS, **given) -> Warehouse:
    warehouse, source = Warehouse(spark, scratch_path(spark, "synced")), {**_entities(spark, d), **given}
    source["stores"] = source["products"].select("store_id").distinct()
    for end in ends:
        repair.run_sync(warehouse, source, as_of=end)
    repair.run_transform(warehouse, source["stores"], as_of=ends[-1])
    return warehouse


@query("refresh_after_several_syncs", sql_views("transactions") + """ SELECT store_id, strftime(CAST(sale_timestamp AS DATE), '%Y-%m-%d') AS sales_date,
  CAST(SUM(total_amount) AS DOUBLE) AS total_sales, CAST(COUNT(*) AS BIGINT) AS transaction_count FROM transactions
 WHERE sale_timestamp >= TIMESTAMP '2001-04-01 00:00:00' AND sale_timestamp < TIMESTAMP '2001-05-31 00:00:00' GROUP BY 1, 2""")
def _(spark, d):
    return for_output(_synced(spark, d).read("sales_daily").select("store_id", "sales_date", "total_sales", "transaction_count"))


@query("mart_metadata", sql_views("products") + """ SELECT DISTINCT store_id, true AS own_run, '2001-04-01T00:00:00+00:00' AS source_window_start,
  '2001-05-31T00:00:00+00:00' AS source_window_end FROM products""")
def _(spark, d):
    warehouse = _synced(spark, d)
    runs = warehouse.read("pipeline_runs").where("run_type = 'MART_REFRESH' AND status = 'SUCCEEDED'").select("store_id", "pipeline_run_id")
    rows = warehouse.read("analytics_metadata").join(runs, "store_id", "left")
    return for_output(rows.select("store_id", (F.col("last_pipeline_run_id") == F.col("pipeline_run_id")).alias("own_run"), "source_window_start", "source_window_end"))


def _sale_lines(spark, d):
    """The lines with their sale's store and time."""
    sales = td.transactions(spark, d).select("transaction_id", "store_id", "sale_timestamp", F.col("sale_timestamp").alias("created_at"))
    return td.items(spark, d).drop("store_id", "sale_timestamp").join(sales, "transaction_id")


#: The last sync ends within a day, so that the day has a dashboard row.
MIDDAY_ENDS = (*SYNC_ENDS[:-1], "2001-05-31 12:00:00")
LOADED = "sale_timestamp >= TIMESTAMP '2001-04-01 00:00:00' AND sale_timestamp < TIMESTAMP '2001-05-31 12:00:00'"


@query("marts_of_one_version", sql_views("transactions", "products", "customers") + f""",
 lines AS (SELECT concat('store_', CAST(o_custkey % 5 AS VARCHAR)) AS store_id, CAST(l_partkey AS VARCHAR) AS product_id, p_name AS product_name,
   CAST(l_quantity AS BIGINT) AS quantity, CAST(l_extendedprice AS DECIMAL(18,2)) AS line_total, CAST(o_orderdate AS TIMESTAMP) AS sale_timestamp
  FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey),
 sales AS (SELECT store_id, CAST(sale_timestamp AS DATE) AS day, SUM(total_amount) AS total, COUNT(*) AS n FROM transactions WHERE {LOADED} GROUP BY 1, 2),
 sold AS (SELECT store_id, CAST(sale_timestamp AS DATE) AS day, product_id, MAX(product_name) AS product_name, SUM(quantity) AS n, SUM(line_total) AS total
  FROM lines WHERE {LOADED} GROUP BY 1, 2, 3),
 health AS (SELECT *, quantity_on_hand < reorder_threshold AS low FROM products WHERE updated_at >= TIMESTAMP '2001-04-01 00:00:00' AND updated_at < TIMESTAMP '2001-05-31 12:00:00'),
 people AS (SELECT * FROM customers WHERE created_at >= TIMESTAMP '2001-04-01 00:00:00' AND created_at < TIMESTAMP '2001-05-31 12:00:00'),
 top AS (SELECT store_id, max_by(product_name, (n, product_name, product_id)) AS product_name FROM sold WHERE day = DATE '2001-05-31' GROUP BY 1),
 low AS (SELECT store_id, count(*) FILTER (WHERE low) AS n FROM health GROUP BY 1)
 SELECT 'sales_daily' AS mart, store_id, strftime(day, '%Y-%m-%d') AS day, NULL AS id, NULL AS name, CAST(n AS BIGINT) AS n, CAST(total AS DOUBLE) AS amount FROM sales
 UNION ALL SELECT 'product_sales_daily', store_id, strftime(day, '%Y-%m-%d'), product_id, product_name, CAST(n AS BIGINT), CAST(total AS DOUBLE) FROM sold
 UNION ALL SELECT 'customer_summary', store_id, NULL, customer_id, name, visit_count, CAST(total_spend AS DOUBLE) FROM people
 UNION ALL SELECT 'inventory_health', store_id, '2001-05-31', product_id, name, quantity_on_hand, CAST(date_diff('day', DATE '2001-05-31', CAST(expiry_date AS DATE)) AS DOUBLE) FROM health
 UNION ALL SELECT 'dashboard_summary', s.store_id, '2001-05-31', NULL, top.product_name, CAST(coalesce(low.n, 0) AS BIGINT), CAST(s.total AS DOUBLE)
  FROM sales s LEFT JOIN top ON top.store_id = s.store_id LEFT JOIN low ON low.store_id = s.store_id WHERE s.day = DATE '2001-05-31'""")
def _(spark, d):
    """All five marts after three syncs, read from one version."""
    reader = _synced(spark, d, MIDDAY_ENDS, lines=_sale_lines(spark, d)).at()
    none = "cast(null as string)"
    shapes = {
        "sales_daily": ("sales_date", none, none, "transaction_count", "total_sales"),
        "product_sales_daily": ("sales_date", "product_id", "product_name", "quantity_sold", "revenue"),
        "customer_summary": ("cast(null as date)", "customer_id", "customer_name", "visit_count", "lifetime_spend"),
        "inventory_health": ("snapshot_date", "product_id", "product_name", "quantity_on_hand", "days_to_expiry"),
        "dashboard_summary": ("snapshot_date", none, "top_selling_product", "low_stock_count", "today_sales"),
    }
    frames = [reader.read(mart).selectExpr(f"'{mart}' AS mart", "store_id", f"date_format({day}, 'yyyy-MM-dd') AS day", f"{key} AS id", f"{name} AS name", f"{n} AS n", f"cast({amount} as double) AS amount")
              for mart, (day, key, name, n, amount) in shapes.items()]
    return reduce(DataFrame.unionByName, frames)


@query("purge_store", sql_views("transactions", "customers") + f""", sales AS (SELECT * FROM transactions WHERE {LOADED} AND store_id <> 'store_1')
 SELECT 'transactions_raw' AS name, store_id, COUNT(*) AS n FROM sales GROUP BY 2
 UNION ALL SELECT 'sales_daily', store_id, COUNT(DISTINCT CAST(sale_timestamp AS DATE)) FROM sales GROUP BY 2
 UNION ALL SELECT 'customers_raw', store_id, COUNT(*) FROM customers WHERE store_id <> 'store_1' AND created_at >= TIMESTAMP '2001-04-01 00:00:00' AND created_at < TIMESTAMP '2001-05-31 12:00:00' GROUP BY 2""")
def _(spark, d):
    """What is left of three tables once one store has left."""
    warehouse = _synced(spark, d, MIDDAY_ENDS)
    warehouse.purge_store("store_1")
    frames = [warehouse.read(name).groupBy("store_id").agg(F.count(F.lit(1)).alias("n")).withColumn("name", F.lit(name)) for name in ("transactions_raw", "sales_daily", "customers_raw")]
    return reduce(DataFrame.unionByName, frames)


@query("replace_stores", """SELECT concat('store_', CAST(vec_id % 5 AS VARCHAR)) AS store_id, CAST(vec_id AS VARCHAR) AS product_id, len(embedding) AS n_dims,
  vec_id % 5 < 2 AS replaced FROM embeddings WHERE vec_id % 5 >= 2 OR vec_id % 2 = 0""")
def _(spark, d):
    """All vectors, then two stores' anew, of every other product only."""
    warehouse = Warehouse(spark, scratch_path(spark, "replaced"))
    rows = td.embeddings(spark, d)
    warehouse.replace_stores("product_embeddings", rows.withColumn("embedding_text", F.lit("first")))
    anew = rows.where("store_id IN ('store_0', 'store_1') AND cast(product_id as bigint) % 2 = 0")
    warehouse.replace_stores("product_embeddings", anew.withColumn("embedding_text", F.lit("second")))
    return warehouse.read("product_embeddings").select("store_id", "product_id", F.size("embedding").cast("long").alias("n_dims"), (F.col("embedding_text") == "second").alias("replaced"))


@query("append_rows", """SELECT concat('e_', CAST(event_id AS VARCHAR)) AS event_id, 'store_' || (user_id % 5) AS store_id FROM events UNION ALL
 SELECT concat('e_', CAST(event_id AS VARCHAR)), 'store_' || (user_id % 5) FROM events WHERE event_type = 'click'""")
def _(spark, d):
    """Audit rows are only ever added, also rows that are there already."""
    warehouse = Warehouse(spark, scratch_path(spark, "appended"))
    rows = td.table(spark, d, "events").selectExpr(
        "concat('e_', cast(event_id as string)) AS event_id", "concat('store_', cast(user_id % 5 as string)) AS store_id", "cast(ts as timestamp) AS changed_at", "event_type")
    warehouse.append("alert_events", rows)
    warehouse.append("alert_events", rows.where("event_type = 'click'"))
    return warehouse.read("alert_events").select("event_id", "store_id")
