"""Marts and the reads over them."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark.functions.coerce import for_output
from shelfmark.plans import marts, reads
from shelfmark.registry import query
from shelfmark.sources import testdata as td
from shelfmark.sources.testdata import AS_OF, EVENTS_AS_OF, sql_views

SALES = """, sales AS (SELECT store_id, CAST(sale_timestamp AS DATE) AS sales_date, SUM(total_amount) AS total_sales,
  CAST(COUNT(*) AS BIGINT) AS transaction_count FROM transactions GROUP BY 1, 2)"""
PRODUCT_SALES = """, product_sales AS (SELECT store_id, CAST(sale_timestamp AS DATE) AS sales_date, product_id,
  MAX(product_name) AS product_name, CAST(SUM(quantity) AS BIGINT) AS quantity_sold, SUM(line_total) AS revenue
  FROM items GROUP BY 1, 2, 3)"""
HEALTH = """, health AS (SELECT store_id, product_id, product_name, quantity_on_hand, reorder_threshold,
  CAST(date_diff('day', DATE '2001-06-30', CAST(expiry_date AS DATE)) AS INTEGER) AS days_to_expiry,
  quantity_on_hand < reorder_threshold AS is_low_stock
  FROM (SELECT *, row_number() OVER (PARTITION BY store_id, product_id
        ORDER BY captured_at DESC, t1 DESC, t2 DESC, t3 DESC, t4 DESC) AS rn FROM inventory_snapshots) WHERE rn = 1)"""
SUMMARY = """, summary AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY store_id, customer_id
  ORDER BY captured_at DESC, tie DESC) AS rn FROM customer_captures) WHERE rn = 1)"""
DASHBOARD = SALES + PRODUCT_SALES + HEALTH + """, low AS (SELECT store_id, CAST(COUNT(*) AS BIGINT) AS n FROM health
  WHERE is_low_stock GROUP BY 1),
 top AS (SELECT * FROM (SELECT store_id, product_name, row_number() OVER (PARTITION BY store_id
  ORDER BY quantity_sold DESC, product_name DESC, product_id DESC) AS rn FROM product_sales
  WHERE sales_date = DATE '2001-06-30') WHERE rn = 1),
 dashboard AS (SELECT s.store_id, s.sales_date AS snapshot_date, s.total_sales AS today_sales,
  s.transaction_count AS today_transactions, coalesce(low.n, 0) AS active_alert_count,
  coalesce(low.n, 0) AS low_stock_count, top.product_name AS top_selling_product
  FROM sales s LEFT JOIN low ON low.store_id = s.store_id LEFT JOIN top ON top.store_id = s.store_id
  WHERE s.sales_date = DATE '2001-06-30')"""
DAY = "strftime({}, '%Y-%m-%d')"


def _sales(spark, d):
    return marts.sales_daily(td.transactions(spark, d))


def _product_sales(spark, d):
    return marts.product_sales_daily(td.items(spark, d))


def _health(spark, d):
    return marts.inventory_health(td.inventory_snapshots(spark, d), as_of=AS_OF, tie=["tie"])


def _summary(spark, d):
    return marts.customer_summary(td.customer_captures(spark, d), tie=["tie"])


def _dashboard(spark, d):
    return marts.dashboard_summary(_sales(spark, d), _product_sales(spark, d), _health(spark, d), as_of=AS_OF)


def _stores(spark, d):
    return td.customers(spark, d).select("store_id").distinct()


@query("sales_daily", sql_views("transactions") + SALES + """
 SELECT store_id, strftime(sales_date, '%Y-%m-%d') AS sales_date, CAST(total_sales AS DOUBLE) AS total_sales, transaction_count,
  CAST(total_sales AS DOUBLE) / transaction_count AS average_basket_value FROM sales""")
def _(spark, d):
    return for_output(_sales(spark, d))


@query("product_sales_daily", sql_views("items") + PRODUCT_SALES + """
 SELECT store_id, strftime(sales_date, '%Y-%m-%d') AS sales_date, product_id, product_name, quantity_sold,
  CAST(revenue AS DOUBLE) AS revenue FROM product_sales""")
def _(spark, d):
    return for_output(_product_sales(spark, d))


@query("customer_latest", sql_views("customer_captures") + SUMMARY + """
 SELECT store_id, customer_id, name AS customer_name, CAST(total_spend AS DOUBLE) AS lifetime_spend, visit_count,
  strftime(last_purchase_at, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS last_purchase_at FROM summary""")
def _(spark, d):
    return for_output(_summary(spark, d))


@query("inventory_health", sql_views("inventory_snapshots") + HEALTH + """
 SELECT store_id, '2001-06-30' AS snapshot_date, product_id, product_name, quantity_on_hand, reorder_threshold,
  days_to_expiry, is_low_stock FROM health""")
def _(spark, d):
    return for_output(_health(spark, d))


@query("low_stock_counts", sql_views("inventory_snapshots") + HEALTH + """
 SELECT store_id, '2001-06-30' AS snapshot_date, CAST(count(*) FILTER (WHERE is_low_stock) AS BIGINT) AS low_stock_count
 FROM health GROUP BY 1""")
def _(spark, d):
    return for_output(marts.low_stock_counts(_health(spark, d)))


@query("dashboard_summary", sql_views("transactions", "items", "inventory_snapshots") + DASHBOARD + """
 SELECT store_id, strftime(snapshot_date, '%Y-%m-%d') AS snapshot_date, CAST(today_sales AS DOUBLE) AS today_sales, today_transactions,
  active_alert_count, low_stock_count, top_selling_product FROM dashboard""")
def _(spark, d):
    return for_output(_dashboard(spark, d))


# Every sales day as a dashboard row, so that "latest" has something to choose from.
DASHBOARDS = SALES + PRODUCT_SALES + """, top AS (SELECT * FROM (SELECT store_id, sales_date, product_name,
  row_number() OVER (PARTITION BY store_id, sales_date ORDER BY quantity_sold DESC, product_name DESC, product_id DESC) AS rn
  FROM product_sales) WHERE rn = 1),
 dashboards AS (SELECT s.store_id, s.sales_date AS snapshot_date, s.total_sales AS today_sales,
  s.transaction_count AS today_transactions, top.product_name AS top_selling_product
  FROM sales s LEFT JOIN top ON top.store_id = s.store_id AND top.sales_date = s.sales_date),
 latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY store_id ORDER BY snapshot_date DESC) AS rn FROM dashboards)
  WHERE rn = 1)"""


def _dashboards(spark, d, product_sales=None):
    top = (
        (_product_sales(spark, d) if product_sales is None else product_sales).groupBy("store_id", "sales_date")
        .agg(F.max(F.struct("quantity_sold", "product_name", "product_id")).alias("top"))
    )
    zero = F.lit(0).cast("bigint")
    return _sales(spark, d).join(top, ["store_id", "sales_date"], "left").select(
        "store_id", F.col("sales_date").alias("snapshot_date"), F.col("total_sales").alias("today_sales"),
        F.col("transaction_count").alias("today_transactions"), zero.alias("active_alert_count"),
        zero.alias("low_stock_count"), F.col("top.product_name").alias("top_selling_product"),
    )


@query("latest_dashboard", sql_views("transactions", "items") + DASHBOARDS + """
 SELECT store_id, strftime(snapshot_date, '%Y-%m-%d') AS snapshot_date, CAST(today_sales AS DOUBLE) AS today_sales, today_transactions,
  CAST(0 AS BIGINT) AS active_alert_count, CAST(0 AS BIGINT) AS low_stock_count, top_selling_product FROM latest""")
def _(spark, d):
    return for_output(reads.latest_dashboard(_dashboards(spark, d)))


@query("dashboard_with_alert_truth", sql_views("transactions", "items", "alert_log") + DASHBOARDS + """
 , alert_now AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY store_id, alert_id ORDER BY captured_at DESC, seq DESC) AS rn
   FROM alert_log) WHERE rn = 1),
 truth AS (SELECT store_id, CAST(count(*) FILTER (WHERE status = 'ACTIVE') AS BIGINT) AS n FROM alert_now GROUP BY 1)
 SELECT l.store_id, strftime(snapshot_date, '%Y-%m-%d') AS snapshot_date, CAST(today_sales AS DOUBLE) AS today_sales, today_transactions,
  coalesce(truth.n, 0) AS active_alert_count, CAST(0 AS BIGINT) AS low_stock_count, top_selling_product
 FROM latest l LEFT JOIN truth ON truth.store_id = l.store_id""")
def _(spark, d):
    return for_output(reads.dashboard_with_alert_truth(_dashboards(spark, d), td.alert_log(spark, d), tie=F.desc("seq")))


@query("active_alert_counts", sql_views("alert_log") + """
 SELECT store_id, CAST(count(*) FILTER (WHERE status = 'ACTIVE') AS BIGINT) AS active_alert_count
 FROM (SELECT *, row_number() OVER (PARTITION BY store_id, alert_id ORDER BY captured_at DESC, seq DESC) AS rn FROM alert_log)
 WHERE rn = 1 GROUP BY 1""")
def _(spark, d):
    return reads.active_alert_counts(td.alert_log(spark, d), tie=F.desc("seq"))


@query("live_dashboard", sql_views("transactions", "items", "alerts", "customers") + """
 , today AS (SELECT store_id, CAST(SUM(total_amount) AS DOUBLE) AS today_sales, CAST(COUNT(*) AS BIGINT) AS n FROM transactions
   WHERE CAST(sale_timestamp AS DATE) = DATE '2001-06-30' GROUP BY 1),
 open_alerts AS (SELECT store_id, CAST(COUNT(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE alert_type = 'LOW_STOCK') AS BIGINT) AS low
   FROM alerts WHERE status = 'ACTIVE' GROUP BY 1),
 units AS (SELECT store_id, product_id, SUM(quantity) AS u, MAX(product_name) AS nm FROM items
   WHERE CAST(sale_timestamp AS DATE) = DATE '2001-06-30' GROUP BY 1, 2),
 top AS (SELECT * FROM (SELECT store_id, nm, row_number() OVER (PARTITION BY store_id ORDER BY u DESC, nm DESC, product_id DESC) AS rn
   FROM units) WHERE rn = 1)
 SELECT s.store_id, coalesce(t.today_sales, 0) AS today_sales, coalesce(t.n, 0) AS today_transactions,
  coalesce(a.n, 0) AS active_alert_count, coalesce(a.low, 0) AS low_stock_count, top.nm AS top_selling_product
 FROM (SELECT DISTINCT store_id FROM customers) s LEFT JOIN today t ON t.store_id = s.store_id
 LEFT JOIN open_alerts a ON a.store_id = s.store_id LEFT JOIN top ON top.store_id = s.store_id""")
def _(spark, d):
    return for_output(reads.live_dashboard(_stores(spark, d), td.transactions(spark, d), td.items(spark, d),
                                           td.alerts(spark, d), as_of=AS_OF))


def _trend_sql(source: str, label: str, days: int) -> str:
    return sql_views("transactions") + SALES + f"""
 SELECT store_id, strftime({label}, '%Y-%m-%d') AS label, CAST(SUM(total_sales) AS DOUBLE) AS sales_amount,
  CAST(SUM(transaction_count) AS BIGINT) AS transactions FROM {source}
 WHERE sales_date >= DATE '2001-06-30' - INTERVAL '{days}' DAY GROUP BY 1, 2"""


@query("trend_daily_mart", _trend_sql("sales", "sales_date", 30))
def _(spark, d):
    return for_output(reads.in_chart_order(reads.sales_trend(_sales(spark, d), as_of=AS_OF, days=30)))


@query("trend_weekly_mart", _trend_sql("sales", "date_trunc('week', sales_date)", 90))
def _(spark, d):
    return for_output(reads.sales_trend(_sales(spark, d), as_of=AS_OF, days=90, granularity="weekly"))


@query("trend_live_daily", _trend_sql("sales", "sales_date", 29))
def _(spark, d):
    return for_output(reads.live_sales_trend(td.transactions(spark, d), as_of=AS_OF, days=30))


@query("trend_live_weekly", _trend_sql("sales", "date_trunc('week', sales_date)", 89))
def _(spark, d):
    return for_output(reads.live_sales_trend(td.transactions(spark, d), as_of=AS_OF, days=90, granularity="weekly"))


def _performance_sql(order: str) -> str:
    return sql_views("items") + f"""
 , totals AS (SELECT store_id, product_id, MAX(product_name) AS product_name, CAST(SUM(quantity) AS BIGINT) AS quantity_sold,
   SUM(line_total) AS revenue FROM items GROUP BY 1, 2)
 SELECT store_id, product_id, product_name, quantity_sold, CAST(revenue AS DOUBLE) AS revenue
 FROM (SELECT *, row_number() OVER (PARTITION BY store_id ORDER BY {order}) AS rn FROM totals) WHERE rn <= 50"""


@query("product_performance", _performance_sql("revenue DESC, product_id"))
def _(spark, d):
    return for_output(reads.product_performance(_product_sales(spark, d)))


@query("product_performance_live", _performance_sql("revenue DESC, product_name, product_id"))
def _(spark, d):
    return for_output(reads.live_product_performance(td.items(spark, d)))


@query("customer_insights", sql_views("customer_captures") + SUMMARY + """
 SELECT store_id, customer_id, name, CAST(total_spend AS DOUBLE) AS lifetime_spend, visit_count
 FROM (SELECT store_id, customer_id, name, total_spend, visit_count,
   row_number() OVER (PARTITION BY store_id ORDER BY total_spend DESC, customer_id) AS r FROM summary) WHERE r <= 10""")
def _(spark, d):
    return for_output(reads.customer_insights(_summary(spark, d)))


@query("customer_insights_live", sql_views("customers") + """
 SELECT store_id, customer_id, name, CAST(total_spend AS DOUBLE) AS lifetime_spend, visit_count
 FROM (SELECT *, row_number() OVER (PARTITION BY store_id ORDER BY total_spend DESC, name, customer_id) AS r FROM customers)
 WHERE r <= 10""")
def _(spark, d):
    return for_output(reads.live_customer_insights(td.customers(spark, d)))


@query("latest_product_sales_top3", sql_views("items") + PRODUCT_SALES + """
 , newest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY store_id, product_id ORDER BY sales_date DESC) AS rn
   FROM product_sales) WHERE rn = 1)
 SELECT store_id, strftime(sales_date, '%Y-%m-%d') AS sales_date, product_id, product_name, quantity_sold,
  CAST(revenue AS DOUBLE) AS revenue, CAST(r AS INTEGER) AS rank
 FROM (SELECT *, row_number() OVER (PARTITION BY store_id ORDER BY revenue DESC, quantity_sold DESC, product_id) AS r FROM newest)
 WHERE r <= 3""")
def _(spark, d):
    return for_output(reads.latest_product_sales(_product_sales(spark, d)))


@query("last7_days", sql_views("transactions") + SALES + """
 SELECT store_id, strftime(sales_date, '%Y-%m-%d') AS sales_date, CAST(total_sales AS DOUBLE) AS total_sales, transaction_count,
  CAST(total_sales AS DOUBLE) / transaction_count AS average_basket_value, CAST(r AS INTEGER) AS rank
 FROM (SELECT *, row_number() OVER (PARTITION BY store_id ORDER BY sales_date DESC) AS r FROM sales) WHERE r <= 7""")
def _(spark, d):
    return for_output(reads.last_sales_days(_sales(spark, d)))


@query("top3_customers", sql_views("customer_captures") + SUMMARY + """
 SELECT store_id, customer_id, name AS customer_name, CAST(total_spend AS DOUBLE) AS lifetime_spend, visit_count,
  strftime(last_purchase_at, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS last_purchase_at, CAST(r AS INTEGER) AS rank
 FROM (SELECT store_id, customer_id, name, total_spend, visit_count, last_purchase_at,
   row_number() OVER (PARTITION BY store_id ORDER BY total_spend DESC, visit_count DESC, customer_id) AS r FROM summary) WHERE r <= 3""")
def _(spark, d):
    return for_output(reads.top_customers(_summary(spark, d)))


@query("sales_direction", sql_views("transactions") + SALES + """
 , ranked AS (SELECT *, row_number() OVER (PARTITION BY store_id ORDER BY sales_date DESC) AS r FROM sales)
 SELECT a.store_id, strftime(a.sales_date, '%Y-%m-%d') AS latest_sales_date, CAST(a.total_sales AS DOUBLE) AS latest_total_sales,
  CAST(b.total_sales AS DOUBLE) AS previous_total_sales,
  CASE WHEN b.store_id IS NULL THEN NULL WHEN a.total_sales > b.total_sales THEN 'up'
       WHEN a.total_sales < b.total_sales THEN 'down' ELSE 'flat' END AS direction
 FROM ranked a LEFT JOIN ranked b ON b.store_id = a.store_id AND b.r = 2 WHERE a.r = 1""")
def _(spark, d):
    return for_output(reads.sales_direction(_sales(spark, d)))


@query("alert_summary", sql_views("alerts") + """
 SELECT store_id, CAST(count(*) FILTER (WHERE status = 'ACTIVE') AS BIGINT) AS active,
  CAST(count(*) FILTER (WHERE status = 'ACKNOWLEDGED') AS BIGINT) AS acknowledged,
  CAST(count(*) FILTER (WHERE status = 'RESOLVED' AND CAST(resolved_at AS DATE) = DATE '2024-01-31') AS BIGINT) AS resolved_today
 FROM alerts GROUP BY 1""")
def _(spark, d):
    return reads.alert_summary(td.alerts(spark, d), as_of=EVENTS_AS_OF)


@query("inventory_counts", sql_views("products") + """
 SELECT store_id, CAST(count(*) FILTER (WHERE status = 'ACTIVE') AS BIGINT) AS active_products,
  CAST(count(*) FILTER (WHERE status = 'ACTIVE' AND reorder_threshold > 0 AND quantity_on_hand <= reorder_threshold) AS BIGINT) AS low_stock,
  CAST(count(*) FILTER (WHERE status = 'ACTIVE' AND expiry_date <= TIMESTAMP '2001-07-07 00:00:00') AS BIGINT) AS expired_or_expiring
 FROM products GROUP BY 1""")
def _(spark, d):
    return reads.inventory_counts(td.products(spark, d), as_of=AS_OF)
