"""Alert rules, reconciling, lifecycle."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark.functions.coerce import for_output
from shelfmark.operators import alert_book, alert_rules, demand
from shelfmark.plans import sweep
from shelfmark.registry import query
from shelfmark.sources import testdata as td
from shelfmark.sources.testdata import AS_OF, EVENTS_AS_OF, sql_views

LOW = """SELECT store_id, 'LOW_STOCK' AS alert_type, 'LOW_STOCK_' || product_id AS condition_key, product_id AS source_entity_id,
 quantity_on_hand <= reorder_threshold AS triggered,
 CASE WHEN quantity_on_hand <= reorder_threshold THEN CASE WHEN quantity_on_hand = 0 THEN 'CRITICAL' ELSE 'HIGH' END END AS severity,
 CASE WHEN quantity_on_hand <= reorder_threshold THEN name || ' stock is low' END AS title,
 CASE WHEN quantity_on_hand <= reorder_threshold THEN 'Only ' || quantity_on_hand || ' units left. Reorder soon.' END AS message
 FROM products"""
EXPIRY = """SELECT store_id, 'EXPIRY_SOON' AS alert_type, 'EXPIRY_SOON_' || product_id AS condition_key, product_id AS source_entity_id,
 t AS triggered, CASE WHEN t THEN CASE WHEN d <= 0 THEN 'HIGH' ELSE 'MEDIUM' END END AS severity,
 CASE WHEN t THEN name || ' expires soon' END AS title,
 CASE WHEN t THEN CASE WHEN d < 0 THEN quantity_on_hand || ' units have expired.'
   WHEN d = 0 THEN quantity_on_hand || ' units expire today.'
   ELSE quantity_on_hand || ' units expire within ' || d || ' days.' END END AS message
 FROM (SELECT *, coalesce(quantity_on_hand > 0 AND d <= 7, false) AS t
       FROM (SELECT *, CAST(floor((epoch_us(expiry_date) - epoch_us(TIMESTAMP '2001-06-30 00:00:00')) / 86400000000.0) AS BIGINT) AS d
             FROM products))"""
NOT_SELLING = """SELECT p.store_id, 'NOT_SELLING' AS alert_type, 'NOT_SELLING_' || p.product_id AS condition_key,
 p.product_id AS source_entity_id, t AS triggered, CASE WHEN t THEN 'MEDIUM' END AS severity,
 CASE WHEN t THEN name || ' is not selling' END AS title,
 CASE WHEN t THEN 'No sales in the last 14 days while stock is still available.' END AS message
 FROM (SELECT p.*, quantity_on_hand > 0 AND coalesce(u, 0) <= 0 AS t FROM products p LEFT JOIN (
  SELECT store_id, product_id, SUM(quantity) AS u FROM items WHERE status = 'COMPLETED'
   AND sale_timestamp BETWEEN TIMESTAMP '2001-06-16 00:00:00' AND TIMESTAMP '2001-06-30 00:00:00' GROUP BY 1, 2) s
  ON s.store_id = p.store_id AND s.product_id = p.product_id) p"""
DEMAND = """SELECT store_id, 'HIGH_DEMAND' AS alert_type, 'HIGH_DEMAND_' || product_id AS condition_key, product_id AS source_entity_id,
 spike OR cover AS triggered, CASE WHEN spike OR cover THEN 'HIGH' END AS severity,
 CASE WHEN spike OR cover THEN name || ' demand is high' END AS title,
 CASE WHEN spike AND cover THEN 'Recent demand signal detected (sales acceleration and low stock cover).'
   WHEN spike THEN 'Recent demand signal detected (sales acceleration vs baseline).'
   WHEN cover THEN 'Recent demand signal detected (low stock cover).' END AS message
 FROM (SELECT *, b > 0 AND 2 * r * 14 >= 3 * b * 3 AS spike, r > 0 AND quantity_on_hand < r AS cover FROM (
  SELECT p.*, coalesce(x.r, 0) AS r, coalesce(x.b, 0) AS b FROM products p LEFT JOIN (
   SELECT store_id, product_id,
    SUM(CASE WHEN sale_timestamp BETWEEN TIMESTAMP '2001-06-27 00:00:00' AND TIMESTAMP '2001-06-30 00:00:00' THEN quantity ELSE 0 END) AS r,
    SUM(CASE WHEN sale_timestamp BETWEEN TIMESTAMP '2001-06-13 00:00:00' AND TIMESTAMP '2001-06-27 00:00:00' THEN quantity ELSE 0 END) AS b
   FROM items WHERE status = 'COMPLETED' GROUP BY 1, 2) x ON x.store_id = p.store_id AND x.product_id = p.product_id))"""
RULES = ", rules AS (" + "\nUNION ALL\n".join([LOW, EXPIRY, NOT_SELLING, DEMAND]) + ")"

# The newest event of every (user, kind) as the stored alert of the product with that number.
BOOK = """, book AS (SELECT store_id, alert_id, alert_type, alert_type || '_' || source_entity_id AS condition_key, source_entity_id,
  status, severity, title, message, created_at FROM (SELECT *, row_number() OVER (PARTITION BY store_id, source_entity_id, alert_type
   ORDER BY created_at DESC, alert_id DESC) AS rn FROM alerts) WHERE rn = 1)"""


def _book(spark, d):
    alerts = td.alerts(spark, d)
    newest = alert_book.newest_per(alerts, ["store_id", "source_entity_id", "alert_type"],
                                   [F.desc("created_at"), F.desc("alert_id")])
    none = F.lit(None).cast("string")
    return newest.select(
        "alert_id", "store_id", "alert_type",
        F.concat_ws("_", "alert_type", "source_entity_id").alias("condition_key"), "source_entity_id", "status",
        "severity", "title", "message", none.alias("metadata"), "created_at", "last_evaluated_at", "acknowledged_at",
        none.alias("acknowledged_by"), "resolved_at", none.alias("resolved_by"), none.alias("resolution_note"),
    )


def _rules(spark, d):
    return sweep.rule_rows(("LOW_STOCK", "EXPIRY_SOON", "NOT_SELLING", "HIGH_DEMAND"), td.products(spark, d),
                           td.items(spark, d), as_of=AS_OF)


def _fired(rows):
    return rows.where("triggered").drop("triggered", "metadata")


def _fired_sql(rule: str) -> str:
    return f" SELECT store_id, alert_type, condition_key, source_entity_id, severity, title, message FROM ({rule}) WHERE triggered"


@query("units_sold_window", sql_views("items") + """
 SELECT store_id, product_id, CAST(SUM(quantity) AS BIGINT) AS units_sold FROM items WHERE status = 'COMPLETED'
  AND sale_timestamp BETWEEN TIMESTAMP '2001-06-16 00:00:00' AND TIMESTAMP '2001-06-30 00:00:00' GROUP BY 1, 2""")
def _(spark, d):
    from shelfmark.functions.timing import days_before, instant

    return alert_rules.units_sold(td.items(spark, d), start=days_before(AS_OF, 14), end=instant(AS_OF))


@query("rule_low_stock", sql_views("products") + _fired_sql(LOW))
def _(spark, d):
    return _fired(alert_rules.low_stock(td.products(spark, d)))


@query("rule_expiry_soon", sql_views("products") + _fired_sql(EXPIRY))
def _(spark, d):
    return _fired(alert_rules.expiry_soon(td.products(spark, d), as_of=AS_OF))


@query("rule_not_selling", sql_views("products", "items") + _fired_sql(NOT_SELLING))
def _(spark, d):
    return _fired(alert_rules.not_selling(td.products(spark, d), td.items(spark, d), as_of=AS_OF))


@query("rule_high_demand", sql_views("products", "items") + _fired_sql(DEMAND))
def _(spark, d):
    return _fired(alert_rules.high_demand(td.products(spark, d), td.items(spark, d), as_of=AS_OF))


@query("rules_from_kept_days", sql_views("products", "items") + _fired_sql(NOT_SELLING) + " UNION ALL " + _fired_sql(DEMAND))
def _(spark, d):
    """Both sales rules from sums per day and the sales of the windows' first and last days."""
    items = td.items(spark, d)
    ends = items.where(F.to_date("sale_timestamp").isin([F.date_sub(F.lit(AS_OF).cast("date"), n) for n in (0, 3, 14, 17)]))
    return _fired(sweep.rule_rows(("NOT_SELLING", "HIGH_DEMAND"), td.products(spark, d), ends, as_of=AS_OF, days=demand.day_units(items)))


@query("reconcile_alerts", sql_views("products", "items", "alerts") + RULES + BOOK + """
 , open_book AS (SELECT * FROM book WHERE status <> 'RESOLVED'),
 decided AS (SELECT r.*, b.alert_id AS old_id, b.status AS old_status, b.severity AS old_severity, b.title AS old_title,
   b.message AS old_message, b.created_at AS old_created,
   CASE WHEN r.triggered AND b.alert_id IS NULL THEN 'INSERT' WHEN r.triggered THEN 'REFRESH'
        WHEN b.alert_id IS NOT NULL THEN 'RESOLVE' ELSE 'NONE' END AS action
  FROM rules r LEFT JOIN open_book b ON b.store_id = r.store_id AND b.condition_key = r.condition_key)
 SELECT CASE WHEN action = 'INSERT' THEN 'alert_' || substr(sha256(store_id || '|' || condition_key || '|' ||
    CAST(epoch_us(TIMESTAMP '2001-06-30 00:00:00') AS VARCHAR)), 1, 32) ELSE old_id END AS alert_id,
  store_id, condition_key, CASE action WHEN 'INSERT' THEN 'ACTIVE' WHEN 'RESOLVE' THEN 'RESOLVED' ELSE old_status END AS status,
  CASE WHEN action = 'RESOLVE' THEN old_severity ELSE severity END AS severity,
  CASE WHEN action = 'RESOLVE' THEN old_title ELSE title END AS title,
  CASE WHEN action = 'RESOLVE' THEN old_message ELSE message END AS message,
  CASE WHEN action = 'RESOLVE' THEN 'system' END AS resolved_by,
  CASE WHEN action = 'RESOLVE' THEN 'Condition automatically cleared.' END AS resolution_note,
  action = 'INSERT' AS is_new
 FROM decided WHERE action <> 'NONE'""")
def _(spark, d):
    changed = alert_book.reconcile(_rules(spark, d), _book(spark, d), as_of=AS_OF).alerts
    return changed.select(
        "alert_id", "store_id", "condition_key", "status", "severity", "title", "message", "resolved_by",
        "resolution_note", F.col("alert_id").startswith("alert_").alias("is_new"),
    )


@query("reconcile_events", sql_views("products", "items", "alerts") + RULES + BOOK + """
 , decided AS (SELECT r.store_id, r.triggered, r.condition_key, b.alert_id AS old_id, b.status AS old_status
  FROM rules r LEFT JOIN (SELECT * FROM book WHERE status <> 'RESOLVED') b
   ON b.store_id = r.store_id AND b.condition_key = r.condition_key)
 SELECT store_id, CASE WHEN triggered THEN 'NONE' ELSE old_status END AS from_status,
  CASE WHEN triggered THEN 'ACTIVE' ELSE 'RESOLVED' END AS to_status, CAST(count(*) AS BIGINT) AS events
 FROM decided WHERE triggered = (old_id IS NULL) GROUP BY 1, 2, 3""")
def _(spark, d):
    events = alert_book.reconcile(_rules(spark, d), _book(spark, d), as_of=AS_OF).events
    return events.groupBy("store_id", "from_status", "to_status").agg(F.count_distinct("event_id").alias("events"))


@query("backfill_alerts", sql_views("products", "alerts") + ", rules AS (" + LOW + " WHERE status <> 'INACTIVE' UNION ALL " +
       EXPIRY + " WHERE status <> 'INACTIVE')" + BOOK + """
 SELECT r.store_id, r.alert_type, CASE WHEN r.triggered AND b.alert_id IS NULL THEN 'INSERT' WHEN r.triggered THEN 'REFRESH'
   ELSE 'RESOLVE' END AS action, CAST(count(*) AS BIGINT) AS alerts
 FROM rules r LEFT JOIN (SELECT * FROM book WHERE status <> 'RESOLVED') b ON b.store_id = r.store_id AND b.condition_key = r.condition_key
 WHERE r.triggered OR b.alert_id IS NOT NULL GROUP BY 1, 2, 3""")
def _(spark, d):
    live = td.products(spark, d).where("status <> 'INACTIVE'")
    rules = sweep.rule_rows(("LOW_STOCK", "EXPIRY_SOON"), live, None, as_of=AS_OF)
    return (
        alert_book.decide(rules, _book(spark, d)).where("action <> 'NONE'")
        .groupBy("store_id", "alert_type", "action").agg(F.count(F.lit(1)).alias("alerts"))
    )


# Every event is also a command on the alert of its user: clicks acknowledge, purchases and errors resolve.
COMMANDS = """, commands AS (SELECT CAST(event_id AS VARCHAR) AS command_id, event_id, CAST(user_id AS VARCHAR) AS alert_id,
  concat('store_', CAST(CASE WHEN event_id % 50 = 0 THEN (user_id + 1) % 5 ELSE user_id % 5 END AS VARCHAR)) AS store_id,
  CASE WHEN event_type IN ('click', 'view') THEN 'ACKNOWLEDGE' ELSE 'RESOLVE' END AS command, ts FROM events),
 state0 AS (SELECT store_id, alert_id, CASE CAST(alert_id AS BIGINT) % 3 WHEN 0 THEN 'ACTIVE' WHEN 1 THEN 'ACKNOWLEDGED' ELSE 'RESOLVED' END AS status
  FROM (SELECT DISTINCT store_id, source_entity_id AS alert_id FROM alerts))"""


@query("alert_lifecycle", sql_views("alerts") + COMMANDS + """
 , seen AS (SELECT c.*, s.status AS s0,
   count(*) FILTER (WHERE command = 'RESOLVE') OVER w AS prior_resolve, count(*) FILTER (WHERE command = 'ACKNOWLEDGE') OVER w AS prior_ack
  FROM commands c LEFT JOIN state0 s ON s.alert_id = c.alert_id AND s.store_id = c.store_id
  WINDOW w AS (PARTITION BY c.alert_id, c.store_id ORDER BY ts, command_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 staged AS (SELECT *, CASE WHEN s0 IS NULL THEN NULL WHEN s0 = 'RESOLVED' OR prior_resolve > 0 THEN 'RESOLVED'
   WHEN s0 = 'ACKNOWLEDGED' OR prior_ack > 0 THEN 'ACKNOWLEDGED' ELSE 'ACTIVE' END AS from_status FROM seen)
 SELECT command_id, alert_id, store_id, command, from_status,
  coalesce(CASE WHEN command = 'ACKNOWLEDGE' THEN from_status = 'ACTIVE' ELSE from_status <> 'RESOLVED' END, false) AS accepted,
  CASE WHEN from_status IS NULL THEN 'ALERT_NOT_FOUND' WHEN coalesce(CASE WHEN command = 'ACKNOWLEDGE' THEN from_status = 'ACTIVE'
   ELSE from_status <> 'RESOLVED' END, false) THEN NULL ELSE 'INVALID_ALERT_TRANSITION' END AS reason
 FROM staged""")
def _(spark, d):
    commands = td.table(spark, d, "events").selectExpr(
        "cast(event_id as string) AS command_id", "cast(user_id as string) AS alert_id",
        "concat('store_', cast(CASE WHEN event_id % 50 = 0 THEN (user_id + 1) % 5 ELSE user_id % 5 END as string)) AS store_id",
        "CASE WHEN event_type IN ('click', 'view') THEN 'ACKNOWLEDGE' ELSE 'RESOLVE' END AS command",
        "'u' AS user_id", "cast(null as string) AS note", "cast(ts as timestamp) AS requested_at",
    )
    states = td.alerts(spark, d).select("store_id", F.col("source_entity_id").alias("alert_id")).distinct().selectExpr(
        "alert_id", "store_id",
        "CASE cast(alert_id as bigint) % 3 WHEN 0 THEN 'ACTIVE' WHEN 1 THEN 'ACKNOWLEDGED' ELSE 'RESOLVED' END AS status",
        "cast(null as timestamp) AS acknowledged_at", "cast(null as string) AS acknowledged_by",
        "cast(null as timestamp) AS resolved_at", "cast(null as string) AS resolved_by",
        "cast(null as string) AS resolution_note",
    )
    return alert_book.run_commands(states, commands).decisions.select(
        "command_id", "alert_id", "store_id", "command", "from_status", "accepted", "reason"
    )


@query("alert_list", sql_views("alerts") + """
 SELECT store_id, alert_id, alert_type, status, severity, title, message FROM alerts WHERE status = 'ACTIVE' AND severity = 'HIGH'""")
def _(spark, d):
    return alert_book.list_alerts(td.alerts(spark, d), status="ACTIVE", severity="HIGH").select(
        "store_id", "alert_id", "alert_type", "status", "severity", "title", "message"
    )


@query("alert_priority_list", sql_views("alerts") + """
 SELECT store_id, alert_id, status, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY store_id
  ORDER BY CASE WHEN status = 'ACTIVE' THEN 0 ELSE 1 END, alert_id) AS r FROM alerts WHERE status IN ('ACTIVE', 'ACKNOWLEDGED')) WHERE r <= 10""")
def _(spark, d):
    return alert_book.relevant_alerts(td.alerts(spark, d)).select("store_id", "alert_id", "status", "rank")
