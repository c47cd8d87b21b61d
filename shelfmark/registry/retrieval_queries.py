"""Intents, product matching, snapshots, briefings, evidence, sessions."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark.functions import phrases as P, text as X
from shelfmark.functions.coerce import for_output
from shelfmark.operators import advice, focus, hybrid, lexical, sessions, vectors
from shelfmark.operators.alert_book import relevant_alerts
from shelfmark.plans import answers, briefing, reads
from shelfmark.registry import query
from shelfmark.registry.mart_queries import SALES, SUMMARY, DASHBOARDS, _dashboards, _product_sales, _sales, _stores, _summary
from shelfmark.session import settle, small_broadcasts
from shelfmark.sources import testdata as td
from shelfmark.sources.testdata import AS_OF, sql_views


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_phrase(phrases, column: str = "lower(query_text)") -> str:
    return "(" + " OR ".join(f"contains({column}, {_quoted(p)})" for p in phrases) + ")"


def sql_word(words) -> str:
    listed = ", ".join(_quoted(w) for w in words)
    return f"list_has_any(string_split_regex(lower(query_text), '[^a-z0-9]+'), [{listed}])"


SUMMARY_SQL = sql_phrase(P.BUSINESS_SUMMARY_PHRASES)
REASON_SQL = f"(NOT {SUMMARY_SQL} AND ({sql_phrase(P.REASONING_PHRASES)} OR regexp_matches(lower(query_text), '\\b(why|explain)\\b')))"
INTENT_SQL = f"""CASE WHEN {SUMMARY_SQL} THEN 'business_summary' WHEN {sql_phrase(P.REORDER_INTENT_PHRASES)} THEN 'reorder_decision'
 WHEN {sql_phrase(P.SALES_INTENT_PHRASES)} THEN 'sales_kpi' WHEN {sql_phrase(P.CUSTOMER_KEYWORDS)} THEN 'customer_insight'
 WHEN {sql_phrase(P.TRANSACTION_KEYWORDS)} THEN 'transaction_lookup' WHEN {sql_phrase(P.RISK_INTENT_PHRASES)} THEN 'inventory_risk'
 WHEN {sql_word(P.PRODUCT_INTENT_WORDS)} THEN 'product_lookup' WHEN {REASON_SQL} THEN 'reasoning' ELSE 'general' END"""


@query("intent", sql_views("questions") + f""", q AS (SELECT *, {INTENT_SQL} AS intent FROM questions)
 SELECT store_id, query_id, intent, intent = 'customer_insight' OR {sql_phrase(P.CUSTOMER_KEYWORDS)} AS needs_customers,
  intent IN ('transaction_lookup', 'reasoning') OR {sql_phrase(P.TRANSACTION_KEYWORDS)} AS needs_transactions,
  intent IN ('product_lookup', 'inventory_risk', 'reorder_decision', 'reasoning') AS needs_product_focus,
  {sql_word(P.OPERATOR_WORDS)} OR {sql_phrase(P.OPERATOR_PHRASES)} AS prefers_operator FROM q""")
def _(spark, d):
    return answers.with_intent(td.questions(spark, d)).select(
        "store_id", "query_id", "intent", "needs_customers", "needs_transactions", "needs_product_focus",
        X.prefers_operator_answer(F.col("query_text")).alias("prefers_operator"))


@query("clean_text", """SELECT conv_id, turn, trim(regexp_replace(replace(replace('** ' || text || ' __', '**', ''), '__', ''), '[ \t\r\n\f\v]+', ' ', 'g')) AS cleaned,
  trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS normal FROM conversations""")
def _(spark, d):
    rows = td.table(spark, d, "conversations")
    noisy = F.concat(F.lit("** "), "text", F.lit(" __ Freshness status: stale."))
    return rows.select("conv_id", "turn", X.clean_answer(noisy).alias("cleaned"), X.normal(F.col("text")).alias("normal"))


@query("embedding_text", sql_views("products") + """ SELECT store_id, product_id, concat_ws(' | ', name, category, 'product_id: ' || product_id,
  'price_in_inr: ' || price, 'quantity_on_hand: ' || quantity_on_hand, 'status: ' || status, 'expiry_status: ' ||
  CASE WHEN expiry_date IS NULL THEN 'OK' WHEN expiry_date < TIMESTAMP '2001-06-30 00:00:00' THEN 'EXPIRED'
   WHEN expiry_date <= TIMESTAMP '2001-07-07 00:00:00' THEN 'EXPIRING_SOON' ELSE 'OK' END) AS embedding_text FROM products""")
def _(spark, d):
    return vectors.product_texts(td.products(spark, d), as_of=AS_OF).select("store_id", "product_id", "embedding_text")


NORMAL = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"
SCORE = """CASE WHEN qn = '' THEN 0.0::DOUBLE ELSE
  CASE WHEN pn <> '' AND contains(qn, pn) THEN 1.0::DOUBLE ELSE 0.0 END + CASE WHEN pn <> '' AND contains(pn, qn) THEN 0.9::DOUBLE ELSE 0.0 END
  + CASE WHEN pid <> '' AND contains(qn, pid) THEN 0.95::DOUBLE ELSE 0.0 END
  + CASE WHEN len(toks) > 0 AND pn <> '' THEN least(len(list_filter(toks, lambda t: contains(pn, t)))::DOUBLE / len(toks), 0.8::DOUBLE) ELSE 0.0 END
  + CASE WHEN len(toks) > 0 AND pc <> '' THEN least(len(list_filter(toks, lambda t: contains(pc, t)))::DOUBLE / len(toks), 0.3::DOUBLE) ELSE 0.0 END END"""
ASKED = f""", asked AS (SELECT store_id, query_id, query_text, qn, list_filter(string_split(qn, ' '), lambda t: length(t) >= 3) AS toks
  FROM (SELECT *, {NORMAL.format('query_text')} AS qn FROM {{source}})),
 shelf AS (SELECT store_id, product_id, name, category, {NORMAL.format('name')} AS pn, {NORMAL.format('category')} AS pc, {NORMAL.format('product_id')} AS pid FROM products)"""


@query("lexical_top", sql_views("questions", "products") + ASKED.format(source="questions") + f""",
 scored AS (SELECT a.store_id, a.query_id, s.product_id, {SCORE} AS score FROM asked a JOIN shelf s ON s.store_id = a.store_id)
 SELECT store_id, query_id, product_id, score, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY store_id, query_id
  ORDER BY score DESC, product_id) AS r FROM scored) WHERE r <= 4""")
def _(spark, d):
    return lexical.best_by_text(td.questions(spark, d), td.products(spark, d))


DISTANCE = "round(1 - list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(p.embedding AS DOUBLE[])), 9)"


@query("vector_topk", sql_views("product_embeddings") + f""", pairs AS (SELECT q.store_id, q.product_id AS query_id, p.product_id, {DISTANCE} AS d
  FROM product_embeddings q JOIN product_embeddings p ON p.store_id = q.store_id AND p.product_id <> q.product_id)
 SELECT store_id, query_id, product_id, round(d, 6) AS distance, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (
  PARTITION BY store_id, query_id ORDER BY d, product_id) AS r FROM pairs) WHERE r <= 5""")
def _(spark, d):
    rows = td.embeddings(spark, d)
    asked = rows.withColumnRenamed("product_id", "query_id")
    return vectors.nearest(asked, rows, k=5, skip_same=True).withColumn("distance", F.round("distance", 6))


def _vector_questions(spark, d):
    """Every embedded product asks about its neighbours: its name as text, its vector as the embedding."""
    names = td.products(spark, d).select("store_id", "product_id", "name")
    return td.embeddings(spark, d).join(names, ["store_id", "product_id"]).select(
        "store_id", F.col("product_id").alias("query_id"), F.concat(F.lit("tell me about "), "name").alias("query_text"), "embedding")


VECTOR_QUESTIONS = """, vq AS (SELECT e.store_id, e.product_id AS query_id, 'tell me about ' || p.name AS query_text, e.embedding
  FROM product_embeddings e JOIN products p ON p.product_id = e.product_id AND p.store_id = e.store_id)"""


@query("hybrid_match", sql_views("product_embeddings", "products") + VECTOR_QUESTIONS + ASKED.format(source="vq") + f""",
 pairs AS (SELECT q.store_id, q.query_id, p.product_id, {DISTANCE} AS d FROM vq q JOIN product_embeddings p ON p.store_id = q.store_id),
 hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY store_id, query_id ORDER BY d, product_id) AS r FROM pairs) WHERE r <= 6),
 scored AS (SELECT a.store_id, a.query_id, s.product_id, {SCORE} AS lex FROM asked a JOIN shelf s ON s.store_id = a.store_id),
 merged AS (SELECT s.store_id, s.query_id, s.product_id, h.d, CASE WHEN h.d IS NULL THEN lex ELSE
   greatest(lex, 0.65::DOUBLE + greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1.0::DOUBLE - h.d))) END AS score
  FROM scored s LEFT JOIN hits h ON h.store_id = s.store_id AND h.query_id = s.query_id AND h.product_id = s.product_id
  UNION ALL
  SELECT store_id, query_id, product_id, d, greatest({SCORE}, 0.55::DOUBLE + greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1.0::DOUBLE - d)))
  FROM (SELECT h.store_id, h.query_id, h.product_id, h.d, a.qn, a.toks, '' AS pn, '' AS pc, {NORMAL.format('h.product_id')} AS pid
   FROM hits h JOIN asked a ON a.store_id = h.store_id AND a.query_id = h.query_id
   WHERE NOT EXISTS (SELECT 1 FROM products p WHERE p.store_id = h.store_id AND p.product_id = h.product_id)))
 SELECT store_id, query_id, product_id, round(score, 6) AS score, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (
  PARTITION BY store_id, query_id ORDER BY score DESC, product_id) AS r FROM merged) WHERE r <= 4""")
def _(spark, d):
    asked = _vector_questions(spark, d)
    hits = vectors.nearest(asked, td.embeddings(spark, d), k=6)
    found = hybrid.hybrid_matches(asked, td.products(spark, d), hits)
    return found.select("store_id", "query_id", "product_id", F.round("score", 6).alias("score"), "rank")


TOKENS = """list_filter(list_transform(string_split_regex(query_text, '\\s+'), lambda x: lower(regexp_replace(x, '^[.,!?\\-_/]+|[.,!?\\-_/]+$', '', 'g'))), lambda x: length(x) >= 3)"""


def _focus_sql(source: str, hay: str, order: str, key: str, limit: int) -> str:
    return f""", spoken AS (SELECT store_id, query_id, {TOKENS} AS toks FROM questions),
 seen AS (SELECT s.store_id, s.query_id, x.*EXCLUDE (store_id), len(list_filter(s.toks, lambda t: {hay})) > 0 AS focused
  FROM spoken s JOIN {source} x ON x.store_id = s.store_id)
 SELECT store_id, query_id, {key}, focused, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY store_id, query_id
  ORDER BY focused DESC, {order}) AS r FROM seen) WHERE r <= {limit}"""


@query("product_snapshot", sql_views("questions", "products") + _focus_sql("products", "contains(lower(x.name), t)", "product_id", "product_id", 24))
def _(spark, d):
    products = td.products(spark, d)
    return focus.per_text(td.questions(spark, d), lambda asked: focus.product_snapshot(asked, products).select(
        "store_id", "query_id", "product_id", "focused", "rank"))


@query("customer_snapshot", sql_views("questions", "customers") + _focus_sql(
    "customers", "contains(lower(x.name), t) OR contains(x.customer_id, t) OR contains(x.phone, t)",
    "total_spend DESC, visit_count DESC, customer_id", "customer_id", 10))
def _(spark, d):
    customers = td.customers(spark, d)
    return focus.per_text(td.questions(spark, d), lambda asked: focus.customer_snapshot(asked, customers).select(
        "store_id", "query_id", "customer_id", "focused", "rank"))


def _lines(spark, d, heads):
    """Lines with the time of their sale: here the last of its lines' days."""
    when = heads.select("store_id", "transaction_id", "sale_timestamp")
    return td.items(spark, d).select("store_id", "product_id", "transaction_id").distinct().join(when, ["store_id", "transaction_id"])


def _sale_heads(spark, d):
    """Lines of one order belong to several stores here, so a sale is taken per store from its lines."""
    return td.items(spark, d).groupBy("store_id", "transaction_id").agg(
        F.max("sale_timestamp").alias("sale_timestamp"), F.sum("line_total").cast("decimal(18,2)").alias("total_amount"),
        F.lit(None).cast("string").alias("customer_id"))


@query("transaction_snapshot", sql_views("questions", "products", "items") + ASKED.format(source="questions") + f""",
 scored AS (SELECT a.store_id, a.query_id, s.product_id, {SCORE} AS score FROM asked a JOIN shelf s ON s.store_id = a.store_id),
 matches AS (SELECT * FROM (SELECT store_id, query_id, product_id, row_number() OVER (PARTITION BY store_id, query_id ORDER BY score DESC, product_id) AS r
  FROM scored) WHERE r <= 4),
 heads AS (SELECT store_id, transaction_id, MAX(sale_timestamp) AS sold_at FROM items GROUP BY 1, 2),
 about AS (SELECT DISTINCT m.store_id, m.query_id, i.transaction_id FROM matches m JOIN items i ON i.store_id = m.store_id AND i.product_id = m.product_id),
 spoken AS (SELECT DISTINCT store_id, query_id, unnest({TOKENS}) AS t FROM questions),
 named AS (SELECT DISTINCT s.store_id, s.query_id, h.transaction_id FROM spoken s JOIN heads h ON h.store_id = s.store_id AND contains(h.transaction_id, s.t)),
 pool AS (SELECT h.store_id, f.query_id, h.transaction_id, h.sold_at, true AS focused FROM heads h
   JOIN (SELECT * FROM about UNION SELECT * FROM named) f ON f.store_id = h.store_id AND f.transaction_id = h.transaction_id
  UNION ALL SELECT q.store_id, q.query_id, h.transaction_id, h.sold_at, false FROM questions q
   JOIN (SELECT *, row_number() OVER (PARTITION BY store_id ORDER BY sold_at DESC, transaction_id) AS r FROM heads) h ON h.store_id = q.store_id AND h.r <= 8),
 once AS (SELECT store_id, query_id, transaction_id, MAX(sold_at) AS sold_at, bool_or(focused) AS focused FROM pool GROUP BY 1, 2, 3)
 SELECT store_id, query_id, transaction_id, focused, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY store_id, query_id
  ORDER BY focused DESC, sold_at DESC, transaction_id) AS r FROM once) WHERE r <= 8""")
def _(spark, d):
    products, heads = td.products(spark, d), settle(_sale_heads(spark, d), "heads")

    def found(asked):
        also = focus.recent_sales_of(settle(lexical.best_by_text(asked, products)), _lines(spark, d, heads), on="product_id", limit=8)
        return focus.transaction_snapshot(asked, heads, limit=8, also=also).select("store_id", "query_id", "transaction_id", "focused", "rank")

    return focus.per_text(td.questions(spark, d), found)


RISK = """, r0 AS (SELECT *, CASE WHEN expiry_date IS NULL THEN 'OK' WHEN expiry_date < TIMESTAMP '2001-06-30 00:00:00' THEN 'EXPIRED'
   WHEN expiry_date <= TIMESTAMP '2001-07-07 00:00:00' THEN 'EXPIRING_SOON' ELSE 'OK' END AS expiry_status FROM products),
 risky AS (SELECT *, CASE expiry_status WHEN 'EXPIRED' THEN 4 WHEN 'EXPIRING_SOON' THEN 2 ELSE 0 END
   + CASE WHEN (reorder_threshold > 0 AND quantity_on_hand <= reorder_threshold) OR quantity_on_hand <= 0 THEN 3 ELSE 0 END AS risk FROM r0)"""


@query("risk_ranking", sql_views("products") + RISK + """ SELECT store_id, product_id, expiry_status, quantity_on_hand, CAST(risk AS INTEGER) AS risk, CAST(r AS INTEGER) AS rank
 FROM (SELECT *, row_number() OVER (PARTITION BY store_id ORDER BY risk DESC, quantity_on_hand, product_id) AS r FROM risky WHERE risk > 0 AND status = 'ACTIVE') WHERE r <= 20""")
def _(spark, d):
    return advice.risk_ranking(td.products(spark, d), as_of=AS_OF, k=20).select(
        "store_id", "product_id", "expiry_status", "quantity_on_hand", "risk", "rank")


@query("reorder_priority", sql_views("transactions", "items", "products") + DASHBOARDS + """,
 seller AS (SELECT p.store_id, MIN(p.product_id) AS product_id FROM products p JOIN latest l ON l.store_id = p.store_id
   AND lower(trim(p.name)) = lower(trim(l.top_selling_product)) WHERE p.status = 'ACTIVE' GROUP BY 1)
 SELECT store_id, product_id, gap, quantity_on_hand, is_top_seller, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (
   PARTITION BY store_id ORDER BY is_top_seller DESC, gap, quantity_on_hand, product_id) AS r FROM (
  SELECT p.store_id, p.product_id, quantity_on_hand - reorder_threshold AS gap, quantity_on_hand, s.product_id IS NOT NULL AS is_top_seller
  FROM products p LEFT JOIN seller s ON s.store_id = p.store_id AND s.product_id = p.product_id
  WHERE p.status = 'ACTIVE' AND reorder_threshold > 0 AND quantity_on_hand <= reorder_threshold)) WHERE r <= 10""")
def _(spark, d):
    latest = reads.latest_dashboard(_dashboards(spark, d))
    return advice.reorder_priority(td.products(spark, d), latest, k=10).select(
        "store_id", "product_id", "gap", "quantity_on_hand", "is_top_seller", "rank")


@query("newest_product", sql_views("products") + """ SELECT store_id, product_id, name, category FROM (SELECT *, row_number() OVER (PARTITION BY store_id
  ORDER BY (status = 'ACTIVE') DESC, created_at DESC, updated_at DESC, product_id) AS r FROM products) WHERE r = 1""")
def _(spark, d):
    return advice.newest_product(td.products(spark, d)).select("store_id", "product_id", "name", "category")


@query("session_history", sql_views("messages") + """ SELECT store_id, chat_session_id, role, text, CAST(r AS INTEGER) AS position
 FROM (SELECT *, row_number() OVER (PARTITION BY store_id, chat_session_id ORDER BY created_at, turn) AS r FROM messages) WHERE r <= 50""")
def _(spark, d):
    return sessions.session_history(td.messages(spark, d), tie="turn").select(
        "store_id", "chat_session_id", "role", "text", "position")


def _freshness(spark, d):
    return _stores(spark, d).select("store_id", F.lit("2001-06-30 10:45:00").cast("timestamp").alias("analytics_last_updated_at"),
                                    F.lit("fresh").alias("freshness_status"))


def _context(spark, d):
    by_day = settle(_product_sales(spark, d), "product-sales")
    return briefing.mart_context(_dashboards(spark, d, by_day), _sales(spark, d), by_day, _summary(spark, d))


FLOAT = "regexp_replace(CAST(CAST({} AS DECIMAL(18,2)) AS VARCHAR), '0$', '')"


@query("analytics_summary", sql_views("transactions", "items", "customer_captures") + DASHBOARDS + SUMMARY + f""",
 ranked AS (SELECT *, row_number() OVER (PARTITION BY store_id ORDER BY sales_date DESC) AS r FROM sales),
 newest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY store_id, product_id ORDER BY sales_date DESC) AS n FROM product_sales) WHERE n = 1),
 best AS (SELECT store_id, string_agg(product_name || ' qty_sold=' || quantity_sold || ' revenue=' || {FLOAT.format('revenue')}, ' | ' ORDER BY r) AS t
  FROM (SELECT *, row_number() OVER (PARTITION BY store_id ORDER BY revenue DESC, quantity_sold DESC, product_id) AS r FROM newest) WHERE r <= 3 GROUP BY 1),
 people AS (SELECT store_id, string_agg(name || ' lifetime_spend=' || {FLOAT.format('total_spend')} || ' visit_count=' || visit_count, '; ' ORDER BY r) AS t
  FROM (SELECT store_id, name, total_spend, visit_count, row_number() OVER (PARTITION BY store_id ORDER BY total_spend DESC, visit_count DESC, customer_id) AS r
   FROM summary) WHERE r <= 3 GROUP BY 1)
 SELECT l.store_id, 'analytics_last_updated_at=2001-06-30 10:45 UTC; freshness_status=fresh; today_sales=' || {FLOAT.format('l.today_sales')} ||
  '; today_transactions=' || l.today_transactions || '; top_selling_product=' || coalesce(l.top_selling_product, 'None') || '; active_alert_count=0; low_stock_count=0; latest_sales_date=' ||
  strftime(a.sales_date, '%Y-%m-%d') || '; latest_total_sales=' || {FLOAT.format('a.total_sales')} || '; sales_trend_direction=' ||
  CASE WHEN a.total_sales > b.total_sales THEN 'up' WHEN a.total_sales < b.total_sales THEN 'down' ELSE 'flat' END ||
  '; product_performance=' || best.t || '; top_customers=' || people.t AS analytics_summary
 FROM latest l JOIN ranked a ON a.store_id = l.store_id AND a.r = 1 JOIN ranked b ON b.store_id = l.store_id AND b.r = 2
 JOIN best ON best.store_id = l.store_id JOIN people ON people.store_id = l.store_id""")
def _(spark, d):
    return briefing.analytics_summary(_context(spark, d), _freshness(spark, d))


@query("mart_context", sql_views("transactions", "items", "customer_captures") + DASHBOARDS + SUMMARY + """,
 days AS (SELECT store_id, string_agg(strftime(sales_date, '%Y-%m-%d'), ',' ORDER BY r) AS t FROM (SELECT *, row_number() OVER (PARTITION BY store_id
  ORDER BY sales_date DESC) AS r FROM sales) WHERE r <= 7 GROUP BY 1),
 newest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY store_id, product_id ORDER BY sales_date DESC) AS n FROM product_sales) WHERE n = 1),
 best AS (SELECT store_id, string_agg(product_id, ',' ORDER BY r) AS t FROM (SELECT *, row_number() OVER (PARTITION BY store_id
  ORDER BY revenue DESC, quantity_sold DESC, product_id) AS r FROM newest) WHERE r <= 3 GROUP BY 1),
 people AS (SELECT store_id, string_agg(customer_id, ',' ORDER BY r) AS t FROM (SELECT store_id, customer_id, row_number() OVER (PARTITION BY store_id
  ORDER BY total_spend DESC, visit_count DESC, customer_id) AS r FROM summary) WHERE r <= 3 GROUP BY 1)
 SELECT l.store_id, strftime(l.snapshot_date, '%Y-%m-%d') AS snapshot_date, CAST(l.today_sales AS DOUBLE) AS today_sales, days.t AS sales_days,
  best.t AS products, people.t AS customers
 FROM latest l JOIN days ON days.store_id = l.store_id JOIN best ON best.store_id = l.store_id JOIN people ON people.store_id = l.store_id""")
def _(spark, d):
    listed = lambda column, field: F.array_join(F.transform(column, lambda e: e[field].cast("string")), ",").alias(column)
    return for_output(_context(spark, d).select(
        "store_id", "dashboard.snapshot_date", "dashboard.today_sales", listed("sales_days", "sales_date"),
        listed("products", "product_id"), listed("customers", "customer_id")))


def _facts(spark, d):
    return briefing.store_facts(_stores(spark, d), _dashboards(spark, d), td.products(spark, d), td.alerts(spark, d),
                                _summary(spark, d), td.transactions(spark, d), as_of=AS_OF)


WHOLE = "CAST(CAST(round(CAST({} AS DECIMAL(18,2)), 0) AS DECIMAL(18,0)) AS VARCHAR)"
BRIEFING = DASHBOARDS + SUMMARY + RISK + f""",
 ranked_risk AS (SELECT *, row_number() OVER (PARTITION BY store_id ORDER BY risk DESC, quantity_on_hand, product_id) AS r FROM risky WHERE risk > 0 AND status = 'ACTIVE'),
 worst AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY store_id ORDER BY risk DESC, quantity_on_hand, product_id) AS r FROM risky WHERE risk > 0) WHERE r = 1),
 risk_text AS (SELECT store_id, string_agg(name || ' (' || quantity_on_hand || ' units, ' || lower(expiry_status) || ')', ', ' ORDER BY r) AS t FROM ranked_risk WHERE r <= 3 GROUP BY 1),
 inv AS (SELECT store_id, count(*) FILTER (WHERE status = 'ACTIVE') AS active, count(*) FILTER (WHERE status = 'ACTIVE' AND reorder_threshold > 0 AND quantity_on_hand <= reorder_threshold) AS low,
  count(*) FILTER (WHERE status = 'ACTIVE' AND expiry_status <> 'OK') AS expiring, count(*) FILTER (WHERE reorder_threshold > 0 AND quantity_on_hand <= reorder_threshold) AS low_all FROM risky GROUP BY 1),
 near AS (SELECT *, row_number() OVER (PARTITION BY store_id ORDER BY alert_id) AS r FROM alerts WHERE status = 'ACTIVE'),
 open_n AS (SELECT store_id, count(*) AS n FROM near GROUP BY 1),
 seller AS (SELECT p.store_id, MIN(p.product_id) AS product_id FROM products p JOIN latest l ON l.store_id = p.store_id
   AND lower(trim(p.name)) = lower(trim(l.top_selling_product)) WHERE p.status = 'ACTIVE' GROUP BY 1),
 pick AS (SELECT * FROM (SELECT p.*, s.product_id IS NOT NULL AS is_top, row_number() OVER (PARTITION BY p.store_id ORDER BY s.product_id IS NOT NULL DESC,
   quantity_on_hand - reorder_threshold, quantity_on_hand, p.product_id) AS r FROM products p LEFT JOIN seller s ON s.store_id = p.store_id AND s.product_id = p.product_id
   WHERE p.status = 'ACTIVE' AND reorder_threshold > 0 AND quantity_on_hand <= reorder_threshold) WHERE r = 1),
 people AS (SELECT store_id, string_agg(name || ' (' || {WHOLE.format('total_spend')} || ' spend, ' || visit_count || ' visits)', ', ' ORDER BY r) AS t,
   min_by(name, r) AS lead, min_by(last_purchase_at, r) AS seen
  FROM (SELECT *, row_number() OVER (PARTITION BY store_id ORDER BY total_spend DESC, visit_count DESC, customer_id) AS r FROM (SELECT * EXCLUDE (rn) FROM summary)) WHERE r <= 3 GROUP BY 1),
 sold AS (SELECT store_id, string_agg(transaction_id || ' for ' || {WHOLE.format('total_amount')} || ' via ' || payment_method, ', ' ORDER BY r) AS t, min_by(sale_timestamp, r) AS at
  FROM (SELECT *, row_number() OVER (PARTITION BY store_id ORDER BY sale_timestamp DESC, transaction_id) AS r FROM transactions) WHERE r <= 3 GROUP BY 1),
 newest AS (SELECT *, date_diff('day', created_at, TIMESTAMP '2001-06-30 00:00:00') AS age FROM (SELECT *, row_number() OVER (PARTITION BY store_id
  ORDER BY (status = 'ACTIVE') DESC, created_at DESC, updated_at DESC, product_id) AS r FROM products) WHERE r = 1),
 texts AS (SELECT l.store_id,
  'Your store has ' || {WHOLE.format('today_sales')} || ' in sales across ' || today_transactions || ' transactions today.'
   || CASE WHEN top_selling_product IS NOT NULL THEN ' ' || top_selling_product || ' is the current top-selling product.' ELSE '' END
   || CASE WHEN coalesce(open_n.n, 0) > 0 THEN ' There are ' || open_n.n || ' active alerts that need attention.'
      WHEN low_all > 0 THEN ' ' || low_all || ' products are low on stock, so inventory needs a quick review.'
      ELSE ' Operations look stable right now with no urgent stock or alert pressure in the current snapshot.' END AS business_summary,
  'Today''s confirmed sales are ' || {WHOLE.format('today_sales')} || ' across ' || today_transactions || ' transactions. ' || coalesce(top_selling_product, 'your top product')
   || ' is the current top-selling product. Inventory coverage looks cleaner, so the next step is to maintain momentum on the current top seller.' AS sales_text,
  CASE WHEN top_selling_product IS NULL THEN 'I can see the current sales snapshot, but it does not identify a top-selling product yet.' ELSE top_selling_product
   || ' is the current top-selling product. Today''s store snapshot shows ' || {WHOLE.format('today_sales')} || ' in sales across ' || today_transactions
   || ' transactions. Keep that item in stock and visible because it is leading sales right now.' END AS top_seller,
  CASE WHEN pick.is_top THEN 'You should reorder ' || pick.name || ' first. It is currently your top-selling product and has ' || pick.quantity_on_hand
    || ' units on hand against a reorder threshold of ' || pick.reorder_threshold || '. Protecting availability on that fast mover is the highest-priority replenishment action.'
   ELSE 'You should reorder ' || pick.name || ' first. It has ' || pick.quantity_on_hand || ' units on hand against a reorder threshold of ' || pick.reorder_threshold
    || ', which makes it the weakest stock position in the current snapshot. That is the clearest restock priority right now.' END AS reorder,
  'I can see ' || inv.active || ' active products in the current inventory snapshot. ' || inv.low || ' are at or below reorder threshold. ' || inv.expiring
   || ' are expired or expiring soon. Top attention items are ' || risk_text.t || '. There are also ' || open_n.n
   || ' active alerts reinforcing those risks. Best next move is to reorder the lowest-stock items first and clear any expired stock from sale.' AS inventory_status,
  'Your top customers right now are ' || people.t || '. ' || people.lead || ' was last seen on ' || strftime(people.seen, '%Y-%m-%d %H:%M UTC')
   || '. Best next move is to target these repeat buyers with availability updates, bundles, or loyalty outreach.' AS customers_text,
  'The most recent transactions I can see are ' || sold.t || '. The latest one was recorded on ' || strftime(sold.at, '%Y-%m-%d %H:%M UTC') || '.' AS transactions_text,
  'Your first priority is ' || near.title || '. The most urgent inventory item is ' || worst.name || ' with ' || worst.quantity_on_hand || ' units left and status ' || lower(worst.expiry_status)
   || '.' || CASE WHEN top_selling_product IS NOT NULL THEN ' Keep ' || top_selling_product || ' available because it is currently leading sales.' ELSE '' END
   || ' Best next move is to resolve the top alert, restock the weakest item, and then review your best seller coverage.' AS focus,
  'The newest product I can see is ' || nw.name || ' in ' || nw.category || ', ' || CASE WHEN age = 0 THEN 'added today' WHEN age = 1 THEN 'added 1 day ago' WHEN age < 7 THEN 'added ' || age || ' days ago'
    ELSE 'added on ' || strftime(nw.created_at, '%b %d') END || '. It is priced at ' || {FLOAT.format('nw.price')} || ' and currently has ' || nw.quantity_on_hand || ' units on hand. '
   || CASE WHEN nw.reorder_threshold > 0 AND nw.quantity_on_hand <= nw.reorder_threshold THEN 'It is already near or below its reorder threshold, so it needs replenishment planning.'
      WHEN nw.quantity_on_hand = 0 THEN 'It is already out of stock, so it should be restocked before promotion.'
      ELSE 'Stock looks available, so the next step is to watch sell-through and reorder timing.' END AS newest_product
 FROM latest l JOIN inv ON inv.store_id = l.store_id LEFT JOIN open_n ON open_n.store_id = l.store_id LEFT JOIN near ON near.store_id = l.store_id AND near.r = 1
 LEFT JOIN worst ON worst.store_id = l.store_id LEFT JOIN risk_text ON risk_text.store_id = l.store_id LEFT JOIN pick ON pick.store_id = l.store_id
 LEFT JOIN people ON people.store_id = l.store_id LEFT JOIN sold ON sold.store_id = l.store_id LEFT JOIN newest nw ON nw.store_id = l.store_id)"""
BRIEFING_VIEWS = ("transactions", "items", "customer_captures", "products", "alerts")


@query("store_briefing", sql_views(*BRIEFING_VIEWS) + BRIEFING + " SELECT * FROM texts")
def _(spark, d):
    return briefing.briefings(_facts(spark, d), as_of=AS_OF)


# Every store of the test tables has every text, so the first trigger decides.
ANSWERED_BY = f"""CASE WHEN {SUMMARY_SQL} THEN 'business_summary' WHEN {sql_phrase(P.TOP_SELLER_PHRASES)} THEN 'top_seller'
 WHEN {sql_word(P.REORDER_WORDS)} OR {sql_phrase(P.REORDER_PHRASES)} THEN 'reorder'
 WHEN {sql_word(P.RECENT_PRODUCT_WORDS)} OR {sql_phrase(P.RECENT_PRODUCT_PHRASES)} THEN 'newest_product' WHEN {sql_phrase(P.FOCUS_PHRASES)} THEN 'focus'
 WHEN {sql_word(P.INVENTORY_STATUS_WORDS)} OR {sql_phrase(P.INVENTORY_STATUS_PHRASES)} THEN 'inventory_status'
 WHEN {sql_word(P.CUSTOMER_WORDS)} OR {sql_phrase(P.CUSTOMER_PHRASES)} THEN 'customers_text'
 WHEN {sql_word(P.TRANSACTION_WORDS)} OR {sql_phrase(P.TRANSACTION_PHRASES)} THEN 'transactions_text' WHEN {sql_word(P.SALES_WORDS)} THEN 'sales_text' END"""


@query("operator_answers", sql_views("questions", *BRIEFING_VIEWS) + BRIEFING + f""",
 chosen AS (SELECT *, {ANSWERED_BY} AS answered_by, {REASON_SQL} AS deep, {sql_word(P.OPERATOR_WORDS)} OR {sql_phrase(P.OPERATOR_PHRASES)} AS prefers FROM questions)
 SELECT c.store_id, query_id, answered_by, CASE answered_by WHEN 'business_summary' THEN business_summary WHEN 'top_seller' THEN top_seller WHEN 'reorder' THEN reorder
   WHEN 'newest_product' THEN newest_product WHEN 'focus' THEN focus WHEN 'inventory_status' THEN inventory_status WHEN 'customers_text' THEN customers_text
   WHEN 'transactions_text' THEN transactions_text WHEN 'sales_text' THEN sales_text END AS operator_answer,
  coalesce(answered_by IN ('business_summary', 'top_seller', 'reorder', 'customers_text', 'sales_text'), false) AS operator_analytics_used,
  answered_by IS NOT NULL AND NOT deep AND prefers AS operator_suffices FROM chosen c JOIN texts ON texts.store_id = c.store_id""")
def _(spark, d):
    return answers.operator_answers(answers.with_intent(td.questions(spark, d)), settle(briefing.briefings(_facts(spark, d), as_of=AS_OF))).select(
        "store_id", "query_id", "answered_by", "operator_answer", "operator_analytics_used", "operator_suffices")


def _text_matches(spark, d, asked):
    """Matches by text alone; there are no question vectors in the test tables."""
    none = spark.createDataFrame([], "store_id string, query_id string, product_id string, distance double")
    return hybrid.hybrid_matches(asked, td.products(spark, d), none)


NO_MATCH_SQL = _quoted(answers.NO_MATCH)
DIRECT = f""", m AS (SELECT * FROM (SELECT s.store_id, s.query_id, s.product_id, s.score, row_number() OVER (PARTITION BY s.store_id, s.query_id
   ORDER BY s.score DESC, s.product_id) AS r FROM (SELECT a.store_id, a.query_id, s.product_id, {SCORE} AS score FROM asked a JOIN shelf s ON s.store_id = a.store_id) s) WHERE r <= 4),
 mf AS (SELECT m.*, p.name, p.price, p.quantity_on_hand AS qty, p.reorder_threshold AS thr, p.expiry_status AS ex, p.status, p.risk, row_number() OVER (
   PARTITION BY m.store_id, m.query_id ORDER BY CASE WHEN p.status = 'ACTIVE' AND p.risk > 0 THEN 0 ELSE 1 END, p.risk DESC, p.quantity_on_hand, m.product_id) AS rr
  FROM m JOIN risky p ON p.store_id = m.store_id AND p.product_id = m.product_id),
 mi AS (SELECT store_id, query_id, count(*) FILTER (WHERE status = 'ACTIVE') AS active, count(*) FILTER (WHERE status = 'ACTIVE' AND thr > 0 AND qty <= thr) AS low,
   count(*) FILTER (WHERE status = 'ACTIVE' AND ex <> 'OK') AS expiring, string_agg(name || ' (' || qty || ' units, ' || lower(ex) || ')', ', ' ORDER BY rr)
    FILTER (WHERE status = 'ACTIVE' AND risk > 0 AND rr <= 3) AS risks FROM mf GROUP BY 1, 2),
 q AS (SELECT x.*, {INTENT_SQL} AS intent, {REASON_SQL} AS deep, {sql_phrase(P.TOP_SELLER_PHRASES)} AS tops, {sql_word(P.SALES_WORDS)} AS sold_words,
   {sql_word(P.INVENTORY_STATUS_WORDS)} OR {sql_phrase(P.INVENTORY_STATUS_PHRASES)} AS about_status,
   len(list_filter(string_split_regex(query_text, '\\s+'), lambda w: w <> '')) AS n FROM questions x),
 d AS (SELECT q.*, greatest(0.0, least(1.0, l.score)) AS c, l.name || ': qty=' || l.qty || ', reorder=' || l.thr || ', expiry=' || l.ex || ', price=' || {FLOAT.format('l.price')} AS line,
   l.thr > 0 AND l.qty <= l.thr AS short, texts.business_summary, texts.top_seller, texts.sales_text,
   'I can see ' || mi.active || ' active products in the current inventory snapshot.' || CASE WHEN mi.low > 0 THEN ' ' || mi.low || ' are at or below reorder threshold.' ELSE '' END
   || CASE WHEN mi.expiring > 0 THEN ' ' || mi.expiring || ' are expired or expiring soon.' ELSE '' END || CASE WHEN mi.risks IS NOT NULL THEN ' Top attention items are ' || mi.risks || '.' ELSE '' END
   || CASE WHEN open_n.n > 0 THEN ' There are also ' || open_n.n || ' active alerts reinforcing those risks.' ELSE '' END
   || CASE WHEN mi.low > 0 THEN ' Best next move is to reorder the lowest-stock items first and clear any expired stock from sale.'
      WHEN mi.expiring > 0 THEN ' Best next move is to prioritise sell-through or markdowns for the expiring items.'
      ELSE ' Overall inventory looks stable right now, so focus on keeping your best sellers in stock.' END AS status_text
  FROM q JOIN mf l ON l.store_id = q.store_id AND l.query_id = q.query_id AND l.r = 1 JOIN mi ON mi.store_id = q.store_id AND mi.query_id = q.query_id
  JOIN texts ON texts.store_id = q.store_id LEFT JOIN open_n ON open_n.store_id = q.store_id),
 e AS (SELECT *, CASE WHEN intent = 'business_summary' THEN business_summary WHEN intent = 'sales_kpi' AND tops THEN top_seller WHEN intent = 'sales_kpi' AND sold_words THEN sales_text
   WHEN intent IN ('product_lookup', 'reorder_decision') AND c < 0.35 THEN {NO_MATCH_SQL}
   WHEN intent = 'reorder_decision' AND short THEN 'Restock priority is ' || line || '. It is at or below reorder threshold, so replenishment should be immediate.'
   WHEN intent = 'reorder_decision' THEN line || '. Stock is above reorder threshold right now, so immediate restock is not urgent.'
   WHEN intent = 'product_lookup' THEN 'Matched product details: ' || line || '.' WHEN intent = 'inventory_risk' AND about_status THEN status_text END AS direct FROM d)
 SELECT store_id, query_id, intent, round(c, 3) AS retrieval_confidence, CASE WHEN direct IS NOT NULL AND ((intent IN ('business_summary', 'sales_kpi', 'inventory_risk') AND NOT deep)
   OR (intent IN ('product_lookup', 'reorder_decision') AND c >= 0.72)) THEN 'retrieval_only' ELSE 'model' END AS answer_mode,
  CASE WHEN intent = 'reasoning' OR deep OR n >= 18 OR (intent = 'product_lookup' AND c < 0.45) THEN 'reasoning' ELSE 'fast' END AS route,
  intent IN ('product_lookup', 'reorder_decision') AND c < 0.35 AS refused, coalesce(direct, {_quoted(answers.NO_CONFIRMATION)}) AS answer FROM e"""


@query("direct_answers", sql_views("questions", *BRIEFING_VIEWS) + BRIEFING + ASKED.format(source="questions") + DIRECT)
def _(spark, d):
    facts = settle(_facts(spark, d))
    asked = answers.with_intent(td.questions(spark, d))
    matched = focus.per_text(td.questions(spark, d), lambda texts: answers.match_facts(_text_matches(spark, d, texts), td.products(spark, d), as_of=AS_OF))
    rows = answers.direct_answers(asked, matched, briefing.briefings(facts, as_of=AS_OF), facts)
    return answers.finalize_answers(rows.withColumn("answer", F.col("direct_answer"))).select(
        "store_id", "query_id", "intent", "retrieval_confidence", "answer_mode", "route", "refused", "answer")


@query("answer_routes", sql_views("questions", "products") + ASKED.format(source="questions") + f""",
 best AS (SELECT a.store_id, a.query_id, MAX({SCORE}) AS score FROM asked a JOIN shelf s ON s.store_id = a.store_id GROUP BY 1, 2),
 q AS (SELECT questions.*, {INTENT_SQL} AS intent, greatest(0.0, least(1.0, best.score)) AS c, {REASON_SQL} AS deep,
   len(list_filter(string_split_regex(query_text, '\\s+'), lambda w: w <> '')) AS n
  FROM questions JOIN best ON best.store_id = questions.store_id AND best.query_id = questions.query_id)
 SELECT store_id, query_id, round(c, 3) AS retrieval_confidence,
  CASE WHEN intent = 'reasoning' OR deep OR n >= 18 OR (intent = 'product_lookup' AND c < 0.45) THEN 'reasoning' ELSE 'fast' END AS route,
  intent IN ('product_lookup', 'reorder_decision') AND c < 0.35 AS refused FROM q""")
def _(spark, d):
    asked = answers.with_intent(td.questions(spark, d))
    sure = focus.per_text(td.questions(spark, d), lambda texts: hybrid.confidences(_text_matches(spark, d, texts)))
    rows = asked.join(sure, ["store_id", "query_id"])
    kind, text, sure = F.col("intent"), F.col("query_text"), F.col("confidence")
    return rows.select(
        "store_id", "query_id", F.round("confidence", 3).alias("retrieval_confidence"),
        F.when(X.needs_strong_route(kind, text, sure), F.lit("reasoning")).otherwise(F.lit("fast")).alias("route"),
        (kind.isin("product_lookup", "reorder_decision") & (sure < 0.35)).alias("refused"))


@query("evidence_pack")
def _(spark, d):
    with small_broadcasts(spark):
        return settle(_evidence_pack(spark, d), "evidence")


def _evidence_pack(spark, d):
    products = td.products(spark, d)
    asked = _vector_questions(spark, d)
    hits = settle(vectors.nearest(asked, td.embeddings(spark, d), k=6).join(
        products.select("store_id", "product_id", F.col("name").alias("product_name"), "category"), ["store_id", "product_id"]))
    asked = settle(answers.with_intent(asked.drop("embedding")))
    found = settle(hybrid.hybrid_matches(asked, products, hits))
    heads = settle(_sale_heads(spark, d), "heads")
    also = focus.recent_sales_of(found, _lines(spark, d, heads), on="product_id", limit=8)
    sold = focus.transaction_snapshot(asked, heads, limit=8, also=also)
    people = focus.customer_snapshot(asked.where("needs_customers"), td.customers(spark, d))
    return answers.evidence(
        asked, answers.match_facts(found, products, as_of=AS_OF), hits, relevant_alerts(td.alerts(spark, d)), people, sold,
        briefing.analytics_summary(_context(spark, d), _freshness(spark, d)), _freshness(spark, d),
    ).select("store_id", "query_id", "evidence", "alerts_used", "inventory_products_used", "rag_products_used")


LEX = ASKED.format(source="questions") + f""",
 scored AS (SELECT a.store_id, a.query_id, s.product_id, {SCORE} AS score FROM asked a JOIN shelf s ON s.store_id = a.store_id),
 matches AS (SELECT * FROM (SELECT store_id, query_id, product_id, row_number() OVER (PARTITION BY store_id, query_id ORDER BY score DESC, product_id) AS r
  FROM scored) WHERE r <= 4)"""


@query("related_products", sql_views("questions", "products", "alerts") + LEX + """,
 near AS (SELECT store_id, source_entity_id AS product_id, row_number() OVER (PARTITION BY store_id ORDER BY CASE WHEN status = 'ACTIVE' THEN 0 ELSE 1 END, alert_id) AS r
  FROM alerts WHERE status IN ('ACTIVE', 'ACKNOWLEDGED')),
 pool AS (SELECT store_id, query_id, product_id, r AS o FROM matches
  UNION ALL SELECT q.store_id, q.query_id, n.product_id, 100 + n.r FROM questions q JOIN near n ON n.store_id = q.store_id AND n.r <= 10),
 once AS (SELECT store_id, query_id, product_id, MIN(o) AS o FROM pool GROUP BY 1, 2, 3)
 SELECT store_id, query_id, product_id, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY store_id, query_id ORDER BY o, product_id) AS r
  FROM once) WHERE r <= 8""")
def _(spark, d):
    products, alerts = td.products(spark, d), relevant_alerts(td.alerts(spark, d))
    return focus.per_text(td.questions(spark, d), lambda asked: answers.related_products(
        settle(lexical.best_by_text(asked, products)), alerts).select("store_id", "query_id", "product_id", "rank"))
