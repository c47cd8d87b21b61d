"""Jobs over written tables, and the intake and view functions that no other query reaches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from shelfmark.functions import coerce, phrases as P, shaping, text as X
from shelfmark.functions.coerce import for_output
from shelfmark.operators import alert_book, customers as cust, ledger, listings, stock
from shelfmark.plans import jobs, repair, sweep
from shelfmark.registry import query
from shelfmark.registry.alert_queries import BOOK, EXPIRY, LOW, _book
from shelfmark.registry.ledger_queries import ISO as RUN_ISO, RUNS, _runs
from shelfmark.registry.load_queries import _entities
from shelfmark.registry.retrieval_queries import sql_phrase, sql_word
from shelfmark.registry.trade_queries import BILL_SQL, ISO, _stocked, line_adjustments, sale_requests
from shelfmark.session import scratch_path
from shelfmark.sources import testdata as td
from shelfmark.sources.jsonl import read_json_lines
from shelfmark.sources.tables import Warehouse
from shelfmark.sources.testdata import AS_OF, sql_views


@query("sale_writeback", BILL_SQL + f""", gone AS (SELECT s.store_id, w.product_id, SUM(w.quantity) AS quantity FROM sold s JOIN wanted w USING (o_orderkey) GROUP BY 1, 2),
 after AS (SELECT p.store_id, p.product_id, p.reorder_threshold, g.product_id IS NOT NULL AS touched, p.quantity_on_hand * 10 - coalesce(g.quantity, 0) AS n
  FROM products p LEFT JOIN gone g ON g.store_id = p.store_id AND g.product_id = p.product_id)
 SELECT 'product' AS kind, store_id, product_id AS id, CAST(n AS BIGINT) AS n, CAST(NULL AS DOUBLE) AS amount, CAST(NULL AS VARCHAR) AS note FROM after
 UNION ALL SELECT 'alert', store_id, 'LOW_STOCK_' || product_id, NULL, NULL, CASE WHEN n = 0 THEN 'CRITICAL' ELSE 'HIGH' END FROM after WHERE touched AND n <= reorder_threshold
 UNION ALL SELECT 'customer', c.store_id, c.customer_id, CAST(c.visit_count + count(s.seq) AS BIGINT), CAST(c.total_spend + coalesce(SUM(s.total), 0) AS DOUBLE), NULL
  FROM customers c LEFT JOIN sold s ON s.store_id = c.store_id AND s.customer_id = c.customer_id GROUP BY c.store_id, c.customer_id, c.visit_count, c.total_spend
 UNION ALL SELECT 'key', s.store_id, s.idempotency_key, NULL, CAST(s.total AS DOUBLE), {ISO.format("l.seen")}
  FROM sold s JOIN (SELECT store_id, idempotency_key, MAX(requested_at) AS seen FROM decided WHERE outcome IN ('ACCEPTED', 'REPLAY') GROUP BY 1, 2) l
   ON l.store_id = s.store_id AND l.idempotency_key = s.idempotency_key""")
def _(spark, d):
    """Two batches of sales one after the other: the second meets the keys, stock and totals that the first has left."""
    warehouse = Warehouse(spark, scratch_path(spark, "sales"))
    warehouse.upsert("products", _stocked(spark, d))
    warehouse.upsert("customers", td.customers(spark, d))
    requests = sale_requests(spark, d)
    early = F.col("requested_at") < F.lit("1998-06-01").cast("timestamp")
    for batch, as_of in ((requests.where(early), "1998-06-01"), (requests.where(~early), AS_OF)):
        jobs.sell(warehouse, batch, as_of=as_of)
        jobs.run_followups(warehouse, jobs.handlers(as_of=as_of), as_of=as_of)
    none = "cast(null as {})".format
    frames = [
        warehouse.read("products").selectExpr("'product' AS kind", "store_id", "product_id AS id", "quantity_on_hand AS n", f"{none('double')} AS amount", f"{none('string')} AS note"),
        warehouse.read("alerts").selectExpr("'alert' AS kind", "store_id", "condition_key AS id", f"{none('bigint')} AS n", f"{none('double')} AS amount", "severity AS note"),
        warehouse.read("customers").selectExpr("'customer' AS kind", "store_id", "customer_id AS id", "visit_count AS n", "cast(total_spend as double) AS amount", f"{none('string')} AS note"),
        warehouse.read("idempotency").selectExpr("'key' AS kind", "store_id", "idempotency_key AS id", f"{none('bigint')} AS n", "cast(total_amount as double) AS amount",
                                                 "concat(date_format(last_seen_at, \"yyyy-MM-dd'T'HH:mm:ss\"), '+00:00') AS note"),
    ]
    return reduce(DataFrame.unionByName, frames)


@query("embedding_followups", sql_views("products") + """ SELECT store_id, product_id, CAST(product_id AS BIGINT) % 3 = 0 AS renewed, 1 + CAST(CAST(product_id AS BIGINT) % 3 = 0 AS INTEGER) AS times_made
 FROM products""")
def _(spark, d):
    """Vectors for all products; then every third is renamed, and only these are made again."""
    warehouse = Warehouse(spark, scratch_path(spark, "embedded"))
    products = td.products(spark, d)
    warehouse.upsert("products", products)
    vectorise = lambda text: F.array(F.char_length(text).cast("double"), F.crc32(text.cast("binary")).cast("double"))
    counted = {}
    for turn, as_of in enumerate(("2001-06-30 01:00:00", "2001-06-30 02:00:00")):
        if turn:
            key = "cast(product_id as bigint)"
            warehouse.upsert("products", products.where(f"{key} % 3 = 0").select("store_id", "product_id", F.concat("name", F.lit(" anew")).alias("name")))
        jobs.follow_marts(warehouse, products.select("store_id"), as_of=as_of)
        work = {jobs.EMBED: jobs.handlers(as_of=as_of, vectorise=vectorise)[jobs.EMBED]}
        jobs.run_followups(warehouse, work, as_of=as_of)
        counted[turn] = warehouse.read("product_embeddings").select("store_id", "product_id", F.col("embedded_at").alias(f"at{turn}"))
    both = counted[0].join(counted[1], ["store_id", "product_id"])
    return both.select("store_id", "product_id", (F.col("at0") != F.col("at1")).alias("renewed"), (1 + (F.col("at0") != F.col("at1")).cast("int")).alias("times_made"))


@query("after_change_alerts", sql_views("products", "alerts") + ", rules AS (SELECT * FROM (" + LOW + " UNION ALL " + EXPIRY + ") WHERE CAST(source_entity_id AS BIGINT) % 3 = 0)" + BOOK + """
 SELECT r.store_id, r.condition_key, CASE WHEN r.triggered THEN coalesce(b.status, 'ACTIVE') ELSE 'RESOLVED' END AS status,
  CASE WHEN r.triggered THEN r.severity ELSE b.severity END AS severity, CASE WHEN r.triggered THEN r.title ELSE b.title END AS title
 FROM rules r LEFT JOIN (SELECT * FROM book WHERE status <> 'RESOLVED') b ON b.store_id = r.store_id AND b.condition_key = r.condition_key
 WHERE r.triggered OR b.alert_id IS NOT NULL""")
def _(spark, d):
    changed = td.products(spark, d).where("cast(product_id as bigint) % 3 = 0")
    return sweep.after_change(changed, td.products(spark, d), _book(spark, d), as_of=AS_OF).alerts.select("store_id", "condition_key", "status", "severity", "title")


@query("records_read_and_written", sql_views("transactions", "products", "customers", "items") + """,
 t AS (SELECT store_id, count(*) AS n FROM transactions WHERE sale_timestamp >= TIMESTAMP '2001-05-31 00:00:00' AND sale_timestamp < TIMESTAMP '2001-06-30 00:00:00' GROUP BY 1),
 i AS (SELECT concat('store_', o_custkey % 5) AS store_id, count(DISTINCT (l_orderkey, l_partkey)) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey
  WHERE o_orderdate >= TIMESTAMP '2001-05-31 00:00:00' AND o_orderdate < TIMESTAMP '2001-06-30 00:00:00' GROUP BY 1),
 p AS (SELECT store_id, count(*) AS n FROM products WHERE updated_at >= TIMESTAMP '2001-05-31 00:00:00' AND updated_at < TIMESTAMP '2001-06-30 00:00:00' GROUP BY 1),
 c AS (SELECT store_id, count(*) AS n FROM customers WHERE created_at >= TIMESTAMP '2001-05-31 00:00:00' AND created_at < TIMESTAMP '2001-06-30 00:00:00' GROUP BY 1)
 SELECT s.store_id, CAST(coalesce(t.n, 0) + coalesce(p.n, 0) + coalesce(c.n, 0) AS BIGINT) AS records_read,
  CAST(coalesce(t.n, 0) + coalesce(i.n, 0) + coalesce(p.n, 0) + coalesce(c.n, 0) AS BIGINT) AS records_written
 FROM (SELECT DISTINCT store_id FROM products) s LEFT JOIN t USING (store_id) LEFT JOIN i USING (store_id) LEFT JOIN p USING (store_id) LEFT JOIN c USING (store_id)""")
def _(spark, d):
    """A sync of one month: sales are read with their lines, which are rows of their own once written."""
    from shelfmark.registry.load_queries import _sale_lines

    warehouse = Warehouse(spark, scratch_path(spark, "counted"))
    source = {**_entities(spark, d), "lines": _sale_lines(spark, d)}
    source["stores"] = listings.distinct_stores(source["products"])
    repair.run_sync(warehouse, source, as_of=AS_OF)
    return warehouse.read("pipeline_runs").select("store_id", "records_read", "records_written")


@query("json_lines", """SELECT CAST(o_orderkey AS VARCHAR) AS transaction_id, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) END AS total_amount,
  strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S+00:00') AS sale_timestamp, CAST(NULL AS VARCHAR) AS broken FROM orders WHERE o_orderkey % 7 <> 0
 UNION ALL SELECT NULL, NULL, NULL, 'no json ' || o_orderkey FROM orders WHERE o_orderkey % 7 = 0""")
def _(spark, d):
    """Orders as lines of JSON, some of them broken, some with an amount that is no number."""
    row = "to_json(struct(o_orderkey AS transaction_id, CASE WHEN o_orderkey % 5 = 0 THEN 'n/a' ELSE cast(cast(o_totalprice as decimal(18,2)) as string) END AS total_amount, " \
          "date_format(o_orderdate, \"yyyy-MM-dd'T'HH:mm:ss'Z'\") AS sale_timestamp))"
    path = scratch_path(spark, "json-lines")
    td.table(spark, d, "orders").selectExpr(f"CASE WHEN o_orderkey % 7 = 0 THEN concat('no json ', o_orderkey) ELSE {row} END AS value").write.text(path)
    rows, broken = read_json_lines(spark, path, "transaction_id string, total_amount decimal(18,2), sale_timestamp timestamp")
    none = F.lit(None)
    return for_output(rows.withColumn("broken", none.cast("string"))).unionByName(broken.select(
        none.cast("string").alias("transaction_id"), none.cast("double").alias("total_amount"), none.cast("string").alias("sale_timestamp"), F.col("line").alias("broken")))


@query("document_keys", """SELECT p_partkey, CASE WHEN p_partkey % 3 = 2 THEN p_name ELSE 'doc-' || p_partkey END AS key,
  CAST(p_partkey AS VARCHAR) || '_' || strftime(TIMESTAMP '2001-06-30 10:20:00' + INTERVAL 1 SECOND * p_partkey, '%Y%m%dT%H%M') AS snapshot_id FROM part""")
def _(spark, d):
    rows = td.table(spark, d, "part").withColumn("given", F.expr("CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE p_name END"))
    at = F.expr("timestamp'2001-06-30 10:20:00' + INTERVAL '1' SECOND * p_partkey")
    return rows.select("p_partkey", coerce.key_or_document_id("given", F.concat(F.lit("doc-"), "p_partkey")).alias("key"), coerce.minute_snapshot_id("p_partkey", at).alias("snapshot_id"))


NEW_PRODUCTS = """SELECT CAST(p_partkey AS {t}) AS product_id, concat('store_', p_partkey % 5) AS store_id, CASE WHEN p_partkey % 9 = 0 THEN '' ELSE p_name END AS name,
  CASE WHEN p_partkey % 14 = 0 THEN NULL ELSE p_type END AS category, CASE WHEN p_partkey % 10 = 0 THEN -1.5e0 ELSE CAST(p_retailprice AS DOUBLE) END AS price,
  CAST(p_size - 2 AS BIGINT) AS quantity, CAST(p_partkey % 30 AS BIGINT) AS reorder_threshold, CASE WHEN p_partkey % 16 = 0 THEN 'GONE' WHEN p_partkey % 4 = 0 THEN NULL ELSE 'ACTIVE' END AS status"""


@query("created_products", "WITH asked AS (" + NEW_PRODUCTS.format(t="VARCHAR") + """ FROM part),
 judged AS (SELECT *, list_filter([CASE WHEN name = '' THEN 'name: required, at most 200 characters' END, CASE WHEN category IS NULL THEN 'category: required, at most 100 characters' END,
   CASE WHEN price < 0 THEN 'price: must be at least 0' END, CASE WHEN quantity < 0 THEN 'quantity: must be at least 0' END,
   CASE WHEN status = 'GONE' THEN 'status: must be one of ACTIVE, INACTIVE' END], lambda x: x IS NOT NULL) AS why FROM asked)
 SELECT product_id, store_id, CASE WHEN len(why) = 0 THEN CAST(CAST(round(price, 2) AS DECIMAL(18,2)) AS DOUBLE) END AS price, CASE WHEN len(why) = 0 THEN quantity END AS quantity_on_hand,
  CASE WHEN len(why) = 0 THEN 'OK' END AS expiry_status, CASE WHEN len(why) > 0 THEN array_to_string(why, '; ') END AS violations FROM judged""")
def _(spark, d):
    asked = spark.sql(NEW_PRODUCTS.format(t="STRING") + " FROM {part}", part=td.table(spark, d, "part")).withColumn("expiry_date", F.lit(None).cast("timestamp"))
    made = stock.create_products(asked, as_of=AS_OF)
    none = F.lit(None)
    good = made.created.select("product_id", "store_id", F.col("price").cast("double").alias("price"), "quantity_on_hand", "expiry_status", none.cast("string").alias("violations"))
    return good.unionByName(made.rejected.select(
        "product_id", "store_id", none.cast("double").alias("price"), none.cast("bigint").alias("quantity_on_hand"), none.cast("string").alias("expiry_status"),
        F.array_join("violations", "; ").alias("violations")))


@query("adjustments_refused", """SELECT concat_ws('-', l_orderkey, l_linenumber, l_suppkey, CAST(CAST(trunc(l_extendedprice * 100) AS BIGINT) AS VARCHAR)) AS adjustment_id,
  CASE WHEN l_orderkey % 6 = 0 THEN 'adjustment_type: must be one of ADD, MANUAL_CORRECTION, REMOVE, SALE_DEDUCTION' ELSE 'PRODUCT_NOT_FOUND' END AS refusal
 FROM lineitem WHERE l_orderkey % 6 IN (0, 1)""")
def _(spark, d):
    """A sixth of the lines names a kind that there is not, another sixth a product of another store."""
    turn = F.expr("cast(split(adjustment_id, '-')[0] as bigint) % 6")
    rows = line_adjustments(spark, d)
    rows = rows.withColumn("adjustment_type", F.when(turn == 0, F.lit("STEAL")).otherwise(F.col("adjustment_type"))).withColumn(
        "store_id", F.when(turn == 1, F.lit("elsewhere")).otherwise(F.col("store_id")))
    decisions = stock.apply_adjustments(td.products(spark, d), rows).decisions
    return decisions.where("not accepted and refusal <> 'NEGATIVE_STOCK'").select("adjustment_id", "refusal")


@query("alert_views", sql_views("alerts") + """ SELECT a.store_id, a.alert_id, title, strftime(created_at, '%Y-%m-%dT%H:%M:%S') AS created_at,
  strftime(acknowledged_at, '%Y-%m-%dT%H:%M:%S') AS acknowledged_at, NULL AS resolution_note FROM alerts a WHERE alert_type = 'LOW_STOCK' AND status = 'ACKNOWLEDGED'""")
def _(spark, d):
    mine = alert_book.list_alerts(td.alerts(spark, d), alert_type="LOW_STOCK", status="ACKNOWLEDGED").withColumns(
        {c: F.lit(None).cast("string") for c in ("acknowledged_by", "resolved_by", "resolution_note")})
    shown = shaping.alert_list_item(mine).join(shaping.acknowledge_view(mine).select("alert_id", F.col("acknowledged_at").alias("seen")), "alert_id").join(
        shaping.resolve_view(mine).select("alert_id", "resolution_note"), "alert_id")
    at = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    return shown.select("store_id", "alert_id", "title", at("created_at").alias("created_at"), at("seen").alias("acknowledged_at"), "resolution_note")


@query("first_items", """SELECT l_orderkey, CAST(r - 1 AS INTEGER) AS pos, CAST(l_partkey AS VARCHAR) AS product_id, CAST(l_quantity AS BIGINT) AS quantity
 FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS r FROM lineitem) WHERE r <= 5""")
def _(spark, d):
    line = "struct(l_linenumber AS n, l_partkey AS p, l_suppkey AS s, l_quantity AS q)"
    lines = td.table(spark, d, "lineitem").selectExpr("l_orderkey", f"{line} AS line").groupBy("l_orderkey").agg(F.sort_array(F.collect_list("line")).alias("lines"))
    sales = lines.selectExpr("l_orderkey", "cast(null as string) AS customer_id", "transform(lines, l -> struct(cast(l.p as string) AS product_id, cast(l.q as bigint) AS quantity, "
                             "cast(0 as decimal(18,2)) AS unit_price, cast(0 as decimal(18,2)) AS line_total)) AS items")
    return sales.select("l_orderkey", F.posexplode(shaping.first_items(F.col("items"))).alias("pos", "i")).select("l_orderkey", "pos", "i.product_id", "i.quantity")


WANTED = [str(k) for k in (17, 3, 17, 8, 102, 77, 13, 4, 28, 53, 3, 198, 163, 123, 88, 38, 43, 48, 58, 63, 68, 73, 78, 83, 93, 98)]


@query("products_by_ids", sql_views("products") + f""", asked AS (SELECT v, MIN(i) AS i FROM (SELECT unnest({WANTED}) AS v, unnest(range({len(WANTED)})) AS i) GROUP BY 1),
 first AS (SELECT v, row_number() OVER (ORDER BY i) AS r FROM asked)
 SELECT product_id, name, product_id = '3' AS looked_up FROM products JOIN first ON v = product_id AND r <= 20 WHERE store_id = 'store_3'""")
def _(spark, d):
    """The first twenty of a list of ids, those of one store; and one of them by itself."""
    products = td.products(spark, d)
    one = listings.by_id(products, "product_id", "3", "store_3").select("product_id", F.lit(True).alias("_one"))
    found = listings.by_ids(products, "product_id", WANTED, "store_3", most=20)
    return found.join(one, "product_id", "left").select("product_id", "name", F.coalesce("_one", F.lit(False)).alias("looked_up"))


@query("stores_with_products", sql_views("products") + " SELECT DISTINCT store_id FROM products")
def _(spark, d):
    return listings.distinct_stores(td.products(spark, d))


@query("created_customers", """WITH r AS (SELECT concat('store_', c_custkey % 5) AS store_id, CAST(c_custkey AS VARCHAR) AS customer_id, CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_name END AS name,
  concat('+91', c_custkey % 90) AS phone, TIMESTAMP '2001-06-30 00:00:00' + INTERVAL '1' MINUTE * (c_custkey % 60) AS requested_at FROM customer),
 known AS (SELECT DISTINCT concat('store_', s_suppkey % 5) AS store_id, concat('+91', s_suppkey % 40) AS phone FROM supplier),
 n AS (SELECT *, row_number() OVER (PARTITION BY store_id, phone ORDER BY requested_at, customer_id) AS rn FROM r WHERE name IS NOT NULL)
 SELECT customer_id, r.store_id, CASE WHEN r.name IS NULL THEN 'name: required' WHEN k.phone IS NOT NULL THEN 'PHONE_EXISTS' WHEN n.rn > 1 THEN 'PHONE_REPEATED' END AS reason,
  CASE WHEN r.name IS NOT NULL AND k.phone IS NULL AND n.rn = 1 THEN CAST(0 AS DOUBLE) END AS total_spend
 FROM r LEFT JOIN n USING (customer_id) LEFT JOIN known k ON k.store_id = r.store_id AND k.phone = r.phone""")
def _(spark, d):
    requests = td.table(spark, d, "customer").selectExpr(
        "concat('store_', c_custkey % 5) AS store_id", "cast(c_custkey as string) AS customer_id", "CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_name END AS name",
        "concat('+91', c_custkey % 90) AS phone", "timestamp'2001-06-30 00:00:00' + INTERVAL '1' MINUTE * (c_custkey % 60) AS requested_at")
    existing = td.table(spark, d, "supplier").selectExpr("concat('store_', s_suppkey % 5) AS store_id", "concat('+91', s_suppkey % 40) AS phone")
    made = cust.create_customers(requests, existing, as_of=AS_OF)
    good = made.created.select("customer_id", "store_id", F.lit(None).cast("string").alias("reason"), F.col("total_spend").cast("double").alias("total_spend"))
    return good.unionByName(made.rejected.select("customer_id", "store_id", "reason", F.lit(None).cast("double").alias("total_spend")))


@query("analytics_flags", sql_views("questions") + f""", said AS (SELECT *, CASE length(query_text) % 3 WHEN 0 THEN 'Your total sales are up.' WHEN 1 THEN 'Nothing to add.' ELSE query_text END AS answer FROM questions)
 SELECT store_id, query_id, CASE WHEN length(query_text) % 10 = 0 THEN true WHEN {sql_word(P.ANALYTICS_WORDS)} THEN true WHEN {sql_word(P.INVENTORY_ONLY_WORDS)} THEN false
  ELSE {sql_phrase(P.ANALYTICS_SIGNALS, "lower(answer)")} END AS analytics_used FROM said""")
def _(spark, d):
    size = F.char_length("query_text")
    answer = F.when(size % 3 == 0, F.lit("Your total sales are up.")).when(size % 3 == 1, F.lit("Nothing to add.")).otherwise(F.col("query_text"))
    return td.questions(spark, d).select("store_id", "query_id", X.analytics_used(F.col("query_text"), answer, size % 10 == 0).alias("analytics_used"))


@query("dead_letters", RUNS + f""" SELECT pipeline_run_id, store_id, 'Billing' AS source_module, {RUN_ISO.format("checkpoint_start")} || '/' || {RUN_ISO.format("checkpoint_end")} AS batch_ref,
  3 AS retry_count, 'RAW_LOAD' AS failure_stage, 'OPEN' AS dead_letter_status FROM runs WHERE status = 'FAILED'""")
def _(spark, d):
    runs = _runs(spark, d).withColumns({"attempt_count": F.lit(0), "failure_stage": F.lit(None).cast("string"), "error_message": F.lit(None).cast("string")})
    errors = runs.where("status = 'FAILED'").select("pipeline_run_id", F.lit(3).alias("attempt_count"), F.lit("RAW_LOAD").alias("failure_stage"), F.lit("no disk").alias("error_message"))
    letters = ledger.dead_letters(ledger.failed(runs, errors, as_of="2024-01-31"), source_module="Billing", as_of="2024-01-31")
    return letters.select("pipeline_run_id", "store_id", "source_module", "batch_ref", "retry_count", "failure_stage", "dead_letter_status")


@query("one_store_range", sql_views("transactions") + """ SELECT 'store_2' AS store_id, strftime(CAST(sale_timestamp AS DATE), '%Y-%m-%d') AS sales_date, CAST(SUM(total_amount) AS DOUBLE) AS total_sales
 FROM transactions WHERE store_id = 'store_2' AND CAST(sale_timestamp AS DATE) >= DATE '2001-05-31' AND CAST(sale_timestamp AS DATE) <= DATE '2001-06-30' GROUP BY 2""")
def _(spark, d):
    """A single store's read of the marts, for a range of days."""
    from shelfmark.plans import marts, reads

    rows = marts.sales_daily(reads.one_store(td.transactions(spark, d), "store_2"))
    days = reads.range_days("30d")
    first = F.date_sub(F.lit(AS_OF).cast("date"), days)
    return for_output(rows.where((F.col("sales_date") >= first) & (F.col("sales_date") <= F.lit(AS_OF).cast("date"))).select("store_id", "sales_date", "total_sales"))
