"""Streams over slices of the test tables, drained once; each has a batch answer to equal."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, functions as F

from shelfmark.functions.coerce import for_output
from shelfmark.registry import query
from shelfmark.registry.trade_queries import STOCK_SQL, line_adjustments
from shelfmark.plans.raw_load import transactions_raw
from shelfmark.session import scratch_path
from shelfmark.sources import testdata as td
from shelfmark.sources.tables import Warehouse
from shelfmark.sources.testdata import sql_views
from shelfmark.streaming import feed, sales, stateful

# The slices are not in time order, so nothing may count as late.
FOREVER = "4000 days"


#: Bytes of input that go into one file of a slice.
FILE_BYTES = 4 << 20


def _input_bytes(rows: DataFrame) -> int:
    spark = rows.sparkSession
    paths = [spark._jvm.org.apache.hadoop.fs.Path(f) for f in rows.inputFiles()]
    return sum(p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).getLen() for p in paths)


def _slices(rows: DataFrame, label: str, n: int = 4):
    """``rows`` as a stream of ``n`` slices, each of as many files as tasks run at once, or more if they would get large."""
    spark = rows.sparkSession
    folder, each = scratch_path(spark, label), max(spark.sparkContext.defaultParallelism, -(-_input_bytes(rows) // (n * FILE_BYTES)))
    rows.repartition(n * each).write.parquet(folder)
    return lambda slices: spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", slices * each).parquet(folder)


def _drained(stream: DataFrame, label: str, mode: str) -> str:
    spark = stream.sparkSession
    path = scratch_path(spark, label)
    stateful.run_to_table(stream, path, mode=mode, checkpoint=scratch_path(spark, f"{label}-checkpoint"))
    return path


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)


@query("stream_sales_days", sql_views("transactions") + """ SELECT store_id, strftime(CAST(sale_timestamp AS DATE), '%Y-%m-%d') AS sales_date,
  CAST(SUM(total_amount) AS DOUBLE) AS total_sales, CAST(COUNT(*) AS BIGINT) AS transaction_count FROM transactions GROUP BY 1, 2""")
def _(spark, d):
    stream = sales.sales_by_window(_slices(td.transactions(spark, d), "sales-files")(2), length="1 day", lateness=FOREVER)
    path = _drained(stream, "sales-days", "update")
    rows = stateful.newest_update(spark, path, _ddl(stream), ["store_id", "window_start", "window_end"])
    return for_output(rows.select("store_id", F.to_date("window_start").alias("sales_date"), "total_sales", "transaction_count"))


@query("stream_demand", sql_views("items") + """ SELECT store_id, product_id, strftime(CAST(sale_timestamp AS DATE) - CAST(o AS INTEGER), '%Y-%m-%d') AS first_day,
  CAST(SUM(quantity) AS BIGINT) AS units_sold FROM items, range(3) AS r(o) WHERE status = 'COMPLETED' GROUP BY 1, 2, 3""")
def _(spark, d):
    lines = td.items(spark, d).select("store_id", "product_id", "quantity", "status", "sale_timestamp")
    path = scratch_path(spark, "demand")
    sales.keep_demand(_slices(lines, "line-files")(2), path, checkpoint=scratch_path(spark, "demand-checkpoint")).awaitTermination()
    rows = sales.demand_by_window(spark, path)
    return rows.select("store_id", "product_id", F.date_format("first_day", "yyyy-MM-dd").alias("first_day"), "units_sold")


@query("stream_requests_once", """SELECT DISTINCT concat('store_', CAST(o_custkey % 5 AS VARCHAR)) AS store_id,
  concat('k', CAST(o_custkey AS VARCHAR)) AS idempotency_key FROM orders""")
def _(spark, d):
    requests = td.table(spark, d, "orders").selectExpr(
        "concat('store_', cast(o_custkey % 5 as string)) AS store_id", "concat('k', cast(o_custkey as string)) AS idempotency_key",
        "cast(o_orderdate as timestamp) AS requested_at")
    path = _drained(sales.each_request_once(_slices(requests, "request-files")(2), lateness=FOREVER), "requests-once", "append")
    return spark.read.schema(requests.schema).parquet(path).select("store_id", "idempotency_key")


@query("stream_alert_events", """WITH e AS (SELECT concat('store_', CAST(user_id % 5 AS VARCHAR)) AS store_id, concat('C_', CAST(user_id AS VARCHAR)) AS condition_key,
  event_type IN ('error', 'signup') AS triggered, ts, event_id FROM events),
 l AS (SELECT *, coalesce(lag(triggered) OVER (PARTITION BY condition_key ORDER BY ts, event_id), false) AS before FROM e)
 SELECT store_id, condition_key, CASE WHEN triggered THEN 'NONE' ELSE 'ACTIVE' END AS from_status,
  CASE WHEN triggered THEN 'ACTIVE' ELSE 'RESOLVED' END AS to_status, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS changed_at
 FROM l WHERE triggered <> before""")
def _(spark, d):
    rows = td.table(spark, d, "events").selectExpr(
        "concat('store_', cast(user_id % 5 as string)) AS store_id", "concat('C_', cast(user_id as string)) AS condition_key",
        "event_type IN ('error', 'signup') AS triggered", "'HIGH' AS severity", "cast(ts as timestamp) AS evaluated_at")
    stream = stateful.alert_events(_slices(rows, "evaluation-files")(1000))
    path = _drained(stream, "alert-events", "append")
    return spark.read.schema(stream.schema).parquet(path).select(
        "store_id", "condition_key", "from_status", "to_status", F.date_format("changed_at", "yyyy-MM-dd'T'HH:mm:ss").alias("changed_at"))


@query("stream_stock", STOCK_SQL + """ SELECT store_id, product_id, quantity_after AS quantity_on_hand FROM
 (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY rn DESC) AS last FROM fold) WHERE last = 1""")
def _(spark, d):
    warehouse = Warehouse(spark, scratch_path(spark, "stock-warehouse"))
    warehouse.upsert("products", td.products(spark, d))
    rows = line_adjustments(spark, d)
    stateful.keep_stock(_slices(rows, "adjustment-files")(1000), warehouse,
                        checkpoint=scratch_path(spark, "stock-checkpoint")).awaitTermination()
    return warehouse.read("products").select("store_id", "product_id", "quantity_on_hand")


@query("stream_feed", sql_views("transactions") + """ SELECT store_id, transaction_id, CAST(total_amount AS DOUBLE) AS total_amount, payment_method FROM transactions""")
def _(spark, d):
    warehouse = Warehouse(spark, scratch_path(spark, "feed-warehouse"))
    changes = td.transactions(spark, d).select("*", F.lit(None).cast("string").alias("idempotency_key"), F.col("sale_timestamp").alias("created_at"))
    feed.feed_table(_slices(changes, "change-files", 2)(1), warehouse, "transactions_raw", shape=transactions_raw, newest_by="created_at",
                    checkpoint=scratch_path(spark, "feed-checkpoint")).awaitTermination()
    return for_output(warehouse.read("transactions_raw").select("store_id", "transaction_id", "total_amount", "payment_method"))


@query("stream_late_rows", """SELECT event_id, CAST(ts < TIMESTAMP '2024-01-14 00:00:00' AND event_id % 3 = 0 AS BOOLEAN) AS is_late FROM events""")
def _(spark, d):
    """The rows of the first half of January with a number divisible by three arrive after all others."""
    rows = td.table(spark, d, "events").selectExpr("event_id", "user_id", "cast(ts as timestamp) AS at")
    folder, out = scratch_path(spark, "arrivals"), scratch_path(spark, "split")
    behind = (F.col("at") < F.lit("2024-01-14 00:00:00").cast("timestamp")) & (F.col("event_id") % 3 == 0)
    schema, end = _ddl(rows), F.lit("2024-01-30 00:00:00").cast("timestamp")

    def arrive(part: DataFrame) -> None:
        part.write.mode("append").parquet(folder)
        stream = feed.arriving(spark, folder, schema, files_per_trigger=1000)
        feed.split_late(stream, event_time="at", delay=dt.timedelta(days=16), on_time=f"{out}/on_time", late=f"{out}/late",
                        marks=f"{out}/marks", checkpoint=f"{out}/checkpoint").awaitTermination()

    # No event counts as later than the 30th, so the closed time is sixteen days before: the 14th.
    arrive(rows.where(~behind).withColumn("at", F.least("at", end)))
    arrive(rows.where(behind))
    read = lambda name: spark.read.schema(schema).parquet(f"{out}/{name}").select("event_id")
    return read("on_time").withColumn("is_late", F.lit(False)).unionByName(read("late").withColumn("is_late", F.lit(True)))


@query("feed_out_of_order", """SELECT concat('e_', CAST(event_id AS VARCHAR)) AS event_id, concat('store_', CAST(user_id % 5 AS VARCHAR)) AS store_id, 'new' AS note,
  strftime(ts, '%Y-%m-%d') AS day FROM events""")
def _(spark, d):
    """The later change of every event comes first, the older one, of the day before, in a later batch."""
    warehouse = Warehouse(spark, scratch_path(spark, "order-warehouse"))
    rows = td.table(spark, d, "events").selectExpr(
        "concat('e_', cast(event_id as string)) AS event_id", "concat('store_', cast(user_id % 5 as string)) AS store_id",
        "cast(ts as timestamp) AS changed_at", "'new' AS note")
    folder, checkpoint, schema = scratch_path(spark, "order-files"), scratch_path(spark, "order-checkpoint"), _ddl(rows)
    older = rows.withColumn("changed_at", F.expr("changed_at - INTERVAL '1' DAY")).withColumn("note", F.lit("old"))
    for part in (rows, older):
        part.write.mode("append").parquet(folder)
        feed.feed_table(feed.arriving(spark, folder, schema, files_per_trigger=1000), warehouse, "alert_events", shape=lambda batch: batch,
                        newest_by="changed_at", checkpoint=checkpoint).awaitTermination()
    return warehouse.read("alert_events").select("event_id", "store_id", "note", F.date_format("changed_at", "yyyy-MM-dd").alias("day"))
