"""Run ledger, windows, failures. Every event of the test tables is one run or one failure."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark.functions.coerce import for_output
from shelfmark.operators import ledger
from shelfmark.plans import reads
from shelfmark.registry import query
from shelfmark.registry.mart_queries import _dashboards
from shelfmark.sources import testdata as td

AS_OF = "2024-01-31"
# 400 stores, so that some lack a run of a kind.
RUN_COLUMNS = [
    ("pipeline_run_id", "concat('run_', CAST(event_id AS {t}))"),
    ("store_id", "concat('store_', CAST((user_id * 7 + event_id) % 400 AS {t}))"),
    ("run_type", "CASE event_id % 5 WHEN 0 THEN 'MART_REFRESH' WHEN 1 THEN 'REPAIR' ELSE 'INCREMENTAL_SYNC' END"),
    ("status", "CASE event_type WHEN 'error' THEN 'FAILED' WHEN 'signup' THEN CASE WHEN event_id % 40 = 0 THEN 'RUNNING' ELSE 'SUCCEEDED' END ELSE 'SUCCEEDED' END"),
]
RUNS = "WITH runs AS (SELECT " + ", ".join(f"{e.format(t='VARCHAR')} AS {n}" for n, e in RUN_COLUMNS) + """,
  date_trunc('second', ts) - INTERVAL '1' DAY AS checkpoint_start, date_trunc('second', ts) - INTERVAL '1' HOUR * (event_id % 30) AS checkpoint_end,
  date_trunc('second', ts) AS finished_at FROM events),
 stores AS (SELECT DISTINCT concat('store_', CAST((user_id * 7 + event_id + 13) % 405 AS VARCHAR)) AS store_id FROM events),
 done AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY store_id, run_type ORDER BY finished_at DESC, pipeline_run_id DESC) AS rn
  FROM runs WHERE status = 'SUCCEEDED') WHERE rn = 1)"""
ISO = "strftime({}, '%Y-%m-%dT%H:%M:%S') || '+00:00'"


def _runs(spark, d):
    return td.table(spark, d, "events").selectExpr(
        *[f"{e.format(t='STRING')} AS {n}" for n, e in RUN_COLUMNS],
        "cast(date_trunc('SECOND', ts) as timestamp) - INTERVAL '1' DAY AS checkpoint_start",
        "cast(date_trunc('SECOND', ts) as timestamp) - INTERVAL '1' HOUR * (event_id % 30) AS checkpoint_end",
        "cast(date_trunc('SECOND', ts) as timestamp) AS finished_at")


def _stores(spark, d):
    return td.table(spark, d, "events").selectExpr("concat('store_', cast((user_id * 7 + event_id + 13) % 405 as string)) AS store_id").distinct()


@query("latest_success", RUNS + f""" SELECT store_id, pipeline_run_id, {ISO.format('checkpoint_end')} AS checkpoint_end FROM done WHERE run_type = 'INCREMENTAL_SYNC'""")
def _(spark, d):
    return for_output(ledger.latest_success(_runs(spark, d), ledger.SYNC).select("store_id", "pipeline_run_id", "checkpoint_end"))


@query("next_window", RUNS + f""" SELECT s.store_id, {ISO.format("coalesce(d.checkpoint_end, TIMESTAMP '2024-01-01 00:00:00')")} AS checkpoint_start,
  '2024-01-31T00:00:00+00:00' AS checkpoint_end FROM stores s LEFT JOIN done d ON d.store_id = s.store_id AND d.run_type = 'INCREMENTAL_SYNC'
 WHERE NOT EXISTS (SELECT 1 FROM runs r WHERE r.store_id = s.store_id AND r.status IN ('QUEUED', 'RUNNING'))""")
def _(spark, d):
    return for_output(ledger.next_windows(_stores(spark, d), _runs(spark, d), as_of=AS_OF))


@query("transform_gate", RUNS + f""" SELECT s.store_id, {ISO.format('min(y.checkpoint_start)')} AS source_window_start, {ISO.format('max(y.checkpoint_end)')} AS source_window_end
 FROM stores s JOIN runs y ON y.store_id = s.store_id AND y.run_type = 'INCREMENTAL_SYNC' AND y.status = 'SUCCEEDED'
 LEFT JOIN done m ON m.store_id = s.store_id AND m.run_type = 'MART_REFRESH' WHERE m.checkpoint_end IS NULL OR m.checkpoint_end < y.checkpoint_end
 GROUP BY 1""")
def _(spark, d):
    return for_output(ledger.stores_to_transform(_stores(spark, d), _runs(spark, d), as_of=AS_OF))


FAILURES = """WITH failures AS (SELECT concat('pf_', CAST(event_id AS VARCHAR)) AS failure_id, concat('run_', CAST(event_id AS VARCHAR)) AS pipeline_run_id,
  concat('store_', CAST(user_id % 5 AS VARCHAR)) AS store_id, CASE event_id % 3 WHEN 0 THEN 'OPEN' WHEN 1 THEN 'RECOVERED' ELSE 'OPEN' END AS dead_letter_status,
  CASE WHEN event_id % 6 = 0 THEN 'garbled' ELSE strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%S') || '+00:00/' ||
   strftime(date_trunc('second', ts) + INTERVAL '1' DAY, '%Y-%m-%dT%H:%M:%S') || 'Z' END AS batch_ref, ts AS created_at FROM events)"""


def _failures(spark, d):
    iso = "date_format({}, \"yyyy-MM-dd'T'HH:mm:ss\")"
    return td.table(spark, d, "events").selectExpr(
        "concat('pf_', cast(event_id as string)) AS failure_id", "concat('run_', cast(event_id as string)) AS pipeline_run_id",
        "concat('store_', cast(user_id % 5 as string)) AS store_id",
        "CASE event_id % 3 WHEN 0 THEN 'OPEN' WHEN 1 THEN 'RECOVERED' ELSE 'OPEN' END AS dead_letter_status",
        f"CASE WHEN event_id % 6 = 0 THEN 'garbled' ELSE concat({iso.format('ts')}, '+00:00/', {iso.format('ts + INTERVAL 1 DAY')}, 'Z') END AS batch_ref",
        "cast(ts as timestamp) AS created_at")


@query("open_failures", FAILURES + """ SELECT store_id, failure_id, batch_ref, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (
  PARTITION BY store_id ORDER BY created_at DESC, failure_id) AS r FROM failures WHERE dead_letter_status = 'OPEN') WHERE r <= 50""")
def _(spark, d):
    return ledger.open_failures(_failures(spark, d)).select("store_id", "failure_id", "batch_ref", "rank")


@query("replay_windows", FAILURES + f""" SELECT store_id, failure_id, batch_ref <> 'garbled' AS from_reference,
  CASE WHEN batch_ref <> 'garbled' THEN {ISO.format("date_trunc('second', created_at)")} ELSE '2024-01-01T00:00:00+00:00' END AS checkpoint_start,
  CASE WHEN batch_ref <> 'garbled' THEN {ISO.format("date_trunc('second', created_at) + INTERVAL '1' DAY")} ELSE '2024-01-31T00:00:00+00:00' END AS checkpoint_end
 FROM (SELECT *, row_number() OVER (PARTITION BY store_id ORDER BY created_at DESC, failure_id) AS r FROM failures WHERE dead_letter_status = 'OPEN') WHERE r <= 20""")
def _(spark, d):
    failures = _failures(spark, d)
    runs = _runs(spark, d).withColumn("store_id", F.concat(F.lit("other_"), "store_id"))
    return for_output(ledger.replay_windows(failures, runs, failures.select("store_id").distinct(), as_of=AS_OF))


@query("not_ready", """WITH stores AS (SELECT DISTINCT concat('store_', CAST(c_custkey % 9 AS VARCHAR)) AS store_id FROM customer),
 meta AS (SELECT DISTINCT concat('store_', CAST(s_suppkey % 7 AS VARCHAR)) AS store_id FROM supplier),
 dash AS (SELECT DISTINCT concat('store_', CAST(o_custkey % 5 AS VARCHAR)) AS store_id FROM orders)
 SELECT store_id, CASE WHEN store_id NOT IN (SELECT store_id FROM meta) THEN 'NO_METADATA' ELSE 'NO_DASHBOARD' END AS reason FROM stores
 WHERE store_id NOT IN (SELECT store_id FROM meta) OR store_id NOT IN (SELECT store_id FROM dash)""")
def _(spark, d):
    stores = td.table(spark, d, "customer").selectExpr("concat('store_', cast(c_custkey % 9 as string)) AS store_id").distinct()
    meta = td.table(spark, d, "supplier").selectExpr("concat('store_', cast(s_suppkey % 7 as string)) AS store_id").distinct()
    return reads.stores_not_ready(stores, meta, _dashboards(spark, d))
