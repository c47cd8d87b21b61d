"""Streams against their batch answers on small files."""

from __future__ import annotations

import datetime as dt

from shelfmark.sources.tables import Warehouse
from shelfmark.streaming import feed, sales, stateful

T0 = dt.datetime(2025, 1, 1)
MIN = dt.timedelta(minutes=1)


def arrive(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def test_alert_state_over_two_runs(spark, tmp_path):
    schema = "store_id string, condition_key string, triggered boolean, severity string, evaluated_at timestamp"
    folder, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    arrive(spark, folder, [("s", "k", True, "HIGH", T0 + MIN), ("s", "k", False, "HIGH", T0), ("s", "j", False, "LOW", T0)], schema)
    for rows in ([("s", "k", True, "HIGH", T0 + 2 * MIN), ("s", "k", False, "HIGH", T0 + 3 * MIN), ("s", "k", True, "LOW", T0 + 4 * MIN)], None):
        stateful.run_to_table(stateful.alert_events(feed.arriving(spark, folder, schema)), out, mode="append", checkpoint=mark)
        if rows:
            arrive(spark, folder, rows, schema)
    got = sorted((r.changed_at, r.from_status, r.to_status) for r in spark.read.parquet(out).collect())
    assert got == [(T0 + MIN, "NONE", "ACTIVE"), (T0 + 3 * MIN, "ACTIVE", "RESOLVED"), (T0 + 4 * MIN, "NONE", "ACTIVE")]


def test_windows_drop_only_what_is_late(spark, tmp_path):
    schema = "store_id string, total_amount decimal(18,2), sale_timestamp timestamp"
    folder, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    from decimal import Decimal

    arrive(spark, folder, [("s", Decimal("1.00"), T0), ("s", Decimal("2.00"), T0 + 14 * MIN), ("s", Decimal("4.00"), T0 + 15 * MIN)], schema)
    stream = lambda: sales.sales_by_window(feed.arriving(spark, folder, schema), lateness="10 minutes")
    stateful.run_to_table(stream(), out, mode="update", checkpoint=mark)
    arrive(spark, folder, [("s", Decimal("8.00"), T0 + 16 * MIN)], schema)
    stateful.run_to_table(stream(), out, mode="update", checkpoint=mark)
    ddl = "store_id string, window_start timestamp, window_end timestamp, total_sales decimal(18,2), transaction_count bigint"
    rows = {r.window_start: (r.total_sales, r.transaction_count) for r in stateful.newest_update(spark, out, ddl, ["store_id", "window_start", "window_end"]).collect()}
    assert rows == {T0: (Decimal("3.00"), 2), T0 + 15 * MIN: (Decimal("12.00"), 2)}


def test_stock_stream_counts_an_adjustment_once(spark, tmp_path):
    warehouse = Warehouse(spark, str(tmp_path / "w"))
    warehouse.upsert("products", spark.createDataFrame([("s", "p", "P", 5)], "store_id string, product_id string, name string, quantity_on_hand bigint"))
    schema = ("adjustment_id string, store_id string, product_id string, adjustment_type string, quantity_delta bigint, reason string, "
              "source_ref string, created_by string, created_at timestamp")
    folder, mark = str(tmp_path / "in"), str(tmp_path / "mark")
    row = lambda i, kind, n, at: (i, "s", "p", kind, n, "r", None, "u", at)
    for rows in ([row("1", "REMOVE", 4, T0), row("2", "REMOVE", 4, T0 + MIN)], [row("1", "REMOVE", 4, T0), row("3", "ADD", 2, T0 + 2 * MIN)]):
        arrive(spark, folder, rows, schema)
        stateful.keep_stock(feed.arriving(spark, folder, schema), warehouse, checkpoint=mark).awaitTermination()
    product = warehouse.read("products").first()
    assert (product.quantity_on_hand, product.name) == (3, "P")
    assert {r.adjustment_id for r in warehouse.read("stock_adjustments").collect()} == {"1", "3"}


def test_feed_takes_newest_change(spark, tmp_path):
    warehouse = Warehouse(spark, str(tmp_path / "w"))
    schema = "customer_id string, store_id string, name string, captured_at timestamp"
    folder, mark = str(tmp_path / "in"), str(tmp_path / "mark")
    for rows in ([("1", "s", "A", T0), ("1", "s", "B", T0 + MIN)], [("2", "s", "C", T0), ("1", "s", "D", T0 + 2 * MIN)]):
        arrive(spark, folder, rows, schema)
        feed.feed_table(feed.arriving(spark, folder, schema), warehouse, "customers_raw", shape=lambda b: b, newest_by="captured_at",
                        checkpoint=mark).awaitTermination()
    assert {r.customer_id: r.name for r in warehouse.read("customers_raw").collect()} == {"1": "D", "2": "C"}


def test_late_rows_are_kept_aside(spark, tmp_path):
    schema = "store_id string, at timestamp"
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    for rows in ([("s", T0 + 60 * MIN), ("s", T0)], [("s", T0 + 10 * MIN), ("s", T0 + 50 * MIN)]):
        arrive(spark, folder, rows, schema)
        feed.split_late(feed.arriving(spark, folder, schema), event_time="at", delay=30 * MIN, on_time=f"{out}/ok", late=f"{out}/late",
                        marks=f"{out}/marks", checkpoint=f"{out}/c").awaitTermination()
    assert [r.late_rows for r in feed.late_counts(spark, f"{out}/late", schema).collect()] == [1]
    assert spark.read.schema(schema).parquet(f"{out}/ok").count() == 3


def test_demand_is_added_up_without_remembered_state(spark, tmp_path):
    """Sums of batches add up to those of all rows, however late a row is; nothing per product and window is held."""
    schema = "store_id string, product_id string, quantity bigint, status string, sale_timestamp timestamp"
    folder, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    day = dt.timedelta(days=1)
    for rows in ([("s", "p", 5, None, T0 + 40 * day), ("s", "p", 2, "COMPLETED", T0), ("s", "p", 9, "FAILED", T0), ("s", "", 9, None, T0)],
                 [("s", "p", 1, "COMPLETED", T0 + day + MIN), ("s", "p", 4, "", T0), ("s", "q", 3, None, None), ("s", "q", None, None, T0)]):
        arrive(spark, folder, rows, schema)
        sales.keep_demand(feed.arriving(spark, folder, schema), out, checkpoint=mark).awaitTermination()
    got = {(r.product_id, r.first_day): r.units_sold for r in sales.demand_by_window(spark, out, days=2).collect()}
    on = lambda n: (T0 + n * day).date()
    assert got == {("p", on(-1)): 6, ("p", on(0)): 7, ("p", on(1)): 1, ("p", on(39)): 5, ("p", on(40)): 5, ("q", on(-1)): None, ("q", on(0)): None}
    assert not (tmp_path / "mark" / "state").exists()
