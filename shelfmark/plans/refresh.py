"""Mart refresh: the five tables in dependency order, freshness last."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from shelfmark.functions.timing import day_of, instant
from shelfmark.plans import marts
from shelfmark.session import settle
from shelfmark.sources.tables import Warehouse
from shelfmark.sources.windows import changed_in_store_windows, envelope

REFRESH_ORDER = ("sales_daily", "product_sales_daily", "customer_summary", "inventory_health", "dashboard_summary")


def touched_days(warehouse: Warehouse, windows: DataFrame) -> DataFrame | None:
    """The (store_id, day) groups that sales loaded in the stores' windows fall in; None without a window.
    Items carry their sale's time, so the same days hold for them."""
    within = envelope(windows)
    if within is None:
        return None
    changed = changed_in_store_windows(warehouse.read("transactions_raw"), windows, on=["created_at"], within=within)
    return settle(changed.select("store_id", F.to_date("sale_timestamp").alias("_day")).distinct(), "touched-days")


def _whole_days(warehouse: Warehouse, name: str, touched: DataFrame | None) -> DataFrame:
    """All raw rows of the touched store-days, from those days' folders; everything without ``touched``."""
    if touched is None:
        return warehouse.read(name)
    folders = warehouse.folders_of(name, touched.withColumn("sale_timestamp", F.col("_day").cast("timestamp")))
    rows = warehouse.read(name, folders=folders).withColumn("_day", F.to_date("sale_timestamp"))
    return rows.join(touched, ["store_id", "_day"], "left_semi").drop("_day")


def refresh_marts(warehouse: Warehouse, *, as_of, run_id: str, window: tuple | None = None,
                  touched: DataFrame | None = None, customers_since=None, stamps: DataFrame | None = None) -> None:
    """Rebuild the marts from the raw tables and stamp the rows with ``as_of``.

    With ``touched`` only those store-days are recomputed, and with ``customers_since`` only customers
    captured from then on. ``stamps`` (store_id, pipeline_run_id, checkpoint_start, checkpoint_end) names
    the stores that are fresh afterwards, by their own runs; without it all stores with raw data are,
    by ``run_id`` and ``window``. The five tables and the metadata rows that readers take freshness from
    appear together, in one version; a failure anywhere before leaves all six as they were.
    """
    with warehouse.transaction():
        _refresh(warehouse, as_of, run_id, window, touched, customers_since, stamps)


def _refresh(warehouse: Warehouse, as_of, run_id: str, window, touched, customers_since, stamps) -> None:
    read = warehouse.read
    people = read("customers_raw")
    if customers_since is not None:
        people = people.where(F.col("captured_at") >= instant(customers_since))
    warehouse.upsert_all({
        "sales_daily": marts.sales_daily(_whole_days(warehouse, "transactions_raw", touched), refreshed_at=as_of),
        "product_sales_daily": marts.product_sales_daily(_whole_days(warehouse, "transaction_items_raw", touched), refreshed_at=as_of),
        "customer_summary": marts.customer_summary(people, refreshed_at=as_of),
        "inventory_health": marts.inventory_health(read("inventory_snapshot_raw"), as_of=as_of, refreshed_at=as_of, tie=["snapshot_id"]),
    }, check_keys=False)
    today = F.col("sales_date") == day_of(as_of)
    dashboard = marts.dashboard_summary(
        read("sales_daily").where(today), read("product_sales_daily").where(today),
        read("inventory_health").where(F.col("snapshot_date") == day_of(as_of)), as_of=as_of, refreshed_at=as_of,
    )
    warehouse.upsert("dashboard_summary", dashboard, check_keys=False)
    if stamps is None:
        start, end = window if window else (None, None)
        at = lambda v: F.lit(None).cast("timestamp") if v is None else instant(v)
        stamps = read("transactions_raw").select("store_id").distinct().select(
            "store_id", F.lit(run_id).alias("pipeline_run_id"), at(start).alias("checkpoint_start"), at(end).alias("checkpoint_end"))
    publish_freshness(warehouse, stamps, as_of=as_of)


def publish_freshness(warehouse: Warehouse, stamps: DataFrame, *, as_of) -> None:
    """One metadata row per store of ``stamps``, with its run and window."""
    warehouse.upsert("analytics_metadata", stamps.select(
        "store_id", instant(as_of).alias("analytics_last_updated_at"), F.lit("fresh").alias("freshness_status"),
        F.col("pipeline_run_id").alias("last_pipeline_run_id"), F.col("checkpoint_start").alias("source_window_start"),
        F.col("checkpoint_end").alias("source_window_end"), instant(as_of).alias("updated_at"),
    ), check_keys=False)
