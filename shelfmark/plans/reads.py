"""Analytics reads over the marts, and the same answers straight from operational data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from shelfmark.functions.coerce import money
from shelfmark.functions.timing import day_of, freshness_by_age, in_utc_day, instant, stricter_freshness
from shelfmark.operators.ranking import newest_per, top_per

# Allowed query arguments.
RANGES = {"7d": 7, "30d": 30, "90d": 90}
GRANULARITIES = ("daily", "weekly")


def range_days(name: str) -> int:
    if name not in RANGES:
        raise ValueError(f"range must be one of {sorted(RANGES)}, got {name!r}")
    return RANGES[name]


def _check_granularity(name: str) -> None:
    if name not in GRANULARITIES:
        raise ValueError(f"granularity must be one of {sorted(GRANULARITIES)}, got {name!r}")


def one_store(df: DataFrame, store_id: str | None) -> DataFrame:
    """The single-store form of any read: a filter that reaches the scan, or none."""
    return df if store_id is None else df.where(F.col("store_id") == store_id)


# --- marts -------------------------------------------------------------------------------------


def latest_dashboard(dashboards: DataFrame) -> DataFrame:
    return newest_per(dashboards, ["store_id"], [F.desc("snapshot_date")])


def active_alert_counts(alerts_raw: DataFrame, *, tie: Column | None = None) -> DataFrame:
    """Count of alerts whose newest captured status is ACTIVE; 0 for a store without one."""
    order = [F.desc("captured_at")] + ([tie] if tie is not None else [])
    newest = newest_per(alerts_raw.select("store_id", "alert_id", "status", "captured_at",
                                          *(["seq"] if "seq" in alerts_raw.columns else [])),
                        ["store_id", "alert_id"], order)
    return newest.groupBy("store_id").agg(F.count_if(F.col("status") == "ACTIVE").alias("active_alert_count"))


def dashboard_with_alert_truth(dashboards: DataFrame, alerts_raw: DataFrame, *, tie: Column | None = None) -> DataFrame:
    """Latest dashboard row with the alert count replaced by the true one; no alerts means 0."""
    truth = active_alert_counts(alerts_raw, tie=tie)
    return (
        latest_dashboard(dashboards).drop("active_alert_count")
        .join(truth, "store_id", "left")
        .select(
            "store_id", "snapshot_date", "today_sales", "today_transactions",
            F.coalesce("active_alert_count", F.lit(0).cast("bigint")).alias("active_alert_count"),
            "low_stock_count", "top_selling_product",
        )
    )


def _label(day: Column, granularity: str) -> Column:
    start = F.to_date(F.date_trunc("week", day)) if granularity == "weekly" else day
    return F.date_format(start, "yyyy-MM-dd")


def sales_trend(sales: DataFrame, *, as_of, days: int = 30, granularity: str = "daily") -> DataFrame:
    """Days from as_of - days on, both ends included; weeks start on Monday."""
    _check_granularity(granularity)
    return (
        sales.where(F.col("sales_date") >= F.date_sub(day_of(as_of), days))
        .groupBy("store_id", _label(F.col("sales_date"), granularity).alias("label"))
        .agg(money(F.sum("total_sales")).alias("sales_amount"), F.sum("transaction_count").alias("transactions"))
    )


def in_chart_order(points: DataFrame) -> DataFrame:
    return points.orderBy("store_id", "label")


def product_performance(product_sales: DataFrame, *, k: int = 50) -> DataFrame:
    totals = product_sales.groupBy("store_id", "product_id").agg(
        F.max("product_name").alias("product_name"),
        F.sum("quantity_sold").alias("quantity_sold"),
        money(F.sum("revenue")).alias("revenue"),
    )
    return top_per(totals, ["store_id"], [F.desc("revenue"), F.asc("product_id")], k)


def customer_insights(summary: DataFrame, *, k: int = 10) -> DataFrame:
    return top_per(summary, ["store_id"], [F.desc("lifetime_spend"), F.asc("customer_id")], k).select(
        "store_id", "customer_id", F.col("customer_name").alias("name"), "lifetime_spend", "visit_count"
    )


def top_customers(summary: DataFrame, *, k: int = 3) -> DataFrame:
    return top_per(
        summary, ["store_id"], [F.desc("lifetime_spend"), F.desc("visit_count"), F.asc("customer_id")], k, rank="rank"
    )


def last_sales_days(sales: DataFrame, *, k: int = 7) -> DataFrame:
    return top_per(sales, ["store_id"], [F.desc("sales_date")], k, rank="rank")


def latest_product_sales(product_sales: DataFrame, *, product_ids: DataFrame | None = None, k: int = 3) -> DataFrame:
    """The newest sales row of every product, then the best ``k`` per store.
    ``product_ids`` (store_id, product_id) restricts the products."""
    if product_ids is not None:
        product_sales = product_sales.join(product_ids, ["store_id", "product_id"], "left_semi")
    newest = newest_per(product_sales, ["store_id", "product_id"], [F.desc("sales_date")])
    return top_per(
        newest, ["store_id"], [F.desc("revenue"), F.desc("quantity_sold"), F.asc("product_id")], k, rank="rank"
    )


def sales_direction(sales: DataFrame) -> DataFrame:
    """Newest sales day against the one before it: up, down or flat; NULL with a single day."""
    two = last_sales_days(sales, k=2)
    pick = lambda rank, column: F.max(F.when(F.col("rank") == rank, F.col(column)))
    pair = two.groupBy("store_id").agg(
        pick(1, "sales_date").alias("latest_sales_date"),
        pick(1, "total_sales").alias("latest_total_sales"),
        pick(2, "total_sales").alias("previous_total_sales"),
        F.count(F.lit(1)).alias("_days"),
    )
    latest, previous = F.coalesce("latest_total_sales", F.lit(0)), F.coalesce("previous_total_sales", F.lit(0))
    return pair.withColumn(
        "direction",
        F.when(F.col("_days") < 2, F.lit(None).cast("string"))
        .when(latest > previous, F.lit("up")).when(latest < previous, F.lit("down")).otherwise(F.lit("flat")),
    ).drop("_days")


def with_freshness(rows: DataFrame, metadata: DataFrame, *, as_of) -> DataFrame:
    """Adds the freshness columns; a store without metadata is not ready and drops out."""
    fresh = metadata.select(
        "store_id",
        "analytics_last_updated_at",
        stricter_freshness(
            freshness_by_age(F.col("analytics_last_updated_at"), as_of), F.col("freshness_status")
        ).alias("freshness_status"),
    )
    return rows.drop("analytics_last_updated_at").join(fresh, "store_id")


def stores_not_ready(stores: DataFrame, metadata: DataFrame, dashboards: DataFrame) -> DataFrame:
    """Stores without metadata or without any dashboard row, with the reason."""
    has_metadata = metadata.select("store_id").distinct().withColumn("_m", F.lit(True))
    has_dashboard = dashboards.select("store_id").distinct().withColumn("_d", F.lit(True))
    return (
        stores.select("store_id").join(has_metadata, "store_id", "left").join(has_dashboard, "store_id", "left")
        .where("_m IS NULL OR _d IS NULL")
        .select("store_id", F.when(F.col("_m").isNull(), F.lit("NO_METADATA")).otherwise(F.lit("NO_DASHBOARD")).alias("reason"))
    )


# --- live --------------------------------------------------------------------------------------


def live_dashboard(stores: DataFrame, transactions: DataFrame, items: DataFrame, alerts: DataFrame, *, as_of) -> DataFrame:
    """Today's figures from operational tables. ``items`` are flat lines with ``sale_timestamp``."""
    today = transactions.where(in_utc_day(F.col("sale_timestamp"), as_of)).groupBy("store_id").agg(
        money(F.sum(money("total_amount"))).alias("today_sales"), F.count(F.lit(1)).alias("today_transactions")
    )
    open_alerts = alerts.where(F.col("status") == "ACTIVE").groupBy("store_id").agg(
        F.count(F.lit(1)).alias("active_alert_count"),
        F.count_if(F.col("alert_type") == "LOW_STOCK").alias("low_stock_count"),
    )
    units = (
        items.where(in_utc_day(F.col("sale_timestamp"), as_of) & (F.coalesce("product_id", F.lit("")) != ""))
        .groupBy("store_id", "product_id")
        .agg(F.sum(F.coalesce("quantity", F.lit(0))).alias("units"),
             F.max(F.nullif("product_name", F.lit(""))).alias("product_name"))
    )
    top = (
        units.groupBy("store_id")
        .agg(F.max(F.struct("units", F.coalesce("product_name", "product_id").alias("shown"), "product_id")).alias("top"))
        .select("store_id", F.col("top.shown").alias("top_selling_product"))
    )
    zero = F.lit(0).cast("bigint")
    return (
        stores.select("store_id").join(today, "store_id", "left").join(open_alerts, "store_id", "left")
        .join(top, "store_id", "left")
        .select(
            "store_id",
            F.coalesce("today_sales", money(F.lit(0))).alias("today_sales"),
            F.coalesce("today_transactions", zero).alias("today_transactions"),
            F.coalesce("active_alert_count", zero).alias("active_alert_count"),
            F.coalesce("low_stock_count", zero).alias("low_stock_count"),
            "top_selling_product",
        )
    )


def live_sales_trend(transactions: DataFrame, *, as_of, days: int = 30, granularity: str = "daily") -> DataFrame:
    """The last ``days`` days with as_of's own; one day fewer than the mart trend."""
    _check_granularity(granularity)
    start = F.date_sub(day_of(as_of), days - 1).cast("timestamp")
    return (
        transactions.where(F.col("sale_timestamp") >= start)
        .groupBy("store_id", _label(F.to_date("sale_timestamp"), granularity).alias("label"))
        .agg(money(F.sum(money(F.coalesce("total_amount", F.lit(0))))).alias("sales_amount"),
             F.count(F.lit(1)).alias("transactions"))
    )


def live_product_performance(items: DataFrame, *, k: int = 50) -> DataFrame:
    per_name = (
        items.where(F.coalesce("product_id", F.lit("")) != "")
        .groupBy("store_id", "product_id", F.nullif("product_name", F.lit("")).alias("_name"))
        .agg(
            F.sum(F.coalesce("quantity", F.lit(0))).alias("_units"),
            F.sum(F.coalesce(money("line_total"), money(F.lit(0)))).alias("_revenue"),
        )
    )
    totals = per_name.groupBy("store_id", "product_id").agg(
        F.coalesce(F.max("_name"), "product_id").alias("product_name"),
        F.sum("_units").alias("quantity_sold"),
        money(F.sum("_revenue")).alias("revenue"),
    )
    return top_per(totals, ["store_id"], [F.desc("revenue"), F.asc("product_name"), F.asc("product_id")], k)


def live_customer_insights(customers: DataFrame, *, k: int = 10) -> DataFrame:
    rows = customers.select(
        "store_id", "customer_id",
        F.coalesce(F.nullif("name", F.lit("")), F.lit("Unknown")).alias("name"),
        F.coalesce(money("total_spend"), money(F.lit(0))).alias("lifetime_spend"),
        F.coalesce("visit_count", F.lit(0).cast("bigint")).alias("visit_count"),
    )
    return top_per(rows, ["store_id"], [F.desc("lifetime_spend"), F.asc("name"), F.asc("customer_id")], k)


def alert_summary(alerts: DataFrame, *, as_of) -> DataFrame:
    status = F.col("status")
    return alerts.groupBy("store_id").agg(
        F.count_if(status == "ACTIVE").alias("active"),
        F.count_if(status == "ACKNOWLEDGED").alias("acknowledged"),
        F.count_if((status == "RESOLVED") & in_utc_day(F.col("resolved_at"), as_of)).alias("resolved_today"),
    )


def inventory_counts(products: DataFrame, *, as_of) -> DataFrame:
    """Active products, those at or below threshold, and those expired or expiring soon."""
    from shelfmark.functions.timing import expiry_status

    active = F.upper(F.coalesce("status", F.lit("ACTIVE"))) == "ACTIVE"
    low = (F.col("reorder_threshold") > 0) & (F.col("quantity_on_hand") <= F.col("reorder_threshold"))
    return products.groupBy("store_id").agg(
        F.count_if(active).alias("active_products"),
        F.count_if(active & low).alias("low_stock"),
        F.count_if(active & (expiry_status(F.col("expiry_date"), as_of) != "OK")).alias("expired_or_expiring"),
    )
