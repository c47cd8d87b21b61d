"""The five mart tables, for all stores at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from shelfmark.functions.coerce import money
from shelfmark.functions.timing import calendar_days_to, day_of, instant
from shelfmark.operators.ranking import newest_per


def _stamp(df: DataFrame, refreshed_at) -> DataFrame:
    return df if refreshed_at is None else df.withColumn("analytics_last_updated_at", instant(refreshed_at))


def sales_daily(transactions: DataFrame, *, refreshed_at=None) -> DataFrame:
    """Every status counts: the raw table does not carry one."""
    daily = (
        transactions.groupBy("store_id", F.to_date("sale_timestamp").alias("sales_date"))
        .agg(F.sum(money("total_amount")).alias("total"), F.count(F.lit(1)).alias("transaction_count"),
             F.count("total_amount").alias("_amounts"))
        .select(
            "store_id",
            "sales_date",
            money("total").alias("total_sales"),
            "transaction_count",
            F.try_divide(F.col("total").cast("double"), F.col("_amounts")).alias("average_basket_value"),
        )
    )
    return _stamp(daily, refreshed_at)


def product_sales_daily(items: DataFrame, *, refreshed_at=None) -> DataFrame:
    """One row per key also when a product was renamed within the day: the greatest name stands."""
    # The raw rows are summed per name first: a maximum over text would make Spark sort them all.
    per_name = (
        items.groupBy("store_id", F.to_date("sale_timestamp").alias("sales_date"), "product_id", "product_name")
        .agg(F.sum("quantity").alias("_units"), F.sum(money("line_total")).alias("_revenue"))
    )
    daily = per_name.groupBy("store_id", "sales_date", "product_id").agg(
        F.max("product_name").alias("product_name"),
        F.sum("_units").alias("quantity_sold"),
        money(F.sum("_revenue")).alias("revenue"),
    )
    return _stamp(daily, refreshed_at)


def customer_summary(
    customers_raw: DataFrame, *, refreshed_at=None, tie: Sequence[Column | str] = ()
) -> DataFrame:
    """Newest capture of every customer."""
    order = [F.col("captured_at").desc(), *[F.desc(c) if isinstance(c, str) else c for c in tie]]
    newest = newest_per(customers_raw, ["store_id", "customer_id"], order).select(
        "store_id",
        "customer_id",
        F.col("name").alias("customer_name"),
        money("total_spend").alias("lifetime_spend"),
        "visit_count",
        "last_purchase_at",
    )
    return _stamp(newest, refreshed_at)


def inventory_health(
    snapshots: DataFrame, *, as_of, refreshed_at=None, tie: Sequence[Column | str] = (), inclusive: bool = False
) -> DataFrame:
    """Newest snapshot of every product. Low stock is strict here; the alert rule includes equality."""
    order = [F.col("captured_at").desc(), *[F.desc(c) if isinstance(c, str) else c for c in tie]]
    on_hand, threshold = F.col("quantity_on_hand"), F.col("reorder_threshold")
    health = newest_per(snapshots, ["store_id", "product_id"], order).select(
        "store_id",
        day_of(as_of).alias("snapshot_date"),
        "product_id",
        "product_name",
        "quantity_on_hand",
        "reorder_threshold",
        calendar_days_to(F.col("expiry_date"), as_of).alias("days_to_expiry"),
        (on_hand <= threshold if inclusive else on_hand < threshold).alias("is_low_stock"),
    )
    return _stamp(health, refreshed_at)


def low_stock_counts(health: DataFrame) -> DataFrame:
    return health.groupBy("store_id", "snapshot_date").agg(F.count_if("is_low_stock").alias("low_stock_count"))


def top_seller_of_day(product_sales: DataFrame, as_of) -> DataFrame:
    """The product with the most units of the day in every store."""
    return (
        product_sales.where(F.col("sales_date") == day_of(as_of))
        .groupBy("store_id")
        .agg(F.max(F.struct("quantity_sold", "product_name", "product_id")).alias("top"))
        .select("store_id", F.col("top.product_name").alias("top_selling_product"))
    )


def dashboard_summary(
    sales: DataFrame, product_sales: DataFrame, health: DataFrame, *, as_of, refreshed_at=None,
    include_idle_stores: bool = False,
) -> DataFrame:
    """Figures of the day per store. ``active_alert_count`` repeats the low-stock count, as the mart does;
    the true count is :func:`shelfmark.plans.reads.dashboard_with_alert_truth`."""
    today = sales.where(F.col("sales_date") == day_of(as_of)).select(
        "store_id", F.col("total_sales").alias("today_sales"), F.col("transaction_count").alias("today_transactions")
    )
    low = low_stock_counts(health.where(F.col("snapshot_date") == day_of(as_of))).select("store_id", "low_stock_count")
    joined = today.join(low, "store_id", "full" if include_idle_stores else "left").join(
        top_seller_of_day(product_sales, as_of), "store_id", "left"
    )
    low_count = F.coalesce("low_stock_count", F.lit(0).cast("bigint"))
    summary = joined.select(
        "store_id",
        day_of(as_of).alias("snapshot_date"),
        F.coalesce("today_sales", money(F.lit(0))).alias("today_sales"),
        F.coalesce("today_transactions", F.lit(0).cast("bigint")).alias("today_transactions"),
        low_count.alias("active_alert_count"),
        low_count.alias("low_stock_count"),
        "top_selling_product",
    )
    return _stamp(summary, refreshed_at)
