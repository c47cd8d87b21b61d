"""The four alert rules as projections over all products of all stores.

Every rule gives one row per evaluated product: whether its condition holds, and what the alert
would say. Reconciling these rows with the stored alerts is :mod:`shelfmark.operators.alert_book`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from shelfmark.functions.timing import days_before, instant, whole_days_to
from shelfmark.operators.demand import completed, units_in

RULE_COLUMNS = (
    "store_id", "alert_type", "condition_key", "source_entity_id", "triggered", "severity", "title", "message", "metadata",
)
KINDS = ("LOW_STOCK", "EXPIRY_SOON", "NOT_SELLING", "HIGH_DEMAND")
NEED_SALES = ("NOT_SELLING", "HIGH_DEMAND")


def _rule(kind: str, triggered: Column, severity: Column, title: Column, message: Column, metadata: Column) -> Column:
    return F.struct(
        F.col("store_id").alias("store_id"),
        F.lit(kind).alias("alert_type"),
        F.concat(F.lit(kind + "_"), F.col("product_id")).alias("condition_key"),
        F.col("product_id").alias("source_entity_id"),
        triggered.alias("triggered"),
        F.when(triggered, severity).alias("severity"),
        F.when(triggered, title).alias("title"),
        F.when(triggered, message).alias("message"),
        F.when(triggered, F.to_json(metadata)).alias("metadata"),
    )


def _known(products: DataFrame) -> DataFrame:
    """Products with an id; missing names and quantities get the rules' defaults."""
    zero = F.lit(0).cast("bigint")
    return (
        products.where(F.coalesce("product_id", F.lit("")) != "")
        .withColumn("name", F.coalesce("name", F.lit("Unknown Product")))
        .withColumn("quantity_on_hand", F.coalesce("quantity_on_hand", zero))
    )


def _low_stock() -> Column:
    quantity = F.col("quantity_on_hand")
    threshold = F.coalesce("reorder_threshold", F.lit(0).cast("bigint"))
    return _rule(
        "LOW_STOCK",
        quantity <= threshold,
        F.when(quantity == 0, F.lit("CRITICAL")).otherwise(F.lit("HIGH")),
        F.concat("name", F.lit(" stock is low")),
        F.format_string("Only %d units left. Reorder soon.", quantity),
        F.struct("quantity_on_hand", threshold.alias("reorder_threshold")),
    )


def _expiry_soon(as_of) -> Column:
    quantity = F.col("quantity_on_hand")
    days = whole_days_to(F.col("expiry_date"), as_of)
    triggered = F.col("expiry_date").isNotNull() & (quantity > 0) & (days <= 7)
    return _rule(
        "EXPIRY_SOON",
        F.coalesce(triggered, F.lit(False)),
        F.when(days <= 0, F.lit("HIGH")).otherwise(F.lit("MEDIUM")),
        F.concat("name", F.lit(" expires soon")),
        F.when(days < 0, F.format_string("%d units have expired.", quantity))
        .when(days == 0, F.format_string("%d units expire today.", quantity))
        .otherwise(F.format_string("%d units expire within %d days.", quantity, days)),
        F.struct("quantity_on_hand", "expiry_date", days.alias("days_to_expiry")),
    )


def _not_selling(lookback_days: int) -> Column:
    return _rule(
        "NOT_SELLING",
        (F.col("quantity_on_hand") > 0) & (F.col("lookback_units_sold") <= 0),
        F.lit("MEDIUM"),
        F.concat("name", F.lit(" is not selling")),
        F.lit(f"No sales in the last {lookback_days} days while stock is still available."),
        F.struct("quantity_on_hand", F.lit(lookback_days).alias("lookback_days"), F.lit(0).alias("recent_sales_units")),
    )


def _high_demand(recent_days: int, baseline_days: int) -> Column:
    """The comparisons are made in whole units; dividing first would let rounding decide ties."""
    quantity, recent, baseline = F.col("quantity_on_hand"), F.col("recent_units_sold"), F.col("baseline_units_sold")
    # recent/recent_days >= 1.5 * baseline/baseline_days, and quantity / (recent/recent_days) < 3 days
    spike = (baseline > 0) & (2 * recent * baseline_days >= 3 * baseline * recent_days)
    cover = (recent > 0) & (quantity * recent_days < 3 * recent)
    reason = (
        F.when(spike & cover, F.lit("sales acceleration and low stock cover"))
        .when(spike, F.lit("sales acceleration vs baseline"))
        .otherwise(F.lit("low stock cover"))
    )
    recent_rate = recent / F.lit(float(recent_days))
    return _rule(
        "HIGH_DEMAND",
        spike | cover,
        F.lit("HIGH"),
        F.concat("name", F.lit(" demand is high")),
        F.concat(F.lit("Recent demand signal detected ("), reason, F.lit(").")),
        F.struct(
            "quantity_on_hand",
            F.lit(recent_days).alias("recent_days"),
            F.lit(baseline_days).alias("baseline_days"),
            "recent_units_sold",
            "baseline_units_sold",
            recent_rate.alias("recent_daily_rate"),
            (baseline / F.lit(float(baseline_days))).alias("baseline_daily_rate"),
            F.try_divide("quantity_on_hand", F.nullif(recent_rate, F.lit(0.0))).alias("stock_cover_days"),
            spike.alias("triggered_by_rate_spike"),
            cover.alias("triggered_by_stock_cover"),
        ),
    )


def units_sold(items: DataFrame, *, start: Column, end: Column, name: str = "units_sold") -> DataFrame:
    """Units per product of completed sales in the closed window [start, end]."""
    return _units(items, {name: (start, end)})


def _units(items: DataFrame, windows: dict[str, tuple[Column, Column]]) -> DataFrame:
    """Units per product in each of several closed windows, from one pass over their span."""
    at, zero = F.col("sale_timestamp"), F.lit(0).cast("bigint")
    quantity = F.coalesce("quantity", zero)
    first = F.least(*[w[0] for w in windows.values()]) if len(windows) > 1 else next(iter(windows.values()))[0]
    last = F.greatest(*[w[1] for w in windows.values()]) if len(windows) > 1 else next(iter(windows.values()))[1]
    return (
        items.where(at.between(first, last))
        .where(completed(F.col("status")) & (F.coalesce("product_id", F.lit("")) != ""))
        .groupBy("store_id", "product_id")
        .agg(*[F.sum(F.when(at.between(*w), quantity).otherwise(zero)).alias(n) for n, w in windows.items()])
    )


def evaluate(kinds: Sequence[str], products: DataFrame, items: DataFrame | None = None, *, as_of=None,
             lookback_days: int = 14, recent_days: int = 3, baseline_days: int = 14, days: DataFrame | None = None) -> DataFrame:
    """One row per product and kind, from one scan of the products and at most one of the sales. With ``days``, kept
    sums per day (:func:`shelfmark.operators.demand.day_units`), only the sales of the windows' first and last days are read.

    The windows are closed at both ends, so a sale at the edge between recent and baseline counts in both.
    """
    unknown = [k for k in kinds if k not in KINDS]
    if unknown:
        raise ValueError(f"kinds must be among {KINDS}, got {unknown}")
    rows = _known(products)
    windows = {}
    if "NOT_SELLING" in kinds:
        windows["lookback_units_sold"] = (days_before(as_of, lookback_days), instant(as_of))
    if "HIGH_DEMAND" in kinds:
        edge = days_before(as_of, recent_days)
        windows["recent_units_sold"] = (edge, instant(as_of))
        windows["baseline_units_sold"] = (days_before(as_of, recent_days + baseline_days), edge)
    if windows:
        units = _units(items, windows) if days is None else units_in(windows, days, items)
        rows = rows.join(units, ["store_id", "product_id"], "left").withColumns(
            {n: F.coalesce(n, F.lit(0).cast("bigint")) for n in windows})
    rules = {
        "LOW_STOCK": _low_stock, "EXPIRY_SOON": lambda: _expiry_soon(as_of), "NOT_SELLING": lambda: _not_selling(lookback_days),
        "HIGH_DEMAND": lambda: _high_demand(recent_days, baseline_days),
    }
    return rows.select(F.inline(F.array(*[rules[k]() for k in kinds])))


def low_stock(products: DataFrame) -> DataFrame:
    return evaluate(("LOW_STOCK",), products)


def expiry_soon(products: DataFrame, *, as_of) -> DataFrame:
    return evaluate(("EXPIRY_SOON",), products, as_of=as_of)


def not_selling(products: DataFrame, items: DataFrame, *, as_of, lookback_days: int = 14) -> DataFrame:
    return evaluate(("NOT_SELLING",), products, items, as_of=as_of, lookback_days=lookback_days)


def high_demand(products: DataFrame, items: DataFrame, *, as_of, recent_days: int = 3, baseline_days: int = 14) -> DataFrame:
    return evaluate(("HIGH_DEMAND",), products, items, as_of=as_of, recent_days=recent_days, baseline_days=baseline_days)
