"""Alert evaluation jobs over all stores."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from shelfmark.operators import alert_rules
from shelfmark.operators.alert_book import AlertChanges, reconcile
from shelfmark.schemas import ALERT_TYPES


def rule_rows(kinds, products: DataFrame, items: DataFrame | None, *, as_of, days: DataFrame | None = None) -> DataFrame:
    """The chosen rules' rows in one frame, from one pass over products and sales."""
    return alert_rules.evaluate(kinds, products, items, as_of=as_of, days=days)


def sweep(kinds, products: DataFrame, items: DataFrame | None, alerts: DataFrame, *, as_of, days: DataFrame | None = None) -> AlertChanges:
    """One scheduled sweep: the given kinds, every store."""
    return reconcile(rule_rows(kinds, products, items, as_of=as_of, days=days), alerts, as_of=as_of)


def rebuild(products: DataFrame, items: DataFrame, alerts: DataFrame, *, as_of) -> AlertChanges:
    """All four rules."""
    return sweep(ALERT_TYPES, products, items, alerts, as_of=as_of)


def backfill_inventory_alerts(products: DataFrame, alerts: DataFrame, *, as_of) -> AlertChanges:
    """The two stock-driven rules for products that are not INACTIVE."""
    live = products.where(F.coalesce("status", F.lit("ACTIVE")) != "INACTIVE")
    return sweep(("LOW_STOCK", "EXPIRY_SOON"), live, None, alerts, as_of=as_of)


def after_change(changed: DataFrame, products: DataFrame, alerts: DataFrame, *, as_of,
                 kinds=("LOW_STOCK", "EXPIRY_SOON")) -> AlertChanges:
    """Only products named in ``changed`` (store_id, product_id). After sales pass ``("LOW_STOCK",)``."""
    touched = products.join(changed.select("store_id", "product_id"), ["store_id", "product_id"], "left_semi")
    return sweep(kinds, touched, None, alerts, as_of=as_of)
