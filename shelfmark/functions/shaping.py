"""Nested line items to flat rows and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def flat_lines(transactions: DataFrame) -> DataFrame:
    """One row per line with its position; lines without a product are kept for the caller to judge."""
    header = [c for c in ("store_id", "transaction_id", "customer_id", "status", "sale_timestamp", "created_at")
              if c in transactions.columns]
    return transactions.select(*header, F.posexplode("items").alias("pos", "line")).select(*header, "pos", "line.*")


def first_items(items: Column, n: int = 5) -> Column:
    """Compact view of the first ``n`` lines of a transaction."""
    return F.transform(
        F.slice(items, 1, n),
        lambda line: F.struct(
            line["product_id"].alias("product_id"),
            line["quantity"].alias("quantity"),
            line["line_total"].alias("line_total"),
        ),
    )


def alert_list_item(alerts: DataFrame) -> DataFrame:
    return alerts.select(
        "store_id", "alert_id", "alert_type", "status", "severity", "title", "message",
        "created_at", "acknowledged_at", "resolved_at",
    )


def acknowledge_view(alerts: DataFrame) -> DataFrame:
    return alerts.select("alert_id", "status", "acknowledged_at", "acknowledged_by")


def resolve_view(alerts: DataFrame) -> DataFrame:
    return alerts.select("alert_id", "status", "resolved_at", "resolved_by", "resolution_note")


def transaction_detail(transactions: DataFrame) -> DataFrame:
    return transactions.select(
        "transaction_id", "store_id", "customer_id", "status", "payment_method", "total_amount", "sale_timestamp",
        "idempotency_key",
        F.transform(
            F.coalesce("items", F.array()),
            lambda i: F.struct(i["product_id"].alias("product_id"), i["quantity"].alias("quantity"),
                               i["unit_price"].alias("unit_price"), i["line_total"].alias("line_total")),
        ).alias("items"),
    )
