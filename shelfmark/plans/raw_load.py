"""Operational tables to raw tables: shaping, and the incremental load of a window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from shelfmark.functions.coerce import key_or_document_id, minute_snapshot_id, money, text_or_null
from shelfmark.functions.shaping import flat_lines
from shelfmark.sources.tables import Warehouse, Written
from shelfmark.sources.windows import any_changed_between, changed_between

ALERT_INSTANTS = ("created_at", "last_evaluated_at", "acknowledged_at", "resolved_at")


def _key(df: DataFrame, column: str) -> Column:
    if "_doc_id" in df.columns:
        return key_or_document_id(column, "_doc_id").alias(column)
    return text_or_null(column).alias(column)


def transactions_raw(transactions: DataFrame) -> DataFrame:
    return transactions.select(
        _key(transactions, "transaction_id"), "store_id", "customer_id", "idempotency_key",
        money("total_amount").alias("total_amount"), "payment_method", "sale_timestamp", "created_at",
    )


def collapse_lines(lines: DataFrame, *, order: Column | None = None) -> DataFrame:
    """One row per (transaction, product): quantities and totals added up, the first name and unit
    price that are given; lines without a product id are dropped. ``order`` is the line order."""
    order = F.col("pos") if order is None else order
    zero = F.lit(0).cast("bigint")
    named = lines.where(F.coalesce("product_id", F.lit("")) != "").withColumn("_order", order)
    first_given = lambda c: F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("_order"))).alias(c)
    price = [first_given("unit_price")] if "unit_price" in lines.columns else []
    return named.groupBy("transaction_id", "store_id", "product_id").agg(
        first_given("product_name"),
        F.sum(F.coalesce("quantity", zero)).alias("quantity"),
        *price,
        money(F.sum(F.coalesce(money("line_total"), money(F.lit(0))))).alias("line_total"),
        F.min("sale_timestamp").alias("sale_timestamp"),
    )


def transaction_items_raw(transactions: DataFrame) -> DataFrame:
    """:func:`collapse_lines` of nested sales. A sale's lines come out of one row, so they are added up before the shuffle."""
    keyed = transactions.withColumn("transaction_id", _key(transactions, "transaction_id"))
    return collapse_lines(flat_lines(keyed))


def inventory_snapshot_raw(products: DataFrame, captured_at: Column) -> DataFrame:
    keyed = products.withColumn("product_id", _key(products, "product_id"))
    return keyed.select(
        minute_snapshot_id("product_id", captured_at).alias("snapshot_id"),
        "store_id", "product_id", F.col("name").alias("product_name"), "quantity_on_hand", "reorder_threshold",
        "expiry_date", captured_at.alias("captured_at"),
    )


def customers_raw(customers: DataFrame, captured_at: Column) -> DataFrame:
    return customers.select(
        _key(customers, "customer_id"), "store_id", "name", "phone", money("total_spend").alias("total_spend"),
        "visit_count", "last_purchase_at", captured_at.alias("captured_at"),
    )


def alerts_raw(alerts: DataFrame, captured_at: Column) -> DataFrame:
    return alerts.select(
        _key(alerts, "alert_id"), "store_id", "alert_type", "status", "severity", "source_entity_id",
        "created_at", "resolved_at", captured_at.alias("captured_at"),
    )


def shape_window(source, since, until) -> dict[str, DataFrame]:
    """The five raw frames of the window [since, until). ``source`` maps entity names to frames;
    ``lines`` may hold the transactions' lines as flat rows in place of the nested ``items``."""
    from shelfmark.functions.timing import instant

    captured = instant(until)
    sales = changed_between(source["transactions"], since, until, on="created_at")
    return {
        "transactions_raw": transactions_raw(sales),
        "transaction_items_raw": (
            collapse_lines(changed_between(source["lines"], since, until, on="created_at"))
            if "lines" in source else transaction_items_raw(sales)
        ),
        "inventory_snapshot_raw": inventory_snapshot_raw(
            changed_between(source["products"], since, until), captured),
        "customers_raw": customers_raw(changed_between(source["customers"], since, until), captured),
        "alerts_raw": alerts_raw(any_changed_between(source["alerts"], since, until, on=ALERT_INSTANTS), captured),
    }


def load_window(warehouse: Warehouse, source, since, until) -> dict[str, Written]:
    """Upsert the window into the raw tables, in one version; returns what was written per table.

    The counts come from the written files. Loading a window again changes nothing.
    """
    return warehouse.upsert_all(shape_window(source, since, until))
