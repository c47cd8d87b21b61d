"""Filtered listings and point lookups over the operational tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from shelfmark.functions.timing import instant
from shelfmark.operators.ranking import page_per


def filter_products(products: DataFrame, *, low_stock_only: bool = False, expiry_before=None,
                    inclusive: bool = True) -> DataFrame:
    """Low stock includes equality here. Products without an expiry date are never "before" one."""
    if low_stock_only:
        quantity, threshold = F.col("quantity_on_hand"), F.col("reorder_threshold")
        products = products.where(quantity <= threshold if inclusive else quantity < threshold)
    if expiry_before is not None:
        products = products.where(F.col("expiry_date") < instant(expiry_before))
    return products


def product_pages(products: DataFrame, *, offset: int = 0, limit: int = 50, **filters) -> DataFrame:
    return page_per(filter_products(products, **filters), ["store_id"], [F.asc("product_id")], offset=offset, limit=limit)


def filter_transactions(transactions: DataFrame, *, customer_id: str | None = None, start=None, end=None) -> DataFrame:
    """Both ends of the time range belong to it."""
    if start is not None and end is not None and str(start) > str(end):
        raise ValueError("start must not be later than end")
    if customer_id is not None:
        transactions = transactions.where(F.col("customer_id") == customer_id)
    if start is not None:
        transactions = transactions.where(F.col("sale_timestamp") >= instant(start))
    if end is not None:
        transactions = transactions.where(F.col("sale_timestamp") <= instant(end))
    return transactions


def transaction_pages(transactions: DataFrame, *, offset: int = 0, limit: int = 50, **filters) -> DataFrame:
    """Newest first within every store."""
    rows = filter_transactions(transactions, **filters).select(
        "store_id", "transaction_id", "customer_id", "total_amount", "sale_timestamp", "status"
    )
    return page_per(rows, ["store_id"], [F.desc("sale_timestamp"), F.asc("transaction_id")], offset=offset, limit=limit)


def by_id(df: DataFrame, key: str, value: str, store_id: str) -> DataFrame:
    """One row of one store, or none."""
    return df.where((F.col(key) == value) & (F.col("store_id") == store_id))


def by_ids(df: DataFrame, key: str, values: Sequence[str], store_id: str, *, most: int | None = None) -> DataFrame:
    """The distinct ids asked for (the first ``most``, if given), in the order asked; ids of other stores drop out."""
    wanted = list(dict.fromkeys(values))[:most]
    if not wanted:
        return df.where(F.lit(False))
    order = F.array_position(F.array(*[F.lit(v) for v in wanted]), F.col(key))
    return df.where(F.col(key).isin(wanted) & (F.col("store_id") == store_id)).orderBy(order)


def distinct_stores(products: DataFrame) -> DataFrame:
    return products.select("store_id").distinct()
