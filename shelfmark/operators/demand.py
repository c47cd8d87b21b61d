"""Units sold per product in windows of time, from sums per day that are kept.

A day's sum never changes once the day is over, so a window needs the rows of its first and last day only; whole
days between come from the kept sums. A sweep on the next day reads the days at its windows' ends and nothing of the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

PRODUCT = ["store_id", "product_id"]


def completed(status: Column) -> Column:
    """A missing or empty status counts as completed."""
    return F.coalesce(F.nullif(status, F.lit("")), F.lit("COMPLETED")) == "COMPLETED"


def _counted(lines: DataFrame) -> DataFrame:
    """Lines that count: of completed sales, with a product."""
    return lines.where(completed(F.col("status")) & (F.coalesce("product_id", F.lit("")) != "")).withColumn(
        "quantity", F.coalesce("quantity", F.lit(0).cast("bigint")))


def day_units(lines: DataFrame) -> DataFrame:
    """(store_id, product_id, sales_date, units). ``lines``: store_id, product_id, quantity, status, sale_timestamp."""
    return _counted(lines).where("sale_timestamp is not null").groupBy(*PRODUCT, F.to_date("sale_timestamp").alias("sales_date")).agg(F.sum("quantity").alias("units"))


def with_more(stored: DataFrame, more: DataFrame) -> DataFrame:
    """The rows of ``more`` with what is stored for them added: what to write after new sales."""
    held = stored.select(*PRODUCT, "sales_date", F.col("units").alias("_held"))
    return more.join(held, [*PRODUCT, "sales_date"], "left").select(
        *PRODUCT, "sales_date", (F.col("units") + F.coalesce("_held", F.lit(0).cast("bigint"))).alias("units"))


def units_in(windows: dict[str, tuple[Column, Column]], days: DataFrame, lines: DataFrame) -> DataFrame:
    """Units per product in each of several closed windows of time. Of ``lines`` only those of the days that a window
    starts or ends in are needed, of ``days`` only those between."""
    at, day, zero = F.col("sale_timestamp"), F.col("sales_date"), F.lit(0).cast("bigint")
    whole = {n: (day > F.to_date(start)) & (day < F.to_date(end)) for n, (start, end) in windows.items()}
    at_end = {n: at.between(start, end) & ((F.to_date(at) == F.to_date(start)) | (F.to_date(at) == F.to_date(end))) for n, (start, end) in windows.items()}
    any_of = lambda conditions: next(iter(conditions.values())) if len(conditions) == 1 else F.greatest(*conditions.values())
    some = lambda amount, conditions: [F.when(c, F.col(amount)).otherwise(zero).alias(n) for n, c in conditions.items()]
    inner = days.where(any_of(whole)).select(*PRODUCT, *some("units", whole))
    ends = _counted(lines).where(any_of(at_end)).select(*PRODUCT, *some("quantity", at_end))
    return inner.unionByName(ends).groupBy(*PRODUCT).agg(*[F.sum(n).alias(n) for n in windows])
