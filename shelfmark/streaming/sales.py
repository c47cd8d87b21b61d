"""Sales and demand over event-time windows, and each sale request once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from shelfmark.functions.coerce import money
from shelfmark.operators.alert_rules import completed


def sales_by_window(sales: DataFrame, *, length: str = "15 minutes", lateness: str = "1 hour") -> DataFrame:
    """Totals per store and tumbling window. With ``length="1 day"`` the windows are UTC days."""
    return (
        sales.withWatermark("sale_timestamp", lateness)
        .groupBy("store_id", F.window("sale_timestamp", length).alias("w"))
        .agg(money(F.sum(money("total_amount"))).alias("total_sales"), F.count(F.lit(1)).alias("transaction_count"))
        .select("store_id", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "total_sales", "transaction_count")
    )


def keep_demand(lines: DataFrame, path: str, *, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Units of completed sales per product and UTC day. Sums add up, so nothing is remembered between batches: every
    batch leaves its own sums in a folder of its own, and a batch that runs again writes that folder again. No row is too late."""

    def write(batch: DataFrame, batch_id: int) -> None:
        sold = batch.where(completed(F.col("status")) & (F.coalesce("product_id", F.lit("")) != "") & F.col("sale_timestamp").isNotNull())
        days = sold.groupBy("store_id", "product_id", F.to_date("sale_timestamp").alias("day")).agg(F.sum("quantity").alias("units"))
        days.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(
        **(trigger or {"availableNow": True})).start()


def demand_by_window(spark: SparkSession, path: str, *, days: int = 3) -> DataFrame:
    """Units per product over windows of ``days`` days that begin on every day, from what ``keep_demand`` wrote."""
    kept = spark.read.schema("store_id string, product_id string, day date, units bigint").parquet(path)
    # Sent by product once; the sums per day and per window then need no other exchange.
    by_product = kept.repartition("store_id", "product_id")
    daily = by_product.groupBy("store_id", "product_id", "day").agg(F.sum("units").alias("units"))
    starts = F.explode(F.transform(F.sequence(F.lit(0), F.lit(days - 1)), lambda back: F.date_sub("day", back))).alias("first_day")
    return daily.select("store_id", "product_id", starts, "units").groupBy("store_id", "product_id", "first_day").agg(
        F.sum("units").alias("units_sold"))


def each_request_once(requests: DataFrame, *, lateness: str = "1 hour") -> DataFrame:
    """The first request of every idempotency key within the lateness. Whether a repeated one is a replay
    or a conflict is told by the batch job, which has the stored hash."""
    return requests.withWatermark("requested_at", lateness).dropDuplicatesWithinWatermark(["store_id", "idempotency_key"])
