"""Ordered work on keys that may hold a large part of all rows.

Rows are range-partitioned by key and order, so that a large key spans several partitions and small
ones share one. The partition number is kept as ``_chunk``: it grows with the order within every key,
and a (key, chunk) group is never larger than a partition. Sums over a whole key are then chunk sums,
chained over the few chunks of the key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from shelfmark.session import settle

CHUNK = "_chunk"


def in_order_chunks(df: DataFrame, keys: Sequence[str], order: Sequence[str], chunks: int | None = None) -> DataFrame:
    """``df`` with its ``_chunk``, in as many partitions as ``chunks`` says or the session shuffles into. Settle the
    result (or what is built from it) before using it twice: chunk borders come from a sample."""
    count = chunks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(count, *keys, *order).withColumn(CHUNK, F.spark_partition_id())


def chained_before(totals: DataFrame, keys: Sequence[str], total: str, before: str) -> DataFrame:
    """``totals`` has one row per (key, chunk); adds the sum of ``total`` over the key's earlier chunks."""
    earlier = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    return totals.withColumn(before, F.coalesce(F.sum(total).over(earlier), F.lit(0).cast("bigint")))


def running_total(chunked: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str) -> DataFrame:
    """Sum of ``value`` up to and including every row, in order, per key."""
    totals = chunked.groupBy(*keys, CHUNK).agg(F.sum(value).alias("_chunk_total"))
    before = chained_before(totals, keys, "_chunk_total", "_chunk_before").select(*keys, CHUNK, "_chunk_before")
    within = Window.partitionBy(*keys, CHUNK).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = chunked.withColumn("_local", F.sum(value).over(within))
    return (
        local.join(before, [*keys, CHUNK])
        .withColumn(name, F.col("_chunk_before") + F.col("_local"))
        .drop("_chunk_before", "_local")
    )


__all__ = ["CHUNK", "in_order_chunks", "chained_before", "running_total", "settle"]
