"""Changed rows arriving as files: into the raw tables, with late rows kept aside."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from shelfmark.operators.ranking import newest_per
from shelfmark.session import in_utc
from shelfmark.sources.tables import LAYOUTS, Warehouse


def arriving(spark: SparkSession, folder: str, schema: str, *, files_per_trigger: int = 100) -> DataFrame:
    """A stream of the Parquet files that land in ``folder``."""
    return in_utc(spark).readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def feed_table(changes: DataFrame, warehouse: Warehouse, table: str, *, shape: Callable[[DataFrame], DataFrame],
               newest_by: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Upsert every micro-batch into ``table``. Of several changes of one key the newest counts, also
    if an older one comes in a later batch. A batch that runs twice after a failure writes the same rows again."""
    keys = list(LAYOUTS[table].keys)

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = shape(batch)
        ties = [F.xxhash64(*[F.col(c) for c in rows.columns if c not in keys]).asc()]
        newest = newest_per(rows, keys, [F.desc(newest_by), *ties])
        warehouse.upsert(table, newest, run_id=f"feed-{table}-{batch_id}", check_keys=False, newest_by=newest_by)

    return changes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(
        **(trigger or {"availableNow": True})).start()


def split_late(changes: DataFrame, *, event_time: str, delay: dt.timedelta, on_time: str, late: str, marks: str,
               checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Write rows older than the closed time to ``late``, the others to ``on_time``, one folder per batch.

    The closed time of a batch is the greatest event time of all earlier batches less ``delay``. Every
    batch leaves its own greatest time in ``marks``, so the split of a batch does not depend on how
    often it was run. No row is lost: each is in exactly one of the two tables.
    """
    spark = changes.sparkSession

    def write(batch: DataFrame, batch_id: int) -> None:
        # The first batch has nothing before it and closes nothing.
        earlier = spark.read.schema("at timestamp, batch bigint").parquet(marks).where(F.col("batch") < batch_id) if batch_id else None
        closed = earlier.agg(F.max("at")).first()[0] if earlier is not None else None
        old = F.lit(False) if closed is None else F.coalesce(
            F.col(event_time) < F.lit(closed - delay).cast("timestamp"), F.lit(False))
        batch.where(~old).write.mode("overwrite").parquet(f"{on_time}/batch={batch_id}")
        batch.where(old).write.mode("overwrite").parquet(f"{late}/batch={batch_id}")
        batch.agg(F.max(event_time).alias("at")).write.mode("overwrite").parquet(f"{marks}/batch={batch_id}")

    return changes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(
        **(trigger or {"availableNow": True})).start()


def late_counts(spark: SparkSession, late: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(late).groupBy("store_id").agg(F.count(F.lit(1)).alias("late_rows"))
