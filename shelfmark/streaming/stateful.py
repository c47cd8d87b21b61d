"""Streams that remember: alert state per condition, stock per product."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from shelfmark.operators.stock import apply_adjustments
from shelfmark.sources.tables import Warehouse

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ALERT_EVENTS = "store_id string, condition_key string, from_status string, to_status string, severity string, changed_at timestamp"


def use_rocksdb(spark: SparkSession) -> None:
    """State larger than memory is kept on disk; the stateful operator below asks for this store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class AlertLifecycle(StatefulProcessor):
    """Opens an alert when its condition first holds and resolves it when it no longer does."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.status = handle.getValueState("status", "status string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        # Rows of one trigger come unordered; a trigger's file limit bounds how many there are.
        evaluations = pd.concat(list(rows)).sort_values("evaluated_at", kind="stable")
        status = self.status.get()[0] if self.status.exists() else "NONE"
        events = []
        for triggered, severity, at in zip(evaluations["triggered"], evaluations["severity"], evaluations["evaluated_at"]):
            target = "ACTIVE" if triggered and status != "ACTIVE" else "RESOLVED" if not triggered and status == "ACTIVE" else None
            if target is not None:
                events.append((key[0], key[1], "NONE" if target == "ACTIVE" else "ACTIVE", target, severity, at))
                status = target
        self.status.update((status,))
        if events:
            yield pd.DataFrame(events, columns=["store_id", "condition_key", "from_status", "to_status", "severity", "changed_at"])

    def close(self) -> None:
        pass


def alert_events(evaluations: DataFrame) -> DataFrame:
    """``evaluations``: store_id, condition_key, triggered, severity, evaluated_at → one row per transition."""
    use_rocksdb(evaluations.sparkSession)
    return evaluations.groupBy("store_id", "condition_key").transformWithStateInPandas(
        statefulProcessor=AlertLifecycle(), outputStructType=ALERT_EVENTS, outputMode="Append", timeMode="None")


def keep_stock(adjustments: DataFrame, warehouse: Warehouse, *, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Apply arriving adjustments to the stored products batch by batch.

    Each micro-batch goes through the batch operator, so a product that most rows are about is
    split into chunks here too. A batch's outcome is written down whole before the tables change,
    as absolute quantities and keyed rows; a batch that runs again finds it and only repeats the
    writing. Adjustments seen in earlier batches are not applied again.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark, folder = batch.sparkSession, f"{warehouse.root}/_batches/stock-{batch_id}"
        if not warehouse.is_complete(f"{folder}/decisions"):
            known = warehouse.read("stock_adjustments").select("adjustment_id")
            fresh = batch.dropDuplicates(["adjustment_id"]).join(known, "adjustment_id", "left_anti")
            result = apply_adjustments(warehouse.read("products"), fresh)
            result.products.write.mode("overwrite").parquet(f"{folder}/products")
            result.decisions.write.mode("overwrite").parquet(f"{folder}/decisions")
        with warehouse.transaction():
            warehouse.upsert("products", spark.read.parquet(f"{folder}/products"), run_id=f"stock-{batch_id}", check_keys=False)
            accepted = spark.read.parquet(f"{folder}/decisions").where("accepted").select(*batch.columns)
            warehouse.upsert("stock_adjustments", accepted, run_id=f"audit-{batch_id}", check_keys=False)

    return adjustments.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(
        **(trigger or {"availableNow": True})).start()


def run_to_table(stream: DataFrame, path: str, *, mode: str, checkpoint: str) -> None:
    """Drain what has arrived and append it to Parquet under ``path``; for update mode every batch
    is a folder and the newest batch's row of a key stands."""
    if mode == "append":
        query = stream.writeStream.outputMode("append").format("parquet").option("path", path)
    else:
        query = stream.writeStream.outputMode(mode).foreachBatch(
            lambda batch, batch_id: batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}"))
    query.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def newest_update(spark: SparkSession, path: str, schema: str, keys: list[str]) -> DataFrame:
    """The last row written for every key by an update-mode stream."""
    rows = spark.read.schema(schema + ", batch bigint").parquet(path)
    values = [c for c in rows.columns if c not in (*keys, "batch")]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("v"))
    return newest.select(*keys, "v.*")
