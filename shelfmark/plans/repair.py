"""Sync, transform and repair jobs, all stores in one pass, kept in the ledger."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from shelfmark.operators import ledger
from shelfmark.plans import jobs, raw_load, refresh
from shelfmark.functions.timing import instant
from shelfmark.session import settle
from shelfmark.sources.tables import Warehouse, Written
from shelfmark.sources.windows import changed_in_store_windows, envelope


def shape_store_windows(source: dict[str, DataFrame], windows: DataFrame) -> dict[str, DataFrame]:
    """The raw frames of every store's own window."""
    within = envelope(windows)
    in_windows = lambda name, on: changed_in_store_windows(source[name], windows, on=on, within=within)
    captured = F.col("checkpoint_end")
    sales = in_windows("transactions", ["created_at"])
    lines = (
        raw_load.collapse_lines(in_windows("lines", ["created_at"])) if "lines" in source
        else raw_load.transaction_items_raw(sales)
    )
    return {
        "transactions_raw": raw_load.transactions_raw(sales),
        "transaction_items_raw": lines,
        "inventory_snapshot_raw": raw_load.inventory_snapshot_raw(in_windows("products", ["updated_at"]), captured),
        "customers_raw": raw_load.customers_raw(in_windows("customers", ["updated_at"]), captured),
        "alerts_raw": raw_load.alerts_raw(in_windows("alerts", list(raw_load.ALERT_INSTANTS)), captured),
    }


def load_store_windows(warehouse: Warehouse, source: dict[str, DataFrame], windows: DataFrame) -> dict[str, Written]:
    """The five raw tables, in one version."""
    return warehouse.upsert_all(shape_store_windows(source, windows))


def read_counts(source: dict[str, DataFrame], windows: DataFrame) -> DataFrame:
    """(store_id, rows) of source records that changed in the stores' windows. Lines are part of their sale. Only the
    store and the change times are read."""
    within = envelope(windows)
    changes = {"transactions": ["created_at"], "products": ["updated_at"], "customers": ["updated_at"], "alerts": list(raw_load.ALERT_INSTANTS)}
    frames = [changed_in_store_windows(source[name], windows, on=on, within=within).select("store_id") for name, on in changes.items()]
    return reduce(DataFrame.unionByName, frames).groupBy("store_id").agg(F.count(F.lit(1)).alias("rows"))


def run_sync(warehouse: Warehouse, source: dict[str, DataFrame], *, as_of) -> dict[str, Written]:
    """Load every idle store's next window and write the runs to the ledger. A failed load leaves
    FAILED runs and dead letters behind and moves no window."""
    runs = warehouse.read("pipeline_runs")
    windows = ledger.next_windows(source["stores"], runs, as_of=as_of)
    queued = ledger.queued_runs(windows, ledger.SYNC, as_of=as_of)
    warehouse.upsert("pipeline_runs", queued)
    mine = warehouse.read("pipeline_runs").where(
        (F.col("status") == "QUEUED") & (F.col("run_type") == ledger.SYNC) & (F.col("started_at") == instant(as_of)))
    warehouse.upsert("pipeline_runs", ledger.running(mine, attempt=1))
    mine = warehouse.read("pipeline_runs").where(
        (F.col("status") == "RUNNING") & (F.col("run_type") == ledger.SYNC) & (F.col("started_at") == instant(as_of)))
    try:
        written = load_store_windows(warehouse, source, mine)
    except Exception as error:
        close_failed(warehouse, mine, stage="RAW_LOAD", error=error, as_of=as_of)
        raise
    per_store = reduce(DataFrame.unionByName, [w.per_store for w in written.values()])
    totals = per_store.groupBy("store_id").agg(F.sum("rows").alias("records_written"))
    found = read_counts(source, mine).withColumnRenamed("rows", "records_read")
    counts = mine.select("store_id", "pipeline_run_id").join(totals, "store_id", "left").join(found, "store_id", "left").select(
        "pipeline_run_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("records_read", "records_written")])
    warehouse.upsert("pipeline_runs", ledger.succeeded(mine, counts, as_of=as_of))
    return written


def close_failed(warehouse: Warehouse, runs: DataFrame, *, stage: str, error: Exception, as_of) -> None:
    errors = runs.select("pipeline_run_id", F.col("attempt_count"), F.lit(stage).alias("failure_stage"),
                         F.lit(str(error)[: ledger.ERROR_LENGTH]).alias("error_message"))
    closed = ledger.failed(runs, errors, as_of=as_of)
    warehouse.append("pipeline_failures", ledger.dead_letters(closed, source_module="Billing", as_of=as_of))
    warehouse.upsert("pipeline_runs", closed)


def _since(warehouse: Warehouse, windows: DataFrame) -> dict:
    """What the loads of these windows touched. Captures bear their window's end as time."""
    bounds = envelope(windows)
    return {"touched": refresh.touched_days(warehouse, windows), "customers_since": bounds and bounds[0]}


def run_transform(warehouse: Warehouse, stores: DataFrame, *, as_of) -> bool:
    """Refresh the marts if any store has a newer sync than mart; returns whether it ran."""
    # Written down: the ledger it is read from changes below.
    due = settle(ledger.stores_to_transform(stores, warehouse.read("pipeline_runs"), as_of=as_of), "due")
    if due.isEmpty():
        return False
    windows = due.withColumnsRenamed({"source_window_start": "checkpoint_start", "source_window_end": "checkpoint_end"})
    warehouse.upsert("pipeline_runs", ledger.queued_runs(windows, ledger.MART, as_of=as_of))
    mine = settle(warehouse.read("pipeline_runs").where(
        (F.col("status") == "QUEUED") & (F.col("run_type") == ledger.MART) & (F.col("started_at") == instant(as_of))), "mart-runs")
    zero = F.lit(0).cast("bigint")
    try:
        # The marts, their freshness, the runs' success and the work that follows appear together.
        with warehouse.transaction():
            refresh.refresh_marts(warehouse, as_of=as_of, run_id=f"mart-{as_of}", stamps=mine, **_since(warehouse, windows))
            counts = mine.select("pipeline_run_id", zero.alias("records_read"), zero.alias("records_written"))
            warehouse.upsert("pipeline_runs", ledger.succeeded(mine, counts, as_of=as_of))
            jobs.follow_marts(warehouse, mine, as_of=as_of)
    except Exception as error:
        close_failed(warehouse, mine, stage="MART_REFRESH", error=error, as_of=as_of)
        raise
    return True


def run_repair(warehouse: Warehouse, source: dict[str, DataFrame], *, as_of) -> dict[str, int]:
    """Load the windows of the open failures again and refresh the marts; the failures become
    RECOVERED, or OPEN again if that failed."""
    failures = warehouse.read("pipeline_failures")
    picked = ledger.replay_windows(failures, warehouse.read("pipeline_runs"), source["stores"], as_of=as_of)
    warehouse.upsert("pipeline_failures", ledger.reprocessing(failures, picked))
    replayed = warehouse.read("pipeline_failures").where("dead_letter_status = 'REPROCESSING'")
    number = replayed.count()
    if number == 0:
        return {"recovered": 0, "failed": 0}
    opened = replayed.withColumn("dead_letter_status", F.lit("OPEN"))
    windows = ledger.replay_windows(opened, warehouse.read("pipeline_runs"), source["stores"], as_of=as_of)
    try:
        replays = settle(ledger.replay_envelopes(windows), "replays")
        load_store_windows(warehouse, source, replays)
        named = replayed.groupBy("store_id").agg(F.max("pipeline_run_id").alias("pipeline_run_id"))
        stamps = settle(replays.join(named, "store_id"), "repair-stamps")
        refresh.refresh_marts(warehouse, as_of=as_of, run_id=f"repair-{as_of}", stamps=stamps, **_since(warehouse, replays))
        ok, why = True, None
    except Exception as error:  # noqa: BLE001 - the failures go back to OPEN, with the new error
        ok, why = False, str(error)[: ledger.ERROR_LENGTH]
    if why is not None:
        replayed = settle(replayed.withColumn("error_message", F.lit(why)), "replayed")
    outcomes = replayed.select("failure_id", F.lit(ok).alias("ok"))
    warehouse.upsert("pipeline_failures", ledger.after_replay(replayed, outcomes, as_of=as_of))
    return {"recovered": number if ok else 0, "failed": 0 if ok else number}
