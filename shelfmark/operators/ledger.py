"""The pipeline's own tables: runs, windows, failures, replays, freshness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from shelfmark.functions.coerce import utc_timestamp
from shelfmark.functions.timing import days_before, instant
from shelfmark.operators.ranking import newest_per, top_per

# Fixed values.
LOOKBACK_DAYS = 30
REPAIR_BATCH = 20
ERROR_LENGTH = 1000
ACTIVE_STATUSES = ("QUEUED", "RUNNING")
SYNC, MART, REPAIR = "INCREMENTAL_SYNC", "MART_REFRESH", "REPAIR"


def current_runs(events: DataFrame) -> DataFrame:
    """Runs are written as status events and never updated: the newest event of a run is its state.
    ``recorded_at`` and ``seq`` order the events of a run."""
    return newest_per(events, ["pipeline_run_id"], [F.desc("recorded_at"), F.desc("seq")])


def latest_success(runs: DataFrame, run_type: str | None = None) -> DataFrame:
    """The run that finished last among the succeeded ones, per store."""
    done = runs.where(F.col("status") == "SUCCEEDED")
    if run_type is not None:
        done = done.where(F.col("run_type") == run_type)
    return newest_per(done, ["store_id"], [F.desc("finished_at"), F.desc("pipeline_run_id")])


def idle_stores(stores: DataFrame, runs: DataFrame) -> DataFrame:
    """Stores without a queued or running run."""
    busy = runs.where(F.col("status").isin(*ACTIVE_STATUSES)).select("store_id")
    return stores.select("store_id").join(busy, "store_id", "left_anti")


def next_windows(stores: DataFrame, runs: DataFrame, *, as_of) -> DataFrame:
    """The window each idle store loads next: from the end of its last successful sync, or 30 days back, to ``as_of``."""
    last = latest_success(runs, SYNC).select("store_id", F.col("checkpoint_end").alias("_end"))
    return idle_stores(stores, runs).join(last, "store_id", "left").select(
        "store_id", F.coalesce("_end", days_before(as_of, LOOKBACK_DAYS)).alias("checkpoint_start"),
        instant(as_of).alias("checkpoint_end"),
    )


def stores_to_transform(stores: DataFrame, runs: DataFrame, *, as_of) -> DataFrame:
    """Stores with succeeded syncs that end later than their last mart refresh, with the window from the
    first start to the last end of these syncs."""
    sync = runs.where((F.col("status") == "SUCCEEDED") & (F.col("run_type") == SYNC)).select("store_id", "checkpoint_start", "checkpoint_end")
    mart = latest_success(runs, MART).select("store_id", F.col("checkpoint_end").alias("_done"))
    return (
        stores.select("store_id").join(sync, "store_id").join(mart, "store_id", "left")
        .where(F.col("checkpoint_end").isNotNull() & (F.col("_done").isNull() | (F.col("_done") < F.col("checkpoint_end"))))
        .groupBy("store_id").agg(F.min(F.coalesce("checkpoint_start", instant(as_of))).alias("source_window_start"),
                                 F.max("checkpoint_end").alias("source_window_end"))
    )


# --- run and failure rows ----------------------------------------------------------------------


def _id(prefix: str, *parts: Column) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256), 1, 12))


def queued_runs(windows: DataFrame, run_type: str, *, as_of) -> DataFrame:
    """One QUEUED run per window row (store_id, checkpoint_start, checkpoint_end)."""
    if run_type not in (SYNC, MART, REPAIR):
        raise ValueError(f"unknown run type {run_type!r}")
    none, zero = F.lit(None), F.lit(0).cast("bigint")
    return windows.select(
        _id("pipe_run_", F.col("store_id"), F.lit(run_type), F.unix_micros("checkpoint_start"),
            F.unix_micros("checkpoint_end"), F.unix_micros(instant(as_of))).alias("pipeline_run_id"),
        "store_id", F.lit(run_type).alias("run_type"), F.lit("QUEUED").alias("status"), F.lit(0).alias("attempt_count"),
        "checkpoint_start", "checkpoint_end", zero.alias("records_read"), zero.alias("records_written"),
        none.cast("string").alias("failure_stage"), none.cast("string").alias("error_message"),
        instant(as_of).alias("started_at"), none.cast("timestamp").alias("finished_at"),
    )


def running(runs: DataFrame, *, attempt: int) -> DataFrame:
    return runs.withColumn("status", F.lit("RUNNING")).withColumn("attempt_count", F.lit(attempt))


def succeeded(runs: DataFrame, counts: DataFrame, *, as_of) -> DataFrame:
    """``counts``: pipeline_run_id, records_read, records_written."""
    return runs.drop("records_read", "records_written").join(counts, "pipeline_run_id").withColumns({
        "status": F.lit("SUCCEEDED"), "finished_at": instant(as_of),
        "failure_stage": F.lit(None).cast("string"), "error_message": F.lit(None).cast("string"),
    }).select(*runs.columns)


def failed(runs: DataFrame, errors: DataFrame, *, as_of) -> DataFrame:
    """``errors``: pipeline_run_id, attempt_count, failure_stage, error_message. The window is not advanced."""
    dropped = runs.drop("attempt_count", "failure_stage", "error_message")
    return dropped.join(errors, "pipeline_run_id").withColumns({
        "status": F.lit("FAILED"), "finished_at": instant(as_of), "error_message": F.substring("error_message", 1, ERROR_LENGTH),
    }).select(*runs.columns)


def iso_window(start: Column, end: Column) -> Column:
    iso = lambda c: F.concat(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))
    return F.concat_ws("/", iso(start), iso(end))


def dead_letters(failed_runs: DataFrame, *, source_module: str, as_of) -> DataFrame:
    """A failure row per exhausted run, with the window to replay."""
    return failed_runs.where("status = 'FAILED'").select(
        _id("pf_", F.col("pipeline_run_id"), F.col("failure_stage"), F.unix_micros(instant(as_of))).alias("failure_id"),
        "pipeline_run_id", "store_id", F.lit(source_module).alias("source_module"),
        iso_window(F.col("checkpoint_start"), F.col("checkpoint_end")).alias("batch_ref"),
        F.col("attempt_count").alias("retry_count"), "failure_stage", F.lit("OPEN").alias("dead_letter_status"),
        F.substring("error_message", 1, ERROR_LENGTH).alias("error_message"), instant(as_of).alias("created_at"),
        F.lit(None).cast("timestamp").alias("recovered_at"),
    )


def open_failures(failures: DataFrame, *, limit: int = 50) -> DataFrame:
    """Newest first, per store."""
    rows = failures.where(F.col("dead_letter_status") == "OPEN")
    return top_per(rows, ["store_id"], [F.desc("created_at"), F.asc("failure_id")], limit, rank="rank")


def replay_windows(failures: DataFrame, runs: DataFrame, stores: DataFrame, *, as_of, limit: int = REPAIR_BATCH) -> DataFrame:
    """The windows to load again: the one in a failure's ``batch_ref``, or the store's next window where
    that does not parse. The failures keep their id for the outcome."""
    parts = F.split("batch_ref", "/", 2)
    start, end = utc_timestamp(F.get(parts, F.lit(0))), utc_timestamp(F.get(parts, F.lit(1)))
    both = start.isNotNull() & end.isNotNull()
    last = latest_success(runs, SYNC).select("store_id", F.col("checkpoint_end").alias("_end"))
    fallback = F.coalesce("_end", days_before(as_of, LOOKBACK_DAYS))
    picked = open_failures(failures, limit=limit).join(stores.select("store_id"), "store_id", "left_semi")
    return picked.join(last, "store_id", "left").select(
        "failure_id", "store_id", F.when(both, start).otherwise(fallback).alias("checkpoint_start"),
        F.when(both, end).otherwise(instant(as_of)).alias("checkpoint_end"), both.alias("from_reference"),
    )


def replay_envelopes(windows: DataFrame) -> DataFrame:
    """One window per store that covers all its replays. The load is idempotent, so rows between two
    replayed windows are simply written again as they are."""
    return windows.groupBy("store_id").agg(
        F.min("checkpoint_start").alias("checkpoint_start"), F.max("checkpoint_end").alias("checkpoint_end"))


def reprocessing(failures: DataFrame, picked: DataFrame) -> DataFrame:
    return failures.join(picked.select("failure_id"), "failure_id", "left_semi").withColumn(
        "dead_letter_status", F.lit("REPROCESSING")).select(*failures.columns)


def after_replay(failures: DataFrame, outcomes: DataFrame, *, as_of) -> DataFrame:
    """Changed failure rows: RECOVERED, or OPEN again. ``outcomes``: failure_id, ok."""
    return failures.join(outcomes, "failure_id").withColumns({
        "dead_letter_status": F.when(F.col("ok"), F.lit("RECOVERED")).otherwise(F.lit("OPEN")),
        "recovered_at": F.when(F.col("ok"), instant(as_of)).otherwise(F.col("recovered_at")),
    }).select(*failures.columns)
