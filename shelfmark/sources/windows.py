"""Change capture by time window."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from shelfmark.functions.timing import instant


def changed_between(df: DataFrame, since, until, *, on: str = "updated_at", store_id: str | None = None) -> DataFrame:
    """Rows whose ``on`` lies in [since, until). A range on the raw column, so the scan can skip row groups."""
    if store_id is not None:
        df = df.where(F.col("store_id") == store_id)
    return df.where((F.col(on) >= instant(since)) & (F.col(on) < instant(until)))


def any_changed_between(df: DataFrame, since, until, *, on: Sequence[str], store_id: str | None = None) -> DataFrame:
    """Rows with any of the ``on`` instants in [since, until): one scan in place of a union of
    one scan per column; a NULL instant never matches, and no row comes twice."""
    if store_id is not None:
        df = df.where(F.col("store_id") == store_id)
    hits = [(F.col(c) >= instant(since)) & (F.col(c) < instant(until)) for c in on]
    return df.where(reduce(lambda a, b: a | b, hits))


def envelope(windows: DataFrame) -> tuple | None:
    """(earliest start, latest end) of all windows; None without any."""
    row = windows.agg(F.min("checkpoint_start"), F.max("checkpoint_end")).first()
    return None if row[0] is None else (row[0], row[1])


def changed_in_store_windows(df: DataFrame, windows: DataFrame, *, on: Sequence[str], within: tuple | None = None) -> DataFrame:
    """Rows that changed in their own store's window (store_id, checkpoint_start, checkpoint_end).

    Joined on store_id; every store has one window, so a row matches at most once. ``within`` is the
    windows' :func:`envelope`: as literals it reaches the scan, so that only rows that may matter
    are joined at all.
    """
    if within is not None:
        df = any_changed_between(df, *within, on=on)
    start, end = F.col("checkpoint_start"), F.col("checkpoint_end")
    hits = reduce(lambda a, b: a | b, [(F.col(c) >= start) & (F.col(c) < end) for c in on])
    bounded = windows.select("store_id", "checkpoint_start", "checkpoint_end")
    return df.join(bounded, "store_id").where(hits)
