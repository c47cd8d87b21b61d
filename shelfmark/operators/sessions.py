"""Chat sessions and their messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from shelfmark.operators.ranking import top_per


def session_history(messages: DataFrame, *, limit: int = 50, latest: bool = False, sessions: DataFrame | None = None,
                    tie: str = "message_id") -> DataFrame:
    """The first ``limit`` messages of every session, oldest first; ``latest`` takes the last ones instead.
    ``sessions`` (chat_session_id, store_id) drops messages whose store is not their session's."""
    if sessions is not None:
        messages = messages.join(sessions.select("chat_session_id", "store_id"), ["chat_session_id", "store_id"], "left_semi")
    order = [F.desc("created_at"), F.desc(tie)] if latest else [F.asc("created_at"), F.asc(tie)]
    return top_per(messages, ["store_id", "chat_session_id"], order, limit, rank="position")


def touched_sessions(messages: DataFrame, stored: DataFrame) -> DataFrame:
    """Session rows after new messages: the first creation time stays, the last query time moves on."""
    seen = messages.groupBy("chat_session_id", "store_id", "user_id").agg(
        F.min("created_at").alias("_first"), F.max("created_at").alias("_last"))
    return seen.join(stored.select("chat_session_id", F.col("created_at").alias("_kept")), "chat_session_id", "left").select(
        "chat_session_id", "store_id", "user_id", F.coalesce("_kept", "_first").alias("created_at"), F.col("_last").alias("last_query_at"))
