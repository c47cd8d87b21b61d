"""Registered queries and their SQL checks. Importing a module of this package registers its queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def add(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = function
        if oracle is not None:
            ORACLES[name] = oracle
        return function

    return add


def load_all() -> None:
    from shelfmark.registry import alert_queries, job_queries, ledger_queries, load_queries, mart_queries, retrieval_queries, stream_queries, trade_queries  # noqa: F401
