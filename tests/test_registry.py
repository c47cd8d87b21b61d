"""Registered queries: all run, agree with their SQL, and do not depend on the number of partitions."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check_queries import TABLES, canonical

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, sf, name):
    df = QUERIES[name](spark, sf)
    rows = [tuple(r) for r in df.collect()]
    if name not in ORACLES:
        assert rows
        return
    result = duck.execute(ORACLES[name])
    columns = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(columns)
    assert canonical(df.columns, rows) == canonical(columns, result.fetchall())


@pytest.mark.parametrize("name", ["sales_daily", "inventory_health", "reconcile_alerts", "product_performance", "vector_topk", "stock_fold", "bill_batch", "lexical_top"])
def test_same_for_any_number_of_partitions(spark, sf, name):
    seen = []
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for partitions in ("1", "17"):
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            df = QUERIES[name](spark, sf)
            seen.append(canonical(df.columns, [tuple(r) for r in df.collect()]))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert seen[0] == seen[1]
