"""Nested sales collapse; plans stay free of what would not scale."""

from __future__ import annotations

import datetime as dt
import random
from decimal import Decimal

import pytest

import __spark_entry__ as entry
from shelfmark.plans import raw_load
from tools.check_plans import signs_of

LINE = "struct<product_id:string,product_name:string,quantity:bigint,unit_price:decimal(18,2),line_total:decimal(18,2)>"


def test_collapse_of_nested_sales(spark):
    rng = random.Random(1)
    maybe = lambda v: v if rng.random() < 0.7 else None
    rows = [(f"t{n}", "s", dt.datetime(2025, 1, 1), [
        (rng.choice(["a", "b", "c", "", None]), maybe(f"n{rng.randint(0, 3)}"), maybe(rng.randint(1, 5)), maybe(Decimal(rng.randint(1, 9))),
         maybe(Decimal(rng.randint(1, 999)) / 100)) for _ in range(rng.choice([0, 3, 12, 900]))]) for n in range(60)] + [("none", "s", dt.datetime(2025, 1, 1), None)]
    sales = spark.createDataFrame(rows, f"transaction_id string, store_id string, sale_timestamp timestamp, items array<{LINE}>")
    want = {}
    for sale, _, _, lines in rows:
        for product, name, quantity, price, total in lines or []:
            if product:
                row = want.setdefault((sale, product), [None, 0, None, Decimal(0)])
                row[0] = row[0] if row[0] is not None else name
                row[1] += quantity or 0
                row[2] = row[2] if row[2] is not None else price
                row[3] += total or 0
    got = {(r.transaction_id, r.product_id): [r.product_name, r.quantity, r.unit_price, r.line_total] for r in raw_load.transaction_items_raw(sales).collect()}
    assert got == want


@pytest.mark.parametrize("name", ["dashboard_summary", "reconcile_alerts", "lexical_top", "vector_topk", "product_snapshot", "transactions_page",
                                  "customer_latest", "alert_lifecycle", "duplicate_phones", "next_window"])
def test_no_nested_loops_and_ranked_windows_are_cut_early(spark, sf, name):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        signs = signs_of(entry.queries()[name](spark, sf))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert signs["nested loop"] == 0
    # Each ranking window has a limit before and after its shuffle; a page adds one window over the page itself.
    assert signs["group limits"] >= 2 * (signs["windows"] - (1 if name.endswith("_page") else 0))


def test_filters_reach_the_scan(spark, tmp_path):
    from shelfmark.operators import alert_rules
    from shelfmark.plans import reads
    from shelfmark.sources.windows import changed_between

    path = str(tmp_path / "sales")
    schema = "store_id string, transaction_id string, product_id string, quantity bigint, status string, total_amount decimal(18,2), sale_timestamp timestamp, note string"
    spark.createDataFrame([], schema).write.parquet(path)
    sales = spark.read.schema(schema).parquet(path)
    start, end = dt.datetime(2025, 1, 1), dt.datetime(2025, 1, 4)
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    from shelfmark.functions.timing import instant
    for df in (changed_between(sales, start, end, on="sale_timestamp", store_id="s").select("transaction_id"),
               alert_rules.units_sold(sales, start=instant(start), end=instant(end)),
               reads.live_sales_trend(sales, as_of=end, days=3)):
        scan = next(line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan" in line)
        assert "GreaterThanOrEqual(sale_timestamp" in scan and "note" not in scan.split("ReadSchema")[1]
