from __future__ import annotations

import datetime as dt
from decimal import Decimal

import pytest

from shelfmark.operators import customers, listings, ranking

NOW = dt.datetime(2025, 1, 1)


def test_ids_in_asked_order_within_the_store(spark):
    rows = spark.createDataFrame([(s, f"p{n}") for s in ("s", "t") for n in range(30)], "store_id string, product_id string")
    got = listings.by_ids(rows, "product_id", ["p9", "p3", "p9", "zz", "p1"], "s").collect()
    assert [(r.store_id, r.product_id) for r in got] == [("s", "p9"), ("s", "p3"), ("s", "p1")]
    assert listings.by_ids(rows, "product_id", [f"p{n}" for n in range(30)], "s", most=20).count() == 20
    assert listings.by_ids(rows, "product_id", [], "s").count() == 0
    assert listings.by_id(rows, "product_id", "p1", "u").count() == 0
    assert listings.distinct_stores(rows).count() == 2


def test_pages(spark):
    rows = spark.createDataFrame([("s", f"p{n:02d}", n, 5, None) for n in range(7)],
                                 "store_id string, product_id string, quantity_on_hand int, reorder_threshold int, expiry_date timestamp")
    page = lambda **kw: [(r.product_id, r.next_page_token) for r in listings.product_pages(rows, **kw).orderBy("position").collect()]
    assert page(limit=3) == [("p00", "3"), ("p01", "3"), ("p02", "3")]
    assert page(limit=3, offset=6) == [("p06", None)] and page(limit=3, offset=7) == []
    assert len(page(low_stock_only=True)) == 6 and page(expiry_before=NOW) == []
    assert ranking.page_token(None) == 0 and ranking.page_token("12") == 12
    with pytest.raises(ValueError):
        ranking.page_token("x")


def test_transactions_in_a_closed_range_newest_first(spark):
    rows = spark.createDataFrame([("s", f"t{n}", "c", Decimal(n), NOW + dt.timedelta(days=n), "COMPLETED") for n in range(4)],
                                 "store_id string, transaction_id string, customer_id string, total_amount decimal(18,2), sale_timestamp timestamp, status string")
    got = listings.transaction_pages(rows, start="2025-01-02", end="2025-01-03", customer_id="c").orderBy("position").collect()
    assert [r.transaction_id for r in got] == ["t2", "t1"]
    with pytest.raises(ValueError):
        listings.filter_transactions(rows, start="2025-02-01", end="2025-01-01")


def test_new_customers_need_a_free_phone(spark):
    schema = "customer_id string, store_id string, name string, phone string, requested_at timestamp"
    later = NOW + dt.timedelta(minutes=1)
    requests = spark.createDataFrame([("1", "s", "A", "11", NOW), ("2", "s", "B", "11", later), ("3", "s", "C", "22", NOW), ("4", "t", "D", "22", NOW),
                                      ("5", "s", None, "33", NOW)], schema)
    existing = spark.createDataFrame([("s", "22")], "store_id string, phone string")
    out = customers.create_customers(requests, existing, as_of=NOW)
    assert sorted((r.customer_id, r.total_spend, r.visit_count) for r in out.created.collect()) == [("1", 0, 0), ("4", 0, 0)]
    assert {r.customer_id: r.reason for r in out.rejected.collect()} == {"2": "PHONE_REPEATED", "3": "PHONE_EXISTS", "5": "name: required"}
