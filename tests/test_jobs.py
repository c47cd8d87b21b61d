"""Jobs that write: sales, stock, alerts, chat, and the tasks they leave."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from shelfmark import schemas
from shelfmark.plans import jobs, raw_load, repair
from shelfmark.sources.tables import Warehouse
from shelfmark.sources.versions import Versions
from test_tables import T0, source  # noqa: F401

NOW = T0 + dt.timedelta(hours=12)
PRODUCT = "store_id string, product_id string, name string, category string, price decimal(18,2), quantity_on_hand bigint, reorder_threshold bigint, expiry_date timestamp, status string"


@pytest.fixture
def shop(spark, tmp_path):
    warehouse = Warehouse(spark, str(tmp_path))
    warehouse.upsert("products", spark.createDataFrame([
        ("s", "a", "Milk", "Dairy", Decimal("2.00"), 10, 4, None, "ACTIVE"), ("s", "b", "Bread", "Bakery", Decimal("1.00"), 50, 4, T0 + dt.timedelta(days=2), "ACTIVE"),
        ("s", "c", "Salt", "Spice", Decimal("1.00"), 1, 4, None, "ACTIVE")], PRODUCT))
    warehouse.upsert("customers", spark.createDataFrame([("c1", "s", "Ann", Decimal("5.00"), 1)], "customer_id string, store_id string, name string, total_spend decimal(18,2), visit_count bigint"))
    return warehouse


def request(spark, *rows):
    return spark.createDataFrame([("s", key, customer, "cash", NOW + dt.timedelta(minutes=seq), seq, lines) for key, customer, seq, lines in rows], schemas.ENTITIES["sale_requests"])


def alerts_of(warehouse):
    return sorted((r.condition_key, r.status, r.severity) for r in warehouse.read("alerts").collect())


def test_a_sale_is_written_once_and_its_alerts_follow(spark, shop):
    batch = request(spark, ("k1", "c1", 1, [("a", 7)]), ("k2", None, 2, [("a", 9)]), ("k3", None, 3, [("b", 1)]))
    for turn in range(2):
        outcomes = {r.idempotency_key: r.outcome for r in jobs.sell(shop, batch, as_of=NOW).collect()}
        assert outcomes == ({"k1": "ACCEPTED", "k2": "REJECTED", "k3": "ACCEPTED"} if turn == 0 else {"k1": "REPLAY", "k2": "REJECTED", "k3": "REPLAY"})
        assert {r.product_id: r.quantity_on_hand for r in shop.read("products").collect()} == {"a": 3, "b": 49, "c": 1}
        assert {r.product_id: r.name for r in shop.read("products").collect()}["a"] == "Milk"
        assert shop.read("transactions").count() == 2 and shop.read("stock_adjustments").count() == 2
        customer = shop.read("customers").first()
        assert (customer.total_spend, customer.visit_count, customer.name) == (Decimal("19.00"), 2, "Ann")
    assert alerts_of(shop) == []
    assert jobs.run_followups(shop, jobs.handlers(as_of=NOW), as_of=NOW) == {jobs.AFTER_SALE: "DONE"}
    # Only products that were sold are looked at, and only for low stock.
    assert alerts_of(shop) == [("LOW_STOCK_a", "ACTIVE", "HIGH")] and shop.read("alert_events").count() == 1
    assert jobs.run_followups(shop, jobs.handlers(as_of=NOW), as_of=NOW) == {}
    assert {(r.status, r.attempt_count) for r in shop.read("followups").collect()} == {("DONE", 1)}


def test_a_lost_sale_leaves_nothing(spark, shop, monkeypatch):
    with monkeypatch.context() as patch:
        patch.setattr(Versions, "write", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            jobs.sell(shop, request(spark, ("k1", "c1", 1, [("a", 7)])), as_of=NOW)
    assert {r.product_id: r.quantity_on_hand for r in shop.read("products").collect()}["a"] == 10
    assert not any(shop.exists(n) for n in ("transactions", "stock_adjustments", "idempotency", "followups"))


def test_stock_changes_alerts_commands_and_sweeps(spark, shop):
    rows = spark.createDataFrame([("j1", "s", "b", "REMOVE", 48, "r", None, "u", NOW), ("j2", "s", "a", "REMOVE", 99, "r", None, "u", NOW), ("j3", "s", "x", "ADD", 1, "r", None, "u", NOW)],
                                 schemas.ENTITIES["stock_adjustments"])
    first = {r.adjustment_id: (r.accepted, r.refusal) for r in jobs.change_stock(shop, rows, as_of=NOW).collect()}
    assert first == {"j1": (True, None), "j2": (False, "NEGATIVE_STOCK"), "j3": (False, "PRODUCT_NOT_FOUND")}
    assert {r.adjustment_id for r in jobs.change_stock(shop, rows, as_of=NOW).collect()} == {"j2", "j3"}  # j1 is known
    assert {r.product_id: r.quantity_on_hand for r in shop.read("products").collect()} == {"a": 10, "b": 2, "c": 1}
    jobs.run_followups(shop, jobs.handlers(as_of=NOW), as_of=NOW)
    assert alerts_of(shop) == [("EXPIRY_SOON_b", "ACTIVE", "MEDIUM"), ("LOW_STOCK_b", "ACTIVE", "HIGH")]
    low = shop.read("alerts").where("condition_key = 'LOW_STOCK_b'").first().alert_id
    commands = spark.createDataFrame([("m1", low, "s", "ACKNOWLEDGE", "u", None, NOW), ("m2", low, "elsewhere", "RESOLVE", "u", None, NOW)],
                                     "command_id string, alert_id string, store_id string, command string, user_id string, note string, requested_at timestamp")
    assert {r.command_id: r.accepted for r in jobs.command_alerts(shop, commands).collect()} == {"m1": True, "m2": False}
    jobs.sweep_alerts(shop, ("LOW_STOCK", "EXPIRY_SOON", "NOT_SELLING", "HIGH_DEMAND"), as_of=NOW)
    assert ("LOW_STOCK_b", "ACKNOWLEDGED", "HIGH") in alerts_of(shop) and ("LOW_STOCK_c", "ACTIVE", "HIGH") in alerts_of(shop)
    assert len([k for k, *_ in alerts_of(shop) if k.startswith("NOT_SELLING")]) == 3
    events = shop.read("alert_events").count()
    jobs.sweep_alerts(shop, ("LOW_STOCK",), as_of=NOW)
    assert shop.read("alert_events").count() == events


def test_new_and_patched_products(spark, shop):
    new = spark.createDataFrame([("n1", "s", "Tea", "Drinks", 2.0, 1, 5, None, None), ("n2", "s", "", "Drinks", 2.0, 1, 5, None, None)],
                                "product_id string, store_id string, name string, category string, price double, quantity bigint, reorder_threshold bigint, expiry_date timestamp, status string")
    assert [r.product_id for r in jobs.add_products(shop, new, as_of=NOW).collect()] == ["n2"]
    patch = spark.createDataFrame([("s", "n1", None, None, None, 0, None, None, False), ("s", "zz", "Z", None, None, None, None, None, False)],
                                  "store_id string, product_id string, name string, category string, price decimal(18,2), reorder_threshold bigint, status string, expiry_date timestamp, expiry_given boolean")
    jobs.run_followups(shop, jobs.handlers(as_of=NOW), as_of=NOW)
    assert alerts_of(shop) == [("LOW_STOCK_n1", "ACTIVE", "HIGH")]
    later = NOW + dt.timedelta(hours=1)
    assert [r.product_id for r in jobs.patch_products(shop, patch, as_of=later).collect()] == ["zz"]
    jobs.run_followups(shop, jobs.handlers(as_of=later), as_of=later)
    assert alerts_of(shop) == [("LOW_STOCK_n1", "RESOLVED", "HIGH")]


def test_a_failing_embedder_fails_neither_marts_nor_sweep(spark, source, tmp_path):  # noqa: F811
    warehouse = Warehouse(spark, str(tmp_path))
    as_of = T0 + dt.timedelta(days=2, hours=1)
    warehouse.upsert("products", source["products"])
    repair.run_sync(warehouse, source, as_of=as_of)
    # Lines are read with their sale and are rows of their own once written.
    assert {r.store_id: (r.records_read, r.records_written) for r in warehouse.read("pipeline_runs").collect()} == {"s1": (6, 9), "s2": (2, 3)}
    assert repair.run_transform(warehouse, source["stores"], as_of=as_of)
    runs = {(r.run_type, r.status) for r in warehouse.read("pipeline_runs").collect()}
    assert runs == {("INCREMENTAL_SYNC", "SUCCEEDED"), ("MART_REFRESH", "SUCCEEDED")}
    broken = jobs.handlers(as_of=as_of, vectorise=lambda text: F.raise_error(F.lit("no model")).cast("array<double>"))
    assert jobs.run_followups(warehouse, broken, as_of=as_of) == {jobs.SWEEP: "DONE", jobs.EMBED: "OPEN"}
    tasks = {(r.kind, r.status, r.attempt_count): r.error_message for r in warehouse.read("followups").collect()}
    assert set(tasks) == {(jobs.SWEEP, "DONE", 1), (jobs.EMBED, "OPEN", 1)} and "no model" in tasks[jobs.EMBED, "OPEN", 1]
    assert {(r.run_type, r.status) for r in warehouse.read("pipeline_runs").collect()} == runs and warehouse.read("product_embeddings").count() == 0
    assert alerts_of(warehouse)
    works = jobs.handlers(as_of=as_of, vectorise=lambda text: F.array(F.char_length(text).cast("double")))
    assert jobs.run_followups(warehouse, works, as_of=as_of) == {jobs.EMBED: "DONE"}
    assert warehouse.read("product_embeddings").count() == 2
    made = {r.product_id: r.embedded_at for r in warehouse.read("product_embeddings").collect()}
    # Only products whose text has changed are embedded again.
    warehouse.upsert("products", spark.createDataFrame([("s1", "a", "Apple")], "store_id string, product_id string, name string"))
    later = as_of + dt.timedelta(days=1)
    jobs.follow_marts(warehouse, source["stores"], as_of=later)
    jobs.run_followups(warehouse, {jobs.EMBED: jobs.handlers(as_of=later, vectorise=lambda text: F.array(F.lit(1.0)))[jobs.EMBED]}, as_of=later)
    assert {r.product_id: r.embedded_at for r in warehouse.read("product_embeddings").collect()} == {"a": later, "c": made["c"]}


def test_messages_move_their_session_on(spark, tmp_path):
    warehouse = Warehouse(spark, str(tmp_path))
    rows = lambda *r: spark.createDataFrame([("x", m, "s", "u", "user", "hi", NOW + dt.timedelta(minutes=k)) for m, k in r],
                                            "chat_session_id string, message_id string, store_id string, user_id string, role string, text string, created_at timestamp")
    jobs.say(warehouse, rows(("m1", 0), ("m2", 1)))
    jobs.say(warehouse, rows(("m3", 5)))
    session = warehouse.read("chat_sessions").collect()
    assert [(r.created_at, r.last_query_at, r.user_id) for r in session] == [(NOW, NOW + dt.timedelta(minutes=5), "u")]
    assert warehouse.read("messages").count() == 3


def test_raw_load_is_one_version(spark, source, tmp_path):  # noqa: F811
    warehouse = Warehouse(spark, str(tmp_path))
    broken = {**source, "customers": source["customers"].withColumn("name", F.raise_error(F.lit("no disk")).cast("string"))}
    with pytest.raises(Exception):
        raw_load.load_window(warehouse, broken, T0, T0 + dt.timedelta(days=3))
    assert not warehouse.exists("transactions_raw") and warehouse.versions.all() == []
    raw_load.load_window(warehouse, source, T0, T0 + dt.timedelta(days=3))
    assert warehouse.versions.all() == [1] and warehouse.read("transactions_raw").count() == 3


def test_a_batch_of_sales_writes_its_tables_at_the_same_time(spark, shop, monkeypatch):
    together, real = [], Warehouse.upsert_all
    monkeypatch.setattr(Warehouse, "upsert_all", lambda self, frames, **k: (together.append(set(frames)), real(self, frames, **k))[1])
    jobs.sell(shop, request(spark, ("k1", "c1", 1, [("a", 7)])), as_of=NOW)
    jobs.run_followups(shop, jobs.handlers(as_of=NOW), as_of=NOW)
    assert together == [{"transactions", "demand_days", "stock_adjustments", "products", "customers", "idempotency", "followups"}, {"alerts", "alert_events"}]
    assert alerts_of(shop) == [("LOW_STOCK_a", "ACTIVE", "HIGH")] and shop.read("idempotency").count() == 1
