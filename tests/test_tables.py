"""Upserts, windows, loads, ledger jobs on written tables."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from shelfmark.operators import ledger
from shelfmark.plans import raw_load, refresh, repair
from shelfmark.schemas import ENTITIES
from shelfmark.sources.jsonl import read_json_lines
from shelfmark.sources.tables import DuplicateKeys, Warehouse
from shelfmark.sources.windows import any_changed_between, changed_between

T0 = dt.datetime(2025, 1, 1)
DAY = dt.timedelta(days=1)


def frame(spark, entity, rows):
    names = [f.name for f in spark.createDataFrame([], ENTITIES[entity]).schema.fields]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], ENTITIES[entity])


@pytest.fixture
def source(spark):
    line = lambda p, q, t, n="N": {"product_id": p, "product_name": n, "quantity": q, "unit_price": Decimal("2.00"), "line_total": Decimal(t)}
    sale = lambda i, s, day, lines, total: {
        "transaction_id": f"t{i}", "store_id": s, "status": "COMPLETED", "payment_method": "cash", "total_amount": Decimal(total),
        "sale_timestamp": T0 + day * DAY, "created_at": T0 + day * DAY, "items": lines}
    return {
        "stores": frame(spark, "stores", [{"store_id": "s1"}, {"store_id": "s2"}]),
        "transactions": frame(spark, "transactions", [
            sale(1, "s1", 0, [line("a", 1, "2.00", None), line("b", 1, "2.00"), line("a", 2, "4.00", "A"), line("", 9, "9.00")], "8.00"),
            sale(2, "s1", 1, [line("a", 1, "2.00")], "2.00"), sale(3, "s2", 2, [line("c", 1, "2.00")], "2.00")]),
        "products": frame(spark, "products", [
            {"store_id": "s1", "product_id": "a", "name": "A", "quantity_on_hand": 1, "reorder_threshold": 2, "updated_at": T0 + DAY},
            {"store_id": "s2", "product_id": "c", "name": "C", "quantity_on_hand": 2, "reorder_threshold": 2, "updated_at": T0 + 2 * DAY}]),
        "customers": frame(spark, "customers", [
            {"customer_id": "c1", "store_id": "s1", "name": "N", "total_spend": Decimal("5.00"), "visit_count": 1, "updated_at": T0 + DAY}]),
        "alerts": frame(spark, "alerts", [
            {"alert_id": "x", "store_id": "s1", "status": "RESOLVED", "created_at": T0 - 9 * DAY, "resolved_at": T0 + DAY},
            {"alert_id": "y", "store_id": "s1", "status": "ACTIVE", "created_at": T0 - 9 * DAY}]),
    }


def dump(warehouse, name):
    return sorted(map(tuple, warehouse.read(name).collect()), key=repr)


def test_collapse_takes_first_given_name(spark, source):
    rows = {(r.transaction_id, r.product_id): r for r in raw_load.transaction_items_raw(source["transactions"]).collect()}
    a = rows["t1", "a"]
    assert (a.quantity, a.line_total, a.product_name) == (3, Decimal("6.00"), "A")
    assert ("t1", "") not in rows and len(rows) == 4


def test_load_twice_and_split_window(spark, source, tmp_path):
    once, split = Warehouse(spark, str(tmp_path / "once")), Warehouse(spark, str(tmp_path / "split"))
    written = raw_load.load_window(once, source, T0, T0 + 3 * DAY)
    assert {n: w.rows for n, w in written.items()} == {
        "transactions_raw": 3, "transaction_items_raw": 4, "inventory_snapshot_raw": 2, "customers_raw": 1, "alerts_raw": 1}
    before = {n: dump(once, n) for n in written}
    raw_load.load_window(once, source, T0, T0 + 3 * DAY)
    assert before == {n: dump(once, n) for n in written}
    raw_load.load_window(split, source, T0, T0 + DAY)
    raw_load.load_window(split, source, T0 + DAY, T0 + 3 * DAY)
    for name in ("transactions_raw", "transaction_items_raw"):
        assert dump(split, name) == before[name]


def test_upsert_replaces_keeps_and_refuses_duplicates(spark, tmp_path):
    warehouse = Warehouse(spark, str(tmp_path))
    rows = lambda *r: spark.createDataFrame(list(r), "customer_id string, store_id string, name string, visit_count bigint")
    warehouse.upsert("customers_raw", rows(("1", "s", "A", 1), ("2", "s", "B", 1)))
    partial = spark.createDataFrame([("1", "s", 5), ("3", "s", 7)], "customer_id string, store_id string, visit_count bigint")
    warehouse.upsert("customers_raw", partial)
    got = {r.customer_id: (r.name, r.visit_count) for r in warehouse.read("customers_raw").collect()}
    assert got == {"1": ("A", 5), "2": ("B", 1), "3": (None, 7)}
    warehouse.upsert("customers_raw", rows())
    assert warehouse.read("customers_raw").count() == 3
    with pytest.raises(DuplicateKeys):
        warehouse.upsert("customers_raw", rows(("1", "s", "A", 1), ("1", "s", "B", 1)))


def test_publish_can_be_repeated(spark, tmp_path, monkeypatch):
    warehouse = Warehouse(spark, str(tmp_path))
    rows = spark.createDataFrame([("1", "s", "A")], "customer_id string, store_id string, name string")
    real = warehouse.publish
    monkeypatch.setattr(warehouse, "publish", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        warehouse.upsert("customers_raw", rows, run_id="r1")
    assert warehouse.read("customers_raw").count() == 0
    real("customers_raw", "r1")
    real("customers_raw", "r1")
    assert warehouse.read("customers_raw").count() == 1


def test_replace_and_purge(spark, tmp_path):
    warehouse = Warehouse(spark, str(tmp_path))
    rows = lambda *r: spark.createDataFrame(list(r), "store_id string, product_id string, embedding array<double>")
    warehouse.replace_stores("product_embeddings", rows(("s1", "a", [1.0]), ("s1", "b", [1.0]), ("s2", "c", [1.0])))
    warehouse.replace_stores("product_embeddings", rows(("s1", "d", [2.0])))
    assert {r.product_id for r in warehouse.read("product_embeddings").collect()} == {"c", "d"}
    sales = spark.createDataFrame([("1", "s1", T0), ("2", "s2", T0), ("3", "s1", T0 + DAY)], "transaction_id string, store_id string, sale_timestamp timestamp")
    warehouse.upsert("transactions_raw", sales)
    assert warehouse.read("transactions_raw", store_id="s1").count() == 2
    assert set(warehouse.purge_store("s1")) == {"product_embeddings", "transactions_raw"}
    assert [r.transaction_id for r in warehouse.read("transactions_raw").collect()] == ["2"]
    assert [r.product_id for r in warehouse.read("product_embeddings").collect()] == ["c"]
    assert warehouse.purge_store("s1") == []


def test_windows_are_half_open(spark, source):
    changed = lambda a, b: {r.transaction_id for r in changed_between(source["transactions"], a, b, on="created_at").collect()}
    assert changed(T0, T0 + DAY) == {"t1"} and changed(T0 + DAY, T0 + 2 * DAY) == {"t2"}
    assert changed_between(source["transactions"], T0, T0 + 9 * DAY, on="created_at", store_id="s2").count() == 1
    assert [r.alert_id for r in any_changed_between(source["alerts"], T0, T0 + 2 * DAY, on=raw_load.ALERT_INSTANTS).collect()] == ["x"]


def test_two_captures_in_a_minute_share_a_row(spark, source, tmp_path):
    warehouse = Warehouse(spark, str(tmp_path))
    for second, quantity in ((1, 1), (50, 8)):
        products = source["products"].withColumn("quantity_on_hand", F.lit(quantity).cast("bigint"))
        shaped = raw_load.inventory_snapshot_raw(products, F.lit(T0 + dt.timedelta(seconds=second)).cast("timestamp"))
        warehouse.upsert("inventory_snapshot_raw", shaped)
    rows = warehouse.read("inventory_snapshot_raw").collect()
    assert len(rows) == 2 and {r.quantity_on_hand for r in rows} == {8}


def test_json_lines(spark, tmp_path):
    path = tmp_path / "rows.json"
    path.write_text('{"customer_id": "1", "total_spend": "12.50", "visit_count": "7.9", "last_purchase_at": "2025-01-01T00:00:00Z"}\n'
                    '{"customer_id": 2, "total_spend": 3, "visit_count": 4}\nnot json\n')
    rows, broken = read_json_lines(spark, str(path), "customer_id string, total_spend decimal(18,2), visit_count bigint, last_purchase_at timestamp")
    got = {r.customer_id: (r.total_spend, r.visit_count, r.last_purchase_at) for r in rows.collect()}
    assert got == {"1": (Decimal("12.50"), None, T0), "2": (Decimal("3.00"), 4, None)}
    assert [r.line for r in broken.collect()] == ["not json"]


def test_sync_transform_repair(spark, source, tmp_path):
    warehouse = Warehouse(spark, str(tmp_path))
    as_of = T0 + 2 * DAY + dt.timedelta(hours=1)
    repair.run_sync(warehouse, source, as_of=as_of)
    runs = {r.store_id: r for r in warehouse.read("pipeline_runs").collect()}
    assert {s: (r.status, r.records_written) for s, r in runs.items()} == {"s1": ("SUCCEEDED", 9), "s2": ("SUCCEEDED", 3)}
    assert runs["s1"].checkpoint_start == as_of - 30 * DAY and runs["s1"].checkpoint_end == as_of
    assert repair.run_transform(warehouse, source["stores"], as_of=as_of)
    dashboard = {r.store_id: r for r in warehouse.read("dashboard_summary").collect()}
    # Only the store with a sale on the day has a row; equal to its threshold is not low in the mart.
    assert set(dashboard) == {"s2"} and dashboard["s2"].low_stock_count == 0 and dashboard["s2"].top_selling_product == "N"
    assert warehouse.read("sales_daily").count() == 3
    assert {r.freshness_status for r in warehouse.read("analytics_metadata").collect()} == {"fresh"}
    assert not repair.run_transform(warehouse, source["stores"], as_of=as_of + DAY)
    window = ledger.next_windows(source["stores"], warehouse.read("pipeline_runs"), as_of=as_of + DAY).first()
    assert (window.checkpoint_start, window.checkpoint_end) == (as_of, as_of + DAY)

    broken = {**source, "transactions": source["transactions"].withColumn("total_amount", F.raise_error(F.lit("no disk")).cast("decimal(18,2)")).withColumn(
        "created_at", F.lit(as_of).cast("timestamp"))}
    with pytest.raises(Exception):
        repair.run_sync(warehouse, broken, as_of=as_of + DAY)
    failures = warehouse.read("pipeline_failures").collect()
    assert {f.dead_letter_status for f in failures} == {"OPEN"} and len(failures) == 2
    iso = lambda t: t.strftime("%Y-%m-%dT%H:%M:%S+00:00")
    assert failures[0].batch_ref == f"{iso(as_of)}/{iso(as_of + DAY)}"
    assert ledger.latest_success(warehouse.read("pipeline_runs"), ledger.SYNC).first().checkpoint_end == as_of
    assert repair.run_repair(warehouse, source, as_of=as_of + 2 * DAY) == {"recovered": 2, "failed": 0}
    assert {(f.dead_letter_status, f.recovered_at) for f in warehouse.read("pipeline_failures").collect()} == {("RECOVERED", as_of + 2 * DAY)}


def test_failed_refresh_leaves_freshness(spark, source, tmp_path, monkeypatch):
    warehouse = Warehouse(spark, str(tmp_path))
    raw_load.load_window(warehouse, source, T0, T0 + 3 * DAY)
    refresh.refresh_marts(warehouse, as_of=T0 + 3 * DAY, run_id="one")
    monkeypatch.setattr(refresh.marts, "dashboard_summary", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("no")))
    with pytest.raises(RuntimeError):
        refresh.refresh_marts(warehouse, as_of=T0 + 4 * DAY, run_id="two")
    assert {r.last_pipeline_run_id for r in warehouse.read("analytics_metadata").collect()} == {"one"}


def test_replay_window_is_the_one_named(spark):
    failures = frame(spark, "pipeline_failures", [{"failure_id": "f", "store_id": "s", "dead_letter_status": "OPEN", "created_at": T0,
                                                   "batch_ref": "2025-01-01T00:00:00+00:00/2025-01-02T00:00:00+00:00"}])
    stores, runs = spark.createDataFrame([("s",)], "store_id string"), frame(spark, "pipeline_runs", [])
    row = ledger.replay_windows(failures, runs, stores, as_of=T0 + 9 * DAY).first()
    assert (row.checkpoint_start, row.checkpoint_end, row.from_reference) == (T0, T0 + DAY, True)
    outcome = ledger.after_replay(failures, spark.createDataFrame([("f", False)], "failure_id string, ok boolean"), as_of=T0)
    assert outcome.first().dead_letter_status == "OPEN"


def test_upsert_reads_only_touched_folders_and_refresh_only_touched_days(spark, source, tmp_path):
    warehouse = Warehouse(spark, str(tmp_path))
    raw_load.load_window(warehouse, source, T0, T0 + 3 * DAY)
    refresh.refresh_marts(warehouse, as_of=T0 + 3 * DAY, run_id="one")
    one = source["transactions"].where("transaction_id = 't2'")
    assert warehouse.folders_of("transactions_raw", one) == ["2025-01-02"]
    pruned = warehouse.read("transactions_raw", folders=["2025-01-02"])
    scan = next(line for line in pruned._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan" in line)
    assert "PartitionFilters: [" in scan and "p_day" in scan.split("PartitionFilters")[1] and [r.transaction_id for r in pruned.collect()] == ["t2"]
    windows = spark.createDataFrame([("s1", T0 + DAY, T0 + 2 * DAY)], "store_id string, checkpoint_start timestamp, checkpoint_end timestamp")
    touched = refresh.touched_days(warehouse, windows)
    assert [tuple(r) for r in touched.collect()] == [("s1", (T0 + DAY).date())]
    refresh.refresh_marts(warehouse, as_of=T0 + 4 * DAY, run_id="two", touched=touched, customers_since=T0)
    stamps = {(r.store_id, r.sales_date): r.analytics_last_updated_at for r in warehouse.read("sales_daily").collect()}
    assert stamps == {("s1", T0.date()): T0 + 3 * DAY, ("s1", (T0 + DAY).date()): T0 + 4 * DAY, ("s2", (T0 + 2 * DAY).date()): T0 + 3 * DAY}
    assert warehouse.read("product_sales_daily").where("product_id = 'a'").count() == 2


def sales_rows(spark, *rows):
    kind = "transaction_id string, store_id string, sale_timestamp timestamp, created_at timestamp, payment_method string"
    return spark.createDataFrame([(t, "s1", at, made, how) for t, at, made, how in rows], kind)


def test_upsert_moves_a_key_to_its_new_day(spark, tmp_path):
    warehouse = Warehouse(spark, str(tmp_path))
    warehouse.upsert("transactions_raw", sales_rows(spark, ("t1", T0, T0, "a"), ("t2", T0 + DAY, T0, "a")))
    warehouse.upsert("transactions_raw", sales_rows(spark, ("t1", T0 + DAY, T0, "b")))
    rows = {(r.transaction_id, r.sale_timestamp, r.payment_method) for r in warehouse.read("transactions_raw").collect()}
    assert rows == {("t1", T0 + DAY, "b"), ("t2", T0 + DAY, "a")}
    later = sales_rows(spark, ("t1", T0, T0 - DAY, "old"), ("t2", T0 + DAY, T0 + DAY, "new"))
    warehouse.upsert("transactions_raw", later, newest_by="created_at")
    assert {(r.transaction_id, r.payment_method) for r in warehouse.read("transactions_raw").collect()} == {("t1", "b"), ("t2", "new")}


def test_transform_takes_all_syncs_since_the_last(spark):
    run = lambda i, store, kind, start, end, status="SUCCEEDED": {
        "pipeline_run_id": str(i), "store_id": store, "run_type": kind, "status": status, "checkpoint_start": T0 + start * DAY,
        "checkpoint_end": T0 + end * DAY, "finished_at": T0 + (10 + i) * DAY}
    runs = frame(spark, "pipeline_runs", [
        run(1, "s1", ledger.SYNC, 0, 1), run(2, "s1", ledger.MART, 0, 1), run(3, "s1", ledger.SYNC, 1, 2), run(4, "s1", ledger.MART, 1, 2, "FAILED"),
        run(5, "s1", ledger.SYNC, 2, 3), run(6, "s2", ledger.SYNC, 0, 1), run(7, "s2", ledger.MART, 0, 1)])
    stores = spark.createDataFrame([("s1",), ("s2",)], "store_id string")
    assert [tuple(r) for r in ledger.stores_to_transform(stores, runs, as_of=T0).collect()] == [("s1", T0 + DAY, T0 + 3 * DAY)]


def test_only_refreshed_stores_are_stamped(spark, source, tmp_path):
    warehouse = Warehouse(spark, str(tmp_path))
    as_of = T0 + 2 * DAY + dt.timedelta(hours=1)
    repair.run_sync(warehouse, source, as_of=as_of)
    assert repair.run_transform(warehouse, source["stores"].where("store_id = 's1'"), as_of=as_of)
    runs = {r.pipeline_run_id: r for r in warehouse.read("pipeline_runs").where("run_type = 'MART_REFRESH'").collect()}
    stamps = warehouse.read("analytics_metadata").collect()
    assert [r.store_id for r in stamps] == ["s1"] and stamps[0].last_pipeline_run_id in runs
    assert (stamps[0].source_window_start, stamps[0].source_window_end) == (as_of - 30 * DAY, as_of)
