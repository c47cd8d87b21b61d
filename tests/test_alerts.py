"""Rules on literal inputs, reconciling, lifecycle."""

from __future__ import annotations

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from shelfmark.operators import alert_book, alert_rules
from shelfmark.plans import sweep
from shelfmark.schemas import ENTITIES

NOW = dt.datetime(2025, 3, 1, 12, 0)
DAY = dt.timedelta(days=1)
PRODUCTS = ("store_id string, product_id string, name string, quantity_on_hand bigint, reorder_threshold bigint, "
            "expiry_date timestamp, status string")
ITEMS = "store_id string, product_id string, quantity bigint, status string, sale_timestamp timestamp"


def products(spark, *rows):
    return spark.createDataFrame([("s", pid, "Test Product", q, t, e, "ACTIVE") for pid, q, t, e in rows], PRODUCTS)


def items(spark, *rows):
    return spark.createDataFrame([("s", *r) for r in rows], ITEMS)


def alerts(spark, *rows):
    """rows: alert_id, condition_key, status"""
    names = [f.strip().split()[0] for f in ENTITIES["alerts"].split(",")]
    given = [{"alert_id": a, "store_id": "s", "condition_key": k, "status": st, "created_at": NOW - DAY, "severity": "LOW", "title": "old",
              "alert_type": k.rsplit("_", 2)[0], "source_entity_id": "prod_1"} for a, k, st in rows]
    return spark.createDataFrame([tuple(g.get(n) for n in names) for g in given], ENTITIES["alerts"])


def test_low_stock_and_out_of_stock(spark):
    rows = {r.source_entity_id: r for r in alert_rules.low_stock(products(spark, ("a", 5, 10, None), ("b", 0, 10, None), ("c", 10, 10, None), ("d", 11, 10, None))).collect()}
    assert [rows[k].severity for k in "abcd"] == ["HIGH", "CRITICAL", "HIGH", None]
    assert json.loads(rows["a"].metadata) == {"quantity_on_hand": 5, "reorder_threshold": 10}
    assert rows["a"].title == "Test Product stock is low" and rows["a"].message == "Only 5 units left. Reorder soon."
    assert not rows["d"].triggered


def test_expiry_messages(spark):
    hour = dt.timedelta(hours=1)
    rows = {r.source_entity_id: r for r in alert_rules.expiry_soon(products(
        spark, ("past", 2, 0, NOW - hour), ("today", 2, 0, NOW + hour), ("late", 2, 0, NOW + 7 * DAY + 23 * hour), ("far", 2, 0, NOW + 8 * DAY),
        ("none", 2, 0, None), ("empty", 0, 0, NOW)), as_of=NOW).collect()}
    assert rows["past"].message == "2 units have expired." and rows["past"].severity == "HIGH"
    assert rows["today"].message == "2 units expire today." and rows["today"].severity == "HIGH"
    assert rows["late"].message == "2 units expire within 7 days." and rows["late"].severity == "MEDIUM"
    assert not any(rows[k].triggered for k in ("far", "none", "empty"))


def test_not_selling(spark):
    sold = items(spark, ("b", 1, "COMPLETED", NOW), ("c", 1, "FAILED", NOW), ("d", 1, None, NOW - 14 * DAY), ("e", 1, "", NOW - 14 * DAY - dt.timedelta(seconds=1)))
    rows = alert_rules.not_selling(products(spark, *[(p, 6, 0, None) for p in "abcde"], ("f", 0, 0, None)), sold, as_of=NOW).collect()
    assert {r.condition_key for r in rows if r.triggered} == {"NOT_SELLING_a", "NOT_SELLING_c", "NOT_SELLING_e"}
    assert {r.severity for r in rows if r.triggered} == {"MEDIUM"}


def test_high_demand(spark):
    recent, before = NOW - DAY, NOW - 5 * DAY
    sold = items(spark, ("spike", 9, "COMPLETED", recent), ("spike", 14, "COMPLETED", before), ("cover", 6, None, recent),
                 ("edge", 3, "COMPLETED", NOW - 3 * DAY), ("edge", 3, "COMPLETED", NOW - 17 * DAY))
    rows = {r.source_entity_id: r for r in alert_rules.high_demand(
        products(spark, ("spike", 40, 0, None), ("cover", 5, 0, None), ("calm", 100, 0, None), ("edge", 100, 0, None)), sold, as_of=NOW).collect()}
    spike, cover, edge = (json.loads(rows[k].metadata) for k in ("spike", "cover", "edge"))
    assert spike["triggered_by_rate_spike"] and not spike["triggered_by_stock_cover"]
    assert cover["triggered_by_stock_cover"] and cover["stock_cover_days"] == 2.5
    assert not rows["calm"].triggered
    # A sale exactly three days ago is in both windows; one exactly seventeen days ago is in the baseline.
    assert (edge["recent_units_sold"], edge["baseline_units_sold"]) == (3, 6)


def test_open_refresh_resolve_and_rerun(spark):
    rules = alert_rules.low_stock(products(spark, ("prod_1", 15, 10, None), ("prod_2", 1, 10, None), ("prod_3", 1, 10, None), ("prod_4", 99, 1, None)))
    stored = alerts(spark, ("a1", "LOW_STOCK_prod_1", "ACTIVE"), ("a2", "LOW_STOCK_prod_2", "ACKNOWLEDGED"), ("a0", "LOW_STOCK_prod_3", "RESOLVED"))
    changes = alert_book.reconcile(rules, stored, as_of=NOW)
    rows = {r.condition_key: r for r in changes.alerts.collect()}
    cleared = rows["LOW_STOCK_prod_1"]
    assert (cleared.status, cleared.resolved_by, cleared.resolution_note, cleared.title) == ("RESOLVED", "system", "Condition automatically cleared.", "old")
    kept = rows["LOW_STOCK_prod_2"]
    assert (kept.alert_id, kept.status, kept.created_at, kept.severity, kept.last_evaluated_at) == ("a2", "ACKNOWLEDGED", NOW - DAY, "HIGH", NOW)
    opened = rows["LOW_STOCK_prod_3"]
    assert opened.status == "ACTIVE" and opened.alert_id != "a0" and opened.created_at == NOW
    assert {(r.alert_id, r.from_status, r.to_status) for r in changes.events.collect()} == {
        ("a1", "ACTIVE", "RESOLVED"), (opened.alert_id, "NONE", "ACTIVE")}
    after = alert_book.apply_changes(stored, changes.alerts)
    assert after.count() == 4
    again = alert_book.reconcile(rules, after, as_of=NOW + DAY)
    assert again.events.count() == 0 and {r.status for r in again.alerts.collect()} == {"ACTIVE", "ACKNOWLEDGED"}


def test_sweeps(spark):
    rows = products(spark, ("p", 1, 10, NOW + DAY), ("q", 1, 10, None))
    none, empty = items(spark), alerts(spark)
    assert sweep.rebuild(rows, none, empty, as_of=NOW).alerts.count() == 5
    changed = spark.createDataFrame([("s", "q")], "store_id string, product_id string")
    assert [r.condition_key for r in sweep.after_change(changed, rows, empty, as_of=NOW, kinds=("LOW_STOCK",)).alerts.collect()] == ["LOW_STOCK_q"]
    idle = rows.replace("ACTIVE", "INACTIVE", subset=["status"])
    assert sweep.backfill_inventory_alerts(idle, empty, as_of=NOW).alerts.count() == 0
    with pytest.raises(ValueError):
        sweep.sweep(("PARTY",), rows, none, empty, as_of=NOW)


def test_lifecycle(spark):
    schema = "command_id string, alert_id string, store_id string, command string, user_id string, note string, requested_at timestamp"
    t = [NOW + dt.timedelta(minutes=i) for i in range(6)]
    commands = spark.createDataFrame([
        ("1", "a1", "s", "ACKNOWLEDGE", "u1", None, t[0]), ("2", "a1", "s", "ACKNOWLEDGE", "u2", None, t[1]),
        ("3", "a1", "s", "RESOLVE", "u3", "done", t[2]), ("4", "a1", "s", "RESOLVE", "u4", "late", t[3]), ("5", "a1", "s", "ACKNOWLEDGE", "u", None, t[4]),
        ("6", "a2", "s", "RESOLVE", "u", "x", t[0]), ("7", "a3", "s", "ACKNOWLEDGE", "u", None, t[0]), ("8", "a1", "other", "RESOLVE", "u", None, t[0]),
        ("9", "a4", "s", "ACKNOWLEDGE", "u9", None, t[5]),
    ], schema)
    stored = alerts(spark, ("a1", "K_1", "ACTIVE"), ("a2", "K_2", "ACKNOWLEDGED"), ("a3", "K_3", "RESOLVED"), ("a4", "K_4", "ACTIVE"))
    result = alert_book.run_commands(stored, commands)
    got = {r.command_id: (r.from_status, r.accepted, r.reason) for r in result.decisions.collect()}
    bad = "INVALID_ALERT_TRANSITION"
    assert got == {
        "1": ("ACTIVE", True, None), "2": ("ACKNOWLEDGED", False, bad), "3": ("ACKNOWLEDGED", True, None), "4": ("RESOLVED", False, bad),
        "5": ("RESOLVED", False, bad), "6": ("ACKNOWLEDGED", True, None), "7": ("RESOLVED", False, bad), "8": (None, False, "ALERT_NOT_FOUND"),
        "9": ("ACTIVE", True, None)}
    rows = {r.alert_id: r for r in result.alerts.collect()}
    assert (rows["a1"].acknowledged_by, rows["a1"].resolved_by, rows["a1"].resolution_note, rows["a1"].resolved_at) == ("u1", "u3", "done", t[2])
    assert rows["a4"].status == "ACKNOWLEDGED" and "a3" not in rows
    assert result.events.count() == 4 and result.events.select("event_id").distinct().count() == 4


def test_listing(spark):
    stored = alerts(spark, *[(f"a{i}", f"LOW_STOCK_p{i}", s) for i, s in enumerate(["ACKNOWLEDGED", "RESOLVED", "ACTIVE", "ACTIVE", "ACKNOWLEDGED"])])
    assert [r.alert_id for r in alert_book.relevant_alerts(stored, limit=3).orderBy("rank").collect()] == ["a2", "a3", "a0"]
    assert alert_book.list_alerts(stored, status="RESOLVED").count() == 1
    with pytest.raises(ValueError):
        alert_book.list_alerts(stored, severity="HUGE")


def test_rules_from_kept_days_equal_those_from_all_sales(spark):
    """Two sweeps on successive days, at odd times of day, over sales that fall on the windows' very ends too."""
    from shelfmark.operators import alert_rules, demand

    rng = random.Random(4)
    first = dt.datetime(2025, 3, 20, 9, 30)
    edges = [first - dt.timedelta(days=n) + dt.timedelta(seconds=s) for n in (0, 1, 2, 3, 13, 14, 16, 17, 18) for s in (-1, 0, 1)]
    sales = [("s", f"p{rng.randint(0, 14)}", rng.choice([None, 1, 2, 9]), rng.choice([None, "", "COMPLETED", "FAILED"]),
              rng.choice(edges + [first - dt.timedelta(minutes=rng.randint(0, 30_000)) for _ in range(40)])) for _ in range(500)]
    lines = spark.createDataFrame(sales + [("s", "", 5, None, first), ("s", None, 5, None, first), ("s", "p1", 5, None, None)],
                                  "store_id string, product_id string, quantity bigint, status string, sale_timestamp timestamp")
    products = spark.createDataFrame([("s", f"p{k}", f"P{k}", k * 3) for k in range(16)], "store_id string, product_id string, name string, quantity_on_hand bigint")
    early = lines.where(F.col("sale_timestamp") < F.lit(first - dt.timedelta(days=2)))
    kept = demand.with_more(demand.day_units(early), demand.day_units(lines.where(F.col("sale_timestamp") >= F.lit(first - dt.timedelta(days=2)))))
    kept = kept.unionByName(demand.day_units(early).join(kept, ["store_id", "product_id", "sales_date"], "left_anti"))
    assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, demand.day_units(lines).collect()))
    for as_of in (first, first + dt.timedelta(days=1), dt.datetime(2025, 3, 20)):
        ends = [(as_of - dt.timedelta(days=n)).date() for n in (0, 3, 14, 17)]
        some = lines.where(F.to_date("sale_timestamp").isin(ends))
        kinds = ("NOT_SELLING", "HIGH_DEMAND")
        want = sorted(map(str, alert_rules.evaluate(kinds, products, lines, as_of=as_of).collect()))
        assert sorted(map(str, alert_rules.evaluate(kinds, products, some, as_of=as_of, days=kept).collect())) == want
