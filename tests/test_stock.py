"""Adjustments against a plain loop, on data with rejections and a product that holds most rows."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from shelfmark.operators import stock

T0 = dt.datetime(2025, 1, 1)
ADJ = ("adjustment_id string, store_id string, product_id string, adjustment_type string, quantity_delta bigint, "
       "reason string, source_ref string, created_by string, created_at timestamp")
PROD = "store_id string, product_id string, quantity_on_hand bigint"


def run(spark, products, adjustments, **kw):
    result = stock.apply_adjustments(spark.createDataFrame(products, PROD), spark.createDataFrame(adjustments, ADJ), **kw)
    return (
        {r.adjustment_id: (r.accepted, r.refusal, r.quantity_before, r.quantity_after) for r in result.decisions.collect()},
        {(r.store_id, r.product_id): r.quantity_on_hand for r in result.products.collect()},
    )


def loop(products, adjustments):
    on_hand = {(s, p): q for s, p, q in products}
    out = {}
    for a in sorted(adjustments, key=lambda a: (a[8], a[0])):
        key, sign = (a[1], a[2]), -1 if a[3] in ("REMOVE", "SALE_DEDUCTION") else 1
        before = on_hand[key]
        ok = before + sign * a[4] >= 0
        if ok:
            on_hand[key] = before + sign * a[4]
        out[a[0]] = (ok, None if ok else "NEGATIVE_STOCK", before, on_hand[key])
    return out, on_hand


@pytest.mark.parametrize("seed,chunks", [(1, 1), (2, 5), (3, 13)])
def test_same_as_loop(spark, seed, chunks):
    rng = random.Random(seed)
    products = [("s", f"p{i}", rng.randint(0, 30)) for i in range(8)]
    kinds = ["ADD", "REMOVE", "SALE_DEDUCTION", "MANUAL_CORRECTION"]
    adjustments = []
    for n in range(400):
        p = "p0" if rng.random() < 0.5 else f"p{rng.randint(0, 7)}"
        adjustments.append((f"a{n:04d}", "s", p, rng.choice(kinds), rng.randint(1, 25), "r", None, "u",
                            T0 + dt.timedelta(minutes=rng.randint(0, 60))))
    got, on_hand = run(spark, products, adjustments, chunks=chunks)
    want, end = loop(products, adjustments)
    assert got == want
    assert all(end[k] == v for k, v in on_hand.items())
    assert min(v[3] for v in got.values()) >= 0


def test_exact_removal_allowed_more_refused(spark):
    at = [T0 + dt.timedelta(seconds=i) for i in range(3)]
    rows = [("a1", "s", "p", "REMOVE", 11, "r", None, "u", at[0]), ("a2", "s", "p", "REMOVE", 10, "r", None, "u", at[1]),
            ("a3", "s", "p", "SALE_DEDUCTION", 1, "r", None, "u", at[2])]
    got, on_hand = run(spark, [("s", "p", 10)], rows)
    assert [got[k][0] for k in ("a1", "a2", "a3")] == [False, True, False]
    assert on_hand == {("s", "p"): 0}


def test_unknown_foreign_and_invalid(spark):
    rows = [("a1", "s", "nope", "ADD", 1, "r", None, "u", T0), ("a2", "other", "p", "ADD", 1, "r", None, "u", T0),
            ("a3", "s", "p", "STEAL", 1, "r", None, "u", T0), ("a4", "s", "p", "ADD", 0, "r", None, "u", T0),
            ("a5", "s", "p", "ADD", 2, "r", None, "u", T0)]
    got, on_hand = run(spark, [("s", "p", 1)], rows)
    assert got["a1"][1] == got["a2"][1] == "PRODUCT_NOT_FOUND"
    assert "adjustment_type" in got["a3"][1] and "quantity_delta" in got["a4"][1]
    assert got["a5"] == (True, None, 1, 3) and on_hand == {("s", "p"): 3}


def test_create_and_patch(spark):
    as_of = "2025-01-10"
    schema = ("product_id string, store_id string, name string, category string, price double, quantity bigint, "
              "reorder_threshold bigint, expiry_date timestamp, status string")
    new = stock.create_products(spark.createDataFrame([
        ("p1", "s", "Milk", "Dairy", 1.5, 4, 2, dt.datetime(2025, 1, 12), None),
        ("p2", "s", "", "Dairy", -1.0, 4, 2, None, "GONE"),
    ], schema), as_of=as_of)
    row = new.created.collect()
    assert [(r.product_id, r.expiry_status, r.status) for r in row] == [("p1", "EXPIRING_SOON", "ACTIVE")]
    assert len(new.rejected.first()["violations"]) == 3
    patch_schema = ("store_id string, product_id string, name string, category string, price decimal(18,2), "
                    "reorder_threshold bigint, status string, expiry_date timestamp, expiry_given boolean")
    out = stock.patch_products(new.created, spark.createDataFrame([
        ("s", "p1", None, None, None, 9, None, None, True), ("s", "zz", None, None, None, 9, None, None, False),
    ], patch_schema), as_of=as_of)
    changed = out.changed.first()
    assert (changed.name, changed.reorder_threshold, changed.expiry_date, changed.expiry_status) == ("Milk", 9, None, "OK")
    assert out.rejected.select(F.col("violations")[0]).first()[0] == "PRODUCT_NOT_FOUND"


def test_chunks_split_a_large_key_and_grow_with_its_order(spark):
    from shelfmark.operators.running import CHUNK, in_order_chunks

    rows = spark.range(60).selectExpr("'s' AS store_id", "if(id < 50, 'hot', cast(id as string)) AS product_id", "id")
    numbers = [r[CHUNK] for r in in_order_chunks(rows, ["store_id", "product_id"], ["id"], chunks=6).where("product_id = 'hot'").orderBy("id").collect()]
    assert numbers == sorted(numbers) and len(set(numbers)) > 2


def hot_product(rng, n, opening):
    """A product with most adjustments, over many blocks; stock runs short again and again."""
    rows = [(f"a{k:06d}", "s", "hot" if rng.random() < 0.9 else f"p{rng.randint(0, 5)}", rng.choice(["ADD", "REMOVE", "REMOVE"]), rng.randint(1, 30), "r", None, "u",
             T0 + dt.timedelta(minutes=rng.randint(0, 500))) for k in range(n)]
    return [("s", "hot", opening), *[("s", f"p{i}", 5) for i in range(6)]], rows


@pytest.mark.parametrize("opening,chunks", [(0, 3), (20_000, 4), (10**9, 2)])
def test_many_blocks(spark, opening, chunks):
    products, rows = hot_product(random.Random(opening), 4000, opening)
    got, on_hand = run(spark, products, rows, chunks=chunks)
    want, end = loop(products, rows)
    assert got == want and all(end[k] == v for k, v in on_hand.items())


def test_refusals_at_the_end_take_one_round(spark, monkeypatch):
    """Only the last chunk of a hot product runs short: it is folded, nothing else is."""
    rows = [(f"a{k:05d}", "s", "p", "REMOVE", 1, "r", None, "u", T0 + dt.timedelta(seconds=k)) for k in range(3000)]
    labels, real = [], stock.settle
    monkeypatch.setattr(stock, "settle", lambda df, label: labels.append(label) or real(df, label))
    got, on_hand = run(spark, [("s", "p", 2990)], rows, chunks=6)
    assert sum(not v[0] for v in got.values()) == 10 and on_hand == {("s", "p"): 0}
    assert labels.count("folded") == 2  # the second finds nothing to do


def test_plan_has_no_python(spark):
    result = stock.apply_adjustments(spark.createDataFrame([("s", "p", 1)], PROD), spark.createDataFrame(
        [("a", "s", "p", "REMOVE", 2, "r", None, "u", T0)], ADJ))
    assert "Python" not in result.decisions._jdf.queryExecution().toString() and "Pandas" not in result.decisions._jdf.queryExecution().toString()


def test_whole_products_are_folded_where_they_are_sorted(spark, monkeypatch):
    """Rows are moved once: what lies in one partition needs no blocks, and only products over a border are folded by chunks."""
    rng = random.Random(9)
    products = [("s", f"p{i:02d}", rng.randint(0, 40)) for i in range(40)]
    rows = [(f"a{n:04d}", "s", f"p{rng.randint(0, 39):02d}", rng.choice(["ADD", "REMOVE"]), rng.randint(1, 25), "r", None, "u",
             T0 + dt.timedelta(minutes=rng.randint(0, 60))) for n in range(800)]
    large, real = [], stock._fold_in_chunks
    monkeypatch.setattr(stock, "_fold_in_chunks", lambda opening, lines, chunks: large.append(lines.select("product_id").distinct().count()) or real(opening, lines, chunks))
    got, on_hand = run(spark, products, rows, chunks=4)
    want, end = loop(products, rows)
    assert got == want and all(end[k] == v for k, v in on_hand.items())
    assert sum(large) <= 3
