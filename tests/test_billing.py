"""Billing against a plain loop over the requests in order."""

from __future__ import annotations

import datetime as dt
import json
import random
from decimal import Decimal

import pytest

from shelfmark import schemas
from shelfmark.operators import billing

T0 = dt.datetime(2025, 1, 1)
PROD = "store_id string, product_id string, name string, price decimal(18,2), quantity_on_hand bigint"
CUST = ("customer_id string, store_id string, name string, phone string, total_spend decimal(18,2), visit_count bigint, "
        "last_purchase_at timestamp, created_at timestamp, updated_at timestamp")
REQ, IDEM = schemas.ENTITIES["sale_requests"], schemas.ENTITIES["idempotency"]


def loop(requests, products, customers, stored):
    stock = {(s, p): q for s, p, _, _, q in products}
    known = {(c[1], c[0]) for c in customers}
    keys = {(s[0], s[1]): s[2] for s in stored}
    out = {}
    for store, key, customer, pay, at, seq, items in sorted(requests, key=lambda r: (r[4], r[5])):
        payload = json.dumps([customer, pay, sorted(items)])
        if (store, key) in keys:
            same = keys[store, key] == payload
            out[store, seq] = ("REPLAY", None) if same else ("CONFLICT", "IDEMPOTENCY_KEY_CONFLICT")
            continue
        need = {}
        for p, q in items:
            need[p] = need.get(p, 0) + q
        if any((store, p) not in stock for p in need):
            out[store, seq] = ("REJECTED", "PRODUCT_NOT_FOUND")
        elif customer and (store, customer) not in known:
            out[store, seq] = ("REJECTED", "CUSTOMER_NOT_FOUND")
        elif any(stock[store, p] < q for p, q in need.items()):
            out[store, seq] = ("REJECTED", "INSUFFICIENT_STOCK")
        else:
            for p, q in need.items():
                stock[store, p] -= q
            keys[store, key] = payload
            out[store, seq] = ("ACCEPTED", None)
    return out, stock


def bill(spark, requests, products, customers=(), stored=(), **kw):
    return billing.bill(
        spark.createDataFrame(requests, REQ), spark.createDataFrame(products, PROD),
        spark.createDataFrame(list(customers), CUST), spark.createDataFrame(list(stored), IDEM), **kw)


@pytest.mark.parametrize("seed,chunks", [(1, 1), (2, 7), (3, 3)])
def test_same_as_loop(spark, seed, chunks):
    rng = random.Random(seed)
    stores = ["s1", "s1", "s1", "s2"]
    products = [(s, f"p{i}", f"P{i}", Decimal("2.50"), rng.randint(0, 60)) for s in ("s1", "s2") for i in range(6)]
    customers = [(f"c{i}", "s1", "n", str(i), Decimal(0), 0, None, T0, T0) for i in range(3)]
    requests = []
    for n in range(150):
        lines = [(f"p{rng.choice([0, 0, 0, 1, 2, 3, 4, 5, 9] if rng.random() < .1 else [0, 0, 1, 2, 3, 4, 5])}", rng.randint(1, 9))
                 for _ in range(rng.randint(1, 4))]
        requests.append((rng.choice(stores), f"k{rng.randint(0, 60)}", rng.choice([None, None, "c0", "c1", "c7"]),
                         rng.choice(["cash", "upi"]), T0 + dt.timedelta(minutes=rng.randint(0, 40)), n, lines))
        if rng.random() < 0.2:
            r = requests[-1]
            requests.append((r[0], r[1], r[2], r[3], r[4] + dt.timedelta(minutes=rng.randint(0, 9)), 1000 + n, r[6][::-1]))
    result = bill(spark, requests, products, customers, chunks=chunks)
    want, stock = loop(requests, products, customers, [])
    got = {(r.store_id, r.seq): (r.outcome, r.reason) for r in result.decisions.collect()}
    assert got == want
    assert {v[0] for v in got.values()} == {"ACCEPTED", "REPLAY", "CONFLICT", "REJECTED"}
    for r in result.products.collect():
        assert r.quantity_on_hand == stock[r.store_id, r.product_id] >= 0
    sold = sum(i.quantity for t in result.transactions.collect() for i in t["items"])
    assert sold == sum(q for *_, q in products) - sum(stock.values())
    assert sold == sum(a.quantity_delta for a in result.adjustments.collect())


def test_duplicate_lines_count_together_and_nothing_is_taken(spark):
    requests = [("s", "k", None, "cash", T0, 1, [("prod_bbb", 3), ("prod_aaa", 1), ("prod_bbb", 3)])]
    products = [("s", "prod_aaa", "A", Decimal("1"), 9), ("s", "prod_bbb", "B", Decimal("1"), 5)]
    result = bill(spark, requests, products)
    assert [(r.outcome, r.reason) for r in result.decisions.collect()] == [("REJECTED", "INSUFFICIENT_STOCK")]
    assert result.products.count() == result.adjustments.count() == result.idempotency.count() == 0


def test_replay_and_conflict_and_rollup(spark):
    at = [T0 + dt.timedelta(minutes=i) for i in range(4)]
    basket, turned = [("a", 2), ("b", 1)], [("b", 1), ("a", 2)]
    requests = [("s", "k", "c", "cash", at[0], 1, basket), ("s", "k", "c", "cash", at[1], 2, turned),
                ("s", "k", "c", "card", at[2], 3, basket), ("s", "bad", "c", "gold", at[3], 4, basket)]
    products = [("s", "a", "A", Decimal("50.00"), 5), ("s", "b", "B", Decimal("40.00"), 5)]
    customers = [("c", "s", "n", "1", Decimal("10.00"), 2, None, T0, T0)]
    result = bill(spark, requests, products, customers)
    rows = {r.seq: r for r in result.decisions.collect()}
    assert [rows[i].outcome for i in (1, 2, 3, 4)] == ["ACCEPTED", "REPLAY", "CONFLICT", "REJECTED"]
    assert rows[2].transaction_id == rows[1].transaction_id and rows[2].total_amount == Decimal("140.00")
    customer = result.customers.first()
    assert (customer.total_spend, customer.visit_count, customer.last_purchase_at) == (Decimal("150.00"), 3, at[0])
    key = result.idempotency.first()
    assert key.last_seen_at == at[1] and key.created_at == at[0]
    # The next batch finds the stored key.
    later = bill(spark, requests[:1], products, customers, [key.asDict()[c.split()[0]] for c in ()] or [tuple(
        key[c] for c in ("store_id", "idempotency_key", "request_hash", "transaction_id", "result_status", "total_amount",
                         "created_at", "last_seen_at"))])
    assert later.decisions.first().outcome == "REPLAY"
    answer = billing.replay_responses(later.decisions, result.transactions).first()
    assert (answer.transaction_id, answer.status, answer.total_amount) == (rows[1].transaction_id, "COMPLETED", Decimal("140.00"))


def test_refused_request_leaves_its_key_free(spark):
    requests = [("s", "k", None, "cash", T0, 1, [("a", 9)]), ("s", "k", None, "cash", T0 + dt.timedelta(minutes=1), 2, [("a", 4)])]
    result = bill(spark, requests, [("s", "a", "A", Decimal("1"), 5)])
    assert {r.seq: r.outcome for r in result.decisions.collect()} == {1: "REJECTED", 2: "ACCEPTED"}


def chain_of(n, stock=1):
    """Request i asks for the goods i and i + 1, of which there is one each: every second request is served, and
    whether one is hangs on all before it."""
    products = [("s", f"p{i}", f"P{i}", Decimal("1"), stock) for i in range(n + 1)]
    requests = [("s", f"k{i}", None, "cash", T0 + dt.timedelta(seconds=i), i, [(f"p{i}", 1), (f"p{i + 1}", 1)]) for i in range(n)]
    return requests, products


def test_chain_of_2000_in_a_handful_of_rounds(spark, monkeypatch):
    requests, products = chain_of(2000)
    labels, real = [], billing.settle
    monkeypatch.setattr(billing, "settle", lambda df, label: labels.append(label) or real(df, label))
    result = bill(spark, requests, products)
    got = {r.seq: r.outcome for r in result.decisions.collect()}
    assert got == {i: "REJECTED" if i % 2 else "ACCEPTED" for i in range(2000)}
    assert labels.count("served") == 1


@pytest.mark.parametrize("seed,turn", [(4, 10), (5, 40)])
def test_parts_larger_than_a_turn(spark, seed, turn, monkeypatch):
    """Stock is carried from one turn of a part to the next."""
    rng = random.Random(seed)
    products = [(s, f"p{i}", f"P{i}", Decimal("1"), rng.randint(5, 40)) for s in ("s1", "s2") for i in range(8)]
    requests = [(rng.choice(["s1", "s1", "s2"]), f"k{rng.randint(0, 50)}", None, rng.choice(["cash", "upi"]), T0 + dt.timedelta(minutes=rng.randint(0, 60)), n,
                 [(f"p{rng.randint(0, 7)}", rng.randint(1, 6)) for _ in range(rng.randint(1, 3))]) for n in range(120)]
    real = billing.allocate
    monkeypatch.setattr(billing, "allocate", lambda *a, **k: real(*a, **k, requests_per_turn=turn))
    result = bill(spark, requests, products)
    want, stock = loop(requests, products, [], [])
    assert {(r.store_id, r.seq): (r.outcome, r.reason) for r in result.decisions.collect()} == want
    assert all(r.quantity_on_hand == stock[r.store_id, r.product_id] for r in result.products.collect())


def test_connected_parts_over_many_tasks(spark):
    from shelfmark.operators.components import connected

    rng = random.Random(8)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(200)] + [(7, 7), (5000, -5000)]
    root = {x: x for u, v in links for x in (u, v)}
    for _ in links:
        for u, v in links:
            root[u] = root[v] = min(root[u], root[v])
    want = {x: r for x, r in root.items() if any(x in link and link[0] != link[1] for link in links)}
    frame = spark.createDataFrame(links, "u long, v long")
    for size in (10**6, 40):
        assert {r.node: r.part for r in connected(frame, links_per_task=size).collect()} == want
    assert connected(frame.where("false")).count() == 0


def test_parts_that_fit_a_turn_are_never_cut(spark, monkeypatch):
    """Many parts, together more than a turn, each less: all are served at once, and copies of a request count as one."""
    requests, products = [], []
    for store in range(6):
        products += [(f"s{store}", f"p{i}", f"P{i}", Decimal("1"), 3) for i in range(3)]
        requests += [(f"s{store}", f"k{n}", None, "cash", T0 + dt.timedelta(seconds=n), n, [(f"p{n % 3}", 1), (f"p{(n + 1) % 3}", 1)]) for n in range(9)]
    labels, real, settle = [], billing.allocate, billing.settle
    monkeypatch.setattr(billing, "settle", lambda df, label: labels.append(label) or settle(df, label))
    monkeypatch.setattr(billing, "allocate", lambda *a, **k: real(*a, **k, requests_per_turn=11))
    result = bill(spark, requests, products)
    want, stock = loop(requests, products, [], [])
    assert {(r.store_id, r.seq): (r.outcome, r.reason) for r in result.decisions.collect()} == want
    assert all(r.quantity_on_hand == stock[r.store_id, r.product_id] for r in result.products.collect())
    assert labels.count("served") == 1


def test_accepted_requests_are_picked_without_moving_all(spark):
    numbers = [0, 1, 7, 8, 32767, 32768, 32769, 65536, 1 << 33, (1 << 33) + 5, 1 << 40]
    rows = spark.createDataFrame([(n, f"r{n}") for n in [*numbers, 1]], "request_id long, what string")
    for wanted in (set(numbers[::2]), set(numbers), {1, 3}, set()):
        picked = billing.among(rows, spark.createDataFrame([(n,) for n in wanted], "request_id long"))
        assert sorted(r.request_id for r in picked.collect()) == sorted(n for n in [*numbers, 1] if n in wanted)
        assert "Exchange hashpartitioning" not in picked._jdf.queryExecution().executedPlan().toString()


def test_few_links_are_left_after_a_part_of_them(spark, monkeypatch):
    """Of a dense graph nearly all links lie within the parts that a quarter of them makes."""
    from shelfmark.operators import components

    sizes, settle = [], components.settle
    monkeypatch.setattr(components, "settle", lambda df, label: (made := settle(df, label), sizes.append(made.count()) if label == "links" else None)[0])
    links = [(u, 1000 + v) for u in range(60) for v in range(60)]
    frame = spark.createDataFrame(links, "u long, v long")
    assert {r.part for r in components.connected(frame, links_per_task=100).collect()} == {0}
    assert sizes[0] == 3600 and sum(sizes[1:]) < 2000


def test_products_listed_twice_are_added_up_and_others_taken_as_they_are(spark):
    items = [[("a", 3), ("b", 1), ("a", 4)], [("a", 2), ("b", 5)]]
    requests = spark.createDataFrame([("s", f"k{i}", None, "cash", T0, i, lines) for i, lines in enumerate(items)], REQ)
    products = spark.createDataFrame([("s", "a", "A", Decimal(1), 8), ("s", "b", "B", Decimal(1), 9)], PROD)
    result = billing.bill(requests, products, spark.createDataFrame([], CUST), spark.createDataFrame([], IDEM))
    assert [(r.seq, r.outcome) for r in result.decisions.orderBy("seq").collect()] == [(0, "ACCEPTED"), (1, "REJECTED")]
    assert {r.product_id: r.quantity_on_hand for r in result.products.collect()} == {"a": 1, "b": 8}


def test_lines_without_a_product_or_a_quantity_are_refused_without_a_function_per_line(spark):
    from shelfmark.functions.validate import VIOLATIONS, sale_rules, split_valid

    lines = [[("a", 1)], [], None, [("a", None)], [(None, 1)], [("", 1)], [("a", 0), ("b", 2)], [("a", 1), None], [("a", 2), ("b", 1)]]
    requests = spark.createDataFrame([("s", f"k{i}", None, "cash", T0, i, given) for i, given in enumerate(lines)], REQ)
    valid, invalid = split_valid(requests, sale_rules())
    assert sorted(r.seq for r in valid.collect()) == [0, 8]
    wrong = "items: product_id and a quantity of at least 1 in every line"
    assert {r.seq: r[VIOLATIONS] for r in invalid.collect()} == {i: ["items: at least one line"] if i in (1, 2) else [wrong] for i in range(1, 8)}
    assert "lambda" not in valid._jdf.queryExecution().optimizedPlan().toString()


def test_a_billed_request_is_gathered_from_rows_that_have_moved(spark, monkeypatch):
    plans, settle = {}, billing.settle
    monkeypatch.setattr(billing, "settle", lambda df, label: (plans.setdefault(label, df._jdf.queryExecution().toString()), settle(df, label))[1])
    requests = spark.createDataFrame([("s", "k", None, "cash", T0, 1, [("a", 3)])], REQ)
    products = spark.createDataFrame([("s", "a", "A", Decimal(1), 2)], PROD)
    result = billing.bill(requests, products, spark.createDataFrame([], CUST), spark.createDataFrame([], IDEM))
    assert [r.outcome for r in result.decisions.collect()] == ["REJECTED"]
    assert "ObjectHashAggregate" not in "".join(plans.values()) and "lambda" not in plans["requests"]
