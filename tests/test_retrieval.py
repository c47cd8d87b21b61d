"""Matching, ranking, briefings and evidence against plain Python on small inputs."""

from __future__ import annotations

import datetime as dt
import json
import math
import random
import re
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from shelfmark.operators import advice, focus, hybrid, lexical, sessions, vectors
from shelfmark.operators.matching import _looked_up, substring_matches
from shelfmark.plans import answers, briefing, marts, reads
from shelfmark.registry import retrieval_queries

NOW = dt.datetime(2025, 3, 1, 12, 0)
DAY = dt.timedelta(days=1)
ASK = "store_id string, query_id string, query_text string"


def norm(text):
    return re.sub(r"\s+", " ", re.sub(r"[^a-z0-9]+", " ", text.lower())).strip()


def score(query, pid, name, category):
    q, n, c, i = norm(query), norm(name), norm(category), norm(pid)
    if not q:
        return 0.0
    total = (1.0 if n and n in q else 0) + (0.9 if n and q in n else 0) + (0.95 if i and i in q else 0)
    tokens = [t for t in q.split(" ") if len(t) >= 3]
    if tokens and n:
        total += min(sum(t in n for t in tokens) / len(tokens), 0.8)
    if tokens and c:
        total += min(sum(t in c for t in tokens) / len(tokens), 0.3)
    return total


WORDS = ["rice", "red rice", "oil", "tv", "a b", "basmati rice 5kg", "ghee", "soap bar", "bar", "Étoile", "", "long grain rice", "olive oil extra"]


@pytest.mark.parametrize("seed", [1, 2])
def test_best_by_text_same_as_all_pairs(spark, seed):
    rng = random.Random(seed)
    products = [(s, f"{'sku-' if n % 2 else ''}{n}", rng.choice(WORDS), rng.choice(["food", "rice", "", "home oil"])) for s in ("s1", "s2") for n in range(40)]
    asked = [("s1", f"q{n}", " ".join(rng.choice(WORDS + ["earring", "sku 7", "12", "price"]) for _ in range(rng.randint(0, 4)))) for n in range(40)]
    got = {}
    for r in lexical.best_by_text(spark.createDataFrame(asked, ASK), spark.createDataFrame(products, "store_id string, product_id string, name string, category string")).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.product_id, round(r.score, 9)))
    for store, query_id, text in asked:
        ranked = sorted(((-score(text, p, n, c), p) for s, p, n, c in products if s == store))[:4]
        assert sorted(got[query_id]) == [(i + 1, p, round(-v, 9)) for i, (v, p) in enumerate(ranked)], text


def test_substring_matches(spark):
    rng = random.Random(6)
    texts = ["abcdefghijkl", "xabcdefgh", "short", "s", "", "red gear box", "covered gears", "red  gear", "a\tb c", " ", "日本 text"]
    texts += [" ".join("".join(rng.choice("ab1") for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(1, 4))) for _ in range(60)]
    probes = ["abcdefghi", "abcdefgh", "hort", "s", "zzz", "", "abcdefghx", "red gear", "ed gea", "d g", "r", "b c", "本", "日本 t", " ", "gear  "]
    probes += [" ".join("".join(rng.choice("ab1") for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(1, 2))) for _ in range(60)]
    t = spark.createDataFrame([(s, x) for x in texts for s in ("s", "r")] + [("only", "abc")], "store_id string, text string")
    p = spark.createDataFrame([("s", x) for x in probes] + [("r", "ab"), ("only", "bc"), ("none", "a")], "store_id string, probe string")
    want = {("s", a, b) for a in probes for b in texts if a.strip() and a in b} | {("r", "ab", b) for b in texts if "ab" in b} | {("only", "bc", "abc")}
    rows = substring_matches(p, t, probe="probe", text="text").collect()
    assert {tuple(r) for r in rows} == want and len(rows) == len(want)


def test_long_numbers_are_looked_up_by_longer_runs(spark):
    rng = random.Random(8)
    numbers = sorted({str(rng.randint(1_000_000, 9_999_999)) for _ in range(4000)})
    asked = sorted({str(rng.randint(100_000, 9_999_999)) for _ in range(200)} | {n[:6] for n in numbers[:20]} | {"123", "45", "98765"})
    words = spark.createDataFrame([("s", n) for n in numbers], "store_id string, _word string")
    pieces = spark.createDataFrame([("s", a) for a in asked], "store_id string, _piece string")
    found = _looked_up(pieces, words).collect()
    assert sum(len(r._piece) >= 6 for r in found) < 100
    assert {(r._piece, r._word) for r in found if r._piece in r._word} == {(a, n) for a in asked for n in numbers if a in n}


def test_per_text_works_once_on_every_different_text(spark):
    rng = random.Random(9)
    texts = ["tell me about red rice", "rice, oil?", "hello there", "", None, "soap bar"]
    products = spark.createDataFrame([(f"s{n % 2}", f"p{n:03d}", rng.choice(WORDS + ["red rice"] * 9)) for n in range(120)], "store_id string, product_id string, name string")
    asked = [(f"s{n % 2}", f"q{n % 70}", texts[n % 6 if n < 70 else (n + n // 35) % 6]) for n in range(140)] + [(None, "lost", "red rice"), ("s1", None, "soap bar")]
    asked = spark.createDataFrame(asked, ASK)
    seen = []

    def work(some):
        seen.append(some.count())
        return focus.product_snapshot(some, products, limit=5).select("store_id", "query_id", "product_id", "focused", "rank")

    got = sorted(map(repr, focus.per_text(asked, work, texts_per_task=3).collect()))
    want = sorted(map(repr, focus.product_snapshot(asked, products, limit=5).select("store_id", "query_id", "product_id", "focused", "rank").collect()))
    assert got == want and seen[0] < 70


def test_first_rows_of_a_shared_name_come_once_each(spark):
    """Copies of a row, and other rows of the same name, do not push out rows that should be listed."""
    rows = [("s", f"p{n:02d}", "red rice") for n in range(9) for _ in range(3)] + [("s", "p90", "rice oil"), ("s", "p005", "brown rice")]
    asked = spark.createDataFrame([("s", "q", "rice")], ASK)
    got = focus.product_snapshot(asked, spark.createDataFrame(rows, "store_id string, product_id string, name string"), limit=4).collect()
    assert sorted((r["rank"], r.product_id, r.focused) for r in got) == [(1, "p00", True), (2, "p005", True), (3, "p01", True), (4, "p02", True)]


def test_store_context_reads_the_sold_lines_once(spark, sf):
    assert not [f for f in retrieval_queries._context(spark, sf).inputFiles() if "lineitem" in f]


@pytest.mark.parametrize("block", [3, 1000])
def test_nearest_same_as_all_pairs(spark, block):
    rng = random.Random(5)
    vecs = [("s1" if n % 3 else "s2", f"p{n:02d}", [round(rng.uniform(-1, 1), 1) for _ in range(3)]) for n in range(30)]
    vecs += [("s1", "dup1", [1.0, 0.0, 0.0]), ("s1", "dup2", [2.0, 0.0, 0.0]), ("s1", "zero", [0.0, 0.0, 0.0]), ("s1", "none", None)]
    asked = [("s1", f"q{n}", [rng.uniform(-1, 1) for _ in range(3)]) for n in range(7)] + [("s1", "p01", vecs[1][2]), ("s9", "lost", [1.0, 0.0, 0.0])]

    def distance(a, b):
        dot = sum(x * y for x, y in zip(a, b))
        return round(1 - dot / math.sqrt(sum(x * x for x in a)) / math.sqrt(sum(x * x for x in b)), 9)

    got = {}
    rows = vectors.nearest(spark.createDataFrame(asked, "store_id string, query_id string, embedding array<double>"),
                           spark.createDataFrame(vecs, "store_id string, product_id string, embedding array<double>"), k=4, block=block, skip_same=True)
    for r in rows.collect():
        got.setdefault(r.query_id, []).append((r.rank, r.product_id, r.distance))
    for s, q, e in asked:
        want = sorted((distance(e, v), p) for vs, p, v in vecs if vs == s and p != q and v and any(v))[:4]
        assert [(p, pytest.approx(d, abs=1e-8)) for _, p, d in sorted(got.get(q, []))] == [(p, d) for d, p in want]


def test_hybrid_merge(spark):
    asked = spark.createDataFrame([("s", "q", "blue rice")], ASK)
    products = spark.createDataFrame([("s", "1", "rice", "x"), ("s", "2", "oil", "x"), ("s", "3", "blue rice", "x")], "store_id string, product_id string, name string, category string")
    hits = spark.createDataFrame([("s", "q", "2", 0.1, "oil", None), ("s", "q", "gone", 0.3, "blue", "x"), ("s", "q", "3", 1.9, None, None)],
                                 "store_id string, query_id string, product_id string, distance double, product_name string, category string")
    rows = hybrid.hybrid_matches(asked, products, hits)
    got = [(r.product_id, round(r.score, 6)) for r in rows.orderBy("rank").collect()]
    # "3": name in question, question in name, all tokens; "2": 0.65 + 0.9; "1": name in question, half the tokens;
    # "gone" is not listed: its text score 1.5 beats 0.55 + 0.7.
    assert got == [("3", 2.7), ("2", 1.55), ("1", 1.5), ("gone", 1.5)]
    assert hybrid.confidences(rows).first().confidence == 1.0


def test_focus_first_same_as_scan(spark):
    rng = random.Random(3)
    names = ["Asha Rao", "Rao Dev", "Devi", "Mina", "Customer One", "customer two"]
    people = [("s", f"c{n:02d}", rng.choice(names), f"+91{n:03d}", Decimal(rng.randint(0, 5)), rng.randint(0, 3)) for n in range(40)]
    asked = [("s", "q1", "what about rao?"), ("s", "q2", "customer c07 and 912"), ("s", "q3", "hi"), ("s", "q4", "-Devi- or MINA!")]
    got = focus.customer_snapshot(spark.createDataFrame(asked, ASK), spark.createDataFrame(
        people, "store_id string, customer_id string, name string, phone string, total_spend decimal(18,2), visit_count int"), limit=6)
    rows = {}
    for r in got.collect():
        rows.setdefault(r.query_id, []).append((r.rank, r.customer_id, r.focused))
    for _, q, text in asked:
        tokens = {t.strip(".,!?-_/").lower() for t in text.split()}
        tokens = {t for t in tokens if len(t) >= 3}
        hit = lambda p: any(t in h.lower() for t in tokens for h in (p[1], p[2], p[3]))
        want = sorted(people, key=lambda p: (not hit(p), -p[4], -p[5], p[1]))[:6]
        assert sorted(rows[q]) == [(i + 1, p[1], hit(p)) for i, p in enumerate(want)]


def test_transaction_snapshot_takes_named_sales(spark):
    sales = [("s", f"t{n}", f"c{n % 3}", NOW - n * DAY) for n in range(12)]
    heads = spark.createDataFrame(sales, "store_id string, transaction_id string, customer_id string, sale_timestamp timestamp")
    lines = spark.createDataFrame([("s", "rice", f"t{n}", NOW - n * DAY) for n in (9, 10, 11)], "store_id string, product_id string, transaction_id string, sale_timestamp timestamp")
    asked = spark.createDataFrame([("s", "q", "rice sales")], ASK)
    found = spark.createDataFrame([("s", "q", "rice")], "store_id string, query_id string, product_id string")
    also = focus.recent_sales_of(found, lines, on="product_id", limit=2)
    rows = focus.transaction_snapshot(asked, heads, limit=4, also=also).orderBy("rank").collect()
    assert [(r.transaction_id, r.focused) for r in rows] == [("t9", True), ("t10", True), ("t0", False), ("t1", False)]


PRODUCTS = ("store_id string, product_id string, name string, category string, price decimal(18,2), quantity_on_hand bigint, "
            "reorder_threshold bigint, expiry_date timestamp, status string, created_at timestamp, updated_at timestamp")


def shop(spark, *rows):
    """rows: id, name, quantity, threshold, expiry, created"""
    return spark.createDataFrame([("s", i, n, "Snacks", Decimal("20.00"), q, t, e, "ACTIVE", c, c) for i, n, q, t, e, c in rows], PRODUCTS)


def test_risk_reorder_newest(spark):
    products = shop(spark, ("a", "Milk", 6, 8, NOW + DAY, NOW - 30 * DAY), ("b", "Bread", 0, 6, NOW - DAY, NOW - 5 * DAY), ("c", "Salt", 50, 5, None, NOW))
    assert [(r.product_id, r.risk) for r in advice.risk_ranking(products, as_of=NOW).orderBy("rank").collect()] == [("b", 7), ("a", 5)]
    sellers = lambda name: spark.createDataFrame([("s", name)], "store_id string, top_selling_product string")
    assert advice.reorder_priority(products, sellers("Salt")).first().product_id == "b"
    assert advice.reorder_priority(products, sellers(" MILK ")).first().product_id == "a"
    assert advice.newest_product(products).first().product_id == "c"


@pytest.fixture
def facts(spark):
    products = shop(spark, ("a", "Milk", 5, 8, NOW + DAY, NOW - 2 * DAY), ("b", "Bread", 0, 6, NOW - DAY, NOW - 25 * DAY), ("c", "Salt", 50, 5, None, NOW - 30 * DAY))
    dashboards = spark.createDataFrame([("s", NOW.date(), Decimal("12450.40"), 81, 0, 2, "Milk")],
                                       "store_id string, snapshot_date date, today_sales decimal(18,2), today_transactions bigint, active_alert_count bigint, low_stock_count bigint, top_selling_product string")
    alerts = spark.createDataFrame([("s", "x1", "ACTIVE", "Bread stock is low", "HIGH", "b"), ("s", "x2", "RESOLVED", "old", "LOW", "a")],
                                   "store_id string, alert_id string, status string, title string, severity string, source_entity_id string")
    summary = spark.createDataFrame([("s", "c1", "Asha", Decimal("3140"), 9, NOW), ("s", "c2", "Dev", Decimal("1860"), 4, None)],
                                    "store_id string, customer_id string, customer_name string, lifetime_spend decimal(18,2), visit_count bigint, last_purchase_at timestamp")
    sales = spark.createDataFrame([("s", "t1", Decimal("99.60"), "upi", NOW - DAY)], "store_id string, transaction_id string, total_amount decimal(18,2), payment_method string, sale_timestamp timestamp")
    stores = spark.createDataFrame([("s",), ("empty",)], "store_id string")
    return products, alerts, briefing.store_facts(stores, dashboards, products, alerts, summary, sales, as_of=NOW)


def test_briefing_texts(spark, facts):
    rows = {r.store_id: r for r in briefing.briefings(facts[2], as_of=NOW).collect()}
    full, empty = rows["s"], rows["empty"]
    assert full.business_summary == ("Your store has 12450 in sales across 81 transactions today. Milk is the current top-selling product. "
                                     "There are 1 active alerts that need attention.")
    assert full.reorder.startswith("You should reorder Milk first. It is currently your top-selling product and has 5 units on hand against a reorder threshold of 8.")
    assert full.newest_product == ("The newest product I can see is Milk in Snacks, added 2 days ago. It is priced at 20.0 and currently has 5 units on hand. "
                                   "It is already near or below its reorder threshold, so it needs replenishment planning.")
    assert "Top attention items are Bread (0 units, expired), Milk (5 units, expiring_soon)." in full.inventory_status
    assert full.inventory_status.startswith("I can see 3 active products in the current inventory snapshot. 2 are at or below reorder threshold. 2 are expired or expiring soon.")
    assert full.customers_text.startswith("Your top customers right now are Asha (3140 spend, 9 visits), Dev (1860 spend, 4 visits). Asha was last seen on 2025-03-01 12:00 UTC.")
    assert full.transactions_text == "The most recent transactions I can see are t1 for 100 via upi. The latest one was recorded on 2025-02-28 12:00 UTC."
    assert full.focus.startswith("Your first priority is Bread stock is low. The most urgent inventory item is Bread with 0 units left and status expired. Keep Milk available")
    assert full.sales_text.startswith("Today's confirmed sales are 12450 across 81 transactions. Milk is the current top-selling product. 2 products are already low")
    assert full.top_seller.startswith("Milk is the current top-selling product. Today's store snapshot shows 12450 in sales across 81 transactions.")
    assert empty.business_summary is None and empty.sales_text is None and empty.focus is None
    assert empty.top_seller.startswith("I could not load") and empty.reorder.startswith("I could not load") and empty.inventory_status.startswith("I could not load")


def test_operator_and_direct_answers(spark, facts):
    products, _, rows = facts
    texts = briefing.briefings(rows, as_of=NOW)
    asked = spark.createDataFrame([("s", "1", "how is my business"), ("s", "2", "what should i order"), ("s", "3", "about salt"), ("s", "4", "hello"),
                                   ("s", "5", "items zzz"), ("s", "6", "what needs attention"), ("s", "7", "reorder milk?"), ("s", "8", "Milk")], ASK)
    asked = answers.with_intent(asked)
    chosen = {r.query_id: r.answered_by for r in answers.operator_answers(asked, texts).collect()}
    assert chosen == {"1": "business_summary", "2": "reorder", "3": None, "4": None, "5": "inventory_status", "6": "focus", "7": "reorder", "8": None}
    none = spark.createDataFrame([], "store_id string, query_id string, product_id string, distance double")
    matched = answers.match_facts(hybrid.hybrid_matches(asked, products, none), products, as_of=NOW)
    direct = answers.direct_answers(asked, matched, texts, rows)
    got = {r.query_id: r for r in direct.collect()}
    assert got["3"].direct_answer == "Matched product details: Salt: qty=50, reorder=5, expiry=OK, price=20.0."
    assert (got["3"].answer_mode, got["3"].route, got["3"].refused) == ("retrieval_only", "fast", False)
    assert got["5"].direct_answer == answers.NO_MATCH and got["5"].refused and got["5"].route == "reasoning"
    assert got["7"].direct_answer.startswith("Restock priority is Milk: qty=5, reorder=8, expiry=EXPIRING_SOON, price=20.0. It is at or below")
    assert got["6"].direct_answer.startswith("I can see 3 active products") and got["6"].answer_mode == "retrieval_only"
    assert got["1"].answer_mode == "retrieval_only" and got["4"].answer_mode == "model"
    final = {r.query_id: r.answer for r in answers.finalize_answers(direct.withColumn("answer", F.lit("**It** is  there."))).collect()}
    assert final["3"] == "Salt: It is there." and final["5"] == answers.NO_MATCH and final["4"] == "It is there."


def test_evidence(spark, facts):
    products, alerts, _ = facts
    asked = answers.with_intent(spark.createDataFrame([("s", "q", "about milk")], ASK))
    hits = spark.createDataFrame([("s", "q", "a", 0.2, "Milk", "Snacks", 1)], "store_id string, query_id string, product_id string, distance double, product_name string, category string, rank int")
    found = hybrid.hybrid_matches(asked, products, hits)
    people = spark.createDataFrame([], "store_id string, query_id string, customer_id string, name string, total_spend decimal(18,2), visit_count bigint, rank int")
    sales = spark.createDataFrame([("s", "q", "t1", Decimal("5.50"), NOW, 1)], "store_id string, query_id string, transaction_id string, total_amount decimal(18,2), sale_timestamp timestamp, rank int")
    one = lambda **v: spark.createDataFrame([("s", *v.values())], "store_id string, " + ", ".join(f"{k} string" for k in v))
    from shelfmark.operators.alert_book import relevant_alerts
    row = answers.evidence(asked, answers.match_facts(found, products, as_of=NOW), hits, relevant_alerts(alerts), people, sales,
                           one(analytics_summary="a=1"), one(freshness_status="fresh")).first()
    pack = json.loads(row.evidence)
    assert list(pack) == sorted(pack) and pack["intent"] == "product_lookup" and pack["customers"] == []
    assert pack["matched_products"][0] == {"product_id": "a", "name": "Milk", "category": "Snacks", "quantity_on_hand": 5, "reorder_threshold": 8,
                                           "expiry_status": "EXPIRING_SOON", "price": 20.0}
    assert pack["transactions"] == [{"transaction_id": "t1", "total_amount": 5.5, "sale_timestamp": "2025-03-01T12:00:00+00:00"}]
    assert row.alerts_used == ["x1"] and row.rag_products_used == ["a"] and row.citations[0].id == "a"
    related = answers.related_products(found, relevant_alerts(alerts), k=8).orderBy("rank").collect()
    assert [r.product_id for r in related] == ["a", "b", "c"]


def test_sales_direction_and_summary(spark):
    sales = spark.createDataFrame([("s", dt.date(2025, 3, 1), Decimal("12450"), 81), ("s", dt.date(2025, 2, 28), Decimal("11800"), 77), ("t", dt.date(2025, 3, 1), Decimal("1"), 1)],
                                  "store_id string, sales_date date, total_sales decimal(18,2), transaction_count bigint")
    assert {r.store_id: r.direction for r in reads.sales_direction(sales).collect()} == {"s": "up", "t": None}


def test_embedding_rows_and_failed_batch(spark):
    products = shop(spark, *[(f"p{n}" if n else "", f"N{n}", 1, 1, None, NOW) for n in range(5)])

    def embed(texts):
        if any("N4" in t for t in texts):
            raise RuntimeError("down")
        return [[float(len(t)), 1.0] for t in texts]

    rows = vectors.product_embeddings(products, vectors.batched_vectoriser(embed, size=1), as_of=NOW).collect()
    assert {r.product_id for r in rows} == {"p1", "p2", "p3"}
    assert rows[0].embedding == [float(len(rows[0].embedding_text)), 1.0]


def test_sessions(spark):
    rows = [("s", "c", f"m{n:02d}", "user", str(n), NOW + dt.timedelta(seconds=n)) for n in range(60)]
    messages = spark.createDataFrame(rows, "store_id string, chat_session_id string, message_id string, role string, text string, created_at timestamp")
    assert [r.text for r in sessions.session_history(messages, limit=2).orderBy("position").collect()] == ["0", "1"]
    assert [r.text for r in sessions.session_history(messages, limit=2, latest=True).orderBy("position").collect()] == ["59", "58"]
    owner = spark.createDataFrame([("c", "other")], "chat_session_id string, store_id string")
    assert sessions.session_history(messages, sessions=owner).count() == 0
    stored = spark.createDataFrame([("c", NOW - DAY)], "chat_session_id string, created_at timestamp")
    row = sessions.touched_sessions(messages.withColumn("user_id", F.lit("u")), stored).first()
    assert (row.created_at, row.last_query_at) == (NOW - DAY, NOW + dt.timedelta(seconds=59))


def test_same_day_rename_gives_one_row(spark):
    items = spark.createDataFrame([("s", "p", "Old", 1, Decimal("1.00"), NOW), ("s", "p", "New", 2, Decimal("2.00"), NOW)],
                                  "store_id string, product_id string, product_name string, quantity bigint, line_total decimal(18,2), sale_timestamp timestamp")
    row = marts.product_sales_daily(items).collect()
    assert [(r.product_name, r.quantity_sold, r.revenue) for r in row] == [("Old", 3, Decimal("3.00"))]


def test_evidence_pack_sends_no_more_than_a_megabyte_to_every_task(spark, sf, monkeypatch):
    from shelfmark.registry import QUERIES, retrieval_queries

    limits, settle = [], retrieval_queries.settle
    monkeypatch.setattr(retrieval_queries, "settle", lambda df, *a: (limits.append(spark.conf.get("spark.sql.autoBroadcastJoinThreshold")), settle(df, *a))[1])
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    packs = QUERIES["evidence_pack"](spark, sf)
    # The caller runs what is returned under a limit of its own, so no join is left in it.
    assert set(limits) == {"1m"} and "Join" not in packs._jdf.queryExecution().optimizedPlan().toString()
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == before
    assert packs.count() > 0 and packs.where("evidence is null").count() == 0
