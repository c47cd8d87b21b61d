from __future__ import annotations

import datetime as dt
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from shelfmark.functions import coerce, phrases, shaping, text as X, timing, validate
from shelfmark.functions.fingerprint import request_hash
from shelfmark.plans import reads

NOW = dt.datetime(2025, 1, 15, 12, 0)


def column(spark, values, dtype, build):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {dtype}")
    return [r[0] for r in rows.orderBy("i").select(build(F.col("v"))).collect()]


def test_int_and_float(spark):
    loose = [None, "", "7", "7.9", "bad", " 8 ", "-7.9", "1e3", "nan", "5d"]
    assert column(spark, loose, "string", coerce.int_or) == [0, 0, 7, 7, 0, 8, -7, 1000, 0, 0]
    assert column(spark, loose[:5], "string", lambda c: coerce.int_or(c, 3)) == [3, 3, 7, 7, 3]
    assert column(spark, loose[:5], "string", coerce.int_or_null) == [None, None, 7, None, None]
    assert column(spark, [None, "", "12.5", "9", "bad", "9f"], "string", coerce.float_or) == [0.0, 0.0, 12.5, 9.0, 0.0, 0.0]
    assert column(spark, ["12.5", "x", None], "string", coerce.float_or_null) == [12.5, None, None]


def test_timestamps(spark):
    loose = ["2025-01-01T10:00:00Z", "2025-01-01T10:00:00", "2025-01-01T12:00:00+02:00", "", "soon", "2025", None]
    ten = dt.datetime(2025, 1, 1, 10)
    assert column(spark, loose, "string", coerce.utc_timestamp) == [ten, ten, ten, None, None, None, None]
    stamps = [dt.datetime(2025, 1, 1, 10, 0, 0, 5), ten, None]
    assert column(spark, stamps, "timestamp", coerce.iso_utc) == [
        "2025-01-01T10:00:00.000005+00:00", "2025-01-01T10:00:00+00:00", None]
    assert column(spark, [1735725600], "bigint", coerce.epoch_seconds_timestamp) == [ten]


def test_keys_and_snapshot_ids(spark):
    rows = spark.createDataFrame([("a", "d"), ("", "d"), (None, "d")], "k string, _doc_id string")
    assert [r[0] for r in rows.select(coerce.key_or_document_id("k", "_doc_id")).collect()] == ["a", "d", "d"]
    at = [dt.datetime(2025, 1, 2, 3, 4, 5), dt.datetime(2025, 1, 2, 3, 4, 59)]
    assert set(column(spark, at, "timestamp", lambda c: coerce.minute_snapshot_id(F.lit("p"), c))) == {"p_20250102T0304"}


def test_expiry_is_three_functions(spark):
    day = dt.timedelta(days=1)
    expiry = [None, NOW - dt.timedelta(hours=1), NOW, NOW + 7 * day, NOW + 7 * day + dt.timedelta(hours=23), NOW + 9 * day]
    assert column(spark, expiry, "timestamp", lambda c: timing.expiry_status(c, NOW)) == [
        "OK", "EXPIRED", "EXPIRING_SOON", "EXPIRING_SOON", "OK", "OK"]
    assert column(spark, expiry, "timestamp", lambda c: timing.whole_days_to(c, NOW)) == [None, -1, 0, 7, 7, 9]
    assert column(spark, expiry, "timestamp", lambda c: timing.calendar_days_to(c, NOW)) == [None, 0, 0, 7, 8, 9]


def test_age_text(spark):
    ages = [None, dt.timedelta(hours=3), dt.timedelta(days=1, hours=2), dt.timedelta(days=6), dt.timedelta(days=40), -dt.timedelta(days=2)]
    created = [None if a is None else NOW - a for a in ages]
    assert column(spark, created, "timestamp", lambda c: timing.product_age_text(c, NOW)) == [
        "added recently", "added today", "added 1 day ago", "added 6 days ago", "added on Dec 06", "added today"]


def test_freshness(spark):
    minutes = [-5, 0, 30, 31, 120, 121]
    at = [NOW - dt.timedelta(minutes=m) for m in minutes] + [None]
    assert column(spark, at, "timestamp", lambda c: timing.freshness_by_age(c, NOW)) == [
        "fresh", "fresh", "fresh", "delayed", "delayed", "stale", "stale"]
    pairs = spark.createDataFrame([("fresh", " Stale "), ("stale", "fresh"), ("delayed", "odd"), ("fresh", None)], "a string, b string")
    assert [r[0] for r in pairs.select(timing.stricter_freshness(F.col("a"), F.col("b"))).collect()] == [
        "stale", "stale", "delayed", "fresh"]


def test_request_hash_is_canonical_json(spark):
    rows = spark.createDataFrame([([("b", 1), ("a", 2)],)], "items array<struct<product_id:string,quantity:bigint>>")
    got = rows.select(request_hash(F.lit("s"), F.lit(None).cast("string"), F.lit("cash"), F.col("items"))).first()[0]
    body = {"store_id": "s", "customer_id": None, "payment_method": "cash",
            "items": [{"product_id": "a", "quantity": 2}, {"product_id": "b", "quantity": 1}]}
    assert got == hashlib.sha256(json.dumps(body, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


MESSAGES = {
    "How is my business doing?": "business_summary",
    "What should I restock first": "reorder_decision",
    "Show today's sales": "sales_kpi",
    "Who are my loyal buyers": "customer_insight",
    "Any billion rupee ideas": "transaction_lookup",
    "What needs attention": "inventory_risk",
    "Tell me about Rice 5kg": "product_lookup",
    "Explain the dip": "reasoning",
    "hello": "general",
}


def test_nine_intents(spark):
    assert column(spark, list(MESSAGES), "string", X.intent) == list(MESSAGES.values())


def test_questions_and_answers(spark):
    assert column(spark, ["why now", "whyever", "business summary, explain", None], "string", X.asks_for_reasoning) == [True, False, False, False]
    assert column(spark, ["buy more", "hello"], "string", X.prefers_operator_answer) == [True, False]
    assert column(spark, ["I cannot answer that", "Rice is up"], "string", X.looks_like_refusal) == [True, False]
    noisy = "**Rice** is   up. Note: Analytics data is slightly delayed, so this answer uses the latest available snapshot."
    assert column(spark, [noisy], "string", X.clean_answer) == ["Rice is up."]
    assert column(spark, [" Rice, 5-KG! "], "string", X.normal) == ["rice 5 kg"]
    assert column(spark, ["Is it -Rice-, or rice? an A"], "string", X.spoken_tokens) == [["rice"]]
    assert column(spark, [" ".join(["w"] * 18), "a  b"], "string", X.word_count) == [18, 2]
    used = spark.createDataFrame([("any sales", "x"), ("any stock", "transactions"), ("hm", "leading sales"), ("hm", "x")], "q string, a string")
    assert [r[0] for r in used.select(X.analytics_used(F.col("q"), F.col("a"), F.lit(False))).collect()] == [True, False, True, False]


def test_phrase_lists_are_lower_case():
    for name, value in vars(phrases).items():
        if isinstance(value, tuple) and name != "FRESHNESS_NOTICES":
            assert all(v == v.lower() for v in value), name


def test_embedding_text(spark):
    rows = spark.createDataFrame([("p1", "Rice", "", 20.5, 3, None, "OK")],
                                 "id string, n string, c string, p double, q bigint, s string, e string")
    got = rows.select(X.embedding_text(*[F.col(c) for c in rows.columns])).first()[0]
    assert got == "Rice | product_id: p1 | price_in_inr: 20.5 | quantity_on_hand: 3 | expiry_status: OK"


def test_validation_splits(spark):
    schema = ("store_id string, idempotency_key string, customer_id string, payment_method string, "
              "items array<struct<product_id:string,quantity:bigint>>")
    rows = spark.createDataFrame([
        ("s", "k", None, "cash", [("a", 1)]), ("s", "", "", "gold", []), ("s", "k", None, "upi", [("", 1), ("a", 0)]),
        (None, "k", None, "card", None),
    ], schema)
    good, bad = validate.split_valid(rows, validate.sale_rules())
    assert good.count() == 1
    assert sorted(len(r.violations) for r in bad.collect()) == [1, 2, 4]
    inside, outside = validate.in_scope(rows, "s")
    assert (inside.count(), outside.count()) == (3, 1)


def test_query_arguments():
    assert reads.range_days("90d") == 90
    with pytest.raises(ValueError):
        reads.range_days("1y")
    with pytest.raises(ValueError):
        reads.sales_trend(None, as_of=NOW, granularity="hourly")


def test_shapes(spark):
    line = "struct<product_id:string,product_name:string,quantity:bigint,unit_price:decimal(18,2),line_total:decimal(18,2)>"
    rows = spark.createDataFrame([("s", "t", [(str(i), "n", i, None, None) for i in range(7)], NOW)],
                                 f"store_id string, transaction_id string, items array<{line}>, sale_timestamp timestamp")
    assert shaping.flat_lines(rows).count() == 7
    assert [i.product_id for i in rows.select(shaping.first_items(F.col("items")).alias("i")).first().i] == list("01234")
    out = coerce.for_output(rows).first()
    assert out.sale_timestamp == "2025-01-15T12:00:00+00:00"
