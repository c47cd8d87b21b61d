"""Batches of sale requests: idempotency, stock allocation, priced transactions, audit rows."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from shelfmark.functions.coerce import money
from shelfmark.functions.fingerprint import request_hash
from shelfmark.functions.validate import VIOLATIONS, sale_rules, split_valid
from shelfmark.operators.components import connected
from shelfmark.operators.customers import customer_rollup
from shelfmark.session import settings, settle

PRODUCT = ["store_id", "product_id"]
KEY = ["store_id", "idempotency_key"]
ORDER = ["requested_at", "seq"]


class BillingResult(NamedTuple):
    """``decisions``: every request with its outcome (ACCEPTED, REPLAY, CONFLICT, REJECTED), reason,
    transaction id and total. The other frames are rows to write: new transactions and audit rows,
    changed products (store_id, product_id, quantity_on_hand, updated_at) and customers, and
    idempotency rows, both new ones and those seen again."""

    decisions: DataFrame
    transactions: DataFrame
    adjustments: DataFrame
    products: DataFrame
    customers: DataFrame
    idempotency: DataFrame


def _request_sha(seq: Column | None = None) -> Column:
    return F.sha2(F.concat_ws("|", "store_id", (F.col("seq") if seq is None else seq).cast("string"), "idempotency_key"), 256)


GOODS = ["p", "quantity", "_left", "_rows"]
FOLDED = "part bigint, request_id bigint, accepted boolean"


def _serve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Serve requests in order, each with all its goods or none. Rows come sorted by part and order; what is left of
    the goods, and the keys used, are carried over batch borders and forgotten with the part."""
    part, left, used = None, {}, set()
    for rows in batches:
        accepted, end = [], 0
        now, store, key, count = (c.to_pylist() for c in (
            rows.column("part"), rows.column("store_id"), rows.column("idempotency_key"), pc.list_value_length(rows.column("goods"))))
        # The goods of all requests of the batch, one after another.
        p, quantity, had, copies = (c.to_pylist() for c in rows.column("goods").flatten().flatten())
        for at in range(rows.num_rows):
            if now[at] != part:
                part, left, used = now[at], {}, set()
            start, end = end, end + count[at]
            goods, name = range(start, end), (store[at], key[at])
            fits = name not in used and all(left.setdefault(p[i], had[i]) >= quantity[i] for i in goods)
            if fits:
                used.add(name)
                for i in goods:
                    left[p[i]] -= quantity[i] * copies[i]
            accepted.append(fits)
        yield pa.RecordBatch.from_arrays([rows.column("part"), rows.column("request_id"), pa.array(accepted, pa.bool_())], ["part", "request_id", "accepted"])


def goods_asked(wanted: DataFrame, products: DataFrame) -> DataFrame:
    """(store_id, product_id, p, _left, _rows, _short) of every product in ``wanted``: a number for it, what there is of it, how
    often it is stored, and whether less than is asked for; p is null if it is not stored."""
    given = products.where("store_id is not null and product_id is not null").groupBy(*PRODUCT).agg(
        F.min(F.coalesce("quantity_on_hand", F.lit(0).cast("bigint"))).alias("_left"), F.count(F.lit(1)).alias("_rows"))
    asked = wanted.groupBy(*PRODUCT).agg(F.sum("quantity").alias("_asked"))
    number = F.when(F.col("_left").isNotNull(), F.monotonically_increasing_id())
    return settle(asked.join(given, PRODUCT, "left").select(
        *PRODUCT, number.alias("p"), "_left", "_rows", (F.col("_asked") > F.col("_left")).alias("_short")), "stock")


def allocate(lines: DataFrame, opened: DataFrame, *, chunks: int | None = None, requests_per_turn: int = 200_000) -> DataFrame:
    """The ids of the requests that get their goods.

    ``lines``: request_id, p, quantity, _left, _rows, one row per request and product that runs short. ``opened``: request_id,
    store_id, idempotency_key, requested_at, seq of those to decide. In the order (requested_at, seq) of its store a request
    is accepted if every product it asks for still has enough; it takes all or nothing, and only the first accepted
    request of an idempotency key counts.

    Exact at every step:

    * a request that asks for more than there is of a product can never be accepted: it drops out;
    * a product that lasts for all requests that ask for it decides nothing, so its lines do not come here;
    * requests that share one of the products that run short, or a key, directly or through others, form a part; parts do not
      touch each other. A task serves whole parts in order. Of a part that is too large for one task the first
      ``requests_per_turn`` or so are served, and the rest is cut into parts again.

    One turn is enough if no part is that large, however long the chains of requests that wait for each other.
    """
    head = [*KEY, *ORDER]
    hopeless = F.col("quantity") > F.col("_left")

    def by_request(rows: DataFrame, heads: DataFrame) -> DataFrame:
        # Rows move before they are gathered: next to none of a request's goods lie in one task until then.
        goods = rows.repartition("request_id").groupBy("request_id").agg(F.bool_or(hopeless).alias("_never"), F.collect_list(F.struct(*GOODS)).alias("goods"))
        none = F.array().cast("array<struct<p:bigint,quantity:bigint,_left:bigint,_rows:bigint>>")
        return settle(heads.join(goods, "request_id", "left").where(~F.coalesce("_never", F.lit(False))).select(
            "request_id", *head, F.coalesce("goods", none).alias("goods")), "waiting")

    waiting = by_request(lines, opened.select("request_id", *head).dropDuplicates(["request_id"]))
    accepted = []
    while True:
        # A 64-bit hash stands for a key. Two things that share a number would only join two parts.
        key = F.xxhash64(F.lit("key"), *KEY)
        parts = connected(waiting.select(key.alias("u"), F.explode("goods.p").alias("v"))).withColumnRenamed("node", "_node")
        in_parts = waiting.join(parts, key == F.col("_node"), "left").withColumn("part", F.coalesce("part", key)).drop("_node")
        ends = waiting.select(key.alias("_node")).join(parts, "_node", "left")
        sizes = settle(ends.groupBy(F.coalesce("part", "_node").alias("part")).count().where(F.col("count") > requests_per_turn), "sizes")
        many = sizes.agg(F.sum("count")).first()[0]
        now = in_parts
        if many:
            dealt = settle(in_parts, "parts")
            large, now = dealt.join(sizes.select("part"), "part"), dealt.join(sizes, "part", "left_anti")
            turns = max(2, math.ceil(many / requests_per_turn))
            cut = settle(large.repartitionByRange(turns, "part", *ORDER).withColumn("_turn", F.spark_partition_id()), "turns")
            first = cut.groupBy("part").agg(F.min("_turn").alias("_turn"))
            now = now.unionByName(cut.join(first, ["part", "_turn"]).select(*now.columns))
            later = cut.join(first, ["part", "_turn"], "left_anti")
        ordered = (now.repartition(chunks, "part") if chunks else now.repartition("part")).sortWithinPartitions("part", *ORDER)
        served = settle(ordered.select("part", "request_id", *KEY, "goods", *ORDER).mapInArrow(_serve, FOLDED), "served")
        yes = served.where("accepted").select("request_id")
        accepted.append(yes)
        if not many or later.isEmpty():
            break
        done = waiting.join(yes, "request_id", "left_semi")
        taken = done.select(F.explode("goods").alias("g")).groupBy("g.p").agg(F.sum(F.col("g.quantity") * F.col("g._rows")).alias("_taken"))
        rest = later.join(done.select(*KEY), KEY, "left_anti")
        again = rest.select("request_id", F.explode("goods").alias("g")).select("request_id", "g.*")
        again = again.join(taken, "p", "left").withColumn("_left", F.col("_left") - F.coalesce("_taken", F.lit(0).cast("bigint")))
        waiting = by_request(again, rest.select("request_id", *head))
    return reduce(DataFrame.unionByName, accepted)


def among(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """``rows`` whose request_id is in ``ids``. Ids go as bitmaps, 4 KB for 32,768 numbers, so rows need not move as long as
    those are few enough to send to every task."""
    bucket, bit = F.bitmap_bucket_number("request_id"), F.bitmap_bit_position("request_id")
    bitmaps = settle(ids.groupBy(bucket.alias("_bucket")).agg(F.bitmap_construct_agg(bit).alias("_bits")), "bitmaps")
    at = rows.withColumn("_bucket", bucket).withColumn("_bit", bit.cast("int")).join(bitmaps, "_bucket")
    byte = F.conv(F.hex(F.expr("substring(_bits, _bit div 8 + 1, 1)")), 16, 10).cast("int")
    return at.where(F.getbit(byte, F.col("_bit") % 8) == 1).select(*rows.columns)


#: Lists are gathered from sorted rows: tables of them in memory are given up after a few groups and sorted then.
_GATHERING = {"spark.sql.execution.useObjectHashAggregateExec": "false"}


def bill(requests: DataFrame, products: DataFrame, customers: DataFrame, idempotency: DataFrame, *,
         created_by: str = "system", chunks: int | None = None) -> BillingResult:
    """Decide a batch of sale requests (schema ``sale_requests``; ``seq`` unique per store).

    Products and customers are checked before any stock is taken; a refused request leaves
    nothing behind, and its idempotency key stays free.
    """
    with settings(requests.sparkSession, _GATHERING):
        return _bill(requests, products, customers, idempotency, created_by=created_by, chunks=chunks)


def _bill(requests: DataFrame, products: DataFrame, customers: DataFrame, idempotency: DataFrame, *, created_by: str, chunks: int | None) -> BillingResult:
    none = F.lit(None).cast("string")
    valid, invalid = split_valid(requests, sale_rules())
    kept = settle(valid.withColumn("request_id", F.monotonically_increasing_id()), "requests")
    # Copies of one request count as one. Those that share a number are looked at whole.
    number = F.xxhash64(*KEY, *ORDER).alias("_number")
    twice = settle(kept.select(number).groupBy("_number").count().where("count > 1").select("_number"), "twice")
    copies = settle(kept.select("request_id", *KEY, *ORDER, number).join(twice, "_number").groupBy(*KEY, *ORDER).agg(
        F.min("request_id").alias("_one"), F.count(F.lit(1)).alias("_n")).where("_n > 1"), "copies")
    asked = kept.select("request_id", *KEY, *ORDER, "items")
    if not copies.isEmpty():
        same = [kept[c].eqNullSafe(copies[c]) for c in (*KEY, *ORDER)]
        kept = settle(kept.join(copies, same, "left").select(
            *[kept[c] for c in kept.columns if c != "request_id"], F.coalesce(copies["_one"], kept["request_id"]).alias("request_id")), "requests")
        asked = kept.groupBy("request_id", *KEY, *ORDER).agg(F.flatten(F.collect_list("items")).alias("items"))
    known = kept.withColumn("request_hash", request_hash(F.col("store_id"), F.col("customer_id"), F.col("payment_method"), F.col("items")))
    # A product that is listed twice counts once, with both quantities. Few requests do that, and the sum is slow.
    of = lambda product: F.aggregate(F.filter("items", lambda i: i["product_id"] == product), F.lit(0).cast("bigint"), lambda n, i: n + i["quantity"])
    different = F.array_distinct("items.product_id")
    summed = F.transform(different, lambda product: F.struct(product.alias("product_id"), of(product).alias("quantity")))
    needs = F.when(F.size(different) == F.size("items"), F.arrays_zip(F.col("items.product_id"), F.col("items.quantity"))).otherwise(summed)
    wanted = asked.select("request_id", "store_id", needs.alias("_needs")).select("request_id", "store_id", F.explode("_needs").alias("w")).select(
        "request_id", "store_id", "w.product_id", "w.quantity")
    goods = goods_asked(wanted, products)
    # What is not known is little as a rule and stands alone, so that whole requests need not move to be marked.
    unknown = settle(goods.where("p is null").select(*PRODUCT), "unknown")
    missing_product = settle(
        wanted.join(unknown, PRODUCT).groupBy("request_id").agg(F.sort_array(F.collect_set("product_id")).alias("missing_product_ids")), "missing")
    missing_customer = settle(kept.where("customer_id IS NOT NULL").select("request_id", "store_id", "customer_id").join(
        customers.select("store_id", "customer_id"), ["store_id", "customer_id"], "left_anti"
    ).select("request_id", F.lit(True).alias("_no_customer")), "strangers")
    stored = idempotency.select(
        *KEY, F.col("request_hash").alias("_stored_hash"), F.col("transaction_id").alias("_stored_id"),
        F.col("total_amount").alias("_stored_total"),
    )
    # Half a hash tells two payloads apart as well and is a quarter of the bytes to move.
    digest = F.unhex(F.substring("request_hash", 1, 32))
    checked = known.drop("items").join(missing_product, "request_id", "left").join(missing_customer, "request_id", "left").join(
        stored, KEY, "left").withColumn("_digest", digest).withColumn("_as_stored", F.col("_stored_hash") == F.col("request_hash"))
    open_requests = checked.where(
        F.col("_stored_hash").isNull() & F.col("missing_product_ids").isNull() & F.col("_no_customer").isNull()
    )
    lines = wanted.join(goods.where("_short").select(*PRODUCT, "p", "_left", "_rows"), PRODUCT).select("request_id", *GOODS)
    accepted = allocate(lines, open_requests.select("request_id", *KEY, *ORDER), chunks=chunks)
    won = settle(among(kept, accepted), "won")

    catalogue = products.select(*PRODUCT, F.col("name").alias("product_name"),
                                F.coalesce(money("price"), money(F.lit(0))).alias("unit_price"))
    sold = settle(
        won.select(*KEY, *ORDER, "request_id", F.posexplode("items").alias("pos", "line"))
        .select(*KEY, *ORDER, "request_id", "pos", F.col("line.product_id").alias("product_id"), F.col("line.quantity").alias("quantity"))
        .join(catalogue, PRODUCT)
        .withColumn("line_total", money(F.col("quantity") * F.col("unit_price"))),
        "sold",
    )
    # Ids are made after rows have moved.
    transaction_id = F.concat(F.lit("txn_"), F.substring(_request_sha(), 1, 32))
    owner_id = F.concat(F.lit("txn_"), F.substring(_request_sha(F.col("_owner_at.seq")), 1, 32))
    baskets = sold.groupBy("request_id").agg(
        F.sort_array(F.collect_list(F.struct("pos", "product_id", "product_name", "quantity", "unit_price", "line_total"))).alias("_lines"),
        money(F.sum("line_total")).alias("total_amount"),
    )
    bought = won.withColumn("request_hash", request_hash(F.col("store_id"), F.col("customer_id"), F.col("payment_method"), F.col("items")))
    owners = bought.join(baskets.select("request_id", "total_amount"), "request_id").select(
        *KEY, F.struct(*ORDER).alias("_owner_at"), F.col("request_hash").alias("_owner_hash"), digest.alias("_owner_digest"),
        F.col("total_amount").alias("_owner_total"), F.col("request_id").alias("_owner_request"),
    )

    rows = checked.join(owners.drop("_owner_hash"), KEY, "left")
    is_owner = F.coalesce(F.col("_owner_request") == F.col("request_id"), F.lit(False))
    earlier_owner = F.coalesce(F.col("_owner_at") < F.struct(*ORDER), F.lit(False))
    used_before = F.col("_stored_hash").isNotNull() | earlier_owner
    same = F.when(F.col("_stored_hash").isNotNull(), F.col("_as_stored")).otherwise(F.col("_owner_digest") == F.col("_digest"))
    outcome = (
        F.when(is_owner, F.lit("ACCEPTED"))
        .when(used_before & same, F.lit("REPLAY"))
        .when(used_before, F.lit("CONFLICT"))
        .otherwise(F.lit("REJECTED"))
    )
    reason = (
        F.when(F.col("outcome") == "CONFLICT", F.lit("IDEMPOTENCY_KEY_CONFLICT"))
        .when(F.col("outcome") != "REJECTED", none)
        .when(F.col("missing_product_ids").isNotNull(), F.lit("PRODUCT_NOT_FOUND"))
        .when(F.col("_no_customer"), F.lit("CUSTOMER_NOT_FOUND"))
        .otherwise(F.lit("INSUFFICIENT_STOCK"))
    )
    answered = F.col("outcome").isin("ACCEPTED", "REPLAY")
    decided = (
        rows.withColumn("outcome", outcome).withColumn("reason", reason)
        .withColumn("transaction_id", F.when(answered, F.coalesce("_stored_id", F.when(F.col("_owner_request").isNotNull(), owner_id))))
        .withColumn("total_amount", F.when(answered, F.coalesce("_stored_total", "_owner_total")))
    )
    report = ["store_id", "idempotency_key", "requested_at", "seq", "customer_id", "outcome", "reason",
              "transaction_id", "total_amount"]
    decisions = decided.select(*report, "missing_product_ids").unionByName(
        invalid.select(
            *report[:5], F.lit("REJECTED").alias("outcome"), F.concat_ws("; ", VIOLATIONS).alias("reason"),
            none.alias("transaction_id"), F.lit(None).cast("decimal(18,2)").alias("total_amount"),
            F.lit(None).cast("array<string>").alias("missing_product_ids"),
        )
    )

    transactions = won.join(baskets, "request_id").select(
        transaction_id.alias("transaction_id"), "store_id", "idempotency_key", "customer_id",
        F.lit("COMPLETED").alias("status"), "payment_method", "total_amount",
        F.col("requested_at").alias("sale_timestamp"), F.lit(created_by).alias("created_by"),
        F.col("requested_at").alias("created_at"),
        F.transform("_lines", lambda l: F.struct(
            l["product_id"].alias("product_id"), l["product_name"].alias("product_name"), l["quantity"].alias("quantity"),
            l["unit_price"].alias("unit_price"), l["line_total"].alias("line_total"))).alias("items"),
    )
    adjustments = sold.select(
        F.concat(F.lit("adj_"), F.substring(F.sha2(F.concat_ws("|", _request_sha(), F.col("pos").cast("string")), 256), 1, 32))
        .alias("adjustment_id"),
        "store_id", "product_id", F.lit("SALE_DEDUCTION").alias("adjustment_type"),
        F.col("quantity").alias("quantity_delta"),
        F.concat(F.lit("Billing transaction "), transaction_id).alias("reason"), transaction_id.alias("source_ref"),
        F.lit(created_by).alias("created_by"), F.col("requested_at").alias("created_at"),
    )
    deducted = sold.groupBy(*PRODUCT).agg(F.sum("quantity").alias("_sold"), F.max("requested_at").alias("_sold_at"))
    changed_products = products.join(deducted, PRODUCT).select(
        *PRODUCT, (F.col("quantity_on_hand") - F.col("_sold")).alias("quantity_on_hand"), F.col("_sold_at").alias("updated_at")
    )
    changed_customers = customer_rollup(
        customers, transactions.select("store_id", "customer_id", "total_amount", "sale_timestamp")
    )
    seen = decided.where(F.col("outcome").isin("ACCEPTED", "REPLAY")).groupBy(*KEY).agg(
        F.max("requested_at").alias("_seen")
    )
    fresh_keys = owners.select(
        *KEY, F.col("_owner_hash").alias("request_hash"), owner_id.alias("transaction_id"),
        F.lit("COMPLETED").alias("result_status"), F.col("_owner_total").alias("total_amount"),
        F.col("_owner_at.requested_at").alias("created_at"),
    )
    old_keys = idempotency.select(*fresh_keys.columns)
    touched_keys = fresh_keys.unionByName(old_keys).join(seen, KEY).withColumnRenamed("_seen", "last_seen_at")
    return BillingResult(decisions, transactions, adjustments, changed_products, changed_customers, touched_keys)


def replay_responses(decisions: DataFrame, transactions: DataFrame) -> DataFrame:
    """What a repeated request is answered: id, status and total of the stored transaction."""
    stored = transactions.select("transaction_id", "status")
    return decisions.where("outcome = 'REPLAY'").join(stored, "transaction_id").select(
        "store_id", "idempotency_key", "seq", F.lit(True).alias("idempotent_replay"), "transaction_id", "status", "total_amount"
    )
