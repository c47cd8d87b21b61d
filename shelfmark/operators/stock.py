"""Stock: new products, patches, and adjustments that never make a quantity negative."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from shelfmark.functions.coerce import money
from shelfmark.functions.timing import expiry_status, instant
from shelfmark.functions.validate import (
    VIOLATIONS, adjustment_rules, new_product_rules, product_patch_rules, split_valid,
)
from shelfmark.operators.running import CHUNK, chained_before, in_order_chunks
from shelfmark.schemas import SUBTRACTING_TYPES
from shelfmark.session import settle

KEYS = ["store_id", "product_id"]


class NewProducts(NamedTuple):
    created: DataFrame
    rejected: DataFrame


def create_products(requests: DataFrame, *, as_of) -> NewProducts:
    """``requests``: product_id, store_id, name, category, price, quantity, reorder_threshold, expiry_date, status."""
    valid, rejected = split_valid(requests.withColumn("status", F.coalesce("status", F.lit("ACTIVE"))), new_product_rules())
    created = valid.select(
        "store_id", "product_id", "name", "category", money("price").alias("price"),
        F.col("quantity").cast("bigint").alias("quantity_on_hand"), F.col("reorder_threshold").cast("bigint"),
        "expiry_date", expiry_status(F.col("expiry_date"), as_of).alias("expiry_status"), "status",
        instant(as_of).alias("created_at"), instant(as_of).alias("updated_at"),
    )
    return NewProducts(created, rejected)


class PatchResult(NamedTuple):
    changed: DataFrame
    rejected: DataFrame


def patch_products(products: DataFrame, patches: DataFrame, *, as_of) -> PatchResult:
    """Change only the given fields. ``patches``: store_id, product_id, name, category, price,
    reorder_threshold, status, expiry_date, expiry_given; one row per product. ``expiry_given`` tells
    a removed expiry date from an untouched one. The expiry status is derived anew in any case."""
    valid, invalid = split_valid(patches, product_patch_rules())
    known = products.select(*KEYS)
    unknown = valid.join(known, KEYS, "left_anti").withColumn(VIOLATIONS, F.array(F.lit("PRODUCT_NOT_FOUND")))
    patch = valid.select(*KEYS, F.struct(
        "name", "category", "price", "reorder_threshold", "status", "expiry_date", "expiry_given").alias("p"))
    rows = products.join(patch, KEYS)
    expiry = F.when(F.col("p.expiry_given"), F.col("p.expiry_date")).otherwise(F.col("expiry_date"))
    replaced = {c: F.coalesce(F.col(f"p.{c}"), F.col(c)) for c in ("name", "category", "price", "reorder_threshold", "status")}
    replaced |= {"expiry_date": expiry, "expiry_status": expiry_status(expiry, as_of), "updated_at": instant(as_of)}
    columns = [*products.columns, *[c for c in ("expiry_status",) if c not in products.columns]]
    changed = rows.select(*[replaced[c].alias(c) if c in replaced else F.col(c) for c in columns])
    return PatchResult(changed, invalid.unionByName(unknown))


# --- adjustments -------------------------------------------------------------------------------


class StockResult(NamedTuple):
    """``decisions``: every adjustment with accepted, refusal, quantity_before, quantity_after.
    ``products``: store_id, product_id, quantity_on_hand, updated_at of products that changed."""

    decisions: DataFrame
    products: DataFrame


BLOCK = 128  # rows that are looked at together
_LONG = "bigint"


def _after(stock: Column, delta: Column) -> Column:
    """The stock after an adjustment, which does nothing if it does not fit."""
    return F.when(stock + delta >= 0, stock + delta).otherwise(stock)


def _sum_and_low(parts: Column, total, low) -> Column:
    """(total, low) of ordered parts in a row: their sum, and the least that is reached on the way."""
    none = F.struct(F.lit(0).cast(_LONG).alias("total"), F.lit(None).cast(_LONG).alias("low"))
    return F.aggregate(parts, none, lambda run, part: F.struct(
        (run["total"] + total(part)).alias("total"), F.least(run["low"], run["total"] + low(part)).alias("low")))


def _starts(parts: Column, start: Column, end) -> Column:
    """(stock, starts): the stock behind ordered parts, and that before each of them; ``end`` leads over a part."""
    none = F.struct(start.alias("stock"), F.array().cast("array<bigint>").alias("starts"))
    return F.aggregate(parts, none, lambda run, part: F.struct(
        end(run["stock"], part).alias("stock"), F.concat(run["starts"], F.array(run["stock"])).alias("starts")))


def _one_by_one(rows: Column, start: Column) -> Column:
    """For each row of a block the stock before it and whether it fits."""
    none = F.struct(start.alias("stock"), F.array().cast("array<struct<before:bigint,fits:boolean>>").alias("seen"))
    step = lambda run, row: F.struct(
        _after(run["stock"], row["delta"]).alias("stock"),
        F.concat(run["seen"], F.array(F.struct(run["stock"].alias("before"), (run["stock"] + row["delta"] >= 0).alias("fits")))).alias("seen"))
    return F.aggregate(rows, none, step, lambda run: run["seen"])


def _fold_in_chunks(opening: DataFrame, lines: DataFrame, chunks: int | None) -> tuple[DataFrame, DataFrame]:
    """(decisions, changed products) of products whose rows lie in several partitions.

    Rows lie in blocks, blocks in chunks, each with its sum and the lowest sum on the way. A block or chunk
    that stays at or above zero from its start is accepted whole, from these two numbers alone. Only a product's
    first chunk that runs short is folded, which settles the stock that the next chunks start from; within it only
    the blocks that run short are visited row by row. This repeats while any chunk runs short: a round folds one
    chunk of every such product in parallel. All of it is column expressions.
    """
    order = ["created_at", "adjustment_id"]
    # The number that Spark gives a row of a sorted partition grows by one a row; its upper bits are the partition's.
    placed = in_order_chunks(lines, KEYS, order, chunks).sortWithinPartitions(*KEYS, *order).withColumn("place", F.monotonically_increasing_id())
    packed = placed.groupBy(*KEYS, CHUNK, F.expr(f"place div {BLOCK}").alias("block")).agg(
        F.sort_array(F.collect_list(F.struct("place", "delta", "row"))).alias("rows"), F.max("created_at").alias("last"))
    delta = lambda row: row["delta"]
    blocks = settle(packed.withColumn("sums", _sum_and_low(F.col("rows"), delta, delta)), "blocks")
    own = lambda name: lambda part: part[name]
    per_chunk = blocks.groupBy(*KEYS, CHUNK).agg(F.sort_array(F.collect_list(F.struct("block", "sums.total", "sums.low"))).alias("parts"), F.max("last").alias("_last"))
    summary = settle(
        per_chunk.withColumn("sums", _sum_and_low(F.col("parts"), own("total"), own("low"))).join(opening, KEYS).select(
            *KEYS, CHUNK, "parts", F.col("sums.total").alias("_total"), F.col("sums.low").alias("_low"), "_last", "_opening",
            F.lit(None).cast("array<bigint>").alias("_starts")),
        "chunk-sums",
    )
    while True:
        chain = chained_before(summary.drop("parts"), KEYS, "_total", "_earlier").withColumn("_before", F.col("_opening") + F.col("_earlier"))
        short = chain.where(F.col("_starts").isNull() & (F.col("_before") + F.col("_low") < 0))
        first = short.groupBy(*KEYS).agg(F.min_by(F.struct(CHUNK, "_before"), CHUNK).alias("f")).select(*KEYS, "f.*")
        deltas = F.transform("rows", delta)
        to_fold = blocks.join(first, [*KEYS, CHUNK]).groupBy(*KEYS, CHUNK, "_before").agg(
            F.sort_array(F.collect_list(F.struct("block", "sums.total", "sums.low", deltas.alias("deltas")))).alias("parts"))
        over = lambda stock, part: F.when(stock + part["low"] >= 0, stock + part["total"]).otherwise(
            F.aggregate(part["deltas"], stock, _after))
        done = settle(to_fold.withColumn("end", _starts(F.col("parts"), F.col("_before"), over)).select(
            *KEYS, CHUNK, (F.col("end.stock") - F.col("_before")).alias("_fixed"), F.col("end.starts").alias("_folded")), "folded")
        if done.isEmpty():
            break
        summary = settle(
            summary.join(done, [*KEYS, CHUNK], "left").select(
                *KEYS, CHUNK, "parts", F.coalesce("_fixed", "_total").alias("_total"), "_low", "_last", "_opening",
                F.coalesce("_folded", "_starts").alias("_starts")),
            "chunk-sums",
        )

    known = summary.join(chain.select(*KEYS, CHUNK, "_before"), [*KEYS, CHUNK])
    straight = _starts(F.col("parts"), F.col("_before"), lambda stock, part: stock + part["total"])["starts"]
    starts = known.withColumn("_starts", F.coalesce("_starts", straight)).select(
        *KEYS, CHUNK, F.explode(F.arrays_zip(F.col("parts.block").alias("block"), F.col("_starts").alias("start"))).alias("s")).select(
        *KEYS, CHUNK, "s.block", "s.start")
    judged = blocks.join(starts, [*KEYS, CHUNK, "block"]).select(F.explode(
        F.zip_with("rows", _one_by_one(F.col("rows"), F.col("start")), lambda row, seen: F.struct(row["row"].alias("row"), row["delta"].alias("delta"), seen.alias("seen")))).alias("x"))
    decisions = judged.select(
        "x.row.*", F.col("x.seen.fits").alias("accepted"), F.when(~F.col("x.seen.fits"), F.lit("NEGATIVE_STOCK")).alias("refusal"),
        F.col("x.seen.before").alias("quantity_before"), _after(F.col("x.seen.before"), F.col("x.delta")).alias("quantity_after"))
    changed = summary.groupBy(*KEYS).agg(
        (F.max("_opening") + F.sum("_total")).alias("quantity_on_hand"), F.max("_last").alias("updated_at")
    )
    return decisions, changed


_FOLD = "_opening bigint, delta bigint, before bigint, fits boolean, settled boolean"


def _fold(columns: list[str]):
    """Folds the products of a partition that is sorted by product and order, a product's opening row first. Rows of a product without
    one here, or with an ambiguous one, come back unsettled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, opened, stock = None, None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            stores, products = batch.column("store_id"), batch.column("product_id")
            n = batch.num_rows
            new = np.ones(n, dtype=bool)
            for column in (stores, products):
                same = pc.equal(column.slice(1), column.slice(0, n - 1)).to_numpy(zero_copy_only=False)
                new[1:] = same if column is stores else new[1:] & same
            new[1:] = ~new[1:]
            first = (stores[0].as_py(), products[0].as_py())
            new[0] = first != last
            last = (stores[n - 1].as_py(), products[n - 1].as_py())
            kept, openings, befores, fits = [], [], [], []
            for i, (begins, rank, delta, copies) in enumerate(zip(new.tolist(), batch.column("_rank").to_pylist(), batch.column("delta").to_pylist(), batch.column("_copies").to_pylist())):
                if begins:
                    opened = None
                if not rank:
                    opened = stock = delta if copies == 1 else None
                    continue
                kept.append(i)
                openings.append(opened)
                befores.append(stock if opened is not None else None)
                if opened is not None:
                    fits.append(stock + delta >= 0)
                    if fits[-1]:
                        stock += delta
                else:
                    fits.append(None)
            rows = batch.take(pa.array(kept, pa.int64()))
            opening = pa.array(openings, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*[rows.column(c) for c in columns], opening, rows.column("delta"), pa.array(befores, pa.int64()), pa.array(fits, pa.bool_()), pc.is_valid(opening)],
                names=[*columns, "_opening", "delta", "before", "fits", "settled"])

    return run


def apply_adjustments(products: DataFrame, adjustments: DataFrame, *, chunks: int | None = None) -> StockResult:
    """Adjustments in the order (created_at, adjustment_id); one that would make the stock negative is
    rejected and the next ones go on from the unchanged stock.

    Rows are range-partitioned by product and order once, the opening stock of every product as its first row, so that
    no join is needed: a task folds the products that begin in its partition. At most one product a partition began in an
    earlier one; these few, which may be very large, are folded by chunks, all their partitions in parallel.
    """
    zero = F.lit(0).cast(_LONG)
    columns = adjustments.columns
    opening = products.select(*KEYS, F.coalesce("quantity_on_hand", zero).alias("_opening"))
    valid, invalid = split_valid(adjustments, adjustment_rules())
    sign = F.when(F.col("adjustment_type").isin(*SUBTRACTING_TYPES), F.lit(-1)).otherwise(F.lit(1))
    order = ["created_at", "adjustment_id"]
    first = opening.where("store_id is not null and product_id is not null").groupBy(*KEYS).agg(
        F.min("_opening").alias("delta"), F.count(F.lit(1)).alias("_copies")).withColumn("_rank", F.lit(0))
    lines = valid.where("product_id is not null").select(*columns, (sign * F.col("quantity_delta")).cast(_LONG).alias("delta"), F.lit(1).alias("_rank"))
    count = chunks or int(adjustments.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = lines.unionByName(first, allowMissingColumns=True)
    ranged = placed.repartitionByRange(count, *KEYS, "_rank", *order).sortWithinPartitions(*KEYS, "_rank", *order)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in adjustments.schema.fields) + ", " + _FOLD
    folded = settle(ranged.mapInArrow(_fold(columns), schema), "folded-rows")
    # The products of unsettled rows are at most one a partition, those stored twice, and those not stored at all.
    open_keys = settle(folded.where("not settled").select(*KEYS).distinct(), "open-products")
    spanning = settle(opening.join(open_keys, KEYS, "left_semi"), "spanning")

    own = folded.where("settled").join(spanning.select(*KEYS), KEYS, "left_anti")
    after = _after(F.col("before"), F.col("delta"))
    decisions = own.select(*columns, F.col("fits").alias("accepted"), F.when(~F.col("fits"), F.lit("NEGATIVE_STOCK")).alias("refusal"),
                           F.col("before").alias("quantity_before"), after.alias("quantity_after"))
    changed = own.groupBy(*KEYS).agg(
        (F.max("_opening") + F.sum(F.when(F.col("fits"), F.col("delta")).otherwise(zero))).alias("quantity_on_hand"), F.max("created_at").alias("updated_at"))
    if not spanning.isEmpty():
        large = folded.join(spanning.select(*KEYS), KEYS, "left_semi").select(*KEYS, *order, "delta", F.struct(*columns).alias("row"))
        chunked, chunked_products = _fold_in_chunks(spanning, large, chunks)
        decisions, changed = decisions.unionByName(chunked), changed.unionByName(chunked_products)
    unknown = folded.where("not settled").join(spanning.select(*KEYS), KEYS, "left_anti").select(*columns).unionByName(valid.where("product_id is null"))
    refused = lambda df, why: df.select(
        *adjustments.columns, F.lit(False).alias("accepted"), why.alias("refusal"),
        zero.alias("quantity_before"), zero.alias("quantity_after"),
    )
    decisions = decisions.unionByName(refused(unknown, F.lit("PRODUCT_NOT_FOUND"))).unionByName(
        refused(invalid, F.concat_ws("; ", VIOLATIONS))
    )
    return StockResult(decisions, changed)
