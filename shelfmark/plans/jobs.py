"""Jobs that decide and write: sales, stock changes, alert sweeps and commands, chat, and the follow-up work they leave.

Each job commits all it changes in one version. What is to happen afterwards, alerts for the products it
touched, new vectors, a sweep, goes along as rows of ``followups`` in the same commit, so it is neither lost
with the job nor can its failure undo the job. :func:`run_followups` does the open ones, kind by kind.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, functions as F

from shelfmark.functions.timing import days_before, instant
from shelfmark.operators import alert_book, billing, demand, sessions, stock, vectors
from shelfmark.plans import sweep
from shelfmark.session import settle
from shelfmark.sources.tables import Warehouse

AFTER_SALE, AFTER_CHANGE, EMBED, SWEEP = "ALERTS_AFTER_SALE", "ALERTS_AFTER_CHANGE", "EMBEDDINGS", "SWEEP"
ERROR_LENGTH = 1000


def _followups(rows: DataFrame, kind: str, *, as_of) -> DataFrame:
    """One open task per row (store_id, subject_id). Its id follows from what it names, so a job that runs again leaves the same."""
    now = instant(as_of)
    task_id = F.sha2(F.concat_ws("|", F.lit(kind), "store_id", F.coalesce("subject_id", F.lit("")), F.unix_micros(now).cast("string")), 256)
    return rows.select(
        task_id.alias("task_id"), "store_id", F.lit(kind).alias("kind"), "subject_id", F.lit("OPEN").alias("status"),
        F.lit(0).alias("attempt_count"), F.lit(None).cast("string").alias("error_message"), now.alias("created_at"), F.lit(None).cast("timestamp").alias("done_at"))


def _of_products(products: DataFrame) -> DataFrame:
    return products.select("store_id", F.col("product_id").alias("subject_id")).distinct()


def _write_alerts(warehouse: Warehouse, changes) -> None:
    # Both come from the same decisions; written down, these are made once.
    alerts, events = settle(changes.alerts, "alerts"), settle(changes.events, "alert-events")
    warehouse.upsert_all({"alerts": alerts, "alert_events": events}, check_keys=False)


# --- jobs --------------------------------------------------------------------------------------


def sell(warehouse: Warehouse, requests: DataFrame, *, as_of, created_by: str = "system") -> DataFrame:
    """Decide a batch of sale requests against the stored products, customers and keys, and write what follows from it.
    Returns the decisions. A batch sent again finds its keys and changes nothing but their last use."""
    with warehouse.transaction():
        result = billing.bill(requests, warehouse.read("products"), warehouse.read("customers"), warehouse.read("idempotency"), created_by=created_by)
        decisions = settle(result.decisions, "decisions")
        written = settle(result.transactions, "transactions")
        more = settle(demand.day_units(_lines(written)), "demand")
        stored = warehouse.read("demand_days", folders=warehouse.folders_of("demand_days", more))
        sold = settle(result.products, "sold")
        warehouse.upsert_all({
            "transactions": written, "demand_days": demand.with_more(stored, more), "stock_adjustments": result.adjustments, "products": sold,
            "customers": result.customers, "idempotency": result.idempotency, "followups": _followups(_of_products(sold), AFTER_SALE, as_of=as_of),
        }, check_keys=False)
    return decisions


def change_stock(warehouse: Warehouse, adjustments: DataFrame, *, as_of) -> DataFrame:
    """Apply adjustments to the stored products; the accepted ones become audit rows. Those that are stored
    already are not applied again. Returns the decisions."""
    with warehouse.transaction():
        known = warehouse.read("stock_adjustments").select("adjustment_id")
        fresh = adjustments.dropDuplicates(["adjustment_id"]).join(known, "adjustment_id", "left_anti")
        result = stock.apply_adjustments(warehouse.read("products"), fresh)
        decisions = settle(result.decisions, "decisions")
        warehouse.upsert("products", result.products, check_keys=False)
        accepted = decisions.where("accepted")
        warehouse.upsert("stock_adjustments", accepted.select(*adjustments.columns), check_keys=False)
        warehouse.upsert("followups", _followups(_of_products(accepted), AFTER_CHANGE, as_of=as_of), check_keys=False)
    return decisions


def add_products(warehouse: Warehouse, requests: DataFrame, *, as_of) -> DataFrame:
    """Store new products; returns the rejected requests."""
    with warehouse.transaction():
        made = stock.create_products(requests, as_of=as_of)
        created = settle(made.created, "created")
        warehouse.upsert("products", created)
        warehouse.upsert("followups", _followups(_of_products(created), AFTER_CHANGE, as_of=as_of), check_keys=False)
    return made.rejected


def patch_products(warehouse: Warehouse, patches: DataFrame, *, as_of) -> DataFrame:
    """Change stored products; returns the rejected patches."""
    with warehouse.transaction():
        made = stock.patch_products(warehouse.read("products"), patches, as_of=as_of)
        changed = settle(made.changed, "changed")
        warehouse.upsert("products", changed, check_keys=False)
        warehouse.upsert("followups", _followups(_of_products(changed), AFTER_CHANGE, as_of=as_of), check_keys=False)
    return made.rejected


def _lines(transactions: DataFrame) -> DataFrame:
    return transactions.select("store_id", "status", "sale_timestamp", F.explode("items").alias("line")).select(
        "store_id", "status", "sale_timestamp", "line.product_id", "line.quantity")


def end_days(warehouse: Warehouse, *, as_of) -> list[str]:
    """The days in which the rules' windows start or end."""
    ends = [F.date_format(days_before(as_of, n), "yyyy-MM-dd") for n in (0, 3, 14, 17)]
    return sorted(warehouse.spark.range(1).select(F.array(*ends)).first()[0])


def sweep_alerts(warehouse: Warehouse, kinds, *, as_of, stores: DataFrame | None = None) -> None:
    """Evaluate the kinds for all stores, or the given ones, and write alerts and their history. Of the sales only the
    days at the ends of the rules' windows are read; the sums of whole days are kept by :func:`sell`."""
    mine = (lambda df: df) if stores is None else (lambda df: df.join(stores.select("store_id").distinct(), "store_id", "left_semi"))
    lines = _lines(mine(warehouse.read("transactions", folders=end_days(warehouse, as_of=as_of))))
    with warehouse.transaction():
        _write_alerts(warehouse, sweep.sweep(
            kinds, mine(warehouse.read("products")), lines, mine(warehouse.read("alerts")), as_of=as_of, days=mine(warehouse.read("demand_days"))))


def command_alerts(warehouse: Warehouse, commands: DataFrame) -> DataFrame:
    """Acknowledge and resolve stored alerts; returns the decisions."""
    with warehouse.transaction():
        result = alert_book.run_commands(warehouse.read("alerts"), commands)
        decisions = settle(result.decisions, "decisions")
        warehouse.upsert("alerts", result.alerts, check_keys=False)
        warehouse.upsert("alert_events", result.events, check_keys=False)
    return decisions


def say(warehouse: Warehouse, messages: DataFrame) -> None:
    """Store messages (with user_id) and move their sessions on."""
    with warehouse.transaction():
        given = settle(messages, "said")
        warehouse.upsert("messages", given.drop("user_id"))
        warehouse.upsert("chat_sessions", sessions.touched_sessions(given, warehouse.read("chat_sessions")), check_keys=False)


def follow_marts(warehouse: Warehouse, stores: DataFrame, *, as_of) -> None:
    """After a mart refresh: a sweep and new vectors per store, as tasks, so that neither can fail the marts."""
    rows = stores.select("store_id", F.lit(None).cast("string").alias("subject_id")).distinct()
    both = _followups(rows, SWEEP, as_of=as_of).unionByName(_followups(rows, EMBED, as_of=as_of))
    warehouse.upsert("followups", both, check_keys=False)


# --- follow-up work ----------------------------------------------------------------------------

Handler = Callable[[Warehouse, DataFrame], None]


def _alerts_of(kinds: tuple[str, ...], as_of) -> Handler:
    def run(warehouse: Warehouse, tasks: DataFrame) -> None:
        touched = tasks.select("store_id", F.col("subject_id").alias("product_id")).distinct()
        _write_alerts(warehouse, sweep.after_change(touched, warehouse.read("products"), warehouse.read("alerts"), as_of=as_of, kinds=kinds))
    return run


def _embed(vectorise: Callable[[Column], Column], as_of) -> Handler:
    """New vectors for the products of the tasks' stores whose text has changed since the stored one was made."""
    def run(warehouse: Warehouse, tasks: DataFrame) -> None:
        products = warehouse.read("products").join(tasks.select("store_id").distinct(), "store_id", "left_semi")
        made = warehouse.read("product_embeddings").select("store_id", "product_id", F.col("embedding_text").alias("_made"))
        texts = vectors.product_texts(products, as_of=as_of).join(made, ["store_id", "product_id"], "left")
        changed = texts.where(~F.col("embedding_text").eqNullSafe(F.col("_made"))).select("store_id", "product_id")
        rows = settle(vectors.product_embeddings(products.join(changed, ["store_id", "product_id"], "left_semi"), vectorise, as_of=as_of), "vectors")
        warehouse.upsert("product_embeddings", rows, check_keys=False)
    return run


def handlers(*, as_of, vectorise: Callable[[Column], Column] | None = None) -> dict[str, Handler]:
    """What does each kind of task. Without ``vectorise`` the embedding tasks stay open."""
    kinds = {
        AFTER_SALE: _alerts_of(("LOW_STOCK",), as_of),
        AFTER_CHANGE: _alerts_of(("LOW_STOCK", "EXPIRY_SOON"), as_of),
        SWEEP: lambda warehouse, tasks: sweep_alerts(warehouse, ("LOW_STOCK", "EXPIRY_SOON", "NOT_SELLING", "HIGH_DEMAND"), as_of=as_of, stores=tasks),
    }
    return kinds | ({EMBED: _embed(vectorise, as_of)} if vectorise else {})


def run_followups(warehouse: Warehouse, work: Mapping[str, Handler], *, as_of) -> dict[str, str]:
    """Do the open tasks, all of a kind at once. What a kind writes and that its tasks are DONE is one commit; one that
    fails leaves its tasks open, with the error, and the others go on. Returns the outcome per kind that had tasks."""
    outcomes = {}
    for kind, handler in work.items():
        tasks = settle(warehouse.read("followups").where((F.col("status") == "OPEN") & (F.col("kind") == kind)), "tasks")
        if tasks.isEmpty():
            continue
        tried = tasks.withColumn("attempt_count", F.col("attempt_count") + 1)
        try:
            with warehouse.transaction():
                handler(warehouse, tasks)
                done = tried.withColumns({"status": F.lit("DONE"), "done_at": instant(as_of), "error_message": F.lit(None).cast("string")})
                warehouse.upsert("followups", done, check_keys=False)
            outcomes[kind] = "DONE"
        except Exception as error:  # noqa: BLE001 - the tasks stay open and carry the error
            warehouse.upsert("followups", tried.withColumn("error_message", F.lit(str(error)[:ERROR_LENGTH])), check_keys=False)
            outcomes[kind] = "OPEN"
    return outcomes
