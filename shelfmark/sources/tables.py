"""Parquet tables under one root folder: read, keyed upsert, replace, append, purge, all in versions.

An upsert reads and rewrites only the folders its rows fall in. Where a key's day can change, the
folder that holds the key now is looked up by its key columns and rewritten too.

Files never change. A write makes new folders, ``<table>/run=<id>/<folder>``, and then commits a version
that names them (see :mod:`shelfmark.sources.versions`); folders that lose all their rows leave the table in the same
commit. A job lost before the commit has changed nothing, also where it writes several tables in one
:meth:`Warehouse.transaction`. Readers go on with the version they started from.
"""

from __future__ import annotations

import contextlib
import threading
import uuid
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from shelfmark.schemas import TABLES
from shelfmark.session import at_most, settings, settle
from shelfmark.sources.versions import Change, Content, Versions, commit


@dataclass(frozen=True)
class Layout:
    """Key of a table and the one column its folders go by: a day fixed in the row, a bucket of
    the key, or the store. Stores are not folders of the large tables: thousands of stores times
    thousands of days would be too many. Rows are sorted by store within the files instead, so a
    single-store read skips row groups."""

    keys: tuple[str, ...]
    day_of: str | None = None
    bucket_of: str | None = None
    buckets: int = 64
    #: Whether a key's day can never change; where it can, an upsert looks up the stored day of its keys.
    day_fixed: bool = False

    @property
    def may_move(self) -> bool:
        return self.day_of is not None and self.day_of not in self.keys and not self.day_fixed

    @property
    def partition_column(self) -> str:
        return "p_day" if self.day_of else "p_bucket" if self.bucket_of else "p_store"

    def partition_value(self) -> Column:
        if self.day_of:
            value = F.coalesce(F.date_format(F.col(self.day_of), "yyyy-MM-dd"), F.lit("none"))
        elif self.bucket_of:
            value = F.pmod(F.xxhash64(F.col(self.bucket_of)), F.lit(self.buckets)).cast("string")
        else:
            # An empty partition value would be read back as NULL.
            value = F.coalesce(F.nullif("store_id", F.lit("")), F.lit("none"))
        return value.alias(self.partition_column)


LAYOUTS: dict[str, Layout] = {
    "transactions_raw": Layout(("transaction_id",), day_of="sale_timestamp"),
    "transaction_items_raw": Layout(("transaction_id", "product_id"), day_of="sale_timestamp"),
    "inventory_snapshot_raw": Layout(("snapshot_id",), day_of="captured_at", day_fixed=True),
    "customers_raw": Layout(("customer_id",), bucket_of="customer_id"),
    "alerts_raw": Layout(("alert_id",), bucket_of="alert_id"),
    "sales_daily": Layout(("store_id", "sales_date")),
    "product_sales_daily": Layout(("store_id", "sales_date", "product_id"), day_of="sales_date"),
    "demand_days": Layout(("store_id", "sales_date", "product_id"), day_of="sales_date"),
    "customer_summary": Layout(("store_id", "customer_id"), bucket_of="customer_id"),
    "inventory_health": Layout(("store_id", "product_id", "snapshot_date"), day_of="snapshot_date"),
    "dashboard_summary": Layout(("store_id", "snapshot_date")),
    "product_embeddings": Layout(("store_id", "product_id")),
    "analytics_metadata": Layout(("store_id",)),
    "pipeline_runs": Layout(("pipeline_run_id",)),
    "pipeline_failures": Layout(("failure_id",)),
    "alerts": Layout(("alert_id",), bucket_of="alert_id"),
    "alert_events": Layout(("event_id",), day_of="changed_at"),
    "products": Layout(("product_id",), bucket_of="product_id"),
    "customers": Layout(("customer_id",), bucket_of="customer_id"),
    "idempotency": Layout(("store_id", "idempotency_key"), bucket_of="idempotency_key"),
    "transactions": Layout(("transaction_id",), day_of="sale_timestamp"),
    "stock_adjustments": Layout(("adjustment_id",), day_of="created_at"),
    "stores": Layout(("store_id",)),
    "followups": Layout(("task_id",), bucket_of="task_id"),
    "chat_sessions": Layout(("chat_session_id",)),
    "messages": Layout(("message_id",)),
}


def merge_rows(target: DataFrame, source: DataFrame, keys: Sequence[str], *, keep_stored: Sequence[str] = ()) -> DataFrame:
    """``target`` with the rows of ``source`` in place of those of equal key, and the new ones added.

    Source keys must be unique. ``keep_stored`` names columns the source does not really have:
    they keep the target's value. Rows that vanished from the source stay.
    """
    keys, columns = list(keys), target.columns
    if keep_stored:
        held = target.select(*keys, *[F.col(c).alias(f"_held_{c}") for c in keep_stored])
        source = source.join(held, keys, "left").select(
            *[F.col(f"_held_{c}").alias(c) if c in keep_stored else F.col(c) for c in columns]
        )
    kept = target.join(source.select(*keys), keys, "left_anti").select(*columns)
    return kept.unionByName(source.select(*columns))


#: What a task of a merge takes in, as shuffled, and what a join may send to all tasks, as stored. Keys of a table's
#: files take some forty times their stored size in a task's memory.
_MERGE_SIZES = {
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
    "spark.sql.autoBroadcastJoinThreshold": "1m",
}


def merge_newer(target: DataFrame, source: DataFrame, keys: Sequence[str], newest_by: str, *, keep_stored: Sequence[str] = ()) -> DataFrame:
    """:func:`merge_rows`, but a row of ``source`` gives way to one of equal key that is later in ``newest_by``."""
    given = source.select(F.lit(True).alias("_given"), *[F.col(c).alias(f"_given_{c}") for c in source.columns])
    both = target.join(given, reduce(and_, [F.col(k) == F.col(f"_given_{k}") for k in keys]), "full")
    later = F.col(newest_by).isNull() | F.coalesce(F.col(f"_given_{newest_by}") >= F.col(newest_by), F.lit(False))
    wins = F.coalesce(F.col("_given") & later, F.lit(False))
    return both.select(*[F.col(c) if c in keep_stored else F.when(wins, F.col(f"_given_{c}")).otherwise(F.col(c)).alias(c) for c in target.columns])


class Written:
    """How many rows an upsert was given, per store and in all."""

    def __init__(self, per_store: DataFrame):
        self.per_store = per_store

    @property
    def rows(self) -> int:
        return int(self.per_store.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0])


class DuplicateKeys(ValueError):
    """The source of an upsert holds a key twice, so "the" new row is not defined."""


class Warehouse:
    """The tables under ``root``, a folder every executor can reach. With ``version`` the tables as that
    version has them, to read only."""

    def __init__(self, spark: SparkSession, root: str, version: int | None = None):
        self.spark, self.root, self.pinned = spark, root.rstrip("/"), version
        self.versions = Versions(spark, self.root)
        self._open: Change | None = None
        self._lock = threading.Lock()

    # --- versions

    def at(self, version: int | None = None) -> Warehouse:
        """A reader that stays with one version, by default the newest, whatever is written meanwhile."""
        return Warehouse(self.spark, self.root, self.versions.latest() if version is None else version)

    def _base(self) -> int:
        if self.pinned is not None:
            return self.pinned
        return self._open.base if self._open else self.versions.latest()

    def _content(self) -> Content:
        """What the tables are made of, as this reader or this open transaction sees it."""
        stored = self.versions.content(self._base())
        with self._lock:
            return self._open.on(stored) if self._open else stored

    @contextlib.contextmanager
    def transaction(self) -> Iterator[None]:
        """All writes inside become visible together at the end, or none does. Reads inside see them before.
        A transaction within another is part of it."""
        if self._open:
            yield
            return
        self._open = Change(self.versions.latest())
        try:
            yield
            change, self._open = self._open, None
            if change.folders or change.added:
                commit(self.versions, change)
        finally:
            self._open = None

    def _submit(self, change: Change) -> None:
        if self.pinned is not None:
            raise ValueError("a reader of one version cannot write")
        if self._open:
            with self._lock:
                self._open.join(change)
        else:
            commit(self.versions, change)

    def expire(self, keep: int = 2) -> int:
        """Remove all versions but the newest ``keep``, and the folders that only those named. Returns the number of
        folders removed. Readers of a removed version fail; folders of jobs still under way are not touched."""
        found = self.versions.all()
        old, kept = found[:-keep], found[-keep:]
        named = lambda some: {(t, r, f) for v in some for t, folders in self.versions.content(v).items() for f, runs in folders.items() for r in runs}
        gone = named(old) - named(kept)
        # Readers find a version's file before they look for its folders, so the files go first.
        for version in old:
            self.versions.forget(version)
        for table, run, folder in sorted(gone):
            fs, path = self._filesystem(self._folder(table, run, folder))
            fs.delete(path, True)
        return len(gone)

    # --- folders

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def _filesystem(self, path: str):
        jvm = self.spark.sparkContext._jvm
        hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
        return hadoop_path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), hadoop_path

    def _folder(self, name: str, run: str, value: str) -> str:
        escaped = self.spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(value)
        return f"{self.path(name)}/run={run}/{LAYOUTS[name].partition_column}={escaped}"

    def _written_folders(self, name: str, run: str) -> list[str]:
        """The folder values that a run wrote files for."""
        fs, path = self._filesystem(f"{self.path(name)}/run={run}")
        if not fs.exists(path):
            return []
        start = f"{LAYOUTS[name].partition_column}="
        unescape = self.spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
        found = [s.getPath().getName() for s in fs.listStatus(path) if s.isDirectory()]
        return sorted(unescape(n[len(start):]) for n in found if n.startswith(start))

    def exists(self, name: str) -> bool:
        """Whether the table has any files."""
        return bool(self._content().get(name))

    def is_complete(self, path: str) -> bool:
        """Whether a job has finished writing ``path``."""
        fs, marker = self._filesystem(f"{path}/_SUCCESS")
        return fs.exists(marker)

    # --- reading

    def schema(self, name: str) -> T.StructType:
        return T.StructType.fromDDL(TABLES[name])

    def _stored_schema(self, name: str) -> T.StructType:
        return self.schema(name).add(LAYOUTS[name].partition_column, T.StringType())

    def _read_stored(self, name: str, folders: Sequence[str] | None = None) -> DataFrame:
        """All rows, or those of the named folders: only these are listed."""
        held = self._content().get(name, {})
        wanted = held if folders is None else {f: held[f] for f in folders if f in held}
        paths = [self._folder(name, run, value) for value, runs in sorted(wanted.items()) for run in runs]
        schema = self._stored_schema(name)
        if not paths:
            # A range that the optimizer sees to be empty: what reads or joins it is left out of the plan.
            nothing = [F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields]
            return self.spark.range(1).where(F.lit(False)).select(*nothing)
        rows = self.spark.read.schema(schema).option("basePath", self.path(name)).parquet(*paths)
        return rows.select(*schema.fieldNames())

    def read(self, name: str, *, store_id: str | None = None, folders: Sequence[str] | None = None) -> DataFrame:
        """All rows, or one store's, or those of the named folders (see :meth:`folders_of`)."""
        stored = self._read_stored(name, folders)
        if folders is not None:
            stored = self._only(name, stored, folders)
        if store_id is not None:
            stored = stored.where(F.col("store_id") == store_id)
            if LAYOUTS[name].partition_column == "p_store":
                stored = stored.where(F.col("p_store") == store_id)
        return stored.select(*self.schema(name).fieldNames())

    def folders_of(self, name: str, rows: DataFrame) -> list[str]:
        """The folders of ``name`` that ``rows`` fall in. As many values as the table has folders at
        most; as literals they prune the scan, which a join would not reliably do."""
        found = rows.select(LAYOUTS[name].partition_value()).distinct()
        return sorted(r[0] for r in found.collect())

    def _only(self, name: str, stored: DataFrame, folders: Sequence[str]) -> DataFrame:
        return stored.where(F.col(LAYOUTS[name].partition_column).isin(list(folders)))

    # --- writing

    def _conform(self, name: str, rows: DataFrame) -> DataFrame:
        """Declared columns and types, plus the partition columns; absent columns are NULL."""
        columns = [
            (F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in self.schema(name).fields
        ]
        return rows.select(*columns).select("*", LAYOUTS[name].partition_value())

    def _write(self, name: str, rows: DataFrame, run: str) -> list[str]:
        """Write rows as the folders of a new run; returns the folders that got any. A run written again replaces itself."""
        layout = LAYOUTS[name]
        order = ["store_id", *[k for k in layout.keys if k != "store_id"]]
        (
            # Rebalancing splits a folder that holds much of the data over several files and
            # joins small ones, at run time.
            rows.hint("rebalance", F.col(layout.partition_column))
            .sortWithinPartitions(layout.partition_column, *order)
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "static")
            .partitionBy(layout.partition_column)
            .parquet(f"{self.path(name)}/run={run}")
        )
        return self._written_folders(name, run)

    def _stage(self, rows: DataFrame, run_id: str, leaf: str) -> None:
        rows.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(self._staging(run_id, leaf))

    def _staging(self, run_id: str, leaf: str) -> str:
        return f"{self.root}/_staging/{run_id}/{leaf}"

    def _staged(self, name: str, run_id: str, leaf: str) -> DataFrame:
        return self.spark.read.schema(self._stored_schema(name)).parquet(self._staging(run_id, leaf))

    def append(self, name: str, rows: DataFrame) -> None:
        """Audit and event rows: only ever added."""
        run, change = uuid.uuid4().hex, Change(self._base())
        for folder in self._write(name, self._conform(name, rows), run):
            change.add(name, folder, run)
        self._submit(change)

    def upsert(self, name: str, rows: DataFrame, *, run_id: str | None = None, check_keys: bool = True,
               newest_by: str | None = None) -> Written:
        """Replace rows of equal key, add the others, remove none. Declared columns that ``rows`` does
        not have keep their stored value. With ``newest_by`` a row gives way to a stored one that is later
        in that column. A key is replaced in whichever folder it lies, and leaves that folder in the same commit.

        ``run_id`` names the run: after a failure the upsert can simply be repeated, or, if it had come as
        far as committing, be finished by :meth:`publish`.
        """
        run_id = run_id or uuid.uuid4().hex
        change = Change(self._base())
        given = [f.name for f in self.schema(name).fields if f.name in rows.columns]
        # The source plan runs once; the key check, the touched folders and the merge read its result.
        self._stage(self._conform(name, rows), run_id, f"{name}_given")
        with settings(self.spark, {key: at_most(self.spark, key, size) for key, size in _MERGE_SIZES.items()}):
            self._merge(name, given, run_id, change, check_keys=check_keys, newest_by=newest_by)
        self.publish(name, run_id)
        # Counted from the store column of the files just written, not by running the source again.
        counts = settle(self._staged(name, run_id, f"{name}_given").groupBy("store_id").agg(F.count(F.lit(1)).alias("rows")), "counts")
        self.clear_staging(run_id, name)
        return Written(counts)

    def upsert_all(self, frames: dict[str, DataFrame], *, check_keys: bool = True) -> dict[str, Written]:
        """Upsert into several tables in one version, all at the same time: the small jobs of one leave most of a cluster idle."""
        with self.transaction():
            with ThreadPoolExecutor(len(frames)) as pool:
                begun = {name: pool.submit(inheritable_thread_target(self.spark)(self.upsert), name, rows, check_keys=check_keys) for name, rows in frames.items()}
            return {name: job.result() for name, job in begun.items()}

    def _merge(self, name: str, given: list[str], run_id: str, change: Change, *, check_keys: bool, newest_by: str | None) -> None:
        """Write the folders that the staged rows of an upsert fall in anew, and note in ``change`` which they are."""
        layout, source = LAYOUTS[name], self._staged(name, run_id, f"{name}_given")
        if check_keys:
            # All keys are counted at once; looking for one that is there twice would go through them part by part.
            if (source.groupBy(*layout.keys).count().agg(F.max("count")).first()[0] or 0) > 1:
                raise DuplicateKeys(f"{name}: a key occurs more than once in the rows to upsert")
        folders, column = set(self.folders_of(name, source)), layout.partition_column
        if layout.may_move:
            # Reads the key columns only; as many values as the table has days at most.
            homes = self._read_stored(name).join(source.select(*layout.keys), list(layout.keys), "left_semi").select(column).distinct()
            folders |= {r[0] for r in homes.collect()}
        touched = self._read_stored(name, sorted(folders))
        missing = [f.name for f in self.schema(name).fields if f.name not in given]
        columns = self._stored_schema(name).fieldNames()
        touched = touched.select(*columns)
        merged = merge_rows(touched, source, layout.keys, keep_stored=missing) if newest_by is None else merge_newer(
            touched, source, layout.keys, newest_by, keep_stored=missing)
        run = f"{run_id}-{uuid.uuid4().hex[:8]}"  # files of a committed run stay as they are if the upsert is repeated
        filled = set(self._write(name, merged, run)) if folders else set()
        change.read.add(name)
        for folder in folders:
            change.replace(name, folder, [run] if folder in filled else [])
        fs, path = self._filesystem(f"{self._staging(run_id, name)}.change")
        out = fs.create(path, True)
        out.write(bytearray(change.as_json().encode()))
        out.close()

    def clear_staging(self, run_id: str, name: str) -> None:
        for leaf in (f"{name}.change", f"{name}_given"):
            fs, path = self._filesystem(self._staging(run_id, leaf))
            fs.delete(path, True)

    def publish(self, name: str, run_id: str) -> None:
        """Commit what an upsert of this run has written. Repeating it changes nothing."""
        fs, path = self._filesystem(f"{self._staging(run_id, name)}.change")
        stream = fs.open(path)
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        change = Change.from_json(text)
        # A run is named by the versions from its commit until its folders are replaced.
        done = {(t, r) for v in self.versions.all() if v > change.base for t, f in self.versions.content(v).items() for runs in f.values() for r in runs}
        if change.folders and not (change.runs() and change.runs() <= done):
            self._submit(change)

    def replace_stores(self, name: str, rows: DataFrame) -> None:
        """Every store that has rows here gets exactly these rows."""
        if LAYOUTS[name].partition_column != "p_store":
            raise ValueError(f"{name} is not laid out by store")
        run, change = uuid.uuid4().hex, Change(self._base())
        for folder in self._write(name, self._conform(name, rows), run):
            change.replace(name, folder, [run])
        self._submit(change)

    def purge_store(self, store_id: str, names: Sequence[str] | None = None) -> list[str]:
        """Remove a store's rows from the given tables, or from all, in one commit. Returns the tables that had any.

        Only folders that hold rows of the store are rewritten; those with no other rows go. The files stay
        on disk until the versions that name them expire.
        """
        gone = []
        with self.transaction():
            for name in names or LAYOUTS:
                if not self.exists(name):
                    continue
                folder = LAYOUTS[name].partition_column
                mine = F.coalesce(F.col("store_id") == store_id, F.lit(False))
                stored = self._read_stored(name)
                # One row per folder, a number the layout bounds.
                held = stored.groupBy(folder).agg(F.count_if(mine).alias("mine"), F.count_if(~mine).alias("others"))
                found = held.where("mine > 0").select(folder, "others").collect()
                if not found:
                    continue
                run, change = uuid.uuid4().hex, Change(self._base())
                shared = [r[0] for r in found if r[1]]
                if shared:
                    self._write(name, self._read_stored(name, shared).where(~mine), run)
                change.read.add(name)
                for value, others in found:
                    change.replace(name, value, [run] if others else [])
                self._submit(change)
                gone.append(name)
        return gone
