"""Upserts: tables of one load at the same time, tables with no files yet, joins that stay bounded, settings put back."""

from __future__ import annotations

import datetime as dt
import threading

import pytest
from pyspark.sql import functions as F

from shelfmark.plans import raw_load, refresh
from shelfmark.registry import stream_queries
from shelfmark.session import settings
from shelfmark.sources import tables
from shelfmark.sources.tables import DuplicateKeys, Warehouse, merge_newer
from test_tables import DAY, T0, dump, source  # noqa: F401

KIND = "customer_id string, store_id string, name string, phone string, captured_at timestamp"
SIZES = tuple(tables._MERGE_SIZES)


def captures(spark, *rows):
    return spark.createDataFrame(list(rows), KIND)


def test_tables_of_a_load_are_written_at_the_same_time(spark, source, tmp_path, monkeypatch):  # noqa: F811
    warehouse, real = Warehouse(spark, str(tmp_path)), Warehouse._stage
    meet = {"all": threading.Barrier(5)}

    def together(self, *a, **k):
        meet["all"].wait(60)
        return real(self, *a, **k)

    with monkeypatch.context() as patch:
        patch.setattr(Warehouse, "_stage", together)
        written = raw_load.load_window(warehouse, source, T0, T0 + 3 * DAY)
    assert warehouse.versions.all() == [1] and written["transactions_raw"].rows == 3
    refresh.refresh_marts(warehouse, as_of=T0 + 3 * DAY, run_id="one")
    assert len(dump(warehouse, "sales_daily")) == 3 and warehouse.versions.all() == [1, 2]


def test_a_key_that_is_twice_in_one_of_several_tables_leaves_all_as_they_were(spark, source, tmp_path):  # noqa: F811
    warehouse = Warehouse(spark, str(tmp_path))
    before = {name: spark.conf.get(name) for name in SIZES}
    twice = {**source, "customers": source["customers"].unionByName(source["customers"])}
    with pytest.raises(DuplicateKeys):
        raw_load.load_window(warehouse, twice, T0, T0 + 3 * DAY)
    assert warehouse.versions.all() == [] and not warehouse.exists("transactions_raw")
    assert {name: spark.conf.get(name) for name in SIZES} == before


def test_a_table_without_files_costs_no_job(spark, tmp_path):
    warehouse = Warehouse(spark, str(tmp_path))
    empty = warehouse.read("customers_raw")
    assert "LocalRelation <empty>" in empty._jdf.queryExecution().optimizedPlan().toString()
    assert empty.schema.simpleString() == warehouse.schema("customers_raw").simpleString() and empty.count() == 0


def test_settings_are_put_back_by_the_last_holder(spark):
    name = SIZES[0]
    before = spark.conf.get(name)
    with settings(spark, {name: "1m"}):
        with settings(spark, {name: "1m"}):
            pass
        assert spark.conf.get(name) == "1m"
    assert spark.conf.get(name) == before


def test_a_feed_joins_once_and_sends_no_keys_to_all_tasks(spark, tmp_path, monkeypatch):
    warehouse, real, plans = Warehouse(spark, str(tmp_path)), Warehouse._write, []
    many = spark.range(150_000).select(F.sha2(F.col("id").cast("string"), 256).alias("customer_id"), F.lit("s").alias("store_id"),
                                       F.lit(T0).cast("timestamp").alias("captured_at"))

    def watched(self, name, rows, run):
        plans.append(rows._jdf.queryExecution().executedPlan().toString())
        return real(self, name, rows, run)

    monkeypatch.setattr(Warehouse, "_write", watched)
    for _ in range(2):
        warehouse.upsert("customers_raw", many, check_keys=False, newest_by="captured_at")
    assert "Join" not in plans[0] and plans[1].count("Join") == 1 and "Broadcast" not in plans[1]
    assert warehouse.read("customers_raw").count() == 150_000


def test_the_later_row_stands_column_by_column(spark):
    minute = dt.timedelta(minutes=1)
    stored = captures(spark, ("1", "s", "old", "p1", T0), ("2", "s", "late", "p2", T0 + minute), ("3", "s", "no time", "p3", None),
                      ("4", "s", "alone", "p4", T0), (None, "s", "no key", "p5", T0), ("6", "s", "timed", "p6", T0))
    given = captures(spark, ("1", "s", "new", None, T0), ("2", "s", "early", None, T0), ("3", "s", "any", None, None), ("5", "s", "added", None, None),
                     (None, "s", "no key either", None, T0), ("6", "s", "untimed", None, None)).drop("phone").withColumn("phone", F.lit(None).cast("string"))
    rows = merge_newer(stored, given, ["customer_id"], "captured_at", keep_stored=["phone"]).collect()
    assert sorted((r.customer_id or "", r.name, r.phone or "") for r in rows) == sorted([
        ("1", "new", "p1"), ("2", "late", "p2"), ("3", "any", "p3"), ("4", "alone", "p4"), ("5", "added", ""),
        ("", "no key", "p5"), ("", "no key either", ""), ("6", "timed", "p6")])


def test_slices_have_more_files_as_the_input_grows(spark, tmp_path, monkeypatch):
    spark.range(1000).selectExpr("id", "cast(id as string) AS name").repartition(1).write.parquet(str(tmp_path / "in"))
    rows = spark.read.parquet(str(tmp_path / "in"))
    monkeypatch.setattr(stream_queries, "FILE_BYTES", 100)
    monkeypatch.setattr(stream_queries, "scratch_path", lambda spark, label: str(tmp_path / label))
    counts = []
    stream_queries._slices(rows, "many-files", 2)(1).writeStream.foreachBatch(lambda batch, n: counts.append(batch.count())).option(
        "checkpointLocation", str(tmp_path / "mark")).trigger(availableNow=True).start().awaitTermination()
    files = len(list((tmp_path / "many-files").glob("part-*")))
    assert len(counts) == 2 and sum(counts) == 1000 and files > 8 * spark.sparkContext.defaultParallelism
