"""Versions of the warehouse: lost jobs at every step, moved keys, readers, other jobs, expiry."""

from __future__ import annotations

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from shelfmark.plans import raw_load, refresh
from shelfmark.sources.tables import Warehouse
from shelfmark.sources.versions import Conflict, Versions
from test_tables import DAY, T0, dump, sales_rows, source  # noqa: F401

MARTS = (*refresh.REFRESH_ORDER, "analytics_metadata")


class Lost(RuntimeError):
    pass


def lose_after(monkeypatch, steps):
    """The job is lost as soon as it has written that many tables, staged copies or versions."""
    done = {"n": 0}

    def watched(real):
        def run(*a, **k):
            if done["n"] == steps:
                raise Lost
            done["n"] += 1
            return real(*a, **k)
        return run

    for owner, name in ((Warehouse, "_write"), (Warehouse, "_stage"), (Versions, "write")):
        monkeypatch.setattr(owner, name, watched(getattr(owner, name)))
    return done


def dumps(warehouse, names=MARTS):
    return {n: dump(warehouse, n) for n in names}


def test_marts_are_all_old_or_all_new_wherever_the_job_is_lost(spark, source, tmp_path, monkeypatch):  # noqa: F811
    warehouse = Warehouse(spark, str(tmp_path))
    raw_load.load_window(warehouse, source, T0, T0 + 2 * DAY)
    refresh.refresh_marts(warehouse, as_of=T0 + DAY, run_id="one")
    raw_load.load_window(warehouse, source, T0 + 2 * DAY, T0 + 3 * DAY)
    old = dumps(warehouse)
    steps = 0
    while True:
        with monkeypatch.context() as patch:
            done = lose_after(patch, steps)
            try:
                refresh.refresh_marts(warehouse, as_of=T0 + 2 * DAY, run_id="two")
            except Lost:
                assert dumps(Warehouse(spark, str(tmp_path))) == old, steps
                steps += 1
                continue
        break
    assert steps == done["n"] == 13  # six tables given and written, one version
    new = dumps(warehouse)
    assert all(new[n] != old[n] for n in MARTS)
    assert {r.last_pipeline_run_id for r in warehouse.read("analytics_metadata").collect()} == {"two"}


def test_a_moved_key_is_there_once_wherever_the_upsert_is_lost(spark, tmp_path, monkeypatch):
    first = sales_rows(spark, ("t1", T0, T0, "a"), ("t2", T0 + 4 * DAY, T0, "a"))
    moved = sales_rows(spark, ("t1", T0 + 4 * DAY, T0, "b"))
    want = [("t1", "b", T0 + 4 * DAY), ("t2", "a", T0 + 4 * DAY)]
    for steps in range(4):
        warehouse = Warehouse(spark, str(tmp_path / str(steps)))
        rows = lambda: sorted((r.transaction_id, r.payment_method, r.sale_timestamp) for r in warehouse.read("transactions_raw").collect())  # noqa: B023
        warehouse.upsert("transactions_raw", first)
        with monkeypatch.context() as patch:
            lose_after(patch, steps)
            if steps < 3:
                with pytest.raises(Lost):
                    warehouse.upsert("transactions_raw", moved, run_id="move")
                assert rows() == [("t1", "a", T0), ("t2", "a", T0 + 4 * DAY)]
            else:
                warehouse.upsert("transactions_raw", moved, run_id="move")
        if steps == 2:  # it had written everything
            warehouse.publish("transactions_raw", "move")
            warehouse.publish("transactions_raw", "move")
            assert rows() == want
        for _ in range(2):
            warehouse.upsert("transactions_raw", moved, run_id="move")
            assert rows() == want
        assert warehouse.folders_of("transactions_raw", first) == ["2025-01-01", "2025-01-05"]
        assert list(warehouse._content()["transactions_raw"]) == ["2025-01-05"]


def customers(spark, *rows):
    return spark.createDataFrame(list(rows), "customer_id string, store_id string, name string")


def test_readers_keep_their_version(spark, tmp_path):
    warehouse = Warehouse(spark, str(tmp_path))
    warehouse.upsert("customers_raw", customers(spark, ("1", "s", "old"), ("2", "s", "old")))
    reader, frame = warehouse.at(), warehouse.read("customers_raw")
    warehouse.upsert("customers_raw", customers(spark, ("1", "s", "new"), ("3", "s", "new")))
    names = lambda rows: sorted((r.customer_id, r.name) for r in rows.collect())
    assert names(reader.read("customers_raw")) == names(frame) == [("1", "old"), ("2", "old")]
    assert names(warehouse.read("customers_raw")) == [("1", "new"), ("2", "old"), ("3", "new")]
    assert warehouse.at(0).read("customers_raw").count() == 0
    with pytest.raises(ValueError):
        reader.append("customers_raw", customers(spark, ("4", "s", "x")))


def test_reads_inside_a_transaction_see_its_writes_and_others_do_not(spark, tmp_path):
    warehouse, other = Warehouse(spark, str(tmp_path)), Warehouse(spark, str(tmp_path))
    with warehouse.transaction():
        warehouse.upsert("customers_raw", customers(spark, ("1", "s", "a")))
        warehouse.append("customers_raw", customers(spark, ("1x", "s", "b")))
        with warehouse.transaction():
            warehouse.upsert("customers_raw", customers(spark, ("1", "s", "c"), ("2", "s", "c")))
        assert warehouse.read("customers_raw").count() == 3 and other.read("customers_raw").count() == 0
    assert other.read("customers_raw").count() == 3 and warehouse.versions.all() == [1]
    with pytest.raises(Lost), warehouse.transaction():
        warehouse.purge_store("s")
        assert warehouse.read("customers_raw").count() == 0
        raise Lost
    assert warehouse.read("customers_raw").count() == 3
    assert warehouse.purge_store("s") == ["customers_raw"] and not warehouse.exists("customers_raw")


def test_two_jobs(spark, tmp_path):
    one, two = Warehouse(spark, str(tmp_path)), Warehouse(spark, str(tmp_path))
    one.upsert("customers_raw", customers(spark, ("1", "s", "a")))
    # Other tables do not matter, and rows that are only added to a table do not clash.
    with one.transaction():
        one.upsert("customers_raw", customers(spark, ("2", "s", "one")))
        one.append("messages", spark.createDataFrame([("m1", "s")], "message_id string, store_id string"))
        two.append("messages", spark.createDataFrame([("m2", "s")], "message_id string, store_id string"))
        two.upsert("stores", spark.createDataFrame([("s", "n")], "store_id string, name string"))
    assert (one.read("messages").count(), one.read("stores").count(), one.read("customers_raw").count()) == (2, 1, 2)
    with pytest.raises(Conflict), one.transaction():
        one.upsert("customers_raw", customers(spark, ("2", "s", "late")))
        two.upsert("customers_raw", customers(spark, ("3", "s", "two")))
    assert sorted((r.customer_id, r.name) for r in one.read("customers_raw").collect()) == [("1", "a"), ("2", "one"), ("3", "two")]


def test_a_version_is_written_once(spark, tmp_path):
    versions = Versions(spark, str(tmp_path))
    assert versions.write(1, {"t": {"f": ["a"]}}) and not versions.write(1, {"t": {"f": ["b"]}})
    assert Versions(spark, str(tmp_path)).content(1) == {"t": {"f": ["a"]}}
    assert [n for n in os.listdir(tmp_path / "_versions") if not n.endswith(".crc")] == ["000000000001.json"]


def test_expiry_removes_only_what_no_kept_version_names(spark, tmp_path):
    warehouse = Warehouse(spark, str(tmp_path))
    day = lambda n, how: sales_rows(spark, (f"t{n}", T0 + n * DAY, T0, how))
    for n in range(3):
        warehouse.upsert("transactions_raw", day(n, "a"))
    warehouse.upsert("transactions_raw", day(1, "b"))
    pinned = warehouse.at()
    warehouse.upsert("transactions_raw", day(2, "b"))
    assert warehouse.expire(keep=2) == 1 and warehouse.expire(keep=2) == 0  # the first files of day 1
    assert sorted((r.transaction_id, r.payment_method) for r in pinned.read("transactions_raw").collect()) == [("t0", "a"), ("t1", "b"), ("t2", "a")]
    assert warehouse.expire(keep=1) == 1
    assert sorted((r.transaction_id, r.payment_method) for r in warehouse.read("transactions_raw").collect()) == [("t0", "a"), ("t1", "b"), ("t2", "b")]
    assert warehouse.versions.all() == [5]
    warehouse.upsert("transactions_raw", day(0, "c"))
    assert warehouse.read("transactions_raw").count() == 3


def test_odd_store_names_and_times_are_folders(spark, tmp_path):
    warehouse = Warehouse(spark, str(tmp_path))
    names = ["a/b", "x=y", "100%", "*", "{a}", "é ", "", None]
    rows = spark.createDataFrame([(n, f"p{i}", [1.0]) for i, n in enumerate(names)], "store_id string, product_id string, embedding array<double>")
    warehouse.replace_stores("product_embeddings", rows)
    got = {(r.store_id, r.product_id) for r in warehouse.read("product_embeddings").collect()}
    assert got == {(n, f"p{i}") for i, n in enumerate(names)}
    assert [r.product_id for r in warehouse.read("product_embeddings", store_id="{a}").collect()] == ["p4"]
    warehouse.upsert("transactions_raw", spark.createDataFrame([("t", "s", None)], "transaction_id string, store_id string, sale_timestamp timestamp"))
    assert warehouse.read("transactions_raw").where(F.col("sale_timestamp").isNull()).count() == 1
    assert dt.datetime(2025, 1, 1) == T0
