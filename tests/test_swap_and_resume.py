"""Overwrites during which the target is never missing, and copies that go on
where they were ended."""

from __future__ import annotations

import os
import threading

import pytest

import ferry.operators.migrate as migrate
from ferry.operators.migrate import MigrationError, RowCountMismatch, migrate_table, recover_swaps
from ferry.operators.resume import migrate_resumable
from ferry.sources.catalog import namespace_location, table_location, table_type
from ferry.sources.partitions import partition_columns

C = "spark_catalog"


def same_rows(a, b):
    cols = sorted(a.columns)
    a, b = a.select(*cols), b.select(*cols)
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def specs(spark, table):
    return {r.partition for r in spark.sql(f"SHOW PARTITIONS {table}").collect()}


def folder(location):
    return location.replace("file:", "").rstrip("/")


def test_the_target_is_there_during_an_overwrite(spark, src, tgt):
    table = f"{C}.{tgt}.orders"
    migrate_table(spark, f"{C}.{src}.orders", table)
    whole = spark.table(table).count()
    seen, missed, end = [], [], threading.Event()

    def poll():
        while not end.is_set():
            try:
                seen.append(spark.catalog.tableExists(table))
                spark.table(table)
            except Exception as e:
                missed.append(e)

    reader = threading.Thread(target=poll)
    reader.start()
    try:
        for _ in range(3):
            migrate_table(spark, f"{C}.{src}.orders", table, verify="counts")
    finally:
        end.set()
        reader.join()
    assert not missed and seen and all(seen) and spark.table(table).count() == whole
    assert same_rows(spark.table(table), spark.table(f"{C}.{src}.orders")) and table_type(spark, table) == "EXTERNAL"


def test_partitions_of_the_old_version_go_and_new_ones_come(spark, src, tgt):
    table, columns = f"{C}.{tgt}.orders", "o_orderkey, o_totalprice, p"
    spark.sql(f"CREATE TABLE {C}.{tgt}.first USING orc PARTITIONED BY (p) AS SELECT o_orderkey, o_totalprice, IF(o_orderkey % 2 = 0, 'it''s old', p) AS p FROM {C}.{src}.orders_n WHERE p IS NULL OR p <> 'O'")
    spark.sql(f"CREATE TABLE {C}.{tgt}.second USING orc PARTITIONED BY (p) AS SELECT {columns} FROM {C}.{src}.orders_n WHERE p IS NOT NULL")
    migrate_table(spark, f"{C}.{tgt}.first", table)
    first = table_location(spark, table)
    assert "p=__HIVE_DEFAULT_PARTITION__" in specs(spark, table)
    migrate_table(spark, f"{C}.{tgt}.second", table, purge_replaced=True)
    assert specs(spark, table) == specs(spark, f"{C}.{tgt}.second")
    assert same_rows(spark.table(table), spark.table(f"{C}.{tgt}.second"))
    assert table_location(spark, table) != first and not os.path.exists(folder(first))
    # Back again: the NULL partition is new now.
    migrate_table(spark, f"{C}.{tgt}.first", table)
    assert same_rows(spark.table(table), spark.table(f"{C}.{tgt}.first")) and specs(spark, table) == specs(spark, f"{C}.{tgt}.first")


def test_catalogs_that_keep_known_partitions_are_pointed_one_by_one(spark, src, tgt, monkeypatch):
    table = f"{C}.{tgt}.orders"
    migrate_table(spark, f"{C}.{src}.orders", table)
    old, said, sql = table_location(spark, table), [], type(spark).sql
    where = migrate._partition_location
    monkeypatch.setattr(migrate, "_partition_location", lambda s, t, c: old + "/x" if t == table else where(s, t, c))
    monkeypatch.setattr(type(spark), "sql", lambda s, q, *a, **k: (said.append(q), sql(s, q, *a, **k))[1])
    migrate_table(spark, f"{C}.{src}.orders", table)
    assert sum("PARTITION (o_orderstatus" in q and "SET LOCATION" in q for q in said) == 3
    assert same_rows(spark.table(table), spark.table(f"{C}.{src}.orders"))


def test_other_shapes_and_unpartitioned_tables(spark, src, tgt):
    table = f"{C}.{tgt}.t"
    migrate_table(spark, f"{C}.{src}.nation", table)
    before = table_location(spark, table)
    migrate_table(spark, f"{C}.{src}.nation", table)
    assert table_location(spark, table) != before and spark.table(table).count() == 25
    migrate_table(spark, f"{C}.{src}.region", table)  # other columns: renamed into place
    assert same_rows(spark.table(table), spark.table(f"{C}.{src}.region"))
    migrate_table(spark, f"{C}.{src}.region", table, provider="orc")
    migrate_table(spark, f"{C}.{src}.region", table, provider="orc", partition_cols=["r_name"])
    assert partition_columns(spark, table).columns == ["r_name"] and spark.table(table).count() == 5


def test_recovery_finishes_a_swap_that_was_cut_short(spark, src, tgt, monkeypatch):
    table = f"{C}.{tgt}.orders"
    migrate_table(spark, f"{C}.{src}.orders", table)
    with monkeypatch.context() as m:
        m.setattr(migrate, "_repoint_partitions", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):
            migrate_table(spark, f"{C}.{src}.orders", table)
    new = table_location(spark, table)
    assert [r.action for r in recover_swaps(spark, C, tgt, purge=True).collect()] == ["completed", "purged"]
    assert table_location(spark, table) == new and os.path.exists(folder(new))
    assert same_rows(spark.table(table), spark.table(f"{C}.{src}.orders"))
    assert {r.tableName for r in spark.sql(f"SHOW TABLES IN {C}.{tgt}").collect() if not r.isTemporary} == {"orders"}


# ---------------------------------------------------------------- resume


class Ended(RuntimeError):
    pass


def end_after(n, done):
    def on_step(step, rows):
        done.append((step, rows))
        if len(done) == n:
            raise Ended

    return on_step


def changed_files(spark, tgt, table):
    root = folder(namespace_location(spark, C, tgt))
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, files in os.walk(root) for f in files if f"{table}__v_" in d and f.startswith("part-")}


def test_an_ended_copy_goes_on_with_the_missing_partitions(spark, src, tgt):
    source, table = f"{C}.{src}.events_d", f"{C}.{tgt}.events_d"
    spark.sql(f"CREATE TABLE {table} USING parquet AS SELECT 'old' AS note")
    first: list = []
    with pytest.raises(Ended):
        migrate_resumable(spark, source, table, steps=6, on_step=end_after(3, first))
    assert spark.table(table).first().note == "old"  # in use until the new copy is whole
    kept = changed_files(spark, tgt, "events_d")
    assert kept and [s for s, _ in first] == [0, 1, 2]
    second: list = []
    made = migrate_resumable(spark, source, table, steps=99, verify="full", on_step=end_after(99, second))
    assert [s for s, _ in second] == [3, 4, 5]  # in the steps of the first run
    assert made.rows_source == sum(r for _, r in first + second) == spark.table(source).count()
    now = changed_files(spark, tgt, "events_d")
    assert {f: t for f, t in now.items() if f in kept} == kept and len(now) > len(kept)
    assert same_rows(spark.table(table), spark.table(source)) and partition_columns(spark, table).columns == ["d"]
    assert {r.tableName for r in spark.sql(f"SHOW TABLES IN {C}.{tgt}").collect() if not r.isTemporary} == {"events_d"}


def test_a_step_that_was_cut_short_is_written_again(spark, src, tgt, monkeypatch):
    import ferry.operators.resume as resume

    source, table = f"{C}.{src}.orders_n", f"{C}.{tgt}.orders_n"
    note = resume._note
    with monkeypatch.context() as m:  # rows are written, but the step is not noted
        m.setattr(resume, "_note", lambda s, t, row: note(s, t, row) if row[4] < 1 else (_ for _ in ()).throw(Ended()))
        with pytest.raises(Ended):
            migrate_resumable(spark, source, table, steps=2)
    migrate_resumable(spark, source, table)
    assert same_rows(spark.table(table), spark.table(source))
    # A second copy over the first, in another partitioning, starts anew.
    migrate_resumable(spark, source, table, partition_cols=["o_orderpriority"], steps=3)
    assert partition_columns(spark, table).columns == ["o_orderpriority"] and same_rows(spark.table(table), spark.table(source))


def test_empty_typed_and_unpartitioned_tables(spark, src, tgt, monkeypatch):
    for t in ("orders_empty", "typed", "nation"):
        made = migrate_resumable(spark, f"{C}.{src}.{t}", f"{C}.{tgt}.{t}", steps=3, verify="full")
        assert made.status == "ok" and same_rows(spark.table(f"{C}.{src}.{t}"), spark.table(f"{C}.{tgt}.{t}"))
    with pytest.raises(MigrationError):
        migrate_resumable(spark, f"{C}.{src}.orders", f"{C}.{src}.orders")
    with pytest.raises(MigrationError):
        migrate_resumable(spark, f"{C}.{src}.orders", "lake.n.orders", provider="iceberg")
    count = migrate._count
    monkeypatch.setattr(migrate, "_count", lambda s, t: count(s, t) - ("__part_" in t))
    with pytest.raises(RowCountMismatch):
        migrate_resumable(spark, f"{C}.{src}.orders", f"{C}.{tgt}.orders", steps=2)
    assert not spark.catalog.tableExists(f"{C}.{tgt}.orders")
