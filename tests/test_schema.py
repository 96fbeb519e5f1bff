"""Namespace-level operators, verification and the command line."""

from __future__ import annotations

import pytest

from ferry.cli import main as cli_main
from ferry.operators.schema import failure_count, migrate_schema, plan_migration
from ferry.operators.verify import compare_tables, partition_row_counts, verify_migration
from ferry.operators.migrate import migrate_table
from ferry.sources.catalog import list_source_tables, missing_tables, normalize_listing
from ferry.sources.partitions import schema_partition_columns

C = "spark_catalog"


def test_listing_drops_temp_views_and_flags_views(spark, src):
    rows = {r.table_name: r.is_view for r in list_source_tables(spark, C, src).collect()}
    assert "ferry_tmp_v" not in rows
    assert rows["nation_v"] is True and rows["broken_v"] is True and rows["lineitem"] is False
    no_views = {r.table_name for r in list_source_tables(spark, C, src, include_views=False).collect()}
    assert "nation_v" not in no_views and "lineitem" in no_views


def test_listing_include_and_missing(spark, src):
    listing = list_source_tables(spark, C, src, include={"nation", "nope"})
    assert [r.table_name for r in listing.collect()] == ["nation"]
    assert missing_tables(spark, listing, {"nation", "nope"}) == ["nope"]


def test_listing_normalizes_column_name_drift(spark):
    a = spark.createDataFrame([("x", None), ("y", True)], "table_name string, is_temporary boolean")
    b = spark.createDataFrame([("x", False)], "tablename string, istemporary boolean")
    assert [(r.table_name, r.is_temporary) for r in normalize_listing(a).collect()] == [("x", False), ("y", True)]
    assert [(r.table_name, r.is_temporary) for r in normalize_listing(b).collect()] == [("x", False)]


def test_plan_has_no_side_effects(spark, src):
    plan = plan_migration(spark, C, src, C, "never_created_ns", tables=["lineitem", "spaced", "ghost"])
    rows = {r.table_name: r for r in plan.collect()}
    assert rows["lineitem"].action == "create" and rows["lineitem"].partition_cols == "l_returnflag,l_linestatus"
    assert rows["spaced"].action == "refuse"
    assert rows["ghost"].action == "not_found"
    assert not spark.catalog.databaseExists(f"{C}.never_created_ns")


def test_migrate_schema_report(spark, src, tgt):
    report = migrate_schema(
        spark, C, src, C, tgt, tables=["lineitem", "nation_v", "broken_v", "ghost"], continue_on_error=True
    )
    rows = {r.table_name: r for r in report.collect()}
    assert rows["lineitem"].status == "ok" and rows["lineitem"].rows_source == rows["lineitem"].rows_target
    assert rows["nation_v"].status == "ok" and rows["nation_v"].rows_target == 25
    assert rows["broken_v"].status == "failed" and "TABLE_OR_VIEW_NOT_FOUND" in rows["broken_v"].error
    assert rows["ghost"].status == "not_found"
    assert failure_count(report) == 1


def test_migrate_schema_raises_without_continue(spark, src, tgt):
    with pytest.raises(Exception):
        migrate_schema(spark, C, src, C, tgt, tables=["broken_v"])


def test_migrate_schema_parallel_and_full_verify(spark, src, tgt):
    report = migrate_schema(
        spark, C, src, C, tgt, tables=["orders", "orders_n", "nation"], verify="full", parallelism=3
    )
    assert {r.status for r in report.collect()} == {"ok"}
    again = migrate_schema(spark, C, src, C, tgt, tables=["orders"], if_exists="skip")
    assert [r.status for r in again.collect()] == ["skipped"]


def test_schema_partition_columns(spark, src):
    rows = {(r.table_name, r.pos): (r.column_name, r.found_by) for r in schema_partition_columns(spark, C, src).collect()}
    assert rows[("lineitem", 1)] == ("l_returnflag", "catalog")
    assert rows[("typed", 2)] == ("hr", "catalog")
    assert not any(t == "customer" for t, _ in rows)


def test_verify_passes_on_a_good_copy(spark, src, tgt):
    migrate_table(spark, f"{C}.{src}.orders_n", f"{C}.{tgt}.orders_n")
    rep = verify_migration(spark, f"{C}.{src}.orders_n", f"{C}.{tgt}.orders_n").collect()
    assert all(r.ok for r in rep), rep
    counts = {r.p: r.row_count for r in partition_row_counts(spark, f"{C}.{tgt}.orders_n").collect()}
    assert sum(counts.values()) == spark.table(f"{C}.{src}.orders_n").count() and None in counts


def test_verify_catches_changed_lost_and_unpartitioned(spark, src, tgt):
    s = f"{C}.{src}.orders"
    # a changed value in one row
    spark.sql(
        f"CREATE TABLE {C}.{tgt}.changed USING parquet PARTITIONED BY (o_orderstatus) AS "
        f"SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey = (SELECT min(o_orderkey) FROM {s}) "
        f"THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice, o_orderdate, o_orderpriority, o_orderstatus FROM {s}"
    )
    bad = {r.check_name: r.ok for r in verify_migration(spark, s, f"{C}.{tgt}.changed").collect()}
    assert bad["row_count"] and not bad["content_hash"] and not bad["partition_mismatches"]
    # a lost row
    spark.sql(
        f"CREATE TABLE {C}.{tgt}.lost USING parquet PARTITIONED BY (o_orderstatus) AS "
        f"SELECT * FROM {s} WHERE o_orderkey <> (SELECT min(o_orderkey) FROM {s})"
    )
    lost = {r.check_name: r.ok for r in verify_migration(spark, s, f"{C}.{tgt}.lost").collect()}
    assert not lost["row_count"] and not lost["content_hash"]
    # the partition column not registered
    spark.sql(f"CREATE TABLE {C}.{tgt}.flat USING parquet AS SELECT * FROM {s}")
    flat = {r.check_name: r.ok for r in verify_migration(spark, s, f"{C}.{tgt}.flat").collect()}
    assert flat["row_count"] and flat["content_hash"] and not flat["partition_columns"]


def test_hash_handles_maps_regardless_of_entry_order(spark, tgt):
    spark.sql(f"CREATE TABLE {C}.{tgt}.m1 USING parquet AS SELECT 1 AS k, map('a', 1, 'b', 2) AS m")
    spark.sql(f"CREATE TABLE {C}.{tgt}.m2 USING parquet AS SELECT 1 AS k, map('b', 2, 'a', 1) AS m")
    spark.sql(f"CREATE TABLE {C}.{tgt}.m3 USING parquet AS SELECT 1 AS k, map('b', 2, 'a', 3) AS m")
    assert compare_tables(spark, f"{C}.{tgt}.m1", f"{C}.{tgt}.m2")["mismatched"] == 0
    assert compare_tables(spark, f"{C}.{tgt}.m1", f"{C}.{tgt}.m3")["mismatched"] == 1


def test_cli_exit_codes(spark, src, tgt, capsys):
    base = ["--source-schema", src, "--target-catalog", C, "--target-schema", tgt, "--provider", "parquet"]
    assert cli_main(base + ["--tables", "nation", "--dry-run"], spark=spark) == 0
    assert not spark.catalog.tableExists(f"{C}.{tgt}.nation")
    assert cli_main(base + ["--tables", "nation,region"], spark=spark) == 0
    assert cli_main(base + ["--tables", "nation", "--mode", "fail"], spark=spark) == 0
    assert cli_main(base + ["--tables", "broken_v,region", "--continue-on-error"], spark=spark) == 1
    assert cli_main(base + ["--tables", "ghost"], spark=spark) == 1
    out = capsys.readouterr().out
    assert "[skipped] nation" in out and "[failed] broken_v" in out


def test_verify_schema_reports_every_table(spark, src, tgt):
    from ferry.operators.verify import verify_schema

    migrate_schema(spark, C, src, C, tgt, tables=["orders", "nation", "typed"], parallelism=3)
    spark.sql(f"INSERT INTO {C}.{tgt}.nation SELECT * FROM {C}.{src}.nation LIMIT 1")  # one extra row
    rep = verify_schema(spark, C, src, C, tgt, tables=["nation", "orders", "typed"], parallelism=3).collect()
    bad = {(r.table_name, r.check_name) for r in rep if not r.ok}
    assert bad == {("nation", "row_count"), ("nation", "content_hash"), ("nation", "partition_mismatches")}
    assert len(rep) == 21


def test_session_catalog_and_namespace_unchanged(spark, src, tgt):
    before = (spark.catalog.currentCatalog(), spark.catalog.currentDatabase())
    plan_migration(spark, C, src, C, tgt).collect()
    migrate_schema(spark, C, src, C, tgt, tables=["region", "orders_empty"], continue_on_error=True)
    schema_partition_columns(spark, C, src).collect()
    assert (spark.catalog.currentCatalog(), spark.catalog.currentDatabase()) == before


def test_concurrent_jobs_keep_the_callers_job_group(spark, src, tgt):
    sc = spark.sparkContext
    sc.setJobGroup("ferry-group-test", "ferry-group-test")
    try:
        migrate_schema(spark, C, src, C, tgt, tables=["nation", "region", "supplier"], parallelism=3)
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert len(sc.statusTracker().getJobIdsForGroup("ferry-group-test")) >= 3


def test_cli_verbose_logs_each_statement(spark, src, tgt, caplog):
    import logging

    base = ["--source-schema", src, "--target-catalog", C, "--target-schema", tgt, "--provider", "parquet"]
    with caplog.at_level(logging.DEBUG, logger="ferry"):
        assert cli_main(base + ["--tables", "orders", "-v"], spark=spark) == 0
    text = caplog.text
    assert "orders, partitioned by o_orderstatus (from catalog)" in text
    assert f"CREATE TABLE {C}.{tgt}.orders" in text and "PARTITIONED BY (o_orderstatus)" in text


def test_same_namespace_is_refused_before_any_ddl(spark, src):
    plan = {r.table_name: r.action for r in plan_migration(spark, C, src, C, src, tables=["nation", "orders"]).collect()}
    assert plan == {"nation": "refuse", "orders": "refuse"}
    report = migrate_schema(spark, C, src, C, src, tables=["nation", "orders"], continue_on_error=True).collect()
    assert {r.status for r in report} == {"failed"} and all("same table" in r.error for r in report)
    assert spark.table(f"{C}.{src}.orders").count() > 0 and spark.table(f"{C}.{src}.nation").count() == 25


# ------------------------------------------- what verification must not miss

NESTED_PAIRS = [
    ("array(1, NULL)", "array(NULL, 1)"),
    ("named_struct('a', CAST(NULL AS STRING), 'b', 'q')", "named_struct('a', 'q', 'b', CAST(NULL AS STRING))"),
    ("named_struct('a', array(1, 2), 'b', array(3))", "named_struct('a', array(1), 'b', array(2, 3))"),
    ("CAST(NULL AS STRUCT<a: INT>)", "named_struct('a', CAST(NULL AS INT))"),
    ("array(CAST(NULL AS ARRAY<INT>))", "array(CAST(array() AS ARRAY<INT>))"),
    ("map('k', array(1), 'l', array(2, 3))", "map('k', array(1, 2), 'l', array(3))"),
]


@pytest.mark.parametrize("left,right", NESTED_PAIRS)
def test_row_hash_tells_nested_values_apart(spark, left, right):
    from ferry.functions.hashing import row_hash

    a, b, again = (spark.sql(f"SELECT {v} AS v") for v in (left, right, left))
    x, y, z = (df.select(row_hash(df).alias("h")).first().h for df in (a, b, again))
    assert x == z != y


def test_row_hash_of_maps_has_no_order_and_variants_work(spark):
    from ferry.functions.hashing import row_hash

    a, b = (spark.sql(f"SELECT {v} AS v") for v in ("map('a', 1, 'b', 2)", "map('b', 2, 'a', 1)"))
    assert a.select(row_hash(a).alias("h")).first().h == b.select(row_hash(b).alias("h")).first().h
    v = spark.sql("SELECT named_struct('v', parse_json('{\"a\": 1}')) AS s")
    assert v.select(row_hash(v).alias("h")).first().h is not None


def test_verification_compares_declared_types(spark, tgt):
    spark.sql(f"CREATE TABLE {C}.{tgt}.short_text (t VARCHAR(15)) USING parquet")
    spark.sql(f"CREATE TABLE {C}.{tgt}.long_text (t STRING) USING parquet")
    report = verify_migration(spark, f"{C}.{tgt}.short_text", f"{C}.{tgt}.long_text").collect()
    assert [r.check_name for r in report if not r.ok] == ["types"]


def test_first_failure_ends_a_concurrent_run():
    import threading

    from ferry.concurrency import map_concurrently

    started, gate = [], threading.Event()

    def work(x):
        started.append(x)
        if x == 0:
            gate.wait(5)
            raise ValueError("first line\nsecond line")
        if x == 1:
            gate.set()
            threading.Event().wait(0.3)
        return x

    with pytest.raises(ValueError) as caught:
        map_concurrently(work, range(8), 2)
    assert len(started) < 8 and "finished before" in caught.value.__notes__[0]


def test_errors_are_reported_whole(spark, src, tgt):
    report = migrate_schema(spark, C, src, C, tgt, tables=["broken_v"], continue_on_error=True)
    assert "\n" in report.first().error


def test_skipped_tables_are_not_counted_and_full_checks_count_once(spark, src, tgt):
    full = migrate_schema(spark, C, src, C, tgt, tables=["nation"], verify="full").first()
    assert (full.rows_source, full.rows_target, full.status) == (25, 25, "ok")
    again = migrate_schema(spark, C, src, C, tgt, tables=["nation"], if_exists="skip")
    assert (again.first().status, again.first().rows_source) == ("skipped", None)


def test_no_item_starts_after_a_failure():
    import threading

    from ferry.concurrency import map_concurrently

    started, other = [], threading.Event()

    def work(x):
        started.append(x)
        if x == 0:
            raise ValueError("no")
        other.wait(0.5)
        return x

    with pytest.raises(ValueError):
        map_concurrently(work, range(50), 2)
    assert set(started) <= {0, 1}


def test_self_test(spark, capsys):
    assert cli_main(["--self-test"], spark=spark) == 0
    assert "7 of 7 cases hold" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        cli_main([], spark=spark)
