"""migrate_table: create, partitioning kept, special values, overwrite by
swap, skip, refusals, write distribution and pruning in the plans."""

from __future__ import annotations

import os

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ferry.operators.migrate import MigrationError, migrate_table
from ferry.plans.write_plan import WritePlan, explain
from ferry.sources.catalog import table_location
from ferry.sources.partitions import partition_columns

C = "spark_catalog"


def same_rows(a, b):
    cols = sorted(a.columns)
    a, b = a.select(*cols), b.select(*cols)
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_partitioned_copy_keeps_partition_columns(spark, src, tgt):
    res = migrate_table(spark, f"{C}.{src}.lineitem", f"{C}.{tgt}.lineitem")
    assert res.action == "create" and res.status == "ok"
    assert res.partition_cols == ["l_returnflag", "l_linestatus"]
    assert res.found_by == "catalog"
    assert res.distribution == "none"  # source already laid out by the same columns
    assert partition_columns(spark, f"{C}.{tgt}.lineitem").columns == ["l_returnflag", "l_linestatus"]
    assert same_rows(spark.table(f"{C}.{src}.lineitem"), spark.table(f"{C}.{tgt}.lineitem"))
    assert len(spark.sql(f"SHOW PARTITIONS {C}.{tgt}.lineitem").collect()) == 6


def test_unpartitioned_copy(spark, src, tgt):
    res = migrate_table(spark, f"{C}.{src}.customer", f"{C}.{tgt}.customer")
    assert res.partition_cols == [] and res.found_by is None
    assert "PARTITIONED BY" not in res.sql
    assert same_rows(spark.table(f"{C}.{src}.customer"), spark.table(f"{C}.{tgt}.customer"))


def test_null_and_escaped_partition_values_round_trip(spark, src, tgt):
    migrate_table(spark, f"{C}.{src}.orders_n", f"{C}.{tgt}.orders_n")
    assert same_rows(spark.table(f"{C}.{src}.orders_n"), spark.table(f"{C}.{tgt}.orders_n"))
    vals = {r.p for r in spark.table(f"{C}.{tgt}.orders_n").select("p").distinct().collect()}
    assert vals == {None, "a/b:c+d", "O"}


def test_date_partitions_and_array_column(spark, src, tgt):
    migrate_table(spark, f"{C}.{src}.events_d", f"{C}.{tgt}.events_d")
    migrate_table(spark, f"{C}.{src}.embeddings_l", f"{C}.{tgt}.embeddings_l")
    assert dict(spark.table(f"{C}.{tgt}.events_d").dtypes)["d"] == "date"
    assert len(spark.sql(f"SHOW PARTITIONS {C}.{tgt}.events_d").collect()) == 30
    assert same_rows(spark.table(f"{C}.{src}.embeddings_l"), spark.table(f"{C}.{tgt}.embeddings_l"))


def test_varchar_char_decimal_kept(spark, src, tgt):
    migrate_table(spark, f"{C}.{src}.typed", f"{C}.{tgt}.typed")
    ddl = spark.sql(f"SHOW CREATE TABLE {C}.{tgt}.typed").collect()[0][0]
    assert "VARCHAR(15)" in ddl and "CHAR(4)" in ddl and "DECIMAL(12,2)" in ddl
    assert partition_columns(spark, f"{C}.{tgt}.typed").columns == ["dt", "hr"]
    assert same_rows(spark.table(f"{C}.{src}.typed"), spark.table(f"{C}.{tgt}.typed"))


def test_explicit_partitioning_is_rebalanced(spark, src, tgt):
    res = migrate_table(spark, f"{C}.{src}.customer", f"{C}.{tgt}.customer", partition_cols=["C_MKTSEGMENT"])
    assert res.partition_cols == ["c_mktsegment"] and res.found_by == "given"
    assert res.distribution == "rebalance"
    assert "REBALANCE(c_mktsegment)" in res.sql
    # one file per partition value: the shuffle grouped the rows
    loc = table_location(spark, f"{C}.{tgt}.customer").replace("file:", "")
    for d in os.listdir(loc):
        if d.startswith("c_mktsegment="):
            files = [f for f in os.listdir(os.path.join(loc, d)) if f.endswith(".parquet")]
            assert len(files) == 1, (d, files)


def test_plan_shapes(spark, src):
    same = WritePlan(f"{C}.{src}.lineitem", f"{C}.x.y", "parquet", ["l_returnflag", "l_linestatus"], "none").sql()
    text = explain(spark, same, "EXTENDED")
    assert "RebalancePartitions" not in text and "Exchange" not in text
    other = WritePlan(f"{C}.{src}.customer", f"{C}.x.y", "parquet", ["c_mktsegment"], "rebalance").sql()
    assert "RebalancePartitions" in explain(spark, other, "EXTENDED")


def _stages_of(spark, group, action):
    sc = spark.sparkContext
    sc.setJobGroup(group, group)
    try:
        action()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    tracker = sc.statusTracker()
    # AQE runs each query stage as its own job and later jobs list earlier
    # map stages again as skipped ones; count the stages that ran tasks.
    # Catalog calls iterate small local datasets ("hasNext" jobs): not data work.
    ran = set()
    for j in tracker.getJobIdsForGroup(group):
        for s in tracker.getJobInfo(j).stageIds:
            info = tracker.getStageInfo(s)
            if info is not None and info.numCompletedTasks > 0 and not info.name.startswith("hasNext"):
                ran.add(s)
    return len(ran)


def test_executed_copies_shuffle_only_when_layout_changes(spark, src, tgt):
    same = WritePlan(f"{C}.{src}.lineitem", f"{C}.{tgt}.li", "parquet", ["l_returnflag", "l_linestatus"], "none")
    changed = WritePlan(f"{C}.{src}.orders", f"{C}.{tgt}.o", "parquet", ["o_orderpriority"], "rebalance")
    assert _stages_of(spark, "ferry-same", lambda: spark.sql(same.sql())) == 1  # scan+write, no exchange
    assert _stages_of(spark, "ferry-changed", lambda: spark.sql(changed.sql())) >= 2  # rebalance shuffle


def test_pruned_read_has_partition_filters(spark, src, tgt):
    migrate_table(spark, f"{C}.{src}.lineitem", f"{C}.{tgt}.lineitem")
    df = spark.table(f"{C}.{tgt}.lineitem").where(F.col("l_returnflag") == "A").select("l_orderkey")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(l_returnflag" in plan and "(l_returnflag" in plan
    assert "ReadSchema: struct<l_orderkey:bigint>" in plan


def test_overwrite_replaces_other_schema(spark, src, tgt):
    spark.sql(f"CREATE TABLE {C}.{tgt}.orders USING parquet AS SELECT 1 AS x, 'old' AS y")
    res = migrate_table(spark, f"{C}.{src}.orders", f"{C}.{tgt}.orders", verify=True)
    assert res.action == "overwrite"
    assert same_rows(spark.table(f"{C}.{src}.orders"), spark.table(f"{C}.{tgt}.orders"))
    assert partition_columns(spark, f"{C}.{tgt}.orders").columns == ["o_orderstatus"]
    names = {r.tableName for r in spark.sql(f"SHOW TABLES IN {C}.{tgt}").collect()}
    assert not any("__stg_" in n for n in names)


def test_second_overwrite_removes_the_replaced_version(spark, src, tgt):
    migrate_table(spark, f"{C}.{src}.orders", f"{C}.{tgt}.orders")
    spark.sql(f"INSERT INTO {C}.{tgt}.orders SELECT * FROM {C}.{src}.orders")  # make it differ
    migrate_table(spark, f"{C}.{src}.orders", f"{C}.{tgt}.orders")
    first = table_location(spark, f"{C}.{tgt}.orders")
    migrate_table(spark, f"{C}.{src}.orders", f"{C}.{tgt}.orders")
    kept = table_location(spark, f"{C}.{tgt}.orders")
    assert os.path.exists(first.replace("file:", ""))  # removal is asked for, never a default
    first = kept
    migrate_table(spark, f"{C}.{src}.orders", f"{C}.{tgt}.orders", purge_replaced=True)
    second = table_location(spark, f"{C}.{tgt}.orders")
    assert first != second
    assert not os.path.exists(first.replace("file:", ""))
    assert same_rows(spark.table(f"{C}.{src}.orders"), spark.table(f"{C}.{tgt}.orders"))


def test_failed_copy_keeps_old_target(spark, src, tgt):
    spark.sql(f"CREATE TABLE {C}.{tgt}.broken_v USING parquet AS SELECT 7 AS keep")
    with pytest.raises(Exception):
        migrate_table(spark, f"{C}.{src}.broken_v", f"{C}.{tgt}.broken_v")
    assert [r.keep for r in spark.table(f"{C}.{tgt}.broken_v").collect()] == [7]


def test_skip_existing_and_error_mode(spark, src, tgt):
    spark.sql(f"CREATE TABLE {C}.{tgt}.nation USING parquet AS SELECT 1 AS x")
    res = migrate_table(spark, f"{C}.{src}.nation", f"{C}.{tgt}.nation", if_exists="skip")
    assert res.status == "skipped"
    assert spark.table(f"{C}.{tgt}.nation").columns == ["x"]
    with pytest.raises(MigrationError):
        migrate_table(spark, f"{C}.{src}.nation", f"{C}.{tgt}.nation", if_exists="error")


def test_refusals(spark, src, tgt):
    with pytest.raises(MigrationError, match="same table"):
        migrate_table(spark, f"{C}.{src}.nation", f"{C}.{src}.NATION")
    with pytest.raises(MigrationError, match="empty-string"):
        migrate_table(spark, f"{C}.{src}.orders_e", f"{C}.{tgt}.orders_e", partition_cols=["p"])
    assert not spark.catalog.tableExists(f"{C}.{tgt}.orders_e")
    with pytest.raises(MigrationError, match="not a column"):
        migrate_table(spark, f"{C}.{src}.nation", f"{C}.{tgt}.nation", partition_cols=["nope"])
    with pytest.raises(MigrationError, match="every column"):
        migrate_table(spark, f"{C}.{src}.region", f"{C}.{tgt}.region", partition_cols=["r_regionkey", "r_name"])
    with pytest.raises(Exception, match="not a plain name"):
        migrate_table(spark, f"{C}.{src}.spaced", f"{C}.{tgt}.spaced")


def test_empty_partitioned_table(spark, src, tgt):
    res = migrate_table(spark, f"{C}.{src}.orders_empty", f"{C}.{tgt}.orders_empty")
    assert res.partition_cols == ["o_orderstatus"]
    assert spark.table(f"{C}.{tgt}.orders_empty").count() == 0
    assert partition_columns(spark, f"{C}.{tgt}.orders_empty").columns == ["o_orderstatus"]


@pytest.mark.parametrize("probe", ["show_partitions", "show_create", "describe"])
def test_each_fallback_probe_alone(spark, src, probe):
    det = partition_columns(spark, f"{C}.{src}.typed", probes=(probe,))
    assert det.columns == ["dt", "hr"] and det.found_by == probe


def test_fallbacks_for_an_empty_table(spark, src):
    # no partition is listed, so the DDL answers (the catalog is skipped here)
    det = partition_columns(spark, f"{C}.{src}.orders_empty", probes=("show_partitions", "show_create", "describe"))
    assert det.columns == ["o_orderstatus"] and det.found_by == "show_create"
    assert any(n.startswith("show_partitions") for n in det.notes) or det.found_by == "show_create"


def test_full_chain_without_trusting_catalog(spark, src):
    det = partition_columns(spark, f"{C}.{src}.customer", trust_session_catalog=False)
    assert det.columns == [] and det.found_by is None
    assert any(n.startswith("show_partitions") for n in det.notes)


def test_partition_listing_of_a_migrated_table(spark, src, tgt):
    from ferry.sources.partitions import partition_listing

    migrate_table(spark, f"{C}.{src}.orders_n", f"{C}.{tgt}.orders_n")
    rows = {(r.key, r.value) for r in partition_listing(spark, f"{C}.{tgt}.orders_n").collect()}
    assert rows == {("p", None), ("p", "a/b:c+d"), ("p", "O")}


VALUE_CHARS = st.sampled_from(list("ab/=:+%{ }é😀#?'-_.0"))


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.none(), st.lists(VALUE_CHARS, min_size=1, max_size=6).map("".join)), min_size=1, max_size=12))
def test_partition_values_survive_a_migration(spark, values):
    """Random partition values (NULL, path-special characters, unicode) are
    kept through an ORC -> parquet partitioned copy."""
    from ferry.sources.testdata import fresh_schema

    ns = fresh_schema(spark, "prop")
    rows = [(i, v) for i, v in enumerate(values)]
    spark.createDataFrame(rows, "id int, p string").createOrReplaceTempView("prop_rows")
    spark.sql(f"CREATE TABLE {C}.{ns}.s USING orc PARTITIONED BY (p) AS SELECT * FROM prop_rows")
    migrate_table(spark, f"{C}.{ns}.s", f"{C}.{ns}.t")
    assert same_rows(spark.table(f"{C}.{ns}.s"), spark.table(f"{C}.{ns}.t"))
    assert {r.p for r in spark.table(f"{C}.{ns}.t").collect()} == set(values)


def test_hot_partition_is_split_by_the_rebalance(spark, tgt):
    """One value holding most rows is written by several tasks (AQE splits
    the skewed rebalance partition), never funnelled through one."""
    ns = tgt
    spark.sql(
        f"CREATE TABLE {C}.{ns}.skewed USING orc AS SELECT id, "
        "CASE WHEN id % 10 < 6 THEN 'hot' ELSE CAST(id % 10 AS STRING) END AS p, "
        "repeat('x', 200) AS pad FROM range(200000)"
    )
    old = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1m")
    try:
        res = migrate_table(spark, f"{C}.{ns}.skewed", f"{C}.{ns}.skewed_t", partition_cols=["p"])
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", old)
    assert res.distribution == "rebalance"
    loc = table_location(spark, f"{C}.{ns}.skewed_t").replace("file:", "")
    files = {d: [f for f in os.listdir(os.path.join(loc, d)) if f.endswith(".parquet")] for d in os.listdir(loc) if d.startswith("p=")}
    assert len(files["p=hot"]) > 1, files
    assert same_rows(spark.table(f"{C}.{ns}.skewed"), spark.table(f"{C}.{ns}.skewed_t"))


def test_verification_shuffles_once_per_side(spark, src, tgt):
    from ferry.operators.verify import compare_tables

    migrate_table(spark, f"{C}.{src}.lineitem", f"{C}.{tgt}.lineitem")
    compare_tables(spark, f"{C}.{src}.lineitem", f"{C}.{tgt}.lineitem")  # metadata warm-up
    stages = _stages_of(
        spark, "ferry-verify", lambda: compare_tables(spark, f"{C}.{src}.lineitem", f"{C}.{tgt}.lineitem")
    )
    # two map stages (one per side), the join stage, the one-row result stage;
    # AQE may submit stages as separate jobs, so count across the group
    assert stages <= 4, stages


def test_recover_interrupted_swaps(spark, src, tgt):
    from ferry.operators.migrate import recover_swaps
    from ferry.sources.catalog import namespace_location

    root = namespace_location(spark, C, tgt).rstrip("/")
    # a swap that dropped the old target but never renamed the new copy
    spark.sql(
        f"CREATE TABLE {C}.{tgt}.orders__stg_0123456789ab USING parquet PARTITIONED BY (o_orderstatus) "
        f"LOCATION '{root}/orders__v_0123456789ab' AS SELECT * FROM {C}.{src}.orders"
    )
    # a copy that never reached its swap: the target is still there
    spark.sql(f"CREATE TABLE {C}.{tgt}.nation USING parquet AS SELECT * FROM {C}.{src}.nation")
    spark.sql(
        f"CREATE TABLE {C}.{tgt}.nation__stg_ba9876543210 USING parquet "
        f"LOCATION '{root}/nation__v_ba9876543210' AS SELECT * FROM {C}.{src}.nation"
    )
    rows = {r.table_name: r.action for r in recover_swaps(spark, C, tgt).collect()}
    assert rows == {"orders": "completed", "nation": "discarded"}
    assert same_rows(spark.table(f"{C}.{src}.orders"), spark.table(f"{C}.{tgt}.orders"))
    assert partition_columns(spark, f"{C}.{tgt}.orders").columns == ["o_orderstatus"]
    assert not os.path.exists(f"{root}/nation__v_ba9876543210".replace("file:", ""))
    names = {r.tableName for r in spark.sql(f"SHOW TABLES IN {C}.{tgt}").collect()}
    assert not any("__stg_" in n for n in names)


# ------------------------------------------------- copies that must be safe

UNKEPT = [
    ("'__HIVE_DEFAULT_PARTITION__'", "string"),
    ("''", "string"),
    ("X''", "binary"),
    ("X'FF'", "binary"),
]


@pytest.mark.parametrize("value,kind", UNKEPT)
@pytest.mark.parametrize("provider", ["parquet", "hive"])
def test_values_that_a_path_would_change_are_refused(spark, tgt, value, kind, provider):
    spark.sql(f"CREATE TABLE {C}.{tgt}.s USING orc AS SELECT 1 AS id, CAST({value} AS {kind}) AS p UNION ALL SELECT 2, NULL")
    with pytest.raises(MigrationError, match="would change"):
        migrate_table(spark, f"{C}.{tgt}.s", f"{C}.{tgt}.t", provider=provider, partition_cols=["p"])
    assert not spark.catalog.tableExists(f"{C}.{tgt}.t")


def test_repeated_local_times_are_refused_and_others_kept(spark, tgt):
    zone = spark.conf.get("spark.sql.session.timeZone")
    # 06:30 UTC is the second 01:30 of that night in New York, 05:30 UTC the first.
    spark.sql(
        f"CREATE TABLE {C}.{tgt}.s USING orc AS SELECT 1 AS id, TIMESTAMP'2024-11-03 05:30:00Z' AS p "
        "UNION ALL SELECT 2, TIMESTAMP'2024-11-03 06:30:00Z' UNION ALL SELECT 3, NULL"
    )
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        with pytest.raises(MigrationError, match="would change"):
            migrate_table(spark, f"{C}.{tgt}.s", f"{C}.{tgt}.t", partition_cols=["p"])
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    migrate_table(spark, f"{C}.{tgt}.s", f"{C}.{tgt}.t", partition_cols=["p"], verify=True)
    assert same_rows(spark.table(f"{C}.{tgt}.s"), spark.table(f"{C}.{tgt}.t"))


def test_first_copies_are_staged_and_leftovers_do_not_block(spark, src, tgt):
    from ferry.operators.migrate import recover_swaps
    from ferry.sources.catalog import namespace_location, table_type

    root = namespace_location(spark, C, tgt).rstrip("/").replace("file:", "")
    for folder in ("nation/_temporary/0", "nation__v_00112233aabb/_temporary/0"):
        os.makedirs(f"{root}/{folder}")
    migrate_table(spark, f"{C}.{src}.nation", f"{C}.{tgt}.nation", verify=True)
    first = table_type(spark, f"{C}.{tgt}.nation")
    migrate_table(spark, f"{C}.{src}.nation", f"{C}.{tgt}.nation", purge_replaced=True)
    assert first == table_type(spark, f"{C}.{tgt}.nation") == "EXTERNAL"
    assert [(r.found, r.action) for r in recover_swaps(spark, C, tgt).collect()] == [("nation__v_00112233aabb", "orphaned")]
    assert [r.action for r in recover_swaps(spark, C, tgt, purge=True).collect()] == ["purged"]
    assert recover_swaps(spark, C, tgt).count() == 0
    assert same_rows(spark.table(f"{C}.{src}.nation"), spark.table(f"{C}.{tgt}.nation"))


def test_a_failed_first_copy_leaves_nothing(spark, src, tgt):
    from ferry.operators.migrate import recover_swaps

    with pytest.raises(Exception):
        migrate_table(spark, f"{C}.{src}.broken_v", f"{C}.{tgt}.broken_v")
    assert spark.sql(f"SHOW TABLES IN {C}.{tgt}").where("not isTemporary").count() == 0
    assert recover_swaps(spark, C, tgt).count() == 0


def test_a_view_is_refused_before_the_copy(spark, src, tgt):
    spark.sql(f"CREATE VIEW {C}.{tgt}.nation AS SELECT 1 AS x")
    with pytest.raises(MigrationError, match="is a view"):
        migrate_table(spark, f"{C}.{src}.nation", f"{C}.{tgt}.nation")
    assert not any("__stg_" in r.tableName for r in spark.sql(f"SHOW TABLES IN {C}.{tgt}").collect())


def test_only_own_folders_are_removed(spark, src, tgt):
    from ferry.operators.migrate import _ours, recover_swaps

    assert not _ours("file:/lake/orders__v_archive/2019", "orders", "file:/lake")
    assert not _ours("file:/other/orders__v_0123456789ab", "orders", "file:/lake")
    assert _ours("file:/lake/orders__v_0123456789ab", "orders", "file:/lake/")
    # a user's table that only looks like a staging table
    spark.sql(f"CREATE TABLE {C}.{tgt}.nation__stg_0123456789ab USING parquet AS SELECT 1 AS x")
    assert recover_swaps(spark, C, tgt, purge=True).count() == 0
    assert spark.table(f"{C}.{tgt}.nation__stg_0123456789ab").count() == 1


class Recorder:
    """A session that records statements and answers table() only."""

    def __init__(self, spark):
        self.spark, self.said = spark, []

    def sql(self, text, **rows):
        self.said.append(text)

    def table(self, name):
        return self.spark.table(name)


@pytest.mark.parametrize("good", [True, False])
def test_atomic_catalogs_are_checked_before_the_replace(spark, src, monkeypatch, good):
    """Statements and their order; this does not run against a real catalog."""
    import ferry.operators.migrate as m
    from ferry.sources.partitions import Detection

    def check(session, result, copy):
        session.said.append(f"CHECK {copy}")
        if not good:
            raise MigrationError("verification failed")

    session = Recorder(spark)
    monkeypatch.setattr(m, "OBSERVED_WAIT", 0.1)  # the recorder writes nothing
    monkeypatch.setattr(m, "table_exists", lambda s, t: True)
    monkeypatch.setattr(m, "table_type", lambda s, t: "MANAGED")
    monkeypatch.setattr(m, "_verify_or_raise", check)
    found = Detection(f"{C}.{src}.orders", ["o_orderstatus"], "catalog", [])

    def copy():
        return migrate_table(session, f"{C}.{src}.orders", "lake.n.orders", provider="iceberg", verify=True, detection=found, distribution="none")

    if good:
        assert copy().action == "overwrite"
    else:
        with pytest.raises(MigrationError):
            copy()
    verbs = [t.split(" AS SELECT")[0].split("\n")[0] for t in session.said]
    staging = verbs[1].removeprefix("CREATE TABLE ")
    assert staging.startswith("lake.n.orders__stg_")
    replaced = ["CREATE OR REPLACE TABLE lake.n.orders"] if good else []
    assert verbs == [
        "CREATE NAMESPACE IF NOT EXISTS lake.n", f"CREATE TABLE {staging}", f"CHECK {staging}",
        *replaced, f"DROP TABLE IF EXISTS {staging}",
    ]
    if good:
        assert session.said[3].endswith(f"AS SELECT * FROM {staging}") and "PARTITIONED BY (o_orderstatus)" in session.said[3]
