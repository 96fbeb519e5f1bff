"""

``entry(spark)`` is the smoke check; ``queries()`` holds one callable per
returning a DataFrame; ``oracle_sql()`` gives, for each key, DuckDB SQL over
the raw parquet tables that must produce the same rows.

Every query works on a source namespace of ORC tables built (once per
application and scale factor) from the parquet tables of ``sf_dir``, and
writes into its own fresh target namespace, so queries never see each
other's targets.  Returned DataFrames read the migrated tables lazily.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferry.concurrency import map_concurrently
from ferry.functions.partition_spec import file_partition_spec, partition_spec_values
from ferry.operators.differences import row_differences
from ferry.operators.ledger import RunLedger, read_ledger
from ferry.operators.migrate import migrate_table
from ferry.operators.resume import migrate_resumable
from ferry.operators.schema import migrate_schema, plan_migration
from ferry.operators.verify import CHECKS, partition_row_counts, verify_pairs
from ferry.sources.catalog import list_source_tables
from ferry.sources.partitions import schema_partition_columns
from ferry.sources.testdata import FAILING_TABLES, GOOD_TABLES, fresh_schema, source_schema_for

CAT = "spark_catalog"
SMOKE_SF_DIR = "/root/testdata/sf0.001"


def _src(spark: SparkSession, sf_dir: str) -> str:
    return source_schema_for(spark, sf_dir)


def _copy(spark: SparkSession, sf_dir: str, table: str, label: str, **kw) -> str:
    """Migrate one source table into a fresh namespace; returns the target."""
    src = _src(spark, sf_dir)
    tgt = fresh_schema(spark, label)
    migrate_table(spark, f"{CAT}.{src}.{table}", f"{CAT}.{tgt}.{table}", **kw)
    return f"{CAT}.{tgt}.{table}"


# ---------------------------------------------------------------- copies


def q_migrate_partitioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.table(_copy(spark, sf_dir, "lineitem", "partitioned"))


def q_migrate_unpartitioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.table(_copy(spark, sf_dir, "customer", "unpartitioned"))


def q_migrate_explicit_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Unpartitioned source, partitioned target: the write is rebalanced.
    return spark.table(_copy(spark, sf_dir, "customer", "explicit", partition_cols=["c_mktsegment"]))


def q_migrate_null_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.table(_copy(spark, sf_dir, "orders_n", "nullparts"))


def q_migrate_date_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.table(_copy(spark, sf_dir, "events_d", "dateparts"))


def q_migrate_array_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.table(_copy(spark, sf_dir, "embeddings_l", "arrays"))


def q_migrate_text_partitioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Whole documents, partitioned by language; one language holds most rows.
    return spark.table(_copy(spark, sf_dir, "documents_l", "texts"))


def q_migrate_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.table(_copy(spark, sf_dir, "typed", "typed"))


def q_migrate_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    src = _src(spark, sf_dir)
    tgt = fresh_schema(spark, "overwrite")
    # An older target with other columns and other rows.
    spark.sql(f"CREATE TABLE {CAT}.{tgt}.orders USING parquet AS SELECT o_orderkey, 'stale' AS note FROM {CAT}.{src}.orders")
    migrate_table(spark, f"{CAT}.{src}.orders", f"{CAT}.{tgt}.orders", if_exists="overwrite")
    return spark.table(f"{CAT}.{tgt}.orders")


def q_migrate_swapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second overwrite with other partitions points the table at the new files."""
    src = _src(spark, sf_dir)
    tgt = fresh_schema(spark, "swapped")
    spark.sql(f"CREATE TABLE {CAT}.{tgt}.older USING orc PARTITIONED BY (p) AS SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate, o_orderstatus, o_orderpriority, concat('old ', p) AS p FROM {CAT}.{src}.orders_n")
    spark.sql(f"ALTER TABLE {CAT}.{tgt}.older RENAME TO {tgt}.earlier")
    columns = ", ".join(spark.table(f"{CAT}.{src}.orders_n").columns)
    spark.sql(f"CREATE VIEW {CAT}.{tgt}.both AS SELECT {columns} FROM {CAT}.{src}.orders_n UNION ALL SELECT {columns} FROM {CAT}.{tgt}.earlier")
    migrate_table(spark, f"{CAT}.{tgt}.both", f"{CAT}.{tgt}.orders", partition_cols=["p"])
    migrate_table(spark, f"{CAT}.{src}.orders_n", f"{CAT}.{tgt}.orders", verify="counts")
    return spark.table(f"{CAT}.{tgt}.orders")


def q_migrate_resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A copy that ends half-way and is run again."""
    src = _src(spark, sf_dir)
    tgt = fresh_schema(spark, "resumed")
    names = f"{CAT}.{src}.events_d", f"{CAT}.{tgt}.events_d"

    def end_half_way(step: int, rows: int) -> None:
        if step == 2:
            raise InterruptedError

    try:
        migrate_resumable(spark, *names, steps=5, on_step=end_half_way)
    except InterruptedError:
        pass
    migrate_resumable(spark, *names)
    return spark.table(names[1])


def q_migrate_skip_existing(spark: SparkSession, sf_dir: str) -> DataFrame:
    src = _src(spark, sf_dir)
    tgt = fresh_schema(spark, "skip")
    spark.sql(
        f"CREATE TABLE {CAT}.{tgt}.orders USING parquet AS SELECT *, 'previous run' AS version FROM {CAT}.{src}.orders"
    )
    migrate_table(spark, f"{CAT}.{src}.orders", f"{CAT}.{tgt}.orders", if_exists="skip")
    return spark.table(f"{CAT}.{tgt}.orders")


# ---------------------------------------------------------------- batch


def q_migrate_schema_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    src = _src(spark, sf_dir)
    tgt = fresh_schema(spark, "schema")
    return migrate_schema(
        spark, CAT, src, CAT, tgt, tables=list(GOOD_TABLES), continue_on_error=True, parallelism=8
    )


def q_migrate_schema_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables that cannot be copied do not keep the others from being copied."""
    src = _src(spark, sf_dir)
    tgt = fresh_schema(spark, "failures")
    tables = ["lineitem", *FAILING_TABLES, "documents_l", "missing_table"]
    report = migrate_schema(spark, CAT, src, CAT, tgt, tables=tables, continue_on_error=True)
    return report.select("table_name", "action", "status", "rows_source", "rows_target")


def q_migration_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes of a run, read from its durable ledger."""
    src = _src(spark, sf_dir)
    tgt = fresh_schema(spark, "ledgered")
    ledger = RunLedger(spark, f"{CAT}.{tgt}_log.runs")
    migrate_schema(spark, CAT, src, CAT, tgt, tables=[*_LEDGERED, *FAILING_TABLES, "missing_table"], continue_on_error=True, parallelism=4, ledger=ledger)
    rows = read_ledger(spark, ledger.table, ledger.run_id)
    return rows.groupBy("status").agg(F.count("*").alias("n_tables"), F.sum("rows_source").alias("rows_source"), F.sum("rows_target").alias("rows_target"))


_LEDGERED = ("orders_n", "documents_l", "events_d", "customer")


def _counted(spark: SparkSession, src: str, listing: DataFrame, readable: list[str]) -> DataFrame:
    """``listing`` with the rows that each readable table holds."""
    counts = [spark.table(f"{CAT}.{src}.`{t}`").agg(F.count("*").alias("row_count")).select(F.lit(t).alias("table_name"), "row_count") for t in readable]
    return listing.join(reduce(DataFrame.union, counts), "table_name", "left")


def q_plan_migration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a batch would do, and how many rows each step would move."""
    src = _src(spark, sf_dir)
    tgt = fresh_schema(spark, "plan")
    spark.sql(f"CREATE TABLE {CAT}.{tgt}.orders USING parquet AS SELECT o_orderkey FROM {CAT}.{src}.orders")
    plan = plan_migration(spark, CAT, src, CAT, tgt)
    return _counted(spark, src, plan.select("table_name", "partition_cols", "found_by", "action"), list(GOOD_TABLES))


def q_detect_partition_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The detected partition columns, each with the values that it has."""
    src = _src(spark, sf_dir)
    found = schema_partition_columns(spark, CAT, src)
    values = [
        spark.table(f"{CAT}.{src}.`{r.table_name}`")
        .agg(F.count_distinct(F.col(f"`{r.column_name}`")).alias("n_values"))
        .select(F.lit(r.table_name).alias("table_name"), F.lit(r.column_name).alias("column_name"), "n_values")
        for r in found.collect()
    ]
    return found.join(reduce(DataFrame.union, values), ["table_name", "column_name"])


def q_list_source_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    src = _src(spark, sf_dir)
    listing = list_source_tables(spark, CAT, src).select("table_name", "is_view")
    return _counted(spark, src, listing, list(GOOD_TABLES))


def q_partition_spec_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows per key and value of the partition folders of migrated tables."""
    found = []
    for t in _SPEC_TABLES:
        rows = spark.table(_copy(spark, sf_dir, t, f"specs_{t}"))
        files = rows.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count("*").alias("n"))
        specs = partition_spec_values(files.select("n", file_partition_spec("file").alias("partition")), "partition")
        found.append(specs.groupBy("pos", "key", "value").agg(F.sum("n").alias("row_count")).select(F.lit(t).alias("table_name"), "*"))
    return reduce(DataFrame.union, found)


# File paths are not visible through a table with CHAR columns ("typed").
_SPEC_TABLES = ("lineitem", "orders_n", "events_d")


# ---------------------------------------------------------------- checks


def q_verify_migration(spark: SparkSession, sf_dir: str) -> DataFrame:
    src = _src(spark, sf_dir)
    tgt = fresh_schema(spark, "verify")
    tables = list(_VERIFIED)
    migrate_schema(spark, CAT, src, CAT, tgt, tables=tables, verify="none", parallelism=len(tables)).collect()
    # One damaged copy per check; each is compared with the undamaged source.
    damaged = [
        f"CREATE TABLE {CAT}.{tgt}.{label} USING parquet {options} AS SELECT {columns} FROM {CAT}.{src}.orders WHERE {condition}"
        for label, (columns, options, condition) in _DAMAGED.items()
    ]
    map_concurrently(spark.sql, damaged, len(damaged), spark)
    pairs = {t: (f"{CAT}.{src}.{'orders' if t in _DAMAGED else t}", f"{CAT}.{tgt}.{t}") for t in [*tables, *_DAMAGED]}
    report = verify_pairs(spark, pairs, parallelism=len(pairs))
    counts = F.col("check_name").isin("row_count", "partition_count", "partition_mismatches")
    return report.select(
        "table_name", "check_name", "ok", F.when(counts, F.col("expected").cast("long")).alias("expected"), F.when(counts, F.col("actual").cast("long")).alias("actual")
    )


_ORDER_COLUMNS = "o_orderkey, o_custkey, o_totalprice, o_orderdate, o_orderpriority, o_orderstatus"
_BY_STATUS = "PARTITIONED BY (o_orderstatus)"
_DAMAGED = {
    "orders_renamed": (_ORDER_COLUMNS.replace("o_custkey", "o_custkey AS c"), _BY_STATUS, "true"),
    "orders_retyped": (_ORDER_COLUMNS.replace("o_custkey", "CAST(o_custkey AS DECIMAL(20,0)) AS o_custkey"), _BY_STATUS, "true"),
    "orders_short": (_ORDER_COLUMNS, _BY_STATUS, "o_orderstatus <> 'P'"),
    "orders_changed": (_ORDER_COLUMNS.replace("o_custkey", "IF(o_orderstatus = 'F', o_custkey + 1, o_custkey) AS o_custkey"), _BY_STATUS, "true"),
    "orders_flat": (_ORDER_COLUMNS, "", "true"),
}


def q_verify_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows in which a damaged copy differs from its source."""
    src = _src(spark, sf_dir)
    tgt = fresh_schema(spark, "differences")
    spark.sql(f"CREATE TABLE {CAT}.{tgt}.orders USING parquet {_BY_STATUS} AS SELECT {_ORDER_COLUMNS} FROM {_damaged_rows(f'{CAT}.{src}.orders')}")
    return row_differences(spark, f"{CAT}.{src}.orders", f"{CAT}.{tgt}.orders")


def _damaged_rows(orders: str) -> str:
    """Some rows of 'F' changed, some of 'O' lost, some of 'P' twice, some without a customer."""
    changed = "IF(o_orderstatus = 'F' AND o_orderkey % 97 = 1, o_totalprice + 1, o_totalprice)"
    customer = "IF(o_orderkey % 1009 = 5, NULL, o_custkey)"
    lists = f"(SELECT *, IF(o_orderstatus = 'P' AND o_orderkey % 7 = 2, 2, 1) AS times FROM {orders} WHERE o_orderstatus <> 'O' OR o_orderkey % 89 <> 3)"
    return (
        f"(SELECT o_orderkey, {customer} AS o_custkey, {changed} AS o_totalprice, o_orderdate, o_orderpriority, o_orderstatus "
        f"FROM {lists} AS d JOIN (SELECT 1 AS copy UNION ALL SELECT 2) AS c ON copy <= times) AS damaged"
    )


def q_partition_row_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partition_row_counts(spark, _copy(spark, sf_dir, "lineitem", "counts"))


def q_pruned_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = _copy(spark, sf_dir, "lineitem", "pruned")
    return spark.table(target).where(F.col("l_returnflag") == "A")


_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "migrate_partitioned": q_migrate_partitioned,
    "migrate_unpartitioned": q_migrate_unpartitioned,
    "migrate_explicit_partitions": q_migrate_explicit_partitions,
    "migrate_null_partitions": q_migrate_null_partitions,
    "migrate_date_partitions": q_migrate_date_partitions,
    "migrate_array_column": q_migrate_array_column,
    "migrate_text_partitioned": q_migrate_text_partitioned,
    "migrate_typed": q_migrate_typed,
    "migrate_overwrite": q_migrate_overwrite,
    "migrate_swapped": q_migrate_swapped,
    "migrate_resumed": q_migrate_resumed,
    "migrate_skip_existing": q_migrate_skip_existing,
    "migrate_schema_report": q_migrate_schema_report,
    "migrate_schema_failures": q_migrate_schema_failures,
    "plan_migration": q_plan_migration,
    "detect_partition_columns": q_detect_partition_columns,
    "list_source_tables": q_list_source_tables,
    "partition_spec_values": q_partition_spec_values,
    "migration_failures": q_migration_failures,
    "verify_migration": q_verify_migration,
    "verify_differences": q_verify_differences,
    "partition_row_counts": q_partition_row_counts,
    "pruned_read": q_pruned_read,
}


def entry(spark: SparkSession) -> DataFrame:
    """Flagship: partitioned copy of lineitem at sf0.001, then rows per
    registered partition of the new table."""
    return q_partition_row_counts(spark, SMOKE_SF_DIR)


def _optional() -> tuple[dict, dict]:
    """Queries and SQL of ``ferry.llm`` and of the pipeline, where they are installed."""
    found: dict = {}
    sql: dict = {}
    try:
        from ferry.llm.queries import ORACLE_SQL, QUERIES

        found, sql = dict(QUERIES), dict(ORACLE_SQL)
        import corpus_pipeline

        found["pipeline"] = corpus_pipeline.run
        if corpus_pipeline.ORACLE_SQL:
            sql["pipeline"] = corpus_pipeline.ORACLE_SQL
    except ModuleNotFoundError as e:
        if e.name not in ("ferry.llm", "corpus_pipeline"):
            raise
    return found, sql


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _QUERIES | _optional()[0]


_REPORT_ROW = (
    "SELECT '{t}' AS table_name, 'create' AS action, '{p}' AS partition_cols, count(*) AS rows_source, "
    "count(*) AS rows_target, 'ok' AS status, CAST(NULL AS VARCHAR) AS error FROM {src}"
)

_REPORT = [
    ("benchmark", "", "benchmark"),
    ("conversations_r", "role", "conversations"),
    ("customer", "", "customer"),
    ("documents_l", "lang", "documents"),
    ("embeddings_l", "label", "embeddings"),
    ("events_d", "d", "events"),
    ("lineitem", "l_returnflag,l_linestatus", "lineitem"),
    ("nation", "", "nation"),
    ("nation_v", "", "nation"),
    ("orders", "o_orderstatus", "orders"),
    ("orders_e", "", "orders"),
    ("orders_empty", "o_orderstatus", "orders WHERE false"),
    ("orders_n", "p", "orders"),
    ("pages", "", "pages"),
    ("labels", "", "labels"),
    ("part", "", "part"),
    ("region", "", "region"),
    ("supplier", "", "supplier"),
    ("typed", "dt,hr", "orders"),
]

_VERIFIED = ("lineitem", "orders_n", "typed")
_ORDERS_N_P = "CASE o_orderstatus WHEN 'P' THEN NULL WHEN 'F' THEN 'a/b:c+d' ELSE o_orderstatus END"

_COUNTS = "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {src}" for t, _, src in _REPORT) + ") AS c"

# Table, partition column and its value over the raw tables.
_PARTITIONS = [
    ("conversations_r", 1, "role", "role", "conversations"),
    ("documents_l", 1, "lang", "lang", "documents"),
    ("embeddings_l", 1, "label", "label", "embeddings"),
    ("events_d", 1, "d", "CAST(ts AS DATE)", "events"),
    ("lineitem", 1, "l_returnflag", "l_returnflag", "lineitem"),
    ("lineitem", 2, "l_linestatus", "l_linestatus", "lineitem"),
    ("orders", 1, "o_orderstatus", "o_orderstatus", "orders"),
    ("orders_empty", 1, "o_orderstatus", "o_orderstatus", "orders WHERE false"),
    ("orders_n", 1, "p", _ORDERS_N_P, "orders"),
    ("spaced", 1, "o status", "o_orderstatus", "orders"),
    ("typed", 1, "dt", "strftime(o_orderdate, '%Y')", "orders"),
    ("typed", 2, "hr", "month(o_orderdate)", "orders"),
]


def _verify_oracle() -> str:
    """Every check of every copy, with counts from the raw tables."""
    parts = {"lineitem": "l_returnflag, l_linestatus", "orders_n": _ORDERS_N_P, "typed": "strftime(o_orderdate, '%Y'), month(o_orderdate)"}
    rows = []

    def add(name, source, group, wrong=(), kept="true", lost="0", regrouped=None):
        count, groups = f"SELECT count(*) FROM {source}", f"SELECT count(*) FROM (SELECT 1 FROM {source} GROUP BY {group})"
        found = {
            "row_count": (f"({count})", f"({count} WHERE {kept})"),
            "partition_count": (f"({groups})", regrouped or f"(SELECT count(*) FROM (SELECT 1 FROM {source} WHERE {kept} GROUP BY {group}))"),
            "partition_mismatches": ("0", f"({lost})"),
        }
        for check in CHECKS:
            expected, actual = found.get(check, ("NULL", "NULL"))
            rows.append(
                f"SELECT '{name}' AS table_name, '{check}' AS check_name, {'false' if check in wrong else 'true'} AS ok, "
                f"CAST({expected} AS BIGINT) AS expected, CAST({actual} AS BIGINT) AS actual"
            )

    for t in _VERIFIED:
        add(t, "orders" if t != "lineitem" else t, parts[t])
    status = "SELECT count(DISTINCT o_orderstatus) FROM orders"
    add("orders_renamed", "orders", "o_orderstatus", ("columns", "types", "content_hash", "partition_mismatches"), lost=status)
    add("orders_retyped", "orders", "o_orderstatus", ("types", "content_hash", "partition_mismatches"), lost=status)
    add("orders_short", "orders", "o_orderstatus", ("row_count", "content_hash", "partition_count", "partition_mismatches"), "o_orderstatus <> 'P'", "1")
    add("orders_changed", "orders", "o_orderstatus", ("content_hash", "partition_mismatches"), lost="1")
    add("orders_flat", "orders", "o_orderstatus", ("partition_columns",))
    return "\nUNION ALL\n".join(rows)


_ORACLE = {
    "migrate_partitioned": "SELECT * FROM lineitem",
    "migrate_unpartitioned": "SELECT * FROM customer",
    "migrate_explicit_partitions": "SELECT * FROM customer",
    "migrate_null_partitions": f"SELECT *, {_ORDERS_N_P} AS p FROM orders",
    "migrate_date_partitions": "SELECT *, CAST(ts AS DATE) AS d FROM events",
    "migrate_array_column": "SELECT * FROM embeddings",
    "migrate_text_partitioned": "SELECT * FROM documents",
    "migrate_typed": (
        "SELECT CAST(o_orderkey AS INTEGER) AS a, o_orderpriority AS v, rpad(o_orderstatus, 4, ' ') AS ch, "
        "CAST(o_totalprice AS DECIMAL(12,2)) AS amount, strftime(o_orderdate, '%Y') AS dt, "
        "CAST(month(o_orderdate) AS INTEGER) AS hr FROM orders"
    ),
    "migrate_overwrite": "SELECT * FROM orders",
    "migrate_swapped": f"SELECT *, {_ORDERS_N_P} AS p FROM orders",
    "migrate_resumed": "SELECT *, CAST(ts AS DATE) AS d FROM events",
    "migrate_skip_existing": "SELECT *, 'previous run' AS version FROM orders",
    "migrate_schema_report": "\nUNION ALL\n".join(_REPORT_ROW.format(t=t, p=p, src=s) for t, p, s in _REPORT),
    "migrate_schema_failures": (
        "SELECT 'lineitem' AS table_name, 'create' AS action, 'ok' AS status, count(*) AS rows_source, count(*) AS rows_target FROM lineitem\nUNION ALL\n"
        "SELECT 'documents_l', 'create', 'ok', count(*), count(*) FROM documents\nUNION ALL\n"
        "SELECT *, NULL, NULL FROM (VALUES ('broken_v', 'copy', 'failed'), ('spaced', 'refuse', 'failed'), "
        "('missing_table', 'not_found', 'not_found')) AS t(table_name, action, status)"
    ),
    "plan_migration": (
        "SELECT t.*, c.row_count FROM (VALUES "
        "('benchmark', '', NULL, 'create'), "
        "('broken_v', '', NULL, 'create'), "
        "('conversations_r', 'role', 'catalog', 'create'), "
        "('customer', '', NULL, 'create'), "
        "('documents_l', 'lang', 'catalog', 'create'), "
        "('embeddings_l', 'label', 'catalog', 'create'), "
        "('events_d', 'd', 'catalog', 'create'), "
        "('lineitem', 'l_returnflag,l_linestatus', 'catalog', 'create'), "
        "('nation', '', NULL, 'create'), "
        "('nation_v', '', NULL, 'create'), "
        "('orders', 'o_orderstatus', 'catalog', 'overwrite'), "
        "('orders_e', '', NULL, 'create'), "
        "('orders_empty', 'o_orderstatus', 'catalog', 'create'), "
        "('orders_n', 'p', 'catalog', 'create'), "
        "('labels', '', NULL, 'create'), "
        "('pages', '', NULL, 'create'), "
        "('part', '', NULL, 'create'), "
        "('region', '', NULL, 'create'), "
        "('spaced', 'o status', 'catalog', 'refuse'), "
        "('supplier', '', NULL, 'create'), "
        "('typed', 'dt,hr', 'catalog', 'create')"
        ") AS t(table_name, partition_cols, found_by, action) "
        f"LEFT JOIN ({_COUNTS}) AS c USING (table_name)"
    ),
    "detect_partition_columns": "\nUNION ALL\n".join(
        f"SELECT '{t}' AS table_name, {n} AS pos, '{c}' AS column_name, 'catalog' AS found_by, count(DISTINCT {v}) AS n_values FROM {src}"
        for t, n, c, v, src in _PARTITIONS
    ),
    "list_source_tables": (
        "SELECT t.*, c.row_count FROM (VALUES "
        "('benchmark', false), ('broken_v', true), ('conversations_r', false), ('customer', false), "
        "('documents_l', false), ('embeddings_l', false), ('events_d', false), ('labels', false), ('pages', false), "
        "('lineitem', false), ('nation', false), ('nation_v', true), ('orders', false), "
        "('orders_e', false), ('orders_empty', false), ('orders_n', false), ('part', false), "
        "('region', false), ('spaced', false), ('supplier', false), ('typed', false)"
        ") AS t(table_name, is_view) "
        f"LEFT JOIN ({_COUNTS}) AS c USING (table_name)"
    ),
    "partition_spec_values": "\nUNION ALL\n".join(
        f"SELECT '{t}' AS table_name, {n} AS pos, '{c}' AS key, CAST({v} AS VARCHAR) AS value, CAST(count(*) AS BIGINT) AS row_count FROM {src} GROUP BY {v}"
        for t, n, c, v, src in _PARTITIONS
        if t in _SPEC_TABLES
    ),
    "migration_failures": (
        "SELECT 'ok' AS status, count(*) AS n_tables, CAST(sum(n) AS BIGINT) AS rows_source, CAST(sum(n) AS BIGINT) AS rows_target FROM ("
        "SELECT count(*) AS n FROM orders UNION ALL SELECT count(*) FROM documents UNION ALL SELECT count(*) FROM events UNION ALL SELECT count(*) FROM customer) "
        "UNION ALL SELECT 'failed', 2, NULL, NULL UNION ALL SELECT 'not_found', 1, NULL, NULL"
    ),
    "verify_migration": _verify_oracle(),
    "verify_differences": (
        f"WITH s AS (SELECT {_ORDER_COLUMNS} FROM orders), t AS (SELECT {_ORDER_COLUMNS} FROM {_damaged_rows('orders')}) "
        f"SELECT 'missing' AS side, count(*) AS copies, {_ORDER_COLUMNS} FROM (SELECT * FROM s EXCEPT ALL SELECT * FROM t) GROUP BY ALL "
        f"UNION ALL SELECT 'extra', count(*), {_ORDER_COLUMNS} FROM (SELECT * FROM t EXCEPT ALL SELECT * FROM s) GROUP BY ALL"
    ),
    "partition_row_counts": (
        "SELECT l_returnflag, l_linestatus, count(*) AS row_count FROM lineitem GROUP BY l_returnflag, l_linestatus"
    ),
    "pruned_read": "SELECT * FROM lineitem WHERE l_returnflag = 'A'",
}


def oracle_sql() -> dict[str, str]:
    return _ORACLE | _optional()[1]
