"""Copy one catalog table into another catalog/format, keeping its
partition columns registered in the target.

The copy itself is one ``CREATE TABLE ... USING p PARTITIONED BY (...) AS
SELECT * FROM src`` statement: Catalyst plans the scan (vectorized ORC /
parquet readers), the write is a dynamic-partition write, and the optional
REBALANCE shuffle is chosen by :mod:`ferry.plans.write_plan`.  Table data
never passes through the driver.

Every copy into the session catalog, the first one too, is written under a
location of its own run as a staging table, optionally verified, and only
then put into place: a target of the same shape is pointed at the new files and
never missing, any other is dropped before the staging table is renamed
(metadata only, the files stay where they were written).  A failing or
killed copy leaves the old target untouched and never blocks a later run.
Tables written this way are EXTERNAL, first copies and overwrites alike:
dropping one later leaves its files.  The files of a replaced version stay for
readers that are still running unless ``purge_replaced`` asks for their
removal.  Catalogs that implement atomic replace (``CREATE OR REPLACE TABLE
... AS SELECT``) use that instead, from a verified staging table when a check
is asked for.
"""

from __future__ import annotations

import logging
import re
import threading
import uuid
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DataType, StringType, TimestampType

from ferry.functions.identifiers import is_safe_ident, safe_ident, split_fqn
from ferry.functions.partition_spec import partition_spec_values
from ferry.plans.write_plan import DEFAULT_PARTITION, FILE_PROVIDERS, WritePlan, choose_distribution, sql_path
from ferry.sources.catalog import (
    ensure_namespace,
    list_source_tables,
    namespace_location,
    table_exists,
    table_location,
    table_provider,
    table_type,
)
from ferry.sources.partitions import Detection, dedupe, partition_columns

log = logging.getLogger("ferry")

IF_EXISTS = ("overwrite", "skip", "error")
SESSION_CATALOG = "spark_catalog"
VERIFY_MODES = ("none", "counts", "full")
VERSION_MARK = "__v_"
STAGING_MARK = "__stg_"


class MigrationError(RuntimeError):
    """A table that must not or cannot be migrated as asked."""


class RowCountMismatch(MigrationError):
    """A copy that holds another number of rows than its source."""

    def __init__(self, rows_source: int, rows_target: int):
        super().__init__(f"verification failed: the source has {rows_source} rows, the copy {rows_target}")
        self.rows_source, self.rows_target = rows_source, rows_target


@dataclass
class MigrationResult:
    table: str
    source: str
    target: str
    action: str
    partition_cols: list[str]
    found_by: str | None
    status: str
    distribution: str | None = None
    sql: str | None = None
    notes: list[str] = field(default_factory=list)
    rows_source: int | None = None
    rows_target: int | None = None


def resolve_partition_cols(cols: list[str], source_columns: list[str]) -> list[str]:
    by_lower = {c.lower(): c for c in source_columns}
    out = []
    for c in dedupe(cols):
        safe_ident(c)
        if c.lower() not in by_lower:
            raise MigrationError(f"partition column {c!r} is not a column of the source row schema")
        out.append(by_lower[c.lower()])
    if out and len(out) == len(source_columns):
        raise MigrationError("every column would be a partition column; a file table needs a data column")
    return out


def _changed_by_a_path(value: Column, kind: DataType) -> Column | None:
    """True where a value does not come back from a directory name; None for
    types whose text always does."""
    text = value.cast("string")
    if isinstance(kind, TimestampType):
        # Two instants of a daylight-saving overlap have one local text.
        return ~text.try_cast("timestamp").eqNullSafe(value)
    if isinstance(kind, BinaryType):
        return text.isin("", DEFAULT_PARTITION) | ~F.is_valid_utf8(text)
    if isinstance(kind, StringType):
        return text.isin("", DEFAULT_PARTITION)
    return None


def _check_partition_values(df: DataFrame, cols: list[str]) -> None:
    """Refuse partition values that a path-partitioned target would change.
    Filter-and-limit: predicates on strings are pushed to the scan, row-group
    statistics skip most data, the first hit ends it."""
    types = {f.name: f.dataType for f in df.schema.fields}
    tests = {c: t for c in cols if (t := _changed_by_a_path(F.col(f"`{c}`"), types[c])) is not None}
    if not tests:
        return
    flags = [F.coalesce(t, F.lit(False)).alias(f"b{i}") for i, t in enumerate(tests.values())]
    hit = df.where(reduce(Column.__or__, tests.values())).select(*flags).limit(1).collect()
    if hit:
        bad = [c for c, flag in zip(tests, hit[0]) if flag]
        raise MigrationError(
            f"values in partition column(s) {bad} would change in a path-partitioned target (empty-string and "
            "default-partition texts become NULL; bytes that are not UTF-8 and repeated local times are lost)"
        )


def _path_partitioned(spark: SparkSession, name: str) -> bool:
    try:
        return (table_provider(spark, name) or "") in FILE_PROVIDERS
    except Exception:
        return False


def _hadoop_delete(spark: SparkSession, location: str) -> bool:
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(location)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.delete(path, True))


def _ours(location: str | None, table: str, root: str) -> bool:
    """A location written by an earlier swap of this table: directly below
    the namespace's root, the table, the mark and a run's 12 hex digits."""
    return re.fullmatch(rf"{re.escape(root.rstrip('/'))}/{table}{VERSION_MARK}[0-9a-f]{{12}}/?", location or "") is not None


def migrate_table(
    spark: SparkSession,
    source: str,
    target: str,
    *,
    provider: str = "parquet",
    partition_cols: list[str] | None = None,
    if_exists: str = "overwrite",
    distribution: str = "auto",
    verify: bool | str = False,
    purge_replaced: bool = False,
    detection: Detection | None = None,
) -> MigrationResult:
    """Copy ``source`` to ``target`` (both ``catalog.schema.table``).

    ``partition_cols=None`` detects them on the source (catalog flag,
    SHOW PARTITIONS, DDL, DESCRIBE, in that order).  ``if_exists``:
    ``overwrite`` (replace, old rows kept until the new copy exists),
    ``skip`` (leave an existing target alone) or ``error``.  ``verify``
    compares the new copy with the source before it replaces anything: its row
    count (``"counts"``; the source's rows are counted on their way into the
    write, so the source is read once) or everything (``"full"``, or True).
    ``purge_replaced`` deletes the files of a replaced version that an
    earlier run of this function wrote.
    ``detection`` passes the source's detected partitioning when the caller
    already has it (batch runs detect all tables at once).
    Raises :class:`MigrationError` (or Spark's own error) on failure.
    """
    src_c, src_s, src_t = split_fqn(source)
    tgt_c, tgt_s, tgt_t = split_fqn(target)
    safe_ident(provider)
    if if_exists not in IF_EXISTS:
        raise ValueError(f"if_exists must be one of {IF_EXISTS}, got {if_exists!r}")
    verify = {True: "full", False: "none"}.get(verify, verify)
    if verify not in VERIFY_MODES:
        raise ValueError(f"verify must be one of {VERIFY_MODES}, got {verify!r}")
    if (src_c.lower(), src_s.lower(), src_t.lower()) == (tgt_c.lower(), tgt_s.lower(), tgt_t.lower()):
        raise MigrationError("source and target are the same table; refusing before any DDL")

    exists = table_exists(spark, target)
    if exists and if_exists == "skip":
        log.info("%s is left alone: %s is already there", source, target)
        cols = list(detection.columns if detection is not None else partition_cols or [])
        return MigrationResult(src_t, source, target, "skip", cols, None, "skipped")
    if exists and if_exists == "error":
        raise MigrationError(f"target {target} exists")
    if exists and table_type(spark, target) == "VIEW":
        raise MigrationError(f"target {target} is a view; nothing is copied over a view")

    # Detection happens before anything is dropped or written.
    src_df = spark.table(source)
    src_detect = detection if detection is not None else partition_columns(spark, source)
    if partition_cols is None:
        cols, found_by = src_detect.columns, src_detect.found_by
    else:
        cols, found_by = list(partition_cols), "given"
    cols = resolve_partition_cols(cols, src_df.columns)
    notes = list(src_detect.notes)

    if provider.lower() in FILE_PROVIDERS:
        # A source that keeps partitions as directories read its values from
        # there, so only columns that become partitions, or that other sources
        # (Iceberg, Delta, ...) keep as values, are checked.
        kept = {c.lower() for c in src_detect.columns} if _path_partitioned(spark, source) else set()
        _check_partition_values(src_df, [c for c in cols if c.lower() not in kept])

    dist = choose_distribution(spark, distribution, src_detect.columns, cols, source)
    if cols and distribution == "auto" and dist == "none" and [c.lower() for c in cols] != [c.lower() for c in src_detect.columns]:
        notes.append("adaptive execution is off: the copy is written without a rebalance, in many small files")
    ensure_namespace(spark, tgt_c, tgt_s)
    log.info("copying %s, partitioned by %s (from %s), %s write", source, ", ".join(cols) or "nothing", found_by, dist)

    result = MigrationResult(
        src_t, source, target, "overwrite" if exists else "create", cols, found_by, "ok", dist, notes=notes
    )
    if tgt_c.lower() == SESSION_CATALOG and provider.lower() in FILE_PROVIDERS:
        _stage_and_swap(spark, result, provider, exists, verify, purge_replaced)
    else:
        _write_in_one_commit(spark, result, provider, exists, verify)
    return result


def _run(spark: SparkSession, plan: WritePlan) -> str:
    log.debug("%s", plan.sql())
    spark.sql(plan.sql())
    return plan.sql()


def _run_counting(spark: SparkSession, plan: WritePlan, result: MigrationResult) -> None:
    """Run the copy and count the source's rows on their way into the write."""
    log.debug("%s", plan.sql())
    seen = Observation()
    spark.sql(plan.sql(rows="{rows}"), rows=spark.table(plan.source).observe(seen, F.count(F.lit(1)).alias("n")))
    result.sql, result.rows_source = plan.sql(), observed(seen)


#: Seconds that a finished write has to report its counts.
OBSERVED_WAIT = 10


def observed(seen: Observation) -> int | None:
    """The count ``n`` of a write that has ended; None if there is none: the
    optimizer found the source empty, or the catalog writes in a query of its
    own, whose counts do not come here."""
    found: list[int] = []

    def read() -> None:
        try:
            found.append(seen.get["n"])
        except Exception:  # an observation without rows has no values
            pass

    # Reading waits for the report without end, so it waits in a thread.
    reader = threading.Thread(target=read, daemon=True)
    reader.start()
    reader.join(OBSERVED_WAIT)
    return found[0] if found else None


def _count(spark: SparkSession, table: str) -> int:
    return spark.table(table).count()


def check_copy(spark: SparkSession, result: MigrationResult, copy: str, verify: str) -> None:
    if verify == "counts":
        _compare_counts(spark, result, copy)
    elif verify == "full":
        _verify_or_raise(spark, result, copy)


def _compare_counts(spark: SparkSession, result: MigrationResult, copy: str) -> None:
    """Count the copy (file footers) and compare.  Tasks that ran twice because
    an executor was lost are counted twice on their way, so the source is
    counted once more before a copy is refused."""
    result.rows_target = _count(spark, copy)
    if result.rows_source != result.rows_target:
        result.rows_source = _count(spark, result.source)
    if result.rows_source != result.rows_target:
        raise RowCountMismatch(result.rows_source, result.rows_target)


def _verify_or_raise(spark: SparkSession, result: MigrationResult, copy: str) -> None:
    """Compare ``copy`` with the source; the row counts go into the result."""
    from ferry.operators.verify import compare_tables, migration_ok, verify_rows

    summary = compare_tables(spark, result.source, copy, result.partition_cols)
    result.rows_source, result.rows_target = summary["src_rows"], summary["tgt_rows"]
    result.notes += [f"widened {w}" for w in summary["widenings"]]
    if not migration_ok(summary):
        raise MigrationError(f"verification failed: {[r[1] for r in verify_rows('', summary) if not r[4]]}")


def _write_in_one_commit(
    spark: SparkSession, result: MigrationResult, provider: str, exists: bool, verify: str
) -> None:
    """Copy into a catalog that commits a whole statement.  A checked
    overwrite writes twice: a staging table, which is compared with the
    source, and the replacing table, read from the staging table.  A first
    copy that fails its check is removed."""
    source, target, cols = result.source, result.target, result.partition_cols
    if exists and verify != "none":
        staging = f"{target}{STAGING_MARK}{uuid.uuid4().hex[:12]}"
        try:
            _run_counting(spark, WritePlan(source, staging, provider, cols, result.distribution), result)
            check_copy(spark, result, staging, verify)
            result.sql = _run(spark, WritePlan(staging, target, provider, cols, "none", replace=True))
        finally:
            spark.sql(f"DROP TABLE IF EXISTS {staging}")
        return
    _run_counting(spark, WritePlan(source, target, provider, cols, result.distribution, replace=exists), result)
    try:
        check_copy(spark, result, target, verify)
    except Exception:
        spark.sql(f"DROP TABLE IF EXISTS {target}")
        raise


def _drop_and_purge(spark: SparkSession, name: str) -> None:
    loc = None
    try:
        loc = table_location(spark, name)
    except Exception:
        pass
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    if loc:
        _hadoop_delete(spark, loc)


def _stage_and_swap(
    spark: SparkSession, result: MigrationResult, provider: str, exists: bool, verify: str, purge_replaced: bool
) -> None:
    target, cols = result.target, result.partition_cols
    tgt_c, tgt_s, tgt_t = split_fqn(target)
    run = uuid.uuid4().hex[:12]
    root = namespace_location(spark, tgt_c, tgt_s)
    if not root:
        raise MigrationError(f"no location for namespace {tgt_c}.{tgt_s}")
    location = f"{root.rstrip('/')}/{tgt_t}{VERSION_MARK}{run}"
    staging = f"{tgt_c}.{tgt_s}.{tgt_t}{STAGING_MARK}{run}"
    try:
        plan = WritePlan(result.source, staging, provider, cols, result.distribution, location=location)
        _run_counting(spark, plan, result)
        check_copy(spark, result, staging, verify)
    except Exception:
        # Nothing was touched; remove the new version and surface the copy's
        # own error (a failing cleanup must not hide it).
        try:
            spark.sql(f"DROP TABLE IF EXISTS {staging}")
            _hadoop_delete(spark, location)
        except Exception:
            log.warning("%s or files in %s are left over", staging, location)
        raise

    put_into_place(spark, staging, target, location, root, purge_replaced)


def _shape(spark: SparkSession, name: str) -> tuple:
    """Provider, columns with their declared types in order, partition columns."""
    from ferry.operators.verify import column_types

    return table_provider(spark, name), list(column_types(spark, name).items()), partition_columns(spark, name).columns


def put_into_place(spark: SparkSession, staging: str, target: str, location: str, root: str, purge_replaced: bool = False) -> None:
    """Make the finished table ``staging``, stored in ``location``, the target.

    A target that an earlier run wrote, with the same provider, columns and
    partitioning, is pointed at the new files and is there all the time; its
    partitions change over a batch at a time.  Any other target is dropped
    before the staging table takes its name.  Both move metadata only.
    """
    tgt_c, tgt_s, tgt_t = split_fqn(target)
    exists = table_exists(spark, target)
    old_type = table_type(spark, target) if exists else None
    old_location = table_location(spark, target) if exists else None
    replaceable = old_type == "EXTERNAL" and _ours(old_location, tgt_t, root)
    if exists and replaceable and _shape(spark, target) == _shape(spark, staging):
        spark.sql(f"ALTER TABLE {target} SET LOCATION '{sql_path(location)}'")
        _repoint_partitions(spark, staging, target)
        # The staging table is external: its files stay, they are the target's now.
        spark.sql(f"DROP TABLE {staging}")
    else:
        try:
            if exists:
                spark.sql(f"DROP TABLE {target}")
            # An external table keeps its location on rename: metadata-only swap.
            spark.sql(f"ALTER TABLE {staging} RENAME TO {tgt_s}.{tgt_t}")
        except Exception as e:
            if table_exists(spark, target):
                _drop_and_purge(spark, staging)
            else:
                e.add_note(f"the whole copy is in {staging}; recover_swaps puts it into place")
            raise
    if purge_replaced and replaceable:
        _hadoop_delete(spark, old_location)  # type: ignore[arg-type]


def _partition_clauses(specs: DataFrame) -> list[str]:
    """``PARTITION (k = 'v', ...)`` of each spec in a column ``partition``."""
    rows = partition_spec_values(specs, "partition", keep_spec=True).collect()
    found: dict[str, list[tuple[int, str]]] = {}
    for r in rows:
        value = "NULL" if r.value is None else "'" + r.value.replace("\\", "\\\\").replace("'", "\\'") + "'"
        found.setdefault(r.partition, []).append((r.pos, f"{safe_ident(r.key)} = {value}"))
    return [f"PARTITION ({', '.join(v for _, v in sorted(parts))})" for parts in found.values()]


def _partition_location(spark: SparkSession, table: str, clause: str) -> str | None:
    for r in spark.sql(f"DESCRIBE TABLE EXTENDED {table} {clause}").collect():
        if (r.col_name or "").strip() == "Location":
            return r.data_type
    return None


def _repoint_partitions(spark: SparkSession, staging: str, target: str) -> None:
    """Give ``target``, whose location is that of ``staging`` already, the
    partitions of ``staging`` where these are stored, and no others."""
    if not partition_columns(spark, staging).columns:
        spark.catalog.refreshTable(target)
        return
    before, after = (spark.sql(f"SHOW PARTITIONS {t}").select(F.col("partition")) for t in (target, staging))
    shared = before.join(after, "partition", "left_semi")
    gone = _partition_clauses(before.join(after, "partition", "left_anti"))
    sample = _partition_clauses(shared.limit(1))
    spark.sql(f"ALTER TABLE {target} RECOVER PARTITIONS")
    if sample and _partition_location(spark, target, sample[0]) != _partition_location(spark, staging, sample[0]):
        # This catalog leaves partitions that it knows where they were.
        for clause in _partition_clauses(shared):
            new = _partition_location(spark, staging, clause)
            spark.sql(f"ALTER TABLE {target} {clause} SET LOCATION '{sql_path(new or '')}'")
    for clause in gone:
        spark.sql(f"ALTER TABLE {target} DROP IF EXISTS {clause}")
    spark.catalog.refreshTable(target)


RECOVERY_SCHEMA = "table_name string, found string, action string"


def _same_location(a: str | None, b: str | None) -> bool:
    return a is not None and b is not None and re.sub("^file:/+", "/", a).rstrip("/") == re.sub("^file:/+", "/", b).rstrip("/")


def _run_folders(spark: SparkSession, root: str) -> list[str]:
    """Names of the run folders (table, mark, 12 hex digits) below a root."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [s.getPath().getName() for s in fs.listStatus(path) if s.isDirectory()] if fs.exists(path) else []
    return sorted(n for n in found if re.fullmatch(rf"[A-Za-z0-9_]+{VERSION_MARK}[0-9a-f]{{12}}", n))


def recover_swaps(spark: SparkSession, catalog: str, schema: str, *, purge: bool = False) -> DataFrame:
    """Clean up after copies that were interrupted (driver lost) in a target
    namespace.  Run it when no migration into that namespace is running.

    A staging table ``<t>__stg_<run>`` whose target ``<t>`` is missing is a
    whole copy that was never renamed (staging tables only exist after their
    CTAS succeeded; a check that was asked for may not have run), so it is
    renamed into place (``completed``).  One whose target exists never reached
    its swap; it is dropped and its files removed (``discarded``), unless the
    target is pointed at its files already: then that is finished (``completed``).  A run
    folder that no table of the namespace uses is a copy that was cut short or
    a replaced version: it is listed as ``orphaned``, and with ``purge``
    deleted (``purged``).  Only tables stored in a run folder of their own
    name and run are touched.  One row per staging table or folder.
    """
    ns = f"{safe_ident(catalog)}.{safe_ident(schema)}"
    root = namespace_location(spark, catalog, schema) or ""

    def names() -> list[str]:
        return sorted(r.table_name for r in list_source_tables(spark, catalog, schema, include_views=False).collect())

    rows = []
    for name in names():
        m = re.fullmatch(rf"([A-Za-z0-9_]+){STAGING_MARK}([0-9a-f]{{12}})", name)
        if m is None or not _ours(table_location(spark, f"{ns}.{name}"), m[1], root):
            continue
        target, own = f"{ns}.{m[1]}", f"{ns}.{name}"
        if table_exists(spark, target) and _same_location(table_location(spark, target), table_location(spark, own)):
            # The target is pointed at these files already; its partitions may not be.
            _repoint_partitions(spark, own, target)
            spark.sql(f"DROP TABLE {own}")
            rows.append((m[1], name, "completed"))
        elif table_exists(spark, target):
            _drop_and_purge(spark, f"{ns}.{name}")
            rows.append((m[1], name, "discarded"))
        else:
            spark.sql(f"ALTER TABLE {ns}.{name} RENAME TO {schema}.{m[1]}")
            rows.append((m[1], name, "completed"))
    folders = _run_folders(spark, root) if root else []
    if folders:
        used = {(table_location(spark, f"{ns}.{t}") or "").rstrip("/").rpartition("/")[2] for t in names() if is_safe_ident(t)}
        for folder in folders:
            if folder not in used:
                if purge:
                    _hadoop_delete(spark, f"{root.rstrip('/')}/{folder}")
                rows.append((folder.rpartition(VERSION_MARK)[0], folder, "purged" if purge else "orphaned"))
    for table, name, action in rows:
        log.info("%s: %s was %s", table, name, action)
    return spark.createDataFrame(rows, RECOVERY_SCHEMA)
