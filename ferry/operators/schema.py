"""Whole-namespace operators: the migration plan (dry run) and the batch
migration with its per-table report.

A namespace is processed table by table in name order, or, when several are
copied at once, the largest first, so that the longest copy does not begin
last; every table is one write job (see :mod:`ferry.operators.migrate`).  Only one small row per
table crosses to the driver (listing, plan, report).  A failing table is
isolated into a ``failed`` report row when ``continue_on_error`` is set,
otherwise the error propagates, as the first failure ends the batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferry.concurrency import map_concurrently
from ferry.functions.identifiers import UnsafeIdentifier, is_safe_ident, safe_ident
from ferry.operators.ledger import FAILED, RunLedger
from ferry.operators.migrate import VERIFY_MODES, MigrationError, RowCountMismatch, migrate_table
from ferry.sources.catalog import ensure_namespace, estimated_bytes, list_source_tables, missing_tables, table_exists
from ferry.sources.partitions import Detection, detect_partitions, per_table

PLAN_SCHEMA = "table_name string, partition_cols string, found_by string, action string, notes string"
REPORT_SCHEMA = (
    "table_name string, action string, partition_cols string, rows_source bigint, "
    "rows_target bigint, status string, error string"
)


def _listed(spark, source_catalog, source_schema, tables, include_views) -> tuple[list[str], list[str]]:
    listing = list_source_tables(spark, source_catalog, source_schema, tables, include_views=include_views)
    names = sorted(r.table_name for r in listing.collect())
    return names, missing_tables(spark, listing, tables)


def _detect(spark: SparkSession, catalog: str, schema: str, names: list[str]) -> dict[str, Detection]:
    """Batch detection for the plain-identifier names of a listing."""
    safe = [t for t in names if is_safe_ident(t)]
    ns = f"{safe_ident(catalog)}.{safe_ident(schema)}"
    found = detect_partitions(spark, [f"{ns}.{t}" for t in safe])
    return {t: found[f"{ns}.{t}"] for t in safe}


def _largest_first(spark: SparkSession, catalog: str, schema: str, names: list[str]) -> list[str]:
    """Names by falling size, equal sizes by name; names that are no identifiers first, since they fail at once."""
    ns = f"{safe_ident(catalog)}.{safe_ident(schema)}"
    safe = [t for t in names if is_safe_ident(t)]
    sizes = dict(per_table(lambda t: estimated_bytes(spark, f"{ns}.{t}"), safe, spark))
    return sorted(names, key=lambda t: (-sizes.get(t, float("inf")), t))


def plan_migration(
    spark: SparkSession,
    source_catalog: str,
    source_schema: str,
    target_catalog: str,
    target_schema: str | None = None,
    tables: list[str] | set[str] | None = None,
    *,
    if_exists: str = "overwrite",
    include_views: bool = True,
) -> DataFrame:
    """What :func:`migrate_schema` would do, with no side effect at all.

    ``(table_name, partition_cols, found_by, action, notes)``: action is
    ``create``, ``overwrite``, ``skip``, ``refuse`` (name or partition
    column not a plain identifier, or source = target) or ``not_found``
    (asked for but absent).  ``partition_cols`` is comma-joined, ``''`` when
    unpartitioned.
    """
    target_schema = target_schema or source_schema
    names, missing = _listed(spark, source_catalog, source_schema, tables, include_views)
    dets = _detect(spark, source_catalog, source_schema, names)
    tgt_ns = f"{safe_ident(target_catalog)}.{safe_ident(target_schema)}"
    safe = [t for t in names if is_safe_ident(t)]
    existing = {t for t, e in per_table(lambda t: table_exists(spark, f"{tgt_ns}.{t}"), safe, spark) if e is True}
    rows = []
    for t in names:
        if not is_safe_ident(t):
            rows.append((t, None, None, "refuse", f"unsafe identifier: {t!r}"))
            continue
        src = f"{safe_ident(source_catalog)}.{safe_ident(source_schema)}.{t}"
        tgt = f"{safe_ident(target_catalog)}.{safe_ident(target_schema)}.{t}"
        det = dets[t]
        notes = "; ".join(det.notes) or None
        bad = [c for c in det.columns if not is_safe_ident(c)]
        if bad:
            rows.append((t, ",".join(det.columns), det.found_by, "refuse", f"unsafe partition column(s): {bad}"))
            continue
        if src.lower() == tgt.lower():
            rows.append((t, ",".join(det.columns), det.found_by, "refuse", "source and target are the same table"))
            continue
        if t in existing:
            action = "skip" if if_exists == "skip" else ("overwrite" if if_exists == "overwrite" else "refuse")
        else:
            action = "create"
        rows.append((t, ",".join(det.columns), det.found_by, action, notes))
    rows.extend((m, None, None, "not_found", "not in the source namespace") for m in missing)
    return spark.createDataFrame(rows, PLAN_SCHEMA)


def _one(
    spark: SparkSession,
    source_catalog: str,
    source_schema: str,
    target_catalog: str,
    target_schema: str,
    t: str,
    provider: str,
    if_exists: str,
    verify: str,
    continue_on_error: bool,
    purge_replaced: bool,
    ledger: RunLedger | None,
    detection: Detection | None,
) -> tuple:
    """Copy one table; its report row goes into the ledger before anything is raised."""
    try:
        src = f"{safe_ident(source_catalog)}.{safe_ident(source_schema)}.{safe_ident(t)}"
        tgt = f"{safe_ident(target_catalog)}.{safe_ident(target_schema)}.{t}"
        res = migrate_table(
            spark, src, tgt, provider=provider, if_exists=if_exists, verify=verify,
            purge_replaced=purge_replaced, detection=detection,
        )
        row = (t, res.action, ",".join(res.partition_cols), res.rows_source, res.rows_target, res.status, None)
        error = None
    except Exception as e:
        error, msg = e, f"{type(e).__name__}: {e}"
        if isinstance(e, RowCountMismatch):
            row = (t, "copy", None, e.rows_source, e.rows_target, "mismatch", msg)
        else:
            row = (t, "refuse" if isinstance(e, (MigrationError, UnsafeIdentifier)) else "copy", None, None, None, "failed", msg)
    if ledger is not None:
        ledger.append(source_schema, target_schema, row)
    if error is not None and not continue_on_error:
        raise error
    return row


def migrate_schema(
    spark: SparkSession,
    source_catalog: str,
    source_schema: str,
    target_catalog: str,
    target_schema: str | None = None,
    tables: list[str] | set[str] | None = None,
    *,
    provider: str = "parquet",
    if_exists: str = "overwrite",
    continue_on_error: bool = False,
    verify: str = "counts",
    include_views: bool = True,
    parallelism: int = 1,
    purge_replaced: bool = False,
    ledger: str | RunLedger | None = None,
) -> DataFrame:
    """Migrate every table of a namespace (or the ``tables`` asked for).

    Returns ``(table_name, action, partition_cols, rows_source, rows_target,
    status, error)`` with status ``ok``, ``skipped``, ``failed``,
    ``mismatch`` (the copy's rows are not as many as the source's; nothing was
    replaced) or ``not_found``.  ``verify``: ``counts`` (row counts), ``full``
    (content hash and partition checks), each before a replace, or ``none``.
    ``parallelism > 1`` runs that many table copies as concurrent Spark jobs,
    the largest table (by Spark's estimate) first; the report stays in name order.
    Skipped tables are not counted.  ``purge_replaced`` deletes the files of
    replaced versions (see :func:`migrate_table`).  With ``ledger`` (a table
    name, or a :class:`RunLedger`) every row is also appended to that table as
    soon as its table is done, whatever becomes of the batch.
    """
    if verify not in VERIFY_MODES:
        raise ValueError(f"verify must be one of {VERIFY_MODES}")
    target_schema = target_schema or source_schema
    names, missing = _listed(spark, source_catalog, source_schema, tables, include_views)
    # Detection of every table before any copy or drop (one job per probe).
    dets = _detect(spark, source_catalog, source_schema, names)
    if names:
        ensure_namespace(spark, target_catalog, target_schema)
    args = (spark, source_catalog, source_schema, target_catalog, target_schema)
    if isinstance(ledger, str):
        ledger = RunLedger(spark, ledger)
    opts = (provider, if_exists, verify, continue_on_error, purge_replaced, ledger)
    order = names if parallelism <= 1 else _largest_first(spark, source_catalog, source_schema, names)
    rows = sorted(map_concurrently(lambda t: _one(*args, t, *opts, dets.get(t)), order, parallelism, spark), key=lambda r: r[0])
    absent = [(m, "not_found", None, None, None, "not_found", "not in the source namespace") for m in missing]
    if ledger is not None:
        for row in absent:
            ledger.append(source_schema, target_schema, row)
    return spark.createDataFrame(rows + absent, REPORT_SCHEMA)


def failure_count(report: DataFrame) -> int:
    """Tables whose copy failed or disagrees with its source."""
    return report.where(F.col("status").isin(*FAILED)).count()
