"""A copy that can be ended at any time and goes on where it was.

The source's partitions are dealt into steps by a hash of the partition values,
which Spark evaluates on the partition columns alone, so a step reads its own
partitions and no others.  Each step overwrites its partitions of a working
table (dynamic partition overwrite) and is then noted in a manifest table.  A
copy that is started again finds both, leaves the noted steps alone and does the
others; a step that was cut short is written again whole.  The finished working
table is checked and put into place like any other copy.
"""

from __future__ import annotations

import logging
import re
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ferry.functions.identifiers import split_fqn
from ferry.operators.migrate import (
    SESSION_CATALOG,
    VERSION_MARK,
    MigrationError,
    MigrationResult,
    check_copy,
    migrate_table,
    observed,
    put_into_place,
    resolve_partition_cols,
)
from ferry.plans.write_plan import PATH_PROVIDERS, choose_distribution, sql_path
from ferry.sources.catalog import ensure_namespace, list_source_tables, namespace_location, table_exists
from ferry.sources.partitions import partition_columns

log = logging.getLogger("ferry")

WORK_MARK, MANIFEST_MARK = "__part_", "__done_"
MANIFEST = "source string, provider string, partition_cols string, steps int, step int, row_count bigint"


def _step_of(cols: list[str], steps: int) -> Column:
    return F.pmod(F.xxhash64(*[F.col(f"`{c}`").cast("string") for c in cols]), F.lit(steps))


def _unfinished(spark: SparkSession, target: str) -> str | None:
    """The run of a copy into ``target`` that did not end, if there is one."""
    catalog, schema, table = split_fqn(target)
    names = {r.table_name for r in list_source_tables(spark, catalog, schema, include_views=False).collect()}
    runs = [m[1] for n in names if (m := re.fullmatch(rf"{table}{WORK_MARK}([0-9a-f]{{12}})", n))]
    return max((r for r in runs if f"{table}{MANIFEST_MARK}{r}" in names), default=None)


def _manifest(spark: SparkSession, name: str) -> DataFrame:
    spark.catalog.refreshTable(name)
    return spark.table(name)


def migrate_resumable(
    spark: SparkSession,
    source: str,
    target: str,
    *,
    provider: str = "parquet",
    partition_cols: list[str] | None = None,
    steps: int = 16,
    verify: str = "counts",
    purge_replaced: bool = False,
    on_step: Callable[[int, int], None] | None = None,
) -> MigrationResult:
    """Copy ``source`` over ``target`` in ``steps`` parts of its partitions.

    Run again after it was ended, with the same source, provider and partition
    columns, it does the missing steps only (in the number of steps of the first
    run); with others it starts anew beside what is left.  ``on_step(step, rows)``
    is called after each step; an error that it raises ends the copy there.
    The old target stays in use until the new copy is whole and checked.  The
    source must not change in between: counts see other rows, ``verify="full"``
    also changed ones.  A table without partition columns is copied whole, by
    :func:`migrate_table`.  For file providers in the session catalog.
    """
    src_c, src_s, src_t = split_fqn(source)
    catalog, schema, table = split_fqn(target)
    if catalog.lower() != SESSION_CATALOG or provider.lower() not in PATH_PROVIDERS:
        raise MigrationError("copies in steps need a file provider in the session catalog")
    if (src_c.lower(), src_s.lower(), src_t.lower()) == (catalog.lower(), schema.lower(), table.lower()):
        raise MigrationError("source and target are the same table; refusing before any DDL")
    if steps < 1:
        raise ValueError("there must be one step at least")
    found = partition_columns(spark, source)
    rows = spark.table(source)
    cols = resolve_partition_cols(found.columns if partition_cols is None else partition_cols, rows.columns)
    if not cols:
        return migrate_table(spark, source, target, provider=provider, partition_cols=cols, verify=verify, purge_replaced=purge_replaced)

    ensure_namespace(spark, catalog, schema)
    root = (namespace_location(spark, catalog, schema) or "").rstrip("/")
    job = (source, provider.lower(), ",".join(cols))
    run, finished = _unfinished(spark, target), {}
    if run is not None:
        noted = _manifest(spark, f"{catalog}.{schema}.{table}{MANIFEST_MARK}{run}").collect()  # a row per step
        if noted and (noted[0].source, noted[0].provider, noted[0].partition_cols) == job:
            steps, finished = noted[0].steps, {r.step: r.row_count for r in noted if r.step >= 0}
        else:
            run = None
    if run is None:
        run = uuid.uuid4().hex[:12]
    work, manifest = (f"{catalog}.{schema}.{table}{mark}{run}" for mark in (WORK_MARK, MANIFEST_MARK))
    location = f"{root}/{table}{VERSION_MARK}{run}"
    if not table_exists(spark, manifest):
        spark.sql(f"CREATE TABLE {work} USING {provider} PARTITIONED BY ({', '.join(cols)}) LOCATION '{sql_path(location)}' AS SELECT * FROM {source} WHERE 1 = 0")
        spark.sql(f"CREATE TABLE {manifest} ({MANIFEST}) USING parquet")
        _note(spark, manifest, (*job, steps, -1, 0))

    distribution = choose_distribution(spark, "auto", found.columns, cols)
    for step in range(steps):
        if step in finished:
            continue
        seen = Observation()
        part = rows.where(_step_of(cols, steps) == step).observe(seen, F.count(F.lit(1)).alias("n"))
        if distribution == "rebalance":
            part = part.hint("rebalance", *[F.col(f"`{c}`") for c in cols])
        # By path, where the writer takes the overwrite mode as an option of its own and leaves the session's alone.
        part.write.format(provider).mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*cols).save(location)
        finished[step] = observed(seen) or 0  # none if no partition of the source falls into this step
        _note(spark, manifest, (*job, steps, step, finished[step]))
        log.info("%s: step %d of %d, %d rows", target, step + 1, steps, finished[step])
        if on_step is not None:
            on_step(step, finished[step])

    result = MigrationResult(src_t, source, target, "overwrite" if table_exists(spark, target) else "create", cols, found.found_by, "ok", distribution)
    result.rows_source = sum(finished.values())
    spark.sql(f"ALTER TABLE {work} RECOVER PARTITIONS")
    spark.catalog.refreshTable(work)
    check_copy(spark, result, work, verify)
    put_into_place(spark, work, target, location, root, purge_replaced)
    spark.sql(f"DROP TABLE IF EXISTS {manifest}")
    return result


def _note(spark: SparkSession, manifest: str, row: tuple) -> None:
    spark.createDataFrame([row], MANIFEST).write.insertInto(manifest)
