"""Live detection of tables' partition columns.

Four probes are tried in order and the first non-empty answer wins:

1. ``catalog``          -- the catalog's partition flag (``DESCRIBE ... AS JSON``,
                           else ``Catalog.listColumns(...).isPartition``)
2. ``show_partitions``  -- keys of a ``SHOW PARTITIONS`` spec
3. ``show_create``      -- the ``PARTITIONED BY`` clause of ``SHOW CREATE TABLE``
4. ``describe``         -- the partition section of ``DESCRIBE TABLE EXTENDED``

All empty means the table is not partitioned.  For tables of the session
catalog (``spark_catalog``) a successful ``listColumns`` is final: SHOW
PARTITIONS, SHOW CREATE TABLE and DESCRIBE are rendered from the same
catalog entry there, so the later probes cannot disagree and are skipped
(``trust_session_catalog=False`` runs the whole chain anyway).  In other
catalogs the partition flag marks plain columns only, so the partitioning is
read whole there: a transform such as ``bucket(4, id)`` is part of the answer,
which the identifier rule then refuses, rather than copied as if it were not
there.  Detection works on a batch
of tables: each probe runs only for the tables still without an answer,
the catalog command's rows of all those tables are gathered into one
DataFrame, and the same Column functions that parse metastore dumps in bulk
(:mod:`ferry.functions`) parse them in one Spark job per probe.  A probe
that raises for a table is recorded in that table's ``notes``; the
session's current catalog and namespace are never changed.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ferry.concurrency import map_concurrently
from ferry.functions.ddl import ddl_partition_columns
from ferry.functions.describe import PARTITION_HEADER, described_partition_columns, described_transforms
from ferry.functions.fields import ddl_text, first_present
from ferry.functions.identifiers import split_fqn
from ferry.functions.partition_spec import file_partition_spec, partition_spec_values, spec_keys

PROBES = ("catalog", "show_partitions", "show_create", "describe")


@dataclass
class Detection:
    table: str
    columns: list[str]
    found_by: str | None
    notes: list[str] = field(default_factory=list)


def dedupe(names: list[str]) -> list[str]:
    """The names without those that Spark would resolve to an earlier one."""
    first = {n.lower(): n for n in reversed(names) if n}
    return sorted(first.values(), key=names.index)


def _error_text(e: Exception) -> str:
    return f"{type(e).__name__}: {str(e).strip()}"


def _spec_column(df: DataFrame):
    named = first_present(df, "partition", "result")
    strings = [F.col(f"`{f.name}`") for f in df.schema.fields if isinstance(f.dataType, StringType)]
    return F.coalesce(named, *strings) if strings else named


# Catalog calls of different tables are independent requests to the
# catalog; a few run at once so that a namespace of thousands of tables is
# not detected one round trip at a time.
METADATA_THREADS = 8


def per_table(fn, names: list[str], spark=None) -> list:
    """``[(name, result or exception)]`` of ``fn(name)`` for each name."""

    def call(n):
        try:
            return n, fn(n)
        except Exception as e:
            return n, e

    return map_concurrently(call, names, METADATA_THREADS, spark)


def catalog_partition_flags(spark: SparkSession, name: str) -> list[str]:
    """The catalog's own partition columns of a table.

    Asked first as ``DESCRIBE TABLE EXTENDED ... AS JSON`` (one catalog
    command, no Spark job); where that form is not available (v2 catalogs,
    older Spark) through ``Catalog.listColumns(...).isPartition``, which
    iterates a small dataset and costs a few tiny jobs per table.
    """
    try:
        row = spark.sql(f"DESCRIBE TABLE EXTENDED {name} AS JSON").head(1)
        meta = json.loads(row[0][0]) if row else {}
    except Exception:
        meta = {}
    if "columns" in meta:
        return list(meta.get("partition_columns") or [])
    if name.split(".")[0].lower() != SESSION_CATALOG:
        transforms = described_transforms([(r[2], r[3]) for r in describe_rows(spark, name)])
        if transforms:
            return transforms
    return [c.name for c in spark.catalog.listColumns(name) if getattr(c, "isPartition", False)]


def _catalog(spark: SparkSession, names: list[str], notes: dict) -> dict[str, list[str]]:
    out = {}
    for n, res in per_table(lambda n: catalog_partition_flags(spark, n), names, spark):
        if isinstance(res, Exception):
            notes[n].append(f"catalog: {_error_text(res)}")
        else:
            out[n] = res
    return out


SESSION_CATALOG = "spark_catalog"


def _show_partitions(spark: SparkSession, names: list[str], notes: dict) -> dict[str, list[str]]:
    # Every spec of a table has the same keys, so one spec per table answers.
    def first_spec(n):
        listing = spark.sql(f"SHOW PARTITIONS {n}")
        row = listing.select(_spec_column(listing).alias("s")).head(1)
        return row[0].s if row else None

    specs = []
    for n, res in per_table(first_spec, names, spark):
        if isinstance(res, Exception):
            notes[n].append(f"show_partitions: {_error_text(res)}")
        elif res:
            specs.append((n, res))
    if not specs:
        return {}
    df = spark.createDataFrame(specs, "table_name string, partition string")
    return {r.table_name: list(r.keys) for r in df.select("table_name", spec_keys("partition").alias("keys")).collect()}


_MAY_PARTITION = re.compile(r"(?i)partitioned")


def _show_create(spark: SparkSession, names: list[str], notes: dict) -> dict[str, list[str]]:
    def ddl_of(n):
        stmt = spark.sql(f"SHOW CREATE TABLE {n}")
        row = stmt.select(ddl_text(stmt).alias("ddl")).head(1)
        return row[0].ddl if row else None

    ddls = []
    for n, res in per_table(ddl_of, names, spark):
        if isinstance(res, Exception):
            notes[n].append(f"show_create: {_error_text(res)}")
        # Text without the keyword has nothing to parse (views, flat tables).
        elif res and _MAY_PARTITION.search(res):
            ddls.append((n, res))
    if not ddls:
        return {}
    df = spark.createDataFrame(ddls, "table_name string, ddl string")
    return {r.table_name: list(r.cols) for r in df.select("table_name", ddl_partition_columns("ddl").alias("cols")).collect()}


def describe_rows(spark: SparkSession, name: str, table_name: str | None = None) -> list[tuple]:
    """``DESCRIBE TABLE EXTENDED`` rows as ``(table_name, pos, col_name, data_type)``."""
    label = table_name or name
    out = []
    for i, r in enumerate(spark.sql(f"DESCRIBE TABLE EXTENDED {name}").collect()):
        d = r.asDict()
        out.append((label, i, d.get("col_name", d.get("colName")), d.get("data_type", d.get("dataType"))))
    return out


DESCRIBE_SCHEMA = "table_name string, pos int, col_name string, data_type string"


def _describe(spark: SparkSession, names: list[str], notes: dict) -> dict[str, list[str]]:
    rows = []
    for n, listed in per_table(lambda n: describe_rows(spark, n), names, spark):
        if isinstance(listed, Exception):
            notes[n].append(f"describe: {_error_text(listed)}")
        # Only listings with a partition section need the section scan.
        elif any((r[2] or "").strip().startswith(PARTITION_HEADER) for r in listed):
            rows.extend(listed)
    if not rows:
        return {}
    cols = described_partition_columns(spark.createDataFrame(rows, DESCRIBE_SCHEMA)).collect()
    out: dict[str, list[tuple[int, str]]] = {}
    for r in cols:
        out.setdefault(r.table_name, []).append((r.pos, r.column_name))
    return {t: [c for _, c in sorted(v)] for t, v in out.items()}


_PROBE_FUNCS = {
    "catalog": _catalog,
    "show_partitions": _show_partitions,
    "show_create": _show_create,
    "describe": _describe,
}


def detect_partitions(
    spark: SparkSession,
    names: list[str],
    *,
    probes: tuple[str, ...] = PROBES,
    trust_session_catalog: bool = True,
) -> dict[str, Detection]:
    """Ordered partition columns of each ``catalog.schema.table`` in ``names``."""
    for n in names:
        split_fqn(n)
    notes: dict[str, list[str]] = {n: [] for n in names}
    found: dict[str, Detection] = {}
    pending = list(dict.fromkeys(names))
    for probe in probes:
        if not pending:
            break
        answers = _PROBE_FUNCS[probe](spark, pending, notes)
        still = []
        for n in pending:
            cols = dedupe(answers.get(n) or [])
            if cols:
                found[n] = Detection(n, cols, probe, notes[n])
            elif (
                probe == "catalog"
                and trust_session_catalog
                and n in answers
                and n.split(".")[0].lower() == SESSION_CATALOG
            ):
                found[n] = Detection(n, [], None, notes[n])
            else:
                still.append(n)
        pending = still
    for n in pending:
        found[n] = Detection(n, [], None, notes[n])
    return {n: found[n] for n in names}


def partition_columns(
    spark: SparkSession, name: str, *, probes: tuple[str, ...] = PROBES, trust_session_catalog: bool = True
) -> Detection:
    """Ordered partition columns of one ``catalog.schema.table``."""
    return detect_partitions(spark, [name], probes=probes, trust_session_catalog=trust_session_catalog)[name]


def partition_listing(spark: SparkSession, name: str, *, from_files: bool = False) -> DataFrame:
    """Every partition of a table as ``(partition, pos, key, value)`` rows:
    ``SHOW PARTITIONS`` parsed by :func:`partition_spec_values` (values
    unescaped, the default partition as NULL).  Spark materializes that
    listing on the driver; the parse itself is a projection.

    ``from_files`` takes the specs from the paths of the data files instead
    (``_metadata.file_path``, no column is read), in tasks: for tables with
    millions of partitions.  Partitions that hold no rows, and those at a
    location of their own, are not in it."""
    split_fqn(name)
    if from_files:
        paths = spark.table(name).select(F.col("_metadata.file_path").alias("path")).distinct()
        spec = paths.select(file_partition_spec("path").alias("partition")).where("partition <> ''").distinct()
    else:
        listing = spark.sql(f"SHOW PARTITIONS {name}")
        spec = listing.select(_spec_column(listing).alias("partition"))
    return partition_spec_values(spec, "partition", keep_spec=True)


def schema_partition_columns(
    spark: SparkSession, catalog: str, schema: str, tables: list[str] | None = None
) -> DataFrame:
    """``(table_name, pos, column_name, found_by)`` for every table of a
    namespace (or the given ones).  Unpartitioned tables give no rows."""
    from ferry.sources.catalog import list_source_tables

    from ferry.functions.identifiers import is_safe_ident

    if tables is None:
        tables = sorted(r.table_name for r in list_source_tables(spark, catalog, schema).collect())
    # A name that is not a plain identifier cannot be put into SQL: skipped.
    tables = [t for t in tables if is_safe_ident(t)]
    dets = detect_partitions(spark, [f"{catalog}.{schema}.{t}" for t in tables])
    rows = []
    for t in tables:
        det = dets[f"{catalog}.{schema}.{t}"]
        rows.extend((t, i + 1, c, det.found_by) for i, c in enumerate(det.columns))
    return spark.createDataFrame(rows, "table_name string, pos int, column_name string, found_by string")
