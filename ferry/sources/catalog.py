"""Catalog access: listing a namespace, existence, namespace creation.

All of these are metadata calls answered by the catalog on the driver; the
results come back as (small, one row per table) DataFrames so that callers
filter, join and report with the DataFrame API.  None of them changes the
session's current catalog or namespace.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferry.functions.fields import first_present
from ferry.functions.identifiers import safe_ident, split_fqn

# Column names SHOW TABLES / SHOW VIEWS have used for the
# table name and the temporary flag.
TABLE_NAME_COLUMNS = ("tableName", "tablename", "table_name", "viewName", "name")
TEMPORARY_COLUMNS = ("isTemporary", "istemporary", "is_temporary")

def namespace(catalog: str, schema: str) -> str:
    return f"{safe_ident(catalog)}.{safe_ident(schema)}"


def normalize_listing(df: DataFrame) -> DataFrame:
    """``(table_name, is_temporary)`` from a SHOW TABLES-shaped DataFrame,
    whatever its column names; a NULL temporary flag reads as false."""
    return df.select(
        first_present(df, *TABLE_NAME_COLUMNS).cast("string").alias("table_name"),
        F.coalesce(first_present(df, *TEMPORARY_COLUMNS).cast("boolean"), F.lit(False)).alias("is_temporary"),
    )


def list_source_tables(
    spark: SparkSession,
    catalog: str,
    schema: str,
    include: list[str] | set[str] | None = None,
    *,
    include_views: bool = True,
) -> DataFrame:
    """Tables (and, by default, permanent views) of ``catalog.schema``.

    Temporary views that ``SHOW TABLES`` mixes in are dropped.  With
    ``include`` only the named tables are kept; names that do not exist are
    simply absent here (:func:`missing_tables` reports them).
    Columns: ``namespace, table_name, is_view``.
    """
    ns = namespace(catalog, schema)
    try:
        shown = spark.sql(f"SHOW TABLES IN {ns}")
    except Exception:
        # Fallback: the catalog API, namespace-qualified (no USE, so the
        # session's current catalog and namespace stay as they are).
        tables = spark.catalog.listTables(ns)
        shown = spark.createDataFrame(
            [(t.name, bool(t.isTemporary)) for t in tables], "tableName string, isTemporary boolean"
        )
    listing = normalize_listing(shown).where(~F.col("is_temporary"))
    try:
        views = normalize_listing(spark.sql(f"SHOW VIEWS IN {ns}")).where(~F.col("is_temporary"))
        view_names = views.select(F.col("table_name").alias("view_name"), F.lit(True).alias("is_view"))
    except Exception:
        # Catalogs without view support (any error kind) list no views.
        view_names = spark.createDataFrame([], "view_name string, is_view boolean")
    out = listing.join(view_names, listing.table_name == view_names.view_name, "left").select(
        F.lit(ns).alias("namespace"),
        F.col("table_name"),
        F.coalesce(F.col("is_view"), F.lit(False)).alias("is_view"),
    )
    if include is not None:
        out = out.where(F.col("table_name").isin(sorted(set(include))))
    if not include_views:
        out = out.where(~F.col("is_view"))
    return out


def parse_include(arg: str | None) -> set[str] | None:
    """The names in a comma list, blanks around them ignored; None (all
    tables) when it holds none."""
    return set(re.findall(r"[^,\s](?:[^,]*[^,\s])?", arg or "")) or None


def missing_tables(spark: SparkSession, listing: DataFrame, include: set[str] | list[str] | None) -> list[str]:
    """Names asked for in ``include`` that the listing does not hold."""
    if not include:
        return []
    wanted = spark.createDataFrame([(n,) for n in sorted(set(include))], "table_name string")
    return sorted(r.table_name for r in wanted.join(listing, "table_name", "left_anti").collect())


_SIZE = re.compile(r"sizeInBytes=([\d.]+) ([KMGTPE]?i?B)")
_UNITS = {u: 1024**k for k, u in enumerate(("B", "KiB", "MiB", "GiB", "TiB", "PiB", "EiB"))}


def estimated_bytes(spark: SparkSession, name: str) -> float:
    """Spark's estimate of a table's size, from the costs of its plan (no job
    runs).  A size that Spark does not know is large; one that cannot be read
    (a broken view) is 0."""
    split_fqn(name)
    try:
        costs = spark.sql(f"EXPLAIN COST SELECT * FROM {name}").head(1)[0][0]
    except Exception:
        return 0.0
    found = _SIZE.search(costs)
    return float(found[1]) * _UNITS.get(found[2], 1) if found else 0.0


def table_exists(spark: SparkSession, name: str) -> bool:
    """Existence by the catalog API; other errors (permissions, a catalog
    that is down) propagate instead of reading as "absent"."""
    split_fqn(name)
    return spark.catalog.tableExists(name)


def ensure_namespace(spark: SparkSession, catalog: str, schema: str) -> None:
    spark.sql(f"CREATE NAMESPACE IF NOT EXISTS {namespace(catalog, schema)}")


def namespace_location(spark: SparkSession, catalog: str, schema: str) -> str | None:
    """Storage location of a namespace (``DESCRIBE NAMESPACE EXTENDED``)."""
    rows = spark.sql(f"DESCRIBE NAMESPACE EXTENDED {namespace(catalog, schema)}").collect()
    for r in rows:
        d = r.asDict()
        key = d.get("info_name") or d.get("database_description_item")
        val = d.get("info_value") or d.get("database_description_value")
        if key and key.strip().lower() == "location":
            return val
    return None


def table_location(spark: SparkSession, name: str) -> str | None:
    """Storage location of a table, from ``DESCRIBE TABLE EXTENDED``."""
    split_fqn(name)
    rows = spark.sql(f"DESCRIBE TABLE EXTENDED {name}").collect()
    for r in rows:
        d = r.asDict()
        if (d.get("col_name") or "").strip() == "Location":
            return d.get("data_type")
    return None


def table_type(spark: SparkSession, name: str) -> str | None:
    """``MANAGED`` / ``EXTERNAL`` / ``VIEW`` as the catalog reports it."""
    split_fqn(name)
    rows = spark.sql(f"DESCRIBE TABLE EXTENDED {name}").collect()
    for r in rows:
        d = r.asDict()
        if (d.get("col_name") or "").strip() == "Type":
            return (d.get("data_type") or "").strip().upper() or None
    return None


def table_provider(spark: SparkSession, name: str) -> str | None:
    """The table's provider (``orc``, ``parquet``, ``hive``, ``iceberg``...)
    as ``DESCRIBE TABLE EXTENDED`` reports it, lower-cased."""
    split_fqn(name)
    for r in spark.sql(f"DESCRIBE TABLE EXTENDED {name}").collect():
        d = r.asDict()
        if (d.get("col_name") or "").strip() == "Provider":
            return (d.get("data_type") or "").strip().lower() or None
    return None
