"""Build a Hive-style source namespace out of the parquet test tables.

The migration job works on catalog tables, while the test data arrives as
one parquet file per table.  This module turns a scale-factor directory into
a namespace of ORC tables that look like a partitioned warehouse schema:
identity-partitioned tables, unpartitioned ones, a permanent view, a table
with NULL and escaped partition values, date partitions, an array column,
large text columns partitioned by a skewed value (documents by language),
VARCHAR/CHAR/DECIMAL columns, an empty partitioned table, and tables that
must fail (an unsafe partition column name, a view whose base table is
gone).  Every table is derived from the given rows, so its size follows the
scale factor.
"""

from __future__ import annotations

import os
import threading
import uuid

from pyspark.sql import SparkSession

from ferry.concurrency import map_concurrently
from ferry.functions.identifiers import safe_ident

# Table names of the scale-factor directories.
TPCH_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")
OTHER_TABLES = ("events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

# Tables that migrate cleanly, and those built to fail or be refused.
GOOD_TABLES = (
    "benchmark",
    "conversations_r",
    "customer",
    "documents_l",
    "embeddings_l",
    "events_d",
    "lineitem",
    "nation",
    "nation_v",
    "orders",
    "orders_e",
    "orders_empty",
    "orders_n",
    "pages",
    "labels",
    "part",
    "region",
    "supplier",
    "typed",
)
FAILING_TABLES = ("broken_v", "spaced")

# Partition columns each source table is created with (empty: unpartitioned).
SOURCE_PARTITIONS = {
    "benchmark": [],
    "conversations_r": ["role"],
    "customer": [],
    "documents_l": ["lang"],
    "labels": [],
    "pages": [],
    "embeddings_l": ["label"],
    "events_d": ["d"],
    "lineitem": ["l_returnflag", "l_linestatus"],
    "nation": [],
    "orders": ["o_orderstatus"],
    "orders_e": [],
    "orders_empty": ["o_orderstatus"],
    "orders_n": ["p"],
    "part": [],
    "region": [],
    "supplier": [],
    "typed": ["dt", "hr"],
    "spaced": ["o status"],
}

# The special partition value of orders_n, and the value that
# stands for status 'P' there (NULL) and in orders_e (empty string).
SPECIAL_VALUE = "a/b:c+d"


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def sf_tag(sf_dir: str) -> str:
    base = os.path.basename(os.path.normpath(sf_dir)) or "data"
    return "".join(ch if ch.isalnum() else "_" for ch in base)


def register_parquet_views(spark: SparkSession, sf_dir: str, prefix: str = "") -> None:
    """Temp views over the parquet files (used only as CTAS inputs)."""
    for t in TPCH_TABLES + OTHER_TABLES:
        p = table_path(sf_dir, t)
        if os.path.exists(p) or "://" in sf_dir:
            spark.read.parquet(p).createOrReplaceTempView(f"{prefix}{t}")


def build_source_schema(spark: SparkSession, sf_dir: str, schema: str, catalog: str = "spark_catalog") -> str:
    """Create ``catalog.schema`` with the fixture tables; returns its name."""
    ns = f"{safe_ident(catalog)}.{safe_ident(schema)}"
    v = f"pq_{safe_ident(schema)}_"
    register_parquet_views(spark, sf_dir, prefix=v)
    spark.sql(f"CREATE NAMESPACE IF NOT EXISTS {ns}")

    def ctas(name: str, select: str) -> None:
        cols = SOURCE_PARTITIONS.get(name, [])
        part = f" PARTITIONED BY ({', '.join(f'`{c}`' for c in cols)})" if cols else ""
        spark.sql(f"CREATE TABLE {ns}.`{name}` USING orc{part} AS {select}")

    statements = [
        lambda: ctas("lineitem", f"SELECT * FROM {v}lineitem"),
        lambda: ctas("orders", f"SELECT * FROM {v}orders"),
        *[
            (lambda t=t: ctas(t, f"SELECT * FROM {v}{t}"))
            for t in ("customer", "nation", "region", "supplier", "part", "pages", "labels", "benchmark")
        ],
        # Whole texts; 'en' holds most documents (a hot partition value).
        lambda: ctas("documents_l", f"SELECT * FROM {v}documents"),
        lambda: ctas("conversations_r", f"SELECT * FROM {v}conversations"),
        lambda: ctas("events_d", f"SELECT *, to_date(ts) AS d FROM {v}events"),
        lambda: ctas("embeddings_l", f"SELECT * FROM {v}embeddings"),
        lambda: ctas(
            "orders_n",
            f"SELECT *, CASE o_orderstatus WHEN 'P' THEN NULL WHEN 'F' THEN '{SPECIAL_VALUE}' "
            f"ELSE o_orderstatus END AS p FROM {v}orders",
        ),
        lambda: ctas(
            "orders_e",
            f"SELECT *, CASE o_orderstatus WHEN 'P' THEN '' ELSE o_orderstatus END AS p FROM {v}orders",
        ),
        lambda: _typed(spark, ns, v),
        lambda: ctas("spaced", f"SELECT o_orderkey, o_totalprice, o_orderstatus AS `o status` FROM {v}orders"),
        lambda: spark.sql(f"CREATE TABLE {ns}.gone USING orc AS SELECT * FROM {v}region"),
    ]
    # Independent copies run as concurrent jobs; the steps below depend on them.
    map_concurrently(lambda f: f(), statements, 8, spark)
    # CREATE TABLE LIKE takes two-part names only (session catalog).
    spark.sql(f"CREATE TABLE {safe_ident(schema)}.orders_empty LIKE {safe_ident(schema)}.orders")
    spark.sql(f"CREATE VIEW {ns}.nation_v AS SELECT * FROM {ns}.nation")
    # A view whose base table is dropped: listed, but its copy fails.
    spark.sql(f"CREATE VIEW {ns}.broken_v AS SELECT * FROM {ns}.gone")
    spark.sql(f"DROP TABLE {ns}.gone")
    # A temporary view: SHOW TABLES lists it, the migration must not.
    spark.sql(f"CREATE OR REPLACE TEMP VIEW ferry_tmp_v AS SELECT * FROM {ns}.nation")
    return ns


def _typed(spark: SparkSession, ns: str, v: str) -> None:
    # CHAR/VARCHAR exist only as declared table types (a CAST in a query
    # yields STRING), so this table is declared first and then filled.
    spark.sql(
        f"CREATE TABLE {ns}.typed (a INT, v VARCHAR(15), ch CHAR(4), amount DECIMAL(12,2), dt STRING, hr INT) "
        "USING orc PARTITIONED BY (dt, hr)"
    )
    spark.sql(
        f"INSERT INTO {ns}.typed SELECT CAST(o_orderkey AS INT), o_orderpriority, o_orderstatus, "
        f"CAST(o_totalprice AS DECIMAL(12,2)), date_format(o_orderdate, 'yyyy'), month(o_orderdate) FROM {v}orders"
    )


_BUILT: dict[tuple[str, str], str] = {}
_BUILD_LOCK = threading.Lock()


def source_schema_for(spark: SparkSession, sf_dir: str) -> str:
    """The source namespace for ``sf_dir`` in this application, built on
    first use with a fresh run id (so leftovers of other runs never clash).
    Callers on several threads share one build."""
    key = (spark.sparkContext.applicationId, os.path.abspath(sf_dir))
    with _BUILD_LOCK:
        schema = _BUILT.get(key)
        if schema is not None and spark.catalog.tableExists(f"spark_catalog.{schema}.typed"):
            return schema
        schema = f"ferry_src_{sf_tag(sf_dir)}_{uuid.uuid4().hex[:8]}"
        build_source_schema(spark, sf_dir, schema)
        _BUILT[key] = schema
        return schema


def fresh_schema(spark: SparkSession, label: str) -> str:
    """A new, empty target namespace ``ferry_<label>_<run id>``."""
    schema = f"ferry_{safe_ident(label)}_{uuid.uuid4().hex[:8]}"
    spark.sql(f"CREATE NAMESPACE IF NOT EXISTS spark_catalog.{schema}")
    return schema
