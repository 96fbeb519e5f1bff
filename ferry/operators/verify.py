"""Data checks of a migrated table against its source.

Each side is read once and reduced to one row per partition value:
``(partition values..., row count, content-hash slice sums)``.  Both reductions use
partial (map-side) aggregation, so only one small row per partition and task
is shuffled, whatever the table size.  The two per-partition results are
full-outer-joined on null-safe keys (a NULL partition is a partition) and
summarised into a handful of numbers; only that one summary row reaches the
driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferry.functions.hashing import SLICES, combine_slices, content_hash_aggs
from ferry.functions.identifiers import split_fqn
from ferry.functions.types import compare_types
from ferry.sources.catalog import table_provider
from ferry.sources.partitions import partition_columns

REPORT_SCHEMA = "table_name string, check_name string, expected string, actual string, ok boolean, note string"

# Names of the checks, in report order.
CHECKS = (
    "columns",
    "types",
    "row_count",
    "content_hash",
    "partition_columns",
    "partition_count",
    "partition_mismatches",
)


def _resolve(df: DataFrame, names: list[str]) -> list[str] | None:
    by_lower = {c.lower(): c for c in df.columns}
    out = [by_lower.get(n.lower()) for n in names]
    return None if any(o is None for o in out) else out  # type: ignore[return-value]


def column_types(spark: SparkSession, table: str) -> dict[str, str]:
    """The declared type of every column, from the catalog: a DataFrame's
    schema shows CHAR and VARCHAR columns as plain strings."""
    types = {}
    for r in spark.sql(f"DESCRIBE TABLE {table}").collect():
        if not r.col_name or r.col_name.startswith("#"):
            break
        types[r.col_name.lower()] = r.data_type
    return types


def _type_text(types: dict[str, str]) -> str:
    return ",".join(f"{n} {t}" for n, t in sorted(types.items()))


def _provider(spark: SparkSession, table: str) -> str | None:
    try:
        return table_provider(spark, table)
    except Exception:  # a catalog that describes tables in a way of its own
        return None


def _per_partition(df: DataFrame, pcols: list[str], hash_cols: list[str] | None) -> DataFrame:
    """``(k0, z0, .., n, h0..h3)``: rows and hash slice sums per partition
    value.  Each partition column becomes two never-NULL keys, its value as
    text (``k``) and a NULL flag (``z``), so that the later join is a plain
    equi-join on exactly the grouping keys and reuses their partitioning
    (no second shuffle).  Without ``hash_cols`` the hash sums are NULL."""
    keys = []
    for i, c in enumerate(pcols):
        col = F.col(f"`{c}`")
        keys += [F.coalesce(col.cast("string"), F.lit("")).alias(f"k{i}"), col.isNull().alias(f"z{i}")]
    if not keys:
        keys = [F.lit("").alias("k0"), F.lit(False).alias("z0")]
    if hash_cols is not None:
        hashes = content_hash_aggs(df, hash_cols, "h")
    else:
        hashes = [F.lit(None).cast("bigint").alias(f"h{i}") for i in range(SLICES)]
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *hashes)


def compare_tables(
    spark: SparkSession, source: str, target: str, partition_cols: list[str] | None = None
) -> dict:
    """Summary numbers comparing ``target`` with ``source``."""
    split_fqn(source)
    split_fqn(target)
    src = spark.table(source)
    tgt = spark.table(target)
    src_parts = list(partition_cols) if partition_cols is not None else partition_columns(spark, source).columns
    tgt_parts = partition_columns(spark, target).columns

    src_names = src.columns
    tgt_names = _resolve(tgt, src_names)
    same_columns = tgt_names is not None and len(tgt.columns) == len(src_names)
    group_src = _resolve(src, src_parts) or []
    group_tgt = _resolve(tgt, src_parts)
    if group_tgt is None:  # the target lost a partition column entirely
        group_src, group_tgt = [], []

    nkeys = max(1, len(group_src))
    key_names = [n for i in range(nkeys) for n in (f"k{i}", f"z{i}")]
    s = _per_partition(src, group_src, src_names).select(
        *key_names, F.col("n").alias("sn"), *[F.col(f"h{j}").alias(f"sh{j}") for j in range(SLICES)]
    )
    t = _per_partition(tgt, group_tgt, tgt_names if same_columns else None).select(
        *key_names, F.col("n").alias("tn"), *[F.col(f"h{j}").alias(f"th{j}") for j in range(SLICES)]
    )
    joined = s.join(t, key_names, "full_outer")
    same = F.col("sn").eqNullSafe(F.col("tn"))
    for j in range(SLICES):
        same = same & F.col(f"sh{j}").eqNullSafe(F.col(f"th{j}"))
    row = joined.agg(
        F.coalesce(F.sum("sn"), F.lit(0)).alias("src_rows"),
        F.coalesce(F.sum("tn"), F.lit(0)).alias("tgt_rows"),
        *[F.sum(f"sh{j}").alias(f"sh{j}") for j in range(SLICES)],
        *[F.sum(f"th{j}").alias(f"th{j}") for j in range(SLICES)],
        F.count("sn").alias("src_parts"),
        F.count("tn").alias("tgt_parts"),
        F.count_if(~same).alias("mismatched"),
    ).collect()[0]
    src_hash = combine_slices([row[f"sh{j}"] for j in range(SLICES)])
    tgt_hash = combine_slices([row[f"th{j}"] for j in range(SLICES)])
    src_types, tgt_types = column_types(spark, source), column_types(spark, target)
    wrong_types, widenings = compare_types(src_types, tgt_types, _provider(spark, target))
    return {
        "source_columns": ",".join(sorted(c.lower() for c in src_names)),
        "target_columns": ",".join(sorted(c.lower() for c in tgt.columns)),
        "source_types": _type_text(src_types),
        "target_types": _type_text(tgt_types),
        "wrong_types": wrong_types,
        "widenings": widenings,
        "src_rows": row.src_rows,
        "tgt_rows": row.tgt_rows,
        "src_hash": src_hash,
        "tgt_hash": tgt_hash,
        "source_partition_cols": ",".join(src_parts),
        "target_partition_cols": ",".join(tgt_parts),
        "src_parts": row.src_parts if src_parts else 0,
        "tgt_parts": row.tgt_parts if src_parts else 0,
        "mismatched": row.mismatched,
    }


def verify_rows(table_name: str, s: dict) -> list[tuple]:
    def r(check, expected, actual, ok=None, notes=()):
        e = None if expected is None else str(expected)
        a = None if actual is None else str(actual)
        return (table_name, check, e, a, bool(e == a) if ok is None else bool(ok), "; ".join(notes) or None)

    return [
        r("columns", s["source_columns"], s["target_columns"]),
        r("types", s["source_types"], s["target_types"], not s["wrong_types"], s["wrong_types"] + [f"widened {w}" for w in s["widenings"]]),
        r("row_count", s["src_rows"], s["tgt_rows"]),
        r("content_hash", s["src_hash"], s["tgt_hash"]),
        r("partition_columns", s["source_partition_cols"].lower(), s["target_partition_cols"].lower()),
        r("partition_count", s["src_parts"], s["tgt_parts"]),
        r("partition_mismatches", 0, s["mismatched"]),
    ]


def verify_migration(
    spark: SparkSession,
    source: str,
    target: str,
    partition_cols: list[str] | None = None,
    *,
    table_name: str | None = None,
) -> DataFrame:
    """Report ``(table_name, check_name, expected, actual, ok, note)``.

    ``columns``: same column names; ``types``: same column types as the
    catalogs declare them, or the wider ones that the target's provider is known
    to store (:mod:`ferry.functions.types`), which are noted; ``row_count``; ``content_hash``: the
    order-free multiset hash of all rows; ``partition_columns``: the
    target's registered partition columns equal the source's;
    ``partition_count`` and ``partition_mismatches``: the same partitions,
    each with the same rows.
    """
    name = table_name or target.split(".")[-1]
    return spark.createDataFrame(verify_rows(name, compare_tables(spark, source, target, partition_cols)), REPORT_SCHEMA)


def migration_ok(summary: dict) -> bool:
    return all(r[4] for r in verify_rows("", summary))


def partition_row_counts(spark: SparkSession, table: str, partition_cols: list[str] | None = None) -> DataFrame:
    """Rows per partition of a table (partition columns + ``row_count``).

    Reads no data columns: the plan scans partition values only, and the
    count is partially aggregated per task."""
    split_fqn(table)
    cols = list(partition_cols) if partition_cols is not None else partition_columns(spark, table).columns
    df = spark.table(table)
    return df.groupBy(*[F.col(f"`{c}`") for c in cols]).agg(F.count(F.lit(1)).alias("row_count"))


def verify_pairs(spark: SparkSession, pairs: dict[str, tuple[str, str]], *, parallelism: int = 1) -> DataFrame:
    """:func:`verify_migration` for several ``name: (source, target)``, as one
    report; ``parallelism > 1`` runs that many comparisons at once."""
    from ferry.concurrency import map_concurrently

    def one(name: str) -> list[tuple]:
        return verify_rows(name, compare_tables(spark, *pairs[name]))

    parts = map_concurrently(one, list(pairs), parallelism, spark)
    return spark.createDataFrame([r for p in parts for r in p], REPORT_SCHEMA)


def verify_schema(
    spark: SparkSession,
    source_catalog: str,
    source_schema: str,
    target_catalog: str,
    target_schema: str | None = None,
    tables: list[str] | None = None,
    *,
    parallelism: int = 1,
) -> DataFrame:
    """:func:`verify_migration` for every table of a namespace (or the given
    ones), as one report.  Tables are independent jobs; ``parallelism > 1``
    runs that many comparisons at once."""
    from ferry.functions.identifiers import safe_ident
    from ferry.sources.catalog import list_source_tables

    target_schema = target_schema or source_schema
    if tables is None:
        tables = sorted(r.table_name for r in list_source_tables(spark, source_catalog, source_schema).collect())
    src_ns = f"{safe_ident(source_catalog)}.{safe_ident(source_schema)}"
    tgt_ns = f"{safe_ident(target_catalog)}.{safe_ident(target_schema)}"

    pairs = {t: (f"{src_ns}.{safe_ident(t)}", f"{tgt_ns}.{safe_ident(t)}") for t in tables}
    return verify_pairs(spark, pairs, parallelism=parallelism)
