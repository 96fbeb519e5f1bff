"""Partition columns from ``DESCRIBE TABLE EXTENDED`` rows.

The rows of one table are a sequence: data columns, then a
``# Partition Information`` header, a ``# col_name`` header, the partition
columns, and later ``# Detailed Table Information`` (or ``# Metadata`` /
``# Storage``).  The section lies between the first partition header and the
first closing header after it.

A dump of many tables is scanned in one pass with one shuffle: the rows of a
table come together as one array, and array functions cut the section out of
it.  One table's DESCRIBE rows (its columns plus a fixed block of metadata
lines) are bounded by its schema width, so no group can grow with the data
volume.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Section headers of DESCRIBE TABLE EXTENDED output.
PARTITION_HEADER = "# Partition Information"
#: Stands instead of the header above when a table has a partition transform that is not a plain column.
TRANSFORM_HEADER = "# Partitioning"
SECTION_END_HEADERS = ("# Detailed", "# Metadata", "# Storage")


def described_transforms(rows: list[tuple[str | None, str | None]]) -> list[str]:
    """Every partition transform of one table, in order, from its ``(col_name,
    data_type)`` rows: plain column names and texts like ``bucket(4, id)``.
    Empty where all are plain columns (another section lists those)."""
    names = [(name or "").strip() for name, _ in rows]
    if TRANSFORM_HEADER not in names:
        return []
    parts = []
    for name, text in rows[names.index(TRANSFORM_HEADER) + 1 :]:
        if not (name or "").startswith("Part "):
            break
        parts.append((text or "").strip())
    return parts


def described_partition_columns(
    df: DataFrame,
    *,
    table_col: str = "table_name",
    pos_col: str = "pos",
    name_col: str = "col_name",
) -> DataFrame:
    """``(table, pos, column_name)`` for each table's partition section.

    ``pos`` orders the rows of one table (the order DESCRIBE printed them).
    Output ``pos`` is the 1-based rank among the table's partition columns;
    a repeated name keeps its first place (case-insensitive).  Tables without
    a partition section produce no rows.
    """
    name = F.trim(F.coalesce(F.col(name_col), F.lit("")))
    is_end = F.lit(False)
    for h in SECTION_END_HEADERS:
        is_end = is_end | name.startswith(h)
    tables = df.groupBy(table_col).agg(
        F.min(F.when(name.startswith(PARTITION_HEADER), F.col(pos_col))).alias("__start"),
        F.collect_list(F.when(is_end, F.col(pos_col))).alias("__ends"),
        # Headers and blank lines name no column.
        F.collect_list(F.when((name != "") & ~name.startswith("#"), F.struct(F.col(pos_col).alias("pos"), name.alias("name")))).alias("__lines"),
    )
    end = F.array_min(F.filter("__ends", lambda p: p > F.col("__start")))
    section = F.filter("__lines", lambda x: (x.pos > F.col("__start")) & (F.col("__end").isNull() | (x.pos < F.col("__end"))))
    first = F.filter(F.col("__section"), lambda x: ~F.exists("__section", lambda y: (y.pos < x.pos) & (F.lower(y["name"]) == F.lower(x["name"]))))
    kept = (
        tables.where(F.col("__start").isNotNull())
        .withColumn("__end", end)
        .select(table_col, F.array_sort(section).alias("__section"))
        .select(table_col, F.posexplode(F.transform(first, lambda x: x["name"])).alias("__at", "column_name"))
    )
    return kept.select(table_col, (F.col("__at") + 1).alias("pos"), "column_name")
