"""Pick each table's partition columns from several candidate answers.

Candidates are rows ``(table_name, priority, found_by, cols)``, one per
detection source.  The first non-empty list by priority wins; a table whose
candidates are all empty is unpartitioned.  The choice is a grouped
``min_by`` (partially aggregated per task, so a table with a huge number of
candidate rows never lands whole in one task) instead of a window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def distinct_names(cols: Column) -> Column:
    """Drop later repeats of a name, comparing case-insensitively."""
    return F.filter(
        cols,
        lambda x, i: ~F.exists(F.slice(cols, 1, i), lambda y: F.lower(y) == F.lower(x)),
    )


def resolve_partition_columns(
    candidates: DataFrame,
    *,
    table_col: str = "table_name",
    priority_col: str = "priority",
    found_by_col: str = "found_by",
    cols_col: str = "cols",
) -> DataFrame:
    """``(table_name, found_by, pos, column_name)``; an unpartitioned table
    keeps one row with NULL ``found_by``, ``pos`` and ``column_name``."""
    cols = F.coalesce(F.col(cols_col), F.array().cast("array<string>"))
    empty = F.size(cols) == 0
    best = candidates.groupBy(table_col).agg(
        F.min_by(
            F.struct(F.col(found_by_col).alias("found_by"), cols.alias("cols")),
            # Candidates of one priority: the source's name, then the columns decide, whatever the row order.
            F.struct(empty.alias("empty"), F.col(priority_col).alias("priority"), F.col(found_by_col).alias("found_by"), cols.alias("cols")),
        ).alias("best")
    )
    # Repeats are dropped from the winning list only, after the shuffle.
    chosen = best.select(
        F.col(table_col),
        F.when(F.size("best.cols") > 0, F.col("best.found_by")).alias("found_by"),
        distinct_names(F.col("best.cols")).alias("cols"),
    )
    return chosen.select(
        F.col(table_col),
        F.col("found_by"),
        F.posexplode_outer("cols").alias("pos", "column_name"),
    ).select(table_col, "found_by", F.when(F.col("pos").isNotNull(), F.col("pos") + 1).alias("pos"), "column_name")
