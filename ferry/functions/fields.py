"""Read a field whose column name drifts between Spark versions.

``SHOW TABLES`` calls its name column ``tableName`` in one version and
``table_name`` in another; ``SHOW CREATE TABLE`` returns ``createtab_stmt``
or ``create_table_stmt`` or something else.  Instead of fishing values out of
collected rows, these helpers build one Column that coalesces whichever of
the candidate columns the DataFrame actually has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Column names under which SHOW CREATE TABLE has returned the
# DDL text, in the order they are preferred.
DDL_COLUMN_NAMES = ("createtab_stmt", "create_table_stmt", "result")


def _present(df: DataFrame, names: tuple[str, ...]) -> list[str]:
    by_lower = {c.lower(): c for c in df.columns}
    out = []
    for n in names:
        c = by_lower.get(n.lower())
        if c is not None and c not in out:
            out.append(c)
    return out


def first_present(df: DataFrame, *names: str, default: Column | None = None) -> Column:
    """First non-null value among the named columns that exist in ``df``.

    Names are matched case-insensitively; missing ones are skipped.  With
    none present the result is ``default`` (NULL when not given).
    """
    cols = [F.col(f"`{c}`") for c in _present(df, names)]
    if default is not None:
        cols.append(default)
    if not cols:
        return F.lit(None)
    return cols[0] if len(cols) == 1 else F.coalesce(*cols)


def ddl_text(df: DataFrame) -> Column:
    """The DDL string of a ``SHOW CREATE TABLE`` row of unknown shape.

    Preference: a known DDL column that is not blank; else any string column
    that mentions CREATE or TABLE; else the first non-blank string column.
    """
    def not_blank(c: Column) -> Column:
        return F.when(F.trim(c) != "", c)

    string_cols = [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]
    named = [not_blank(F.col(f"`{c}`")) for c in _present(df, DDL_COLUMN_NAMES)]
    mentions = [
        F.when(
            F.col(f"`{c}`").rlike(r"(?i)\b(create|table)\b"),
            F.col(f"`{c}`"),
        )
        for c in string_cols
    ]
    anything = [not_blank(F.col(f"`{c}`")) for c in string_cols]
    cols = named + mentions + anything
    if not cols:
        return F.lit(None).cast("string")
    return cols[0] if len(cols) == 1 else F.coalesce(*cols)
