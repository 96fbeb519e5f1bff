"""Identifier rules for catalog, namespace, table and partition-column names.

Every name that is spliced into SQL text goes through :func:`safe_ident`
first, so no quoting is ever needed and nothing user-supplied can change the
statement.  The same rule exists as a Column predicate for bulk checks over
DataFrames of names (metastore dumps, listings).
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the accepted identifier alphabet (letters, digits, underscore).
# The whole string must match; a trailing newline is refused as well.
IDENT_CLASS = "[A-Za-z0-9_]+"

_IDENT_RE = re.compile(IDENT_CLASS)
# \A and \z anchor the whole input in Java regex (``$`` would accept "ab\n").
_IDENT_JAVA = r"\A" + IDENT_CLASS + r"\z"


class UnsafeIdentifier(ValueError):
    """A name that is not a plain identifier and must never reach SQL text."""


def is_safe_ident(name: object) -> bool:
    return isinstance(name, str) and _IDENT_RE.fullmatch(name) is not None


def safe_ident(name: object) -> str:
    """Return ``name`` unchanged if it is a plain identifier, else raise."""
    if not is_safe_ident(name):
        raise UnsafeIdentifier(f"{name!r} is not a plain name")
    return name  # type: ignore[return-value]


def fqn(catalog: str, schema: str, table: str) -> str:
    """``catalog.schema.table`` with every part checked."""
    return f"{safe_ident(catalog)}.{safe_ident(schema)}.{safe_ident(table)}"


def split_fqn(name: str) -> tuple[str, str, str]:
    """Split a three-part name and check each part."""
    parts = name.split(".") if isinstance(name, str) else []
    if len(parts) != 3:
        raise UnsafeIdentifier(f"expected catalog.schema.table, got {name!r}")
    return safe_ident(parts[0]), safe_ident(parts[1]), safe_ident(parts[2])


def ident_ok(col: Column | str) -> Column:
    """Column predicate: true when the value is a plain identifier."""
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(c.rlike(_IDENT_JAVA), F.lit(False))
