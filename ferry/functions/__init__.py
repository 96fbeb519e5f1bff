"""Column-level building blocks: every function returns a Spark Column or a
DataFrame transformation made of built-in expressions (no UDFs)."""

from ferry.functions.ddl import ddl_partition_columns, partitioned_by_clause
from ferry.functions.describe import described_partition_columns, described_transforms
from ferry.functions.fields import ddl_text, first_present
from ferry.functions.hashing import combine_slices, content_hash_aggs, hash_slices, row_hash
from ferry.functions.identifiers import (
    UnsafeIdentifier,
    fqn,
    ident_ok,
    is_safe_ident,
    safe_ident,
    split_fqn,
)
from ferry.functions.partition_spec import (
    file_partition_spec,
    partition_spec_values,
    spec_keys,
    unescape_path_value,
)

__all__ = [
    "UnsafeIdentifier",
    "combine_slices",
    "content_hash_aggs",
    "hash_slices",
    "ddl_partition_columns",
    "ddl_text",
    "described_partition_columns",
    "file_partition_spec",
    "first_present",
    "fqn",
    "ident_ok",
    "is_safe_ident",
    "partition_spec_values",
    "partitioned_by_clause",
    "row_hash",
    "safe_ident",
    "spec_keys",
    "split_fqn",
    "unescape_path_value",
]
