"""Catalog-side inputs: namespace listings, table existence, and live
partition-column detection."""

from ferry.sources.catalog import (
    ensure_namespace,
    list_source_tables,
    missing_tables,
    namespace_location,
    normalize_listing,
    parse_include,
    table_exists,
    table_location,
)
from ferry.sources.partitions import (
    Detection,
    describe_rows,
    detect_partitions,
    partition_columns,
    partition_listing,
    schema_partition_columns,
)

__all__ = [
    "Detection",
    "describe_rows",
    "detect_partitions",
    "ensure_namespace",
    "list_source_tables",
    "missing_tables",
    "namespace_location",
    "normalize_listing",
    "parse_include",
    "partition_columns",
    "partition_listing",
    "schema_partition_columns",
    "table_exists",
    "table_location",
]
