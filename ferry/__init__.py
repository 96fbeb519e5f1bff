"""ferry: move catalog tables between formats and catalogs with their
partitioning intact, as Spark jobs.

Public API::

    from ferry import migrate_table, migrate_schema, plan_migration, verify_migration
"""

from ferry.operators import (
    MigrationError,
    MigrationResult,
    compare_tables,
    failure_count,
    migrate_schema,
    migrate_table,
    partition_row_counts,
    plan_migration,
    resolve_partition_columns,
    verify_migration,
    verify_schema,
)
from ferry.sources import list_source_tables, partition_columns, schema_partition_columns

__all__ = [
    "MigrationError",
    "MigrationResult",
    "compare_tables",
    "failure_count",
    "list_source_tables",
    "migrate_schema",
    "migrate_table",
    "partition_columns",
    "partition_row_counts",
    "plan_migration",
    "resolve_partition_columns",
    "schema_partition_columns",
    "verify_migration",
    "verify_schema",
]
