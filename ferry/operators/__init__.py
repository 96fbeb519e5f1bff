"""Table-level operators: copy, batch migration, plan, checks."""

from ferry.operators.differences import row_differences
from ferry.operators.ledger import RunLedger, read_ledger, run_summary
from ferry.operators.migrate import MigrationError, MigrationResult, RowCountMismatch, migrate_table, recover_swaps
from ferry.operators.resolve import resolve_partition_columns
from ferry.operators.resume import migrate_resumable
from ferry.operators.schema import failure_count, migrate_schema, plan_migration
from ferry.operators.verify import compare_tables, partition_row_counts, verify_migration, verify_schema

__all__ = [
    "MigrationError",
    "MigrationResult",
    "RowCountMismatch",
    "RunLedger",
    "compare_tables",
    "failure_count",
    "migrate_resumable",
    "migrate_schema",
    "migrate_table",
    "partition_row_counts",
    "plan_migration",
    "read_ledger",
    "recover_swaps",
    "resolve_partition_columns",
    "row_differences",
    "run_summary",
    "verify_migration",
    "verify_schema",
]
