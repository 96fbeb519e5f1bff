"""A durable ledger of migration runs.

Every table's report row is appended to a catalog table as soon as the table is
done, so a batch that dies (or whose driver does) leaves what it had finished.
Counting failures is a query over that table.

The ledger is partitioned by run.  A run writes into its own partition alone, one
row at a time, so runs that share a ledger do not disturb each other.
"""

from __future__ import annotations

import threading
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferry.functions.identifiers import safe_ident, split_fqn
from ferry.sources.catalog import ensure_namespace, table_exists, table_location, table_provider

#: Columns of a row besides ``run_id``: place in the run, the report's columns, time of the row.
LEDGER_COLUMNS = (
    "seq int, source_schema string, target_schema string, table_name string, action string, partition_cols string, "
    "rows_source bigint, rows_target bigint, status string, error string, finished_at timestamp"
)
#: Outcomes that count as failures.
FAILED = ("failed", "mismatch")
PATH_PROVIDERS = ("parquet", "orc")


class RunLedger:
    """The rows of one run, appended to ``table`` (made if it is absent)."""

    def __init__(self, spark: SparkSession, table: str, run_id: str | None = None, *, provider: str = "parquet"):
        catalog, schema, _ = split_fqn(table)
        self.spark, self.table = spark, table
        self.run_id = safe_ident(run_id or f"run_{uuid.uuid4().hex[:12]}")
        self._seq, self._lock = 0, threading.Lock()
        if not table_exists(spark, table):
            ensure_namespace(spark, catalog, schema)
            spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({LEDGER_COLUMNS}, run_id string) USING {safe_ident(provider)} PARTITIONED BY (run_id)")
        self._provider = (table_provider(spark, table) or "").lower()
        self._folder = None
        if self._provider in PATH_PROVIDERS:
            self._folder = f"{(table_location(spark, table) or '').rstrip('/')}/run_id={self.run_id}"
            spark.sql(f"ALTER TABLE {table} ADD IF NOT EXISTS PARTITION (run_id = '{self.run_id}')")

    def append(self, source_schema: str, target_schema: str, row: tuple) -> None:
        """Append a report row.  Threads of a run take turns; the write is one
        committed Spark job, so a row is there whole or not at all."""
        with self._lock:
            columns = LEDGER_COLUMNS.removesuffix(", finished_at timestamp")
            frame = self.spark.createDataFrame([(self._seq, source_schema, target_schema, *row)], columns).withColumn("finished_at", F.current_timestamp())
            if self._folder:
                frame.write.format(self._provider).mode("append").save(self._folder)
            else:
                frame.withColumn("run_id", F.lit(self.run_id)).writeTo(self.table).append()
            self._seq += 1


def read_ledger(spark: SparkSession, table: str, run_id: str | None = None) -> DataFrame:
    """The ledger's rows (of one run), without a stale file listing."""
    split_fqn(table)
    spark.catalog.refreshTable(table)
    rows = spark.table(table)
    return rows if run_id is None else rows.where(F.col("run_id") == run_id)


def run_summary(ledger: DataFrame) -> DataFrame:
    """``(run_id, tables, failures, rows_source, rows_target)`` per run.  A table that a
    run reports more than once counts by its last row."""
    last = ledger.groupBy("run_id", "source_schema", "target_schema", "table_name").agg(F.max_by(F.struct("status", "rows_source", "rows_target"), "seq").alias("r"))
    failed = F.col("r.status").isin(*FAILED)
    return last.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("tables"),
        F.count_if(failed).alias("failures"),
        F.sum("r.rows_source").alias("rows_source"),
        F.sum("r.rows_target").alias("rows_target"),
    )
