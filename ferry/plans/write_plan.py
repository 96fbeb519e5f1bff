"""How one table is written: the CTAS statement and its data distribution.

The copy is a single ``CREATE TABLE ... AS SELECT`` handed to Catalyst.  The
only physical decision made here is whether rows are shuffled by the
partition columns before the write:

* ``none``      -- scan and write in the same task.  Right when the source
  is already laid out by the same partition columns (each input split then
  holds rows of one partition, or a few small ones), and for unpartitioned
  targets.  No shuffle.
* ``rebalance`` -- ``/*+ REBALANCE(cols) */``: one shuffle keyed by the
  partition columns so each target partition is written by few tasks (few,
  large files).  With AQE on, oversized partitions (a hot value holding a
  third of the rows) are split into advisory-size tasks and tiny ones are
  coalesced, so a skewed key does not become one straggler task.

``auto`` picks ``none`` when source and target partitioning agree and
``rebalance`` otherwise (only when AQE is enabled; without AQE a rebalance
is a plain hash shuffle that would put a hot value in one task, so the
write stays unshuffled instead).  ``sizes`` is ``auto``, but looks at the
source's files too and rebalances where they are many and small, so that a
table of tiny files is not copied into as many again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ferry.functions.identifiers import safe_ident, split_fqn
from ferry.functions.partition_spec import file_partition_spec

# Table providers whose partitions are directories
# (partition values live in paths; an empty string becomes NULL there).
PATH_PROVIDERS = ("parquet", "orc", "csv", "json", "text", "avro")
FILE_PROVIDERS = PATH_PROVIDERS + ("hive",)
# Fixed value: the directory name that stands for a NULL partition value.
DEFAULT_PARTITION = "__HIVE_DEFAULT_PARTITION__"

DISTRIBUTIONS = ("auto", "none", "rebalance", "sizes")
#: Mean size below which files are small.
SMALL_FILE_BYTES = 16 << 20


@dataclass
class WritePlan:
    source: str
    target: str
    provider: str
    partition_cols: list[str]
    distribution: str
    location: str | None = None
    replace: bool = False

    def sql(self, rows: str | None = None) -> str:
        """The statement; ``rows`` stands in for the source's name."""
        split_fqn(self.source)
        split_fqn(self.target)
        provider = safe_ident(self.provider)
        cols = ", ".join(safe_ident(c) for c in self.partition_cols)
        verb = "CREATE OR REPLACE TABLE" if self.replace else "CREATE TABLE"
        lines = [f"{verb} {self.target}", f"USING {provider}"]
        if cols:
            lines.append(f"PARTITIONED BY ({cols})")
        if self.location is not None:
            lines.append(f"LOCATION '{sql_path(self.location)}'")
        by = f"({cols})" if cols else ""
        hint = f"/*+ REBALANCE{by} */ " if self.distribution == "rebalance" else ""
        lines.append(f"AS SELECT {hint}* FROM {rows or self.source}")
        return "\n".join(lines)


def sql_path(path: str) -> str:
    if any(c in path for c in "'\\{}"):
        raise ValueError(f"location not usable in SQL text: {path!r}")
    return path


def aqe_enabled(spark: SparkSession) -> bool:
    return str(spark.conf.get("spark.sql.adaptive.enabled", "true")).lower() == "true"


def has_small_files(spark: SparkSession, source: str) -> bool:
    """Whether a table's files are small on average and more than two a
    partition, from their metadata (no column is read; one row comes back).
    A source without files of its own (a view, another catalog) has none."""
    try:
        files = spark.table(source).select("_metadata.file_path", "_metadata.file_size").distinct()
    except AnalysisException:
        return False
    found = files.agg(
        F.count("*").alias("n"), F.sum("file_size").alias("bytes"), F.count_distinct(file_partition_spec("file_path")).alias("parts")
    ).head()
    return found.n > 2 * found.parts and found.bytes < found.n * SMALL_FILE_BYTES


def choose_distribution(
    spark: SparkSession,
    requested: str,
    source_partition_cols: list[str],
    target_partition_cols: list[str],
    source: str | None = None,
) -> str:
    if requested not in DISTRIBUTIONS:
        raise ValueError(f"distribution must be one of {DISTRIBUTIONS}, got {requested!r}")
    if requested == "sizes" and source is not None and aqe_enabled(spark) and has_small_files(spark, source):
        return "rebalance"
    if not target_partition_cols:
        return "none"
    if requested in ("none", "rebalance"):
        return requested
    same = [c.lower() for c in source_partition_cols] == [c.lower() for c in target_partition_cols]
    if same:
        return "none"
    return "rebalance" if aqe_enabled(spark) else "none"


def explain(spark: SparkSession, sql: str, mode: str = "FORMATTED") -> str:
    """Physical plan text of a statement, without running it."""
    mode = safe_ident(mode.upper())
    return "\n".join(r[0] for r in spark.sql(f"EXPLAIN {mode} {sql}").collect())
