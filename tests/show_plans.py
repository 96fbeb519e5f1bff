"""Write PLANS.md: the physical plans Spark actually ran for the main operators.

Usage: ``python tests/show_plans.py [sf_dir] [out.md]``

Runs each operator once with Spark's event log written to a fresh scratch
folder, then reads the SQL execution events back and keeps each execution's
final physical plan (after adaptive re-planning).  No UI, no server.
"""

from __future__ import annotations

import glob
import json
import os
import sys
import tempfile

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

C = "spark_catalog"


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    out_path = argv[2] if len(argv) > 2 else os.path.join(os.path.dirname(os.path.dirname(__file__)), "PLANS.md")
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    scratch = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    events = os.path.join(scratch, "events")
    os.makedirs(events)
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.warehouse.dir", os.path.join(scratch, "warehouse"))
        .config("spark.eventLog.enabled", "true")
        .config("spark.eventLog.dir", "file://" + events)
        .config("spark.eventLog.compress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    from ferry.functions.partition_spec import file_partition_spec, partition_spec_values
    from ferry.operators.migrate import migrate_table
    from ferry.operators.verify import compare_tables, partition_row_counts
    from ferry.sources.testdata import fresh_schema, source_schema_for

    src = source_schema_for(spark, sf_dir)
    tgt = fresh_schema(spark, "plans")
    sc = spark.sparkContext
    steps = []

    def step(title, note, fn):
        tag = f"ferry-plan-{len(steps)}"
        sc.setJobDescription(tag)  # becomes the SQL execution's description
        try:
            fn()
        finally:
            sc.setJobDescription(None)
        steps.append((title, note, tag))

    step(
        "Copy keeping the source's partitioning (lineitem)",
        "Scan and write in one stage: no Exchange. The local Sort orders each task's rows by the partition columns for the dynamic-partition writer.",
        lambda: migrate_table(spark, f"{C}.{src}.lineitem", f"{C}.{tgt}.lineitem"),
    )
    step(
        "Copy into a new partitioning (customer by c_mktsegment)",
        "One RebalancePartitions exchange keyed by the new partition column; AQE sizes (and, for a hot value, splits) the write tasks.",
        lambda: migrate_table(spark, f"{C}.{src}.customer", f"{C}.{tgt}.customer", partition_cols=["c_mktsegment"]),
    )
    step(
        "Per-partition row counts of the new table",
        "ReadSchema is empty: only partition values are read; partial count per task before the shuffle.",
        lambda: partition_row_counts(spark, f"{C}.{tgt}.lineitem").collect(),
    )
    step(
        "Pruned read of the new table",
        "PartitionFilters on l_returnflag: other partitions' files are never listed or opened.",
        lambda: spark.table(f"{C}.{tgt}.lineitem").where(F.col("l_returnflag") == "A").select("l_orderkey").collect(),
    )
    step(
        "Verification (source vs target)",
        "Each side: partial aggregation of (count, four hash-slice sums) per partition value, one shuffle; the full outer join is on exactly the grouping keys (never NULL), so it reuses that partitioning with no further exchange; one row reaches the driver.",
        lambda: compare_tables(spark, f"{C}.{src}.lineitem", f"{C}.{tgt}.lineitem"),
    )
    step(
        "Rows per partition folder (file paths of migrated rows)",
        "Only the file path is read; rows are counted per file before the shuffle, and the few paths are parsed after it.",
        lambda: partition_spec_values(
            spark.table(f"{C}.{tgt}.lineitem")
            .groupBy(F.col("_metadata.file_path").alias("f"))
            .count()
            .select("count", file_partition_spec("f").alias("partition")),
            "partition",
        ).collect(),
    )
    spark.stop()

    execs = _executions(events)
    lines = [
        "# PLANS — physical plans Spark ran for the main operators",
        "",
        f"Generated by `python tests/show_plans.py {sf_dir}` from Spark's event log (final adaptive plans).",
        "Metadata commands of each step (listing, DESCRIBE, catalog calls) are left out; only jobs that read data are shown.",
        "",
    ]
    for title, note, tag in steps:
        lines += [f"## {title}", "", note, ""]
        for desc, plan in execs:
            if desc == tag and _reads_data(plan):
                lines += ["```", plan.strip(), "```", ""]
    with open(out_path, "w") as f:
        f.write("\n".join(lines))
    print(out_path)
    return 0


def ddl_partition_columns_job(spark, sf_dir, dump, parse):
    from pyspark.sql import functions as F

    df = dump(spark, sf_dir)
    df.select("table_name", F.posexplode(parse("ddl"))).write.format("noop").mode("overwrite").save()


def _reads_data(plan: str) -> bool:
    return any(k in plan for k in ("Scan parquet", "Scan orc", "FileScan", "InsertIntoHadoopFsRelationCommand"))


def _executions(events: str) -> list[tuple[str, str]]:
    """(description, final physical plan) of every SQL execution, in order."""
    plans: dict[int, tuple[str, str]] = {}
    files = sorted(glob.glob(os.path.join(events, "**", "*"), recursive=True))
    for path in [p for p in files if os.path.isfile(p)]:
        with open(path, errors="replace") as f:
            for line in f:
                if "SparkListenerSQL" not in line:
                    continue
                ev = json.loads(line)
                kind = ev.get("Event", "")
                if kind.endswith("SparkListenerSQLExecutionStart"):
                    plans[ev["executionId"]] = (ev.get("description", ""), _tree(ev.get("physicalPlanDescription", "")))
                elif kind.endswith("SparkListenerSQLAdaptiveExecutionUpdate"):
                    eid = ev["executionId"]
                    desc = plans.get(eid, ("", ""))[0]
                    plans[eid] = (desc, _tree(ev.get("physicalPlanDescription", "")))
    return [plans[k] for k in sorted(plans)]


_DETAILS = ("PartitionFilters:", "PushedFilters:", "DataFilters:", "ReadSchema:")


def _tree(text: str) -> str:
    """The operator tree of a formatted plan description, followed by the
    scans' filter and schema lines."""
    head = text.split("\n\n\n")[0]
    scans = []
    for block in text.split("\n\n"):
        first = block.strip().splitlines()[0] if block.strip() else ""
        if first.startswith("(") and " Scan " in first:
            scans.append(first)
            scans += ["    " + ln for ln in block.splitlines() if ln.startswith(_DETAILS)]
    out = head if head.strip() else text
    return out + ("\n\n" + "\n".join(scans) if scans else "")


if __name__ == "__main__":
    sys.exit(main(sys.argv))
