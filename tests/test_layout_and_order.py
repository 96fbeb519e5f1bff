"""Small files, listings taken from files, and the order of a batch."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from ferry.operators import schema as batch
from ferry.operators.migrate import migrate_table
from ferry.operators.verify import verify_migration
from ferry.sources.catalog import estimated_bytes
from ferry.sources.partitions import partition_listing

C = "spark_catalog"


def files(spark, table) -> int:
    return spark.table(table).select("_metadata.file_path").distinct().count()


@pytest.mark.parametrize("by", [["k"], []])
def test_a_table_of_tiny_files_is_copied_into_few(spark, tgt, by):
    rows = spark.range(4000).select("id", (F.col("id") % 2).cast("int").alias("k")).repartition(250)
    rows.write.partitionBy(*by).saveAsTable(f"{C}.{tgt}.tiny")
    n = files(spark, f"{C}.{tgt}.tiny")
    assert n == (500 if by else 250)
    res = migrate_table(spark, f"{C}.{tgt}.tiny", f"{C}.{tgt}.few", distribution="sizes", verify="full")
    assert res.distribution == "rebalance" and res.partition_cols == by
    assert files(spark, f"{C}.{tgt}.few") <= 4
    assert all(r["ok"] for r in verify_migration(spark, f"{C}.{tgt}.tiny", f"{C}.{tgt}.few").collect())
    # Few files stay as they are, and so does a source without files.
    again = migrate_table(spark, f"{C}.{tgt}.few", f"{C}.{tgt}.same", distribution="sizes")
    spark.sql(f"CREATE VIEW {C}.{tgt}.seen AS SELECT 1 AS id")
    view = migrate_table(spark, f"{C}.{tgt}.seen", f"{C}.{tgt}.from_view", distribution="sizes")
    assert again.distribution == view.distribution == "none"


def test_partitions_listed_from_files_equal_the_catalog_listing(spark, tgt):
    values = [("a b", 1), ("x/y=z%", 2), ("p+q", 3), (None, 4), ("é", 4)]
    made = spark.createDataFrame([(i, *v) for i, v in enumerate(values * 3)], "id int, s string, n int")
    made.repartition(5).write.partitionBy("s", "n").saveAsTable(f"{C}.{tgt}.odd")
    listed, found = (partition_listing(spark, f"{C}.{tgt}.odd", from_files=x) for x in (False, True))
    want = sorted(map(str, listed.collect()))
    assert sorted(map(str, found.collect())) == want and len(want) == 2 * len(values)
    made.where("id < 0").drop("s", "n").write.saveAsTable(f"{C}.{tgt}.flat")
    assert partition_listing(spark, f"{C}.{tgt}.flat", from_files=True).collect() == []


def test_the_largest_table_of_a_concurrent_batch_starts_first(spark, tgt, monkeypatch):
    sizes = {"a_small": 10, "b_large": 200_000, "c_middle": 20_000}
    for name, n in sizes.items():
        spark.range(n).write.saveAsTable(f"{C}.{tgt}.{name}")
    got = {t: estimated_bytes(spark, f"{C}.{tgt}.{t}") for t in sizes}
    assert got["b_large"] > got["c_middle"] > got["a_small"] > 0
    assert estimated_bytes(spark, f"{C}.{tgt}.absent") == 0

    started, one = [], batch._one
    monkeypatch.setattr(batch, "_one", lambda *a: (started.append(a[5]), one(*a))[1])
    report = batch.migrate_schema(spark, C, tgt, C, f"{tgt}_copy", parallelism=2)
    assert started[0] == "b_large" and sorted(started) == sorted(sizes)
    assert [r["table_name"] for r in report.collect()] == sorted(sizes)
    assert {r["status"] for r in report.collect()} == {"ok"}
    started.clear()
    batch.migrate_schema(spark, C, tgt, C, f"{tgt}_copy", if_exists="skip")
    assert started == sorted(sizes)
