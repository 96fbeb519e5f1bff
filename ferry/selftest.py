"""``--self-test``: the name rule and the parsers of catalog output on a few
known texts, in the session that would run the migration."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ferry.functions import ddl_partition_columns, ident_ok, spec_keys

# (what is tested, text, expected names in order)
CASES = [
    ("ddl", "CREATE TABLE lake.visits (page STRING) USING orc PARTITIONED BY (day, `hour of day`)", ["day", "hour of day"]),
    ("ddl", "create table v (n int) partitioned by (shard INT COMMENT 'a, b', zone STRING)", ["shard", "zone"]),
    ("ddl", "CREATE TABLE flat (note STRING COMMENT 'never PARTITIONED BY (x)') USING parquet", []),
    ("spec", "day=2021-03-04/zone=a%2Fb", ["day", "zone"]),
    ("name", "visits_2021", ["visits_2021"]),
    ("name", "visits; DROP TABLE x", []),
    ("name", "visits\n", []),
]


def self_test(spark: SparkSession) -> list[str]:
    """One line per case that fails; empty when all hold."""
    cases = spark.createDataFrame(
        [(i, *c) for i, c in enumerate(CASES)], "i int, kind string, text string, expected array<string>"
    )
    nothing = F.array().cast("array<string>")
    got = (
        F.when(F.col("kind") == "ddl", ddl_partition_columns(F.col("text")))
        .when(F.col("kind") == "spec", spec_keys(F.col("text")))
        .otherwise(F.when(ident_ok("text"), F.array("text")))
    )
    wrong = cases.withColumn("got", F.coalesce(got, nothing)).where("got != expected").orderBy("i")
    return [f"{r.kind} {r.text!r}: {r.got} instead of {r.expected}" for r in wrong.collect()]
