"""Column functions: identifiers, partition specs, DDL clauses, DESCRIBE
sections, candidate resolution."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from ferry.functions import (
    UnsafeIdentifier,
    ddl_partition_columns,
    ddl_text,
    described_partition_columns,
    described_transforms,
    file_partition_spec,
    fqn,
    ident_ok,
    partition_spec_values,
    partitioned_by_clause,
    safe_ident,
    spec_keys,
)
from ferry.operators.resolve import resolve_partition_columns

# ------------------------------------------------------------ identifiers


@pytest.mark.parametrize("name", ["a1_B", "store_sales", "X", "_", "0"])
def test_safe_ident_accepts(name):
    assert safe_ident(name) == name


@pytest.mark.parametrize("name", ["a-b", "a.b", "", "ab\n", "a b", "`a`", "a;drop", None, 3])
def test_safe_ident_refuses(name):
    with pytest.raises(UnsafeIdentifier):
        safe_ident(name)


def test_fqn_checks_every_part():
    assert fqn("c", "s", "t") == "c.s.t"
    with pytest.raises(UnsafeIdentifier):
        fqn("c", "s-x", "t")


def test_ident_ok_column(spark):
    df = spark.createDataFrame([("a1_B",), ("a-b",), ("ab\n",), ("",), (None,)], "n string")
    got = {r.n: r.ok for r in df.select("n", ident_ok("n").alias("ok")).collect()}
    assert got == {"a1_B": True, "a-b": False, "ab\n": False, "": False, None: False}


# -------------------------------------------------------- partition specs

SPEC_CASES = [
    ("dt=2024-01-01 10%3A00/hr=1", [("dt", "2024-01-01 10:00"), ("hr", "1")]),
    ("dt=a%2Fb+c/hr=__HIVE_DEFAULT_PARTITION__", [("dt", "a/b+c"), ("hr", None)]),
    ("a=1=2/b=3", [("a", "1=2"), ("b", "3")]),
    ("junk/a=1", [("a", "1")]),
    ("x=50%25/y=%zz%", [("x", "50%"), ("y", "%zz%")]),
]


def test_partition_spec_values_fixture_cases(spark):
    df = spark.createDataFrame([(i, s) for i, (s, _) in enumerate(SPEC_CASES)], "id int, partition string")
    rows = partition_spec_values(df, "partition").orderBy("id", "pos").collect()
    for i, (_, expected) in enumerate(SPEC_CASES):
        got = [(r.key, r.value) for r in rows if r.id == i]
        assert got == expected, (i, got)
        assert [r.pos for r in rows if r.id == i] == list(range(1, len(expected) + 1))


def test_spec_keys(spark):
    df = spark.createDataFrame([(s,) for s, _ in SPEC_CASES], "partition string")
    keys = [r.k for r in df.select(spec_keys("partition").alias("k")).collect()]
    assert keys == [[k for k, _ in e] for _, e in SPEC_CASES]


def test_specs_of_real_listings_and_files_give_the_values_back(spark, tgt):
    values = ["a/b:c+d", "x=1%?\"#'*\\{[]^", "sp ace", "é😀", "tab\there", None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, p string")
    df.write.partitionBy("p").format("parquet").saveAsTable(f"spark_catalog.{tgt}.specs")
    listing = spark.sql(f"SHOW PARTITIONS spark_catalog.{tgt}.specs")
    parsed = {r.value for r in partition_spec_values(listing, "partition").collect()}
    assert parsed == set(values)
    files = spark.table(f"spark_catalog.{tgt}.specs").select("id", file_partition_spec("_metadata.file_path").alias("partition"))
    assert {r.id: r.value for r in partition_spec_values(files, "partition").collect()} == dict(enumerate(values))


# ------------------------------------------------------------------- DDL

DDL_CASES = [
    ("CREATE TABLE t (x int) PARTITIONED BY (a int, b struct<x:int,y:int>, m decimal(7,2))", ["a", "b", "m"]),
    ("create table t (x int) partitioned by (a int comment 'x) y, z', `my col` string)", ["a", "my col"]),
    ("CREATE TABLE t (x int) USING orc PARTITIONED BY (dt, hr)", ["dt", "hr"]),
    ("CREATE TABLE t (x int) USING orc", []),
    ("CREATE TABLE t (x int) PARTITIONED BY (dt, hr", []),
    ("CREATE TABLE t (x int) PARTITIONED BY (`a``b` int, c string COMMENT 'it\\'s (x'), d int", ["a`b", "c"]),
    ("CREATE TABLE t (x int) PARTITIONED BY (`a``b` int, c string COMMENT 'it\\'s (x', d int)", ["a`b", "c", "d"]),
    ("CREATE TABLE t (x int) PARTITIONED\n  BY\t(k map<string, array<int>>, `v`)", ["k", "v"]),
    ("CREATE TABLE t (x int) PARTITIONED BY (a int COMMENT \"p(, q\", b int)", ["a", "b"]),
    ("CREATE TABLE t (x int COMMENT 'was partitioned by (day)') PARTITIONED BY (dt)", ["dt"]),
    ("CREATE TABLE t (x int COMMENT 'not partitioned by (day), ok') USING orc", []),
    ("CREATE TABLE t (`it's` int) PARTITIONED BY (`it's`, b)", ["it's", "b"]),
]


def test_ddl_partition_columns_cases(spark):
    df = spark.createDataFrame([(i, d) for i, (d, _) in enumerate(DDL_CASES)], "i int, ddl string")
    got = {r.i: r.cols for r in df.select("i", ddl_partition_columns("ddl").alias("cols")).collect()}
    for i, (_, expected) in enumerate(DDL_CASES):
        assert got[i] == expected, (DDL_CASES[i][0], got[i])


def test_ddl_null_gives_empty(spark):
    df = spark.createDataFrame([(None,)], "ddl string")
    assert df.select(ddl_partition_columns("ddl").alias("c")).collect()[0].c == []


def test_partitioned_by_clause_of_real_statements(spark, tgt):
    spark.sql(f"CREATE TABLE spark_catalog.{tgt}.flat (n int) USING orc")
    spark.sql(f"CREATE TABLE spark_catalog.{tgt}.parted (n int, m decimal(7,2), k string) USING orc PARTITIONED BY (m, k)")
    got = []
    for t in ("flat", "parted"):
        shown = spark.sql(f"SHOW CREATE TABLE spark_catalog.{tgt}.{t}")
        got.append(shown.select(partitioned_by_clause(ddl_text(shown)).alias("c")).first().c)
    assert got == [None, "m, k"]


def test_ddl_of_a_real_table(spark, tgt):
    spark.sql(f"CREATE TABLE spark_catalog.{tgt}.real (v int COMMENT 'partitioned by (x)', `my day` date, n int) USING parquet PARTITIONED BY (`my day`, n)")
    shown = spark.sql(f"SHOW CREATE TABLE spark_catalog.{tgt}.real")
    assert shown.select(ddl_partition_columns(ddl_text(shown)).alias("c")).first().c == ["my day", "n"]


def test_ddl_text_from_rows_of_any_shape(spark):
    statement = "create table readings (celsius double) using orc partitioned by (station)"
    named = spark.createDataFrame([(statement,)], "createtab_stmt string")
    unnamed = spark.createDataFrame([(statement,)], "_1 string")
    other = spark.createDataFrame([(" ", "text about how to Create a Table")], "result string, other string")
    for df, expected in ((named, statement), (unnamed, statement), (other, "text about how to Create a Table")):
        assert df.select(ddl_text(df).alias("d")).first().d == expected


# -------------------------------------------------------------- DESCRIBE


def test_described_partition_columns(spark):
    rows = [
        ("t", 0, "a", "int"),
        ("t", 1, "dt", "string"),
        ("t", 2, "hr", "int"),
        ("t", 3, "# Partition Information", ""),
        ("t", 4, "# col_name", "data_type"),
        ("t", 5, "dt", "string"),
        ("t", 6, "hr", "int"),
        ("t", 7, "HR", "int"),
        ("t", 8, "", ""),
        ("t", 9, "# Detailed Table Information", ""),
        ("t", 10, "Partition Provider", "Catalog"),
        ("u", 0, "a", "int"),
        ("u", 1, "# Detailed Table Information", ""),
        ("v", 0, "# Partition Information", ""),
        ("v", 1, "p", "string"),
    ]
    df = spark.createDataFrame(rows, "table_name string, pos int, col_name string, data_type string")
    got = sorted((r.table_name, r.pos, r.column_name) for r in described_partition_columns(df).collect())
    assert got == [("t", 1, "dt"), ("t", 2, "hr"), ("v", 1, "p")]


def test_described_sections_of_any_row_order_take_one_shuffle(spark):
    rows = [("w", i, n, "") for i, n in enumerate(["# Storage", "k", "# Partition Information", "# col_name", "k", " Day ", None, "day", "# Partition Information", "n", "# Metadata", "z", "# Detailed"])]
    df = spark.createDataFrame([*rows[::-1], (None, 0, "# Partition Information", ""), (None, 1, "q", "")], "table_name string, pos int, col_name string, data_type string").repartition(3)
    found = described_partition_columns(df)
    assert {(r.table_name, r.pos, r.column_name) for r in found.collect()} == {("w", 1, "k"), ("w", 2, "Day"), ("w", 3, "n"), (None, 1, "q")}
    assert found.columns == ["table_name", "pos", "column_name"] and described_partition_columns(df.limit(0)).collect() == []
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1 and "Window" not in plan


def test_transforms_are_read_whole():
    rows = [("id", "bigint"), ("day", "date"), ("", ""), ("# Partitioning", ""), ("Part 0", "day"), ("Part 1", "bucket(4, id)"), ("", ""), ("# Detailed Table Information", "")]
    assert described_transforms(rows) == ["day", "bucket(4, id)"]
    assert described_transforms([("id", "bigint"), ("# Partition Information", ""), ("# col_name", "data_type"), ("id", "bigint")]) == []
    assert described_transforms([]) == described_transforms([(None, None)]) == []


def test_a_bucket_part_is_refused_and_not_left_out(monkeypatch):
    """A catalog that flags plain columns only and prints its transforms."""
    from types import SimpleNamespace

    from ferry.functions.identifiers import is_safe_ident
    from ferry.sources import partitions as p

    listed = [("t", 0, "day", "date"), ("t", 1, "# Partitioning", ""), ("t", 2, "Part 0", "day"), ("t", 3, "Part 1", "bucket(4, id)")]
    monkeypatch.setattr(p, "describe_rows", lambda s, n: listed)
    flags = [SimpleNamespace(name="day", isPartition=True), SimpleNamespace(name="id", isPartition=False)]

    def sql(text):
        raise ValueError("no JSON form here")

    session = SimpleNamespace(sql=sql, catalog=SimpleNamespace(listColumns=lambda n: flags))
    found = p.catalog_partition_flags(session, "lake.s.t")
    assert found == ["day", "bucket(4, id)"] and [c for c in found if not is_safe_ident(c)] == ["bucket(4, id)"]
    assert p.catalog_partition_flags(session, "spark_catalog.s.t") == ["day"]
    monkeypatch.setattr(p, "describe_rows", lambda s, n: [("t", 0, "day", "date")])
    assert p.catalog_partition_flags(session, "lake.s.t") == ["day"]


# ------------------------------------------------------------- resolution


def test_resolve_first_non_empty_by_priority(spark):
    rows = [
        ("a", 1, "catalog", []),
        ("a", 2, "show_partitions", ["x", "X", "y"]),
        ("a", 3, "show_create", ["z"]),
        ("b", 2, "show_partitions", ["q"]),
        ("b", 1, "catalog", ["p"]),
        ("c", 1, "catalog", []),
        ("c", 2, "describe", None),
    ]
    df = spark.createDataFrame(rows, "table_name string, priority int, found_by string, cols array<string>")
    got = sorted(
        resolve_partition_columns(df).collect(), key=lambda r: (r.table_name, r.pos if r.pos is not None else 0)
    )
    assert [(r.table_name, r.found_by, r.pos, r.column_name) for r in got] == [
        ("a", "show_partitions", 1, "x"),
        ("a", "show_partitions", 2, "y"),
        ("b", "catalog", 1, "p"),
        ("c", None, None, None),
    ]
