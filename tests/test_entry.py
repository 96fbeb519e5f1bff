"""The driver contract: entry(), queries() and their DuckDB oracles."""

from __future__ import annotations

import pytest

import __spark_entry__ as E
from tests.conftest import SMALL_SF
from tests.oracle_check import TABLES, rows_of, type_differences


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert sorted(df.columns) == ["l_linestatus", "l_returnflag", "row_count"]
    assert len(rows) == 6 and sum(r.row_count for r in rows) > 0


def test_every_query_has_an_oracle():
    assert set(E._ORACLE) == set(E._QUERIES) and set(E.oracle_sql()) <= set(E.queries())


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL_SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(E._QUERIES))
def test_query_matches_oracle(spark, duck, name):
    df = E.queries()[name](spark, SMALL_SF)
    s_rows = df.collect()
    rel = duck.sql(E.oracle_sql()[name])
    d_cols, d_rows = rel.columns, rel.fetchall()
    assert sorted(df.columns) == sorted(d_cols)
    assert type_differences(df, rel) == []
    assert len(s_rows) == len(d_rows)
    assert rows_of(df.columns, s_rows) == rows_of(d_cols, d_rows)
