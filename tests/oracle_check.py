"""Run every registered query and its DuckDB oracle side by side.

Usage: ``python tests/oracle_check.py [sf_dir] [query ...]``

Mirrors the correctness gate: same column names (order-free), same row
count, same multiset of rows.  Prints one line per query and exits 1 if any
differs.
"""

from __future__ import annotations

import datetime
import decimal
import os
import sys
import tempfile
import time
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def norm(v):
    if isinstance(v, float):
        return float(f"{v:.10g}")
    if isinstance(v, decimal.Decimal):
        return format(v.normalize(), "f")
    if isinstance(v, (datetime.datetime, datetime.date)):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if hasattr(v, "tolist"):
        return norm(v.tolist())
    return v


# Spark simple type names and the DuckDB names they correspond to.
DUCK_TYPES = {
    "int": "INTEGER",
    "bigint": "BIGINT",
    "string": "VARCHAR",
    "double": "DOUBLE",
    "float": "FLOAT",
    "boolean": "BOOLEAN",
    "date": "DATE",
    "timestamp_ntz": "TIMESTAMP",
    "array<float>": "FLOAT[]",
}


def type_differences(df, rel) -> list[tuple[str, str, str]]:
    duck = dict(zip(rel.columns, [str(t) for t in rel.types]))
    out = []
    for f in df.schema.fields:
        spark_type = f.dataType.simpleString()
        if DUCK_TYPES.get(spark_type, spark_type.upper()) != duck.get(f.name):
            out.append((f.name, spark_type, duck.get(f.name)))
    return out


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return Counter(tuple(norm(r[i]) for i in order) for r in rows)


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    only = set(argv[2:])
    import duckdb
    from pyspark.sql import SparkSession

    import __spark_entry__ as E

    scratch = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", os.path.join(scratch, "warehouse"))
        .config("spark.checkpoint.dir", os.path.join(scratch, "checkpoints"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    oracles = E.oracle_sql()
    bad = 0
    for name, fn in E.queries().items():
        if only and name not in only:
            continue
        t0 = time.time()
        try:
            df = fn(spark, sf_dir)
            s_cols = df.columns
            s_rows = df.collect()
        except Exception as e:  # report and go on
            print(f"FAIL {name}: spark error {type(e).__name__}: {e}")
            bad += 1
            continue
        dt = time.time() - t0
        if name not in oracles:
            print(f"ROWS {name}: {len(s_rows)} rows ({dt:.1f}s), no oracle")
            continue
        rel = con.sql(oracles[name])
        d_cols = [c for c in rel.columns]
        d_rows = rel.fetchall()
        problems = []
        if sorted(s_cols) != sorted(d_cols):
            problems.append(f"columns spark={sorted(s_cols)} duck={sorted(d_cols)}")
        elif type_differences(df, rel):
            problems.append(f"types {type_differences(df, rel)}")
        if len(s_rows) != len(d_rows):
            problems.append(f"rows spark={len(s_rows)} duck={len(d_rows)}")
        if not problems:
            a, b = rows_of(s_cols, s_rows), rows_of(d_cols, d_rows)
            if a != b:
                only_s = list((a - b).items())[:3]
                only_d = list((b - a).items())[:3]
                problems.append(f"values differ: spark-only {only_s} duck-only {only_d}")
        if problems:
            bad += 1
            print(f"FAIL {name} ({dt:.1f}s): " + "; ".join(problems))
        else:
            print(f"OK   {name}: {len(s_rows)} rows ({dt:.1f}s)")
    spark.stop()
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))
