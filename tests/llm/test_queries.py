from __future__ import annotations

import hashlib

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ferry.llm.mixing import mix
from ferry.llm.queries import MIX_TARGETS, ORACLE_SQL, QUERIES
from ferry.llm.shared import saved

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "pages"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = db.sql(ORACLE_SQL[name])
    got = QUERIES[name](spark, SF).select(want.columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall()) and len(got) > 0


def test_pipeline_equals_its_stages_one_by_one(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    ids = [d["doc_id"] for d in docs.select("doc_id").collect()]
    seen = [set(ids)]
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        seen.append({r["doc_id"] for r in docs.select("doc_id").collect()})
        assert seen[-1] <= seen[-2]
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    assert seen[3] == seen[4] == seen[5]
    got = {tuple(r) for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == {tuple(r) for r in docs.collect()}


def test_packed_rows_are_written_and_digested_from_their_files(spark):
    made = QUERIES["op8_packed_tokens"](spark, SF)
    files = [f.removeprefix("file://").removeprefix("file:") for f in made.inputFiles()]
    assert files and all("/packed-" in f for f in files)
    want = {}
    for row in (r for f in files for r in pq.ParquetFile(f).read().to_pylist()):
        ids, places, ends = np.frombuffer(row["ids"], "<u4"), np.frombuffer(row["position_ids"], "<u2"), row["cu_seqlens"]
        assert len(ids) == len(places) and ends[0] == 0 and ends[-1] == row["n_tokens"] <= len(ids)
        assert all(places[a:b].tolist() == list(range(b - a)) for a, b in zip(ends, ends[1:]))
        want[row["window"], row["row"]] = tuple(hashlib.sha256(row[c]).hexdigest() for c in ("ids", "position_ids"))
    got = {(r["window"], r["row"]): (r["ids_sha256"], r["position_ids_sha256"]) for r in made.collect()}
    assert got == want and len(got) > 0


def test_mixed_documents_are_written_whole_and_in_order(spark):
    made = QUERIES["op7_mix_sources"](spark, SF)
    files = sorted(f.removeprefix("file://").removeprefix("file:") for f in made.inputFiles())
    assert files and all("/mixed-" in f for f in files)
    rows = [r for f in files for r in pq.ParquetFile(f).read().to_pylist()]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [r["mix_position"] for r in rows] == list(range(docs.count()))
    assert sorted(tuple(r[c] for c in docs.columns) for r in rows) == sorted(map(tuple, docs.collect()))
    assert sorted(tuple(r[c] for c in made.columns) for r in rows) == sorted(map(tuple, made.collect()))


def test_last_stage_keeps_the_order_of_the_mixture(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        mixed = saved(corpus_pipeline.mix_sources(spark, docs, SF), "mixed")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(mixed.inputFiles()) > 1
    want = {r["doc_id"]: r["mix_position"] for r in mix(docs, MIX_TARGETS).collect()}
    for frame in (mixed, spark.createDataFrame([r for f in sorted(mixed.inputFiles()) for r in spark.read.parquet(f).collect()], docs.schema)):
        got = {r["doc_id"]: r["mix_position"] for r in corpus_pipeline.bpe_encode_decode(spark, frame, SF).collect()}
        assert got == want
    assert corpus_pipeline.bpe_encode_decode(spark, mixed.limit(0), SF).collect() == []


CLASHING = "mix_class mix_block mix_slot mix_position _metadata _file _row _start _d _order _bucket _i _nth number before _dropped_id id doc rep key band bands _id _len _prefix _full _group _keep _same _size _n _map _bucket2 c0 c1 score predicted held_out kept component_id quality toxic place n_chars2".split()


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_of_odd_and_empty_tables_with_clashing_columns(spark, stage):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = docs.limit(40).union(docs.limit(3)).union(spark.createDataFrame([(None, None, None, None, None), (None, "", "en", "src0", 0), (None, "", "en", "src0", 0), (7, " ", None, None, 1), (7, None, None, None, 1)], docs.schema))
    wide = odd.select("*", *[F.lit(k).alias(c) for k, c in enumerate(CLASHING)])
    step = dict(corpus_pipeline.STAGES)[stage]
    made = saved(step(spark, saved(wide, "wide"), SF), "clash")
    plain = saved(step(spark, saved(odd, "plain"), SF), "noclash")
    if stage == "bpe_encode_decode":
        assert made.columns == plain.columns and made.count() == odd.count()
        assert sorted(r["mix_position"] for r in made.collect()) == list(range(odd.count()))
    else:
        assert made.columns == wide.columns and plain.columns == odd.columns
        assert all(r[c] == k for r in made.collect() for k, c in enumerate(CLASHING))
        assert sorted(map(str, made.select(odd.columns).collect())) == sorted(map(str, plain.collect()))
    assert step(spark, saved(wide.limit(0), "none"), SF).collect() == []


def test_mixture_refuses_columns_with_its_names(spark):
    with pytest.raises(ValueError, match="mix_Slot"):
        mix(spark.createDataFrame([(1, "a", 2)], "doc_id long, source string, mix_Slot int"), {"a": 1})


def test_places_of_files_pass_no_python_worker(spark):
    placed = corpus_pipeline.in_file_order(spark.read.parquet(f"{SF}/documents.parquet"))
    plan = placed._jdf.queryExecution().executedPlan().toString()
    assert "LocalTableScan" in plan and "ExistingRDD" not in plan
