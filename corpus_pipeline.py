"""From raw documents to token digests, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is
written as Parquet in the shared folder and read again as the next stage's
documents.  All but the last return the columns of ``documents``:

1. ``quality_classifier`` drops documents that score below 0.3,
2. ``exact_dedup`` keeps one of equal texts (the largest id),
3. ``minhash_near_dedup`` keeps one of each group of near duplicates (the
   smallest id),
4. ``mix_sources`` puts the documents in the order of the target mixture; it
   drops none, and files and rows are in that order,
5. ``bpe_encode_decode`` encodes every text and decodes it again; the order
   of the mixture, taken from the files of stage 4, is its column
   ``mix_position``.

In every stage a null text counts as empty, an empty table gives an empty one,
and extra columns pass through stages 1 to 4 whatever their names.  Ties and
repeated rows: stage 1 decides each row by its text, so equal rows go or stay
together.  Stage 2 keeps one row of those with the largest id; an id comes before
none.  Stage 3 drops by id: of rows that share an id all go or all stay, and rows
without an id stay.  Stages 4 and 5 keep every row; rows that share an id, or have
none, get places of their own.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferry.llm.bpe import encode_decode
from ferry.llm.exactdup import drop_exact_duplicates
from ferry.llm.mixing import mix
from ferry.llm.neardup import near_duplicates
from ferry.llm.quality import drop_low_quality
from ferry.llm.queries import MIX_TARGETS, token_digests, tokenizer_path
from ferry.llm.shared import saved, without


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_low_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_exact_duplicates(docs)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    marks = near_duplicates(docs)
    return without(docs, "doc_id", marks.where("not kept").selectExpr("doc_id AS id"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])  # no name of the documents meets one of the mixture
    mixed = mix(plain, MIX_TARGETS, id_col=f"c{names.index('doc_id')}", source_col=f"c{names.index('source')}")
    return mixed.repartitionByRange("mix_position").sortWithinPartitions("mix_position").select(plain.columns).toDF(*names)


def bpe_encode_decode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    placed = in_file_order(docs)
    coded = encode_decode(placed, tokenizer_path(), id_col="mix_position")
    digests = token_digests(coded.withColumnRenamed("mix_position", "doc_id")).withColumnRenamed("doc_id", "mix_position")
    ids = placed.select("mix_position", "doc_id")
    return ids.join(digests, "mix_position").select("doc_id", *digests.columns[1:], "mix_position")


def in_file_order(docs: DataFrame) -> DataFrame:
    """doc_id and text of ``docs`` with ``mix_position``, the number (from 0) of
    each row in its files: files by name, rows as they stand.  Rows that are read
    from no file are written first."""

    def with_place(rows: DataFrame) -> DataFrame:
        place = rows.metadataColumn("_metadata")  # also where a column has that name
        return rows.select("doc_id", "text", place["file_name"].alias("_file"), place["row_index"].alias("_row"))

    try:
        rows = with_place(docs)
    except AnalysisException:
        rows = with_place(saved(docs.select("doc_id", "text"), "ordered"))
    start, offsets = 0, []
    for r in rows.groupBy("_file").count().orderBy("_file").collect():  # a row per file
        offsets.append((r["_file"], start))
        start += r["count"]
    # As an Arrow table: plain rows would go through Python workers of their own on the executors.
    names, at = zip(*offsets) if offsets else ((), ())
    table = pa.table({"_file": pa.array(names, pa.string()), "_start": pa.array(at, pa.int64())})
    starts = docs.sparkSession.createDataFrame(table)
    return rows.join(F.broadcast(starts), "_file").select("doc_id", "text", (F.col("_start") + F.col("_row")).alias("mix_position"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_classifier),
    ("exact_dedup", exact_dedup),
    ("minhash_near_dedup", minhash_near_dedup),
    ("mix_sources", mix_sources),
    ("bpe_encode_decode", bpe_encode_decode),
]

#: A trained classifier cannot be expressed in SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), name)
    return docs
