"""Helpers that several operators use: the shared folder, written tables,
bounded batches, sorted runs, bounded sets of ids."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, a local session gets a temporary folder (there is one
    machine only) and any other session a folder below the warehouse.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if spark.sparkContext.master.startswith(("local[", "local")) and "cluster" not in spark.sparkContext.master:
            found = tempfile.mkdtemp(prefix="run-", dir="/tmp")
        else:
            found = os.path.join(spark.conf.get("spark.sql.warehouse.dir"), "_shared")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` as Parquet (with the writer's ``options``) in the shared folder and read it back.

    Cuts the lineage: a lost executor costs a re-read of its part, not the
    job that made the table.
    """
    spark, path = df.sparkSession, fresh_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of an Arrow batch that a task hands to its Python worker (one row at least).
BATCH_BYTES = "4m"


def bounded_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by their bytes; Spark alone bounds their rows, whatever
    the texts' length.  A session that has a bound of its own keeps it.

    A batch is held several times over: as vectors and as a message outside the
    heap of the executor, and in the worker.
    """
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The runs of equal ``keys`` of a partition sorted by them.

    Holds one run (and a batch) at a time; callers bound the size of a run.
    """
    held: list[pa.RecordBatch] = []
    mark = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, dtype=bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            now = tuple(c[a] for c in cols)
            if held and now != mark:
                yield pa.Table.from_batches(held)
                held = []
            mark = now
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


ID_FILTER_BITS = 1 << 23


def id_filter(ids: DataFrame, column: str, bits: int = ID_FILTER_BITS) -> bytes:
    """A bit map of fixed size (1 MiB) in which every id of ``column`` is set.

    Bits are ``xxhash64(id) mod bits``.  Other ids may hit a set bit, so it
    only saves work and a join must follow; a full map saves none and loses
    nothing.  The driver gets at most ``bits`` bits whatever the input size.
    """
    place = F.pmod(F.xxhash64(F.col(column)), F.lit(bits))
    rows = (
        ids.select(place.alias("p"))
        .groupBy(F.bitmap_bucket_number(F.col("p") + 1).alias("b"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("p") + 1)).alias("m"))
        .collect()
    )
    out = bytearray(bits // 8)
    for r in rows:
        # Value p + 1 is bit p mod 32768 of bucket 1 + p // 32768.
        at = (r["b"] - 1) * 4096
        part = bytes(r["m"])[: len(out) - at]
        out[at : at + len(part)] = part
    return bytes(out)


def id_filter_column(column: str, bits: int = ID_FILTER_BITS) -> "F.Column":
    """The bit place of a row, to be looked up with ``in_filter``."""
    return F.pmod(F.xxhash64(F.col(column)), F.lit(bits))


def in_filter(places: np.ndarray, bitmap: bytes) -> np.ndarray:
    """Which places are set.  Within a byte, bit ``p mod 8`` counts from the low end."""
    body = np.frombuffer(bitmap, dtype=np.uint8)
    return (body[places >> 3] >> (places & 7).astype(np.uint8)) & 1 > 0


#: Ids up to which a list of rows to leave out is broadcast (1.6 MB); a longer one is joined by a shuffle.
BROADCAST_IDS = 100_000


def without(docs: DataFrame, id_col: str, dropped: DataFrame) -> DataFrame:
    """``docs`` without the rows whose id is in ``dropped(id)``; null ids stay."""
    dropped = saved(dropped.select(F.col("id").alias("_dropped_id")).distinct(), "dropped")
    side = F.broadcast(dropped) if dropped.count() <= BROADCAST_IDS else dropped
    return docs.join(side, docs[id_col] == side["_dropped_id"], "left_anti")
