"""Document fingerprints: threshold-scaled sketches.

A sketch keeps every hash of a text's 16-byte shingles (UTF-8, A-Z lowered)
below a fixed fraction of the hash range, so its size follows the text's and
the sketch of a union is the union of the sketches.  Short texts would keep
too few, so a sketch holds its ``FLOOR`` smallest hashes at least; its own
threshold is then the largest hash kept (or none, if the text has no more).
Two sketches are compared below the smaller of their thresholds, where both
are complete; this estimates containment even for very unequal texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ferry.llm.words import LOWER, mix

SHINGLE_BYTES = 16
FRACTION = 1 / 128
FLOOR = 32
_TOP = float(1 << 64)
_LIMIT = np.uint64(int(FRACTION * _TOP))
_ALL = np.uint64((1 << 64) - 1)
_C1, _C2 = np.uint64(0x9FB21C651E98DF25), np.uint64(0xD6E8FEB86659FD93)


def _hashes(raw: bytes) -> np.ndarray:
    low = LOWER[np.frombuffer(raw, dtype=np.uint8)]
    n = len(low)
    if n < SHINGLE_BYTES:  # the whole text is its only shingle
        low = np.concatenate([low, np.zeros(SHINGLE_BYTES - n, np.uint8)])
    eights = np.ndarray((len(low) - 7,), dtype="<u8", buffer=low, strides=(1,))
    return mix(mix(eights[:-8] * _C1) + eights[8:] * _C2 + np.uint64(min(n, SHINGLE_BYTES)))


def sketch(text: str) -> np.ndarray:
    """Sorted distinct hashes; empty for an empty text."""
    raw = text.encode("utf-8")
    if not raw:
        return np.zeros(0, np.uint64)
    h = _hashes(raw)
    share = max(FRACTION, 3 * FLOOR / len(h))
    if share < 0.5:
        near = np.unique(h[h < np.uint64(int(share * _TOP))])
        if len(near) >= FLOOR:
            return near[: max(FLOOR, int(np.searchsorted(near, _LIMIT)))]
    whole = np.unique(h)
    return whole[: max(FLOOR, int(np.searchsorted(whole, _LIMIT)))]


def _threshold(s: np.ndarray) -> np.uint64:
    if len(s) < FLOOR:
        return _ALL
    return max(_LIMIT, s[-1]) if len(s) == FLOOR else _LIMIT


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """Share of the smaller text's shingles that the larger one has too.

    1 for two empty sketches, 0 if only one has hashes to compare.
    """
    limit = min(_threshold(a), _threshold(b))
    a, b = a[: np.searchsorted(a, limit, "right")], b[: np.searchsorted(b, limit, "right")]
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    return len(np.intersect1d(a, b, assume_unique=True)) / min(len(a), len(b))


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of both texts together (shingles across the seam aside)."""
    whole = np.union1d(a, b)
    return whole[: max(FLOOR, int(np.searchsorted(whole, _LIMIT)))]


def as_text(s: np.ndarray) -> str:
    """The hashes as 16 hex digits each, ascending."""
    return s.astype(">u8").tobytes().hex()


def from_text(s: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(s), dtype=">u8").astype(np.uint64)


def edited(text: str, following: str) -> str:
    """``text`` with its last quarter replaced by the start of ``following``."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


COARSE = 128


def _bucket(column: Column, bounds: list[int]) -> Column:
    """How many of the sorted ``bounds`` are at most the value (two levels, so
    a row looks at COARSE + len / COARSE of them); one more for null."""
    if not bounds:
        return F.when(column.isNull(), F.lit(1)).otherwise(F.lit(0))
    coarse = F.lit(bounds[COARSE - 1 :: COARSE] or [bounds[-1] + 1])
    block = F.size(F.filter(coarse, lambda b: b <= column))
    fine = F.slice(F.lit(bounds), block * COARSE + 1, F.lit(COARSE))
    return F.when(column.isNull(), F.lit(len(bounds) + 1)).otherwise(block * COARSE + F.size(F.filter(fine, lambda b: b <= column)))


def _parts(spark: SparkSession) -> int:
    return max(1, min(16_384, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def with_successor(docs: DataFrame, function, schema: str, id_col: str, text_col: str) -> DataFrame:
    """Apply ``function`` to the rows of ``docs(id, text)`` in ascending id,
    dealt into ranges; each range is followed by a copy of the next range's
    first row (the last one by the very first), marked ``tail``.

    Texts are shuffled once; the bounds (at most 16,384 ids) come from the
    ids alone.  Null ids come last; rows of one id are in the order of their
    texts.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    parts = _parts(docs.sparkSession)
    cuts = rows.agg(F.percentile_approx("id", [i / parts for i in range(1, parts)] or [0.5], 100 * parts)).first()[0] or []
    bucket = _bucket(F.col("id"), sorted(set(cuts)))
    least = sorted((r["b"], r["id"]) for r in rows.groupBy(bucket.alias("b")).agg(F.min("id").alias("id")).collect())
    if not least:
        return docs.sparkSession.createDataFrame([], schema)
    before = [(i, least[k - 1][0]) for k, (_, i) in enumerate(least)]
    heads = docs.sparkSession.createDataFrame(before, "head long, before int")
    marked = rows.join(F.broadcast(heads), F.col("id").eqNullSafe(F.col("head")), "left")
    own = F.struct(bucket.cast("int").alias("bucket"), F.lit(False).alias("tail"))
    copy = F.when(F.col("before").isNotNull(), F.struct(F.col("before").alias("bucket"), F.lit(True).alias("tail")))
    dealt = marked.select("id", "text", F.explode(F.filter(F.array(own, copy), lambda x: x.isNotNull())).alias("at"))
    return (
        dealt.select("at.bucket", "at.tail", "id", "text")
        .repartitionByRange(parts, "bucket")
        .sortWithinPartitions("bucket", "tail", F.asc_nulls_last("id"), "text")
        .mapInArrow(function, schema)
    )


def _row(doc, text: str, own: np.ndarray, following: str, next_sketch: np.ndarray) -> tuple:
    after = edited(text, following)
    changed = sketch(after)
    digest = hashlib.sha256(after.encode("utf-8")).hexdigest()
    return doc, len(text), digest, as_text(own), as_text(changed), containment(own, changed), containment(own, next_sketch)


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = None  # the row before, which waits for its successor
    for batch in batches:
        out = []
        for tail, doc, text in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3))):
            if held is None and tail:
                continue  # a further row of the id that ended the range
            own = sketch(text)
            if held is not None:
                out.append(_row(*held, text, own))
            held = None if tail else (doc, text, own)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _TYPES)], names=_NAMES)


_NAMES = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint, n_chars, edited_sha256, edited_fingerprint,
    near_edited, near_next) per row of ``docs``, null texts as empty.

    The edited text has its last quarter replaced by the start of the next
    document, in ascending id, the first after the last (a single document
    follows itself).  Null ids are last.  Other columns are ignored; an empty
    table gives an empty result.
    """
    schema = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_successor(docs, _fingerprints, schema, id_col, text_col).withColumnRenamed("id", id_col)
