"""Quality classifier: random-indexing word vectors pooled per document, then
a two-layer numpy network with temperature-calibrated probabilities.

Every word falls in one of ``BUCKETS`` buckets by its hash and has one of
``SHAPES`` shapes (capitals, runs of signs, the word before again, ...).
Bucket and shape have fixed random index vectors of a few +1/-1 entries.  A
word's vector is the sum of its neighbours' index vectors over all documents
of the corpus; the sums have a fixed size whatever the corpus, and each task
sends its own once.  A document is the mean of its words' unit vectors beside
the shares of its shapes.

The network is fitted on the driver on at most ``SAMPLE`` labelled documents
(those of the smallest id hashes); a fifth of them sets the temperature.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferry.llm.shared import bounded_batches
from ferry.llm.words import BLOCK_BYTES, LOWER, blocks, span_hashes, spans, utf8

BUCKETS, DIM, ENTRIES = 1 << 13, 32, 2
WINDOW = 2
#: Labelled documents that the network is fitted on, at most.
SAMPLE = 12_000
HIDDEN, EPOCHS = 24, 300

_SIGN = np.zeros(256, dtype=np.int32)
_SIGN[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 1
_UPPER = np.zeros(256, dtype=np.int32)
_UPPER[65:91] = 1
_SMALL = np.zeros(256, dtype=np.int32)
_SMALL[97:123] = 1
_DIGIT = np.zeros(256, dtype=np.int32)
_DIGIT[48:58] = 1
SHAPES = 10
PLAIN, TITLE, CAPITALS, STOPPED, SIGNED, SIGNS, NUMBER, AGAIN, HUGE, BREAK = range(SHAPES)

_RNG = np.random.default_rng(4711)
_PLACE = _RNG.integers(0, DIM, (BUCKETS + SHAPES, ENTRIES))
_VALUE = _RNG.choice([-1.0, 1.0], (BUCKETS + SHAPES, ENTRIES))


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, shape, index of each row's first word plus the total)."""
    lower = LOWER[data]
    starts, ends = spans(lower, offsets)
    hashes = span_hashes(lower, starts, ends)
    first = np.searchsorted(starts, offsets)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), first

    def count(table: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(table[data])])
        return total[ends] - total[starts]

    size, signs, upper, digits = ends - starts, count(_SIGN), count(_UPPER), count(_DIGIT)
    small = size - signs - upper - digits  # letters beyond ASCII included
    shape = np.full(len(starts), PLAIN)
    shape[(upper >= 1) & (small >= 1)] = TITLE
    shape[(upper >= 2) & (count(_SMALL) == 0)] = CAPITALS
    shape[(signs == 1) & (shape == PLAIN)] = STOPPED
    shape[signs >= 2] = SIGNED
    shape[(signs > 0) & (signs == size)] = SIGNS
    shape[digits * 2 > size] = NUMBER
    shape[size > 40] = HUGE
    again = np.zeros(len(starts), dtype=bool)
    again[1:] = hashes[1:] == hashes[:-1]
    again[first[:-1][first[:-1] < len(starts)]] = False
    shape[again] = AGAIN
    return (hashes % np.uint64(BUCKETS)).astype(np.int64), shape, first


def _blocks(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    data, offsets = utf8(column)
    for a, b in blocks(offsets, BLOCK_BYTES):
        own = offsets[a : b + 1] - offsets[a]
        yield a, *_tokens(data[offsets[a] : offsets[b]], own)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's sums of index vectors, a row per bucket or shape that occurs."""
    sums = np.zeros((BUCKETS + SHAPES) * DIM)
    for batch in batches:
        for _, bucket, shape, first in _blocks(batch.column(0)):
            row = np.repeat(np.arange(len(first) - 1), np.diff(first))
            for step in range(1, WINDOW + 1):
                if len(bucket) <= step:
                    continue
                near = row[step:] == row[:-step]
                left, right = np.flatnonzero(near), np.flatnonzero(near) + step
                for here, there in ((left, right), (right, left)):
                    for context in (bucket[there], shape[there] + BUCKETS):
                        for e in range(ENTRIES):
                            place, value = _PLACE[context, e], _VALUE[context, e]
                            for target in (bucket[here], shape[here] + BUCKETS):
                                sums += np.bincount(target * DIM + place, weights=value, minlength=len(sums))
    table = sums.reshape(-1, DIM)
    used = np.flatnonzero(np.abs(table).sum(axis=1))
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(list(table[used]), pa.list_(pa.float64()))], names=["token", "vector"])


def word_vectors(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Unit vectors of all buckets and shapes, from all of ``docs``.

    The driver receives (BUCKETS + SHAPES) rows of DIM numbers at most.
    """
    parts = docs.select(F.col(text_col).alias("text")).mapInArrow(_summed, "token long, vector array<double>")
    cells = [F.sum(F.col("vector")[k]).alias(f"v{k}") for k in range(DIM)]
    out = np.zeros((BUCKETS + SHAPES, DIM))
    for r in parts.groupBy("token").agg(*cells).collect():
        out[r[0]] = r[1:]
    size = np.linalg.norm(out, axis=1, keepdims=True)
    return (out / np.where(size > 0, size, 1)).astype(np.float32)


def _pooled(column: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """Per row: mean word vector, mean shape vector, shares of the shapes, 1 if without words."""
    out = np.zeros((len(column), 2 * DIM + SHAPES + 1), dtype=np.float32)
    for at, bucket, shape, first in _blocks(column):
        n = len(first) - 1
        counts = np.diff(first)
        full = np.flatnonzero(counts)
        if len(full):
            starts = first[:-1][full]
            own = out[at : at + n]
            own[full, :DIM] = np.add.reduceat(vectors[bucket], starts, axis=0) / counts[full, None]
            shares = np.bincount(np.repeat(np.arange(n), counts) * SHAPES + shape, minlength=n * SHAPES).reshape(n, SHAPES)
            shares = shares[full] / counts[full, None]
            own[full, DIM : 2 * DIM] = shares @ vectors[BUCKETS:]
            own[full, 2 * DIM : -1] = shares
        out[at + np.flatnonzero(counts == 0), -1] = 1
    return out


@dataclass
class Network:
    """Two layers over standardised features; ``temperature`` divides the logit."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        hidden = np.maximum((x - self.mean) / self.scale @ self.w1 + self.b1, 0)
        return hidden @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def fit_network(x: np.ndarray, y: np.ndarray, seed: int = 5) -> Network:
    """Adam on the log loss; the temperature is the one of least log
    loss on a held-back fifth.  Without labels of both kinds, scores are the
    share of label 1 (0.5 without any label)."""
    rng = np.random.default_rng(seed)
    d = x.shape[1]
    net = Network(x.mean(axis=0) if len(x) else np.zeros(d), (x.std(axis=0) if len(x) else np.ones(d)) + 0.05, rng.normal(0, d**-0.5, (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), 0.0)
    if len(set(y.tolist())) < 2:
        share = float(y.mean()) if len(y) else 0.5
        net.w2[:] = 0
        net.b2 = float(np.clip(np.log((share + 1e-6) / (1 - share + 1e-6)), -8, 8))
        return net
    order = rng.permutation(len(x))
    held, used = order[: len(x) // 5], order[len(x) // 5 :]
    if len(set(y[used].tolist())) < 2 or not len(held):
        held = used = order
    z, t = (x[used] - net.mean) / net.scale, y[used]
    names = ("w1", "b1", "w2", "b2")
    first, second = ({n: 0.0 for n in names} for _ in range(2))
    for step in range(1, EPOCHS + 1):
        pre = z @ net.w1 + net.b1
        hidden = np.maximum(pre, 0)
        error = (1 / (1 + np.exp(-np.clip(hidden @ net.w2 + net.b2, -30, 30))) - t) / len(t)
        back = np.outer(error, net.w2) * (pre > 0)
        grads = {"w1": z.T @ back + 1e-4 * net.w1, "b1": back.sum(axis=0), "w2": hidden.T @ error + 1e-4 * net.w2, "b2": error.sum()}
        for n in names:
            first[n] = 0.9 * first[n] + 0.1 * grads[n]
            second[n] = 0.999 * second[n] + 0.001 * grads[n] ** 2
            move = first[n] / (1 - 0.9**step) / (np.sqrt(second[n] / (1 - 0.999**step)) + 1e-8)
            setattr(net, n, getattr(net, n) - 0.01 * move)
    raw, t = net.logits(x[held]), y[held]
    grid = np.geomspace(0.25, 8, 41)
    loss = [np.mean(np.logaddexp(0, np.where(t == 1, -raw, raw) / k)) for k in grid]
    net.temperature = float(grid[int(np.argmin(loss))])
    return net


def held_out(id_column: Column) -> Column:
    """Whether labels of the row may not be learned: crc32 of the id as text is a multiple of 5."""
    return F.coalesce(F.pmod(F.crc32(id_column.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, limit: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(text, label) of at most ``limit`` labelled documents outside the held-out fold.

    The labels' ids (at most ``limit`` of them, by hash) are broadcast, so the
    texts stay where they are.
    """
    own = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("double").alias("label"))
    own = own.where(F.col("_id").isNotNull() & F.col("label").isNotNull() & ~held_out(F.col("_id"))).groupBy("_id").agg(F.max("label").alias("label"))
    own = own.orderBy(F.xxhash64("_id"), "_id").limit(limit)
    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(F.broadcast(own), "_id").select("text", "label")


def fitted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[np.ndarray, Network]:
    """Word vectors from all of ``docs`` and the network fitted on labelled rows."""
    bounded_batches(docs.sparkSession)
    vectors = word_vectors(docs, text_col)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(list(_pooled(b.column(0), vectors)), pa.list_(pa.float32()))], names=["label", "x"])

    sample = labelled_sample(docs, labels, "quality", SAMPLE, id_col, text_col).mapInArrow(features, "label double, x array<float>").toArrow().combine_chunks()
    x = np.array(sample["x"].combine_chunks().flatten(), dtype=np.float64).reshape(len(sample), 2 * DIM + SHAPES + 1)
    order = np.lexsort(x.T)  # the fit must not depend on the order of rows
    return vectors, fit_network(x[order], np.array(sample["label"].combine_chunks(), dtype=np.float64)[order])


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.3) -> DataFrame:
    """(id, held_out, score, predicted) per row of ``docs``: score in 0..1 for
    ``labels.quality`` = 1, predicted 1 if it is ``least`` or more.

    Null texts are empty; an empty text has a score like any other.  Repeated
    rows score alike; a null id is not held out and has no label.  Only the
    text is scored: labels, ids and other columns are never inputs.
    """
    vectors, net = fitted(docs, labels, id_col, text_col)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores = net.scores(_pooled(b.column(1), vectors).astype(np.float64))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(scores, pa.float64()), pa.array((scores >= least).astype(np.int32))], names=["id", "held_out", "score", "predicted"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), held_out(F.col(id_col)).alias("held_out"))
    return rows.mapInArrow(score, "id long, held_out boolean, score double, predicted int").withColumnRenamed("id", id_col)


def drop_low_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that score ``least`` or more, with their columns.

    Rows are scored and kept or dropped where they are read; no text is shuffled.
    """
    vectors, net = fitted(docs, labels, id_col, text_col)
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    text = names.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(net.scores(_pooled(b.column(text), vectors).astype(np.float64)) >= least, pa.bool_()))

    return plain.mapInArrow(keep, plain.schema).toDF(*names)
