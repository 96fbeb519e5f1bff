"""Periodic runs of words, by seeds and diagonals.

A run is a maximal stretch of words that repeats with its smallest period
``q`` and is long enough: ``max(least_words, 3 * q)`` words.  On the diagonal of
lag ``q`` (word ``i`` against word ``i + q``) it is a stretch of matches of at
least ``length - q`` words, the overlap that is guaranteed.

Lags are taken in classes ``(D, 2 D]``.  A run with a period of the class
matches over ``2 D`` words or more, so every k-gram of ``k = 2 D`` words is
indexed, and the occurrences of one k-gram within the document are paired:

* Occurrences at most ``D`` apart mean a k-gram with a period of its own of at
  most ``k / 2``.  Those are passed over: if all k-grams of a stretch were such,
  neighbours (they share ``k - 1`` words) would have the same period, so would
  the run, and ``q`` would not be its smallest.
* The occurrences of any other k-gram are more than ``D`` apart, so within
  ``2 D`` there is one at most: each is paired with the next occurrence alone.
  Pairs grow with the words, not with the square of a k-gram's occurrences.

So each run has a pair, and the lag of a pair is the smallest period of any run
that holds it.  Every pair is extended along its diagonal to both sides; a table
of the furthest word covered per lag passes over pairs within an extension.

K-grams are numbered by doubling (a 2k-gram is a pair of k-grams), so equal
numbers mean equal words.  A document without a repeated k-gram ends there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST_WORDS, LEAST_POWER = 24, 3
#: The guaranteed overlap of periods up to half as many words, see ``periodic_runs``.
SEED = 16
#: Bytes of a text that are split into words at a time.
PIECE_BYTES = 1 << 20

_SCHEMA = "id {id_type}, words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def numbered_words(text: bytes) -> tuple[np.ndarray, list[bytes]]:
    """(number of each word, the distinct words): words are maximal runs of
    bytes other than 0x20 and 0x09-0x0D.  Splits a long text in pieces."""
    numbers: dict[bytes, int] = {}
    parts, at = [], 0
    while at < len(text):
        end = at + PIECE_BYTES
        while end < len(text) and not text[end - 1 : end].isspace():
            end += 1
        parts.append(np.fromiter((numbers.setdefault(w, len(numbers)) for w in text[at:end].split()), dtype=np.int64))
        at = end
    return np.concatenate(parts) if parts else np.zeros(0, np.int64), list(numbers)


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Numbers of the pairs (a[i], b[i]); equal pairs have equal numbers."""
    return np.unique(a * (int(b.max()) + 1) + b, return_inverse=True)[1]


def _next_equal(grams: np.ndarray) -> np.ndarray:
    """Distance to the next equal entry, 0 if none."""
    order = np.argsort(grams, kind="stable")
    same = grams[order[1:]] == grams[order[:-1]]
    away = np.zeros(len(grams), np.int64)
    away[order[:-1][same]] = (order[1:] - order[:-1])[same]
    return away


def _matching(words: np.ndarray, at: int, lag: int, step: int) -> int:
    """How many words from ``at`` on (backwards if ``step`` is -1) equal those ``lag`` further."""
    room = len(words) - lag - at if step > 0 else at + 1
    done, size = 0, 64
    while done < room:
        size = min(2 * size, room - done)
        lo = at + done if step > 0 else at - done - size + 1
        differ = np.flatnonzero(words[lo : lo + size] != words[lo + lag : lo + lag + size])
        if len(differ):
            return done + int(differ[0] if step > 0 else size - 1 - differ[-1])
        done += size
    return done


def runs_of(words: np.ndarray, least_words: int = LEAST_WORDS, least_power: int = LEAST_POWER) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of a sequence of word numbers, by
    start, then period.  See the module's text for why none is missed."""
    found: list[tuple[int, int, int]] = []
    if len(words) < least_words:
        return found
    grams, k = words.astype(np.int64), 1
    while k < SEED:
        grams, k = _joined(grams[: len(grams) - k], grams[k:]), 2 * k
    low = 0  # the first class takes the lags from 1 to SEED
    while len(grams) > 1:
        away = _next_equal(grams)
        if not away.any():
            break
        seeds = np.flatnonzero((away > low) & (away <= k))
        if len(seeds):
            lags = away[seeds]
            order = np.lexsort((seeds, lags))
            seeds, lags = seeds[order], lags[order]
            # Seeds side by side on one diagonal are one seed.
            first = np.ones(len(seeds), dtype=bool)
            first[1:] = (seeds[1:] != seeds[:-1] + 1) | (lags[1:] != lags[:-1])
            covered: dict[int, int] = {}
            for i, lag in zip(seeds[first].tolist(), lags[first].tolist()):
                if i < covered.get(lag, 0):
                    continue
                end = i + k + _matching(words, i + k, lag, 1)
                start = i - _matching(words, i - 1, lag, -1)
                covered[lag] = end
                length = end - start + lag
                if length >= max(least_words, least_power * lag):
                    found.append((start, length, lag))
        low = k
        if least_power * (low + 1) > len(words) or len(grams) <= k:
            break
        grams, k = _joined(grams[: len(grams) - k], grams[k:]), 2 * k
    return sorted(found, key=lambda r: (r[0], r[2]))


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """False for the words that a run has after its first period."""
    edge = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return np.cumsum(edge[:n]) == 0


def planted(doc_id: int | None, words: np.ndarray) -> np.ndarray:
    """The words of a document, in one of ten documents with a repeating tail:
    with h = crc32 of the decimal id and g = h // 10, every word i >= a of a
    document with h % 10 = 0 becomes word a + (i - a) % p, where a = g % n and
    p = 1 + (n - a) // (3 + g % 8).  A null id changes nothing."""
    n, h = len(words), crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return np.concatenate([words[:a], words[a + np.arange(n - a) % p]])


def _finder(rewrite: Callable[[object, np.ndarray], np.ndarray] | None, least_words: int, least_power: int):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).cast(pa.large_binary())
            at = 0
            while at < len(ids):  # as many texts at a time as a piece holds
                counts, lists, collapsed, size = [], [], [], 0
                for doc, text in zip(ids.slice(at), texts.slice(at)):
                    own, names = numbered_words(text.as_py() or b"")
                    if rewrite is not None:
                        own = rewrite(doc.as_py(), own)
                    runs = runs_of(own, least_words, least_power)
                    left = own[kept_words(len(own), runs)] if runs else own
                    counts.append(len(own))
                    lists.append([dict(zip(("start", "length", "period"), r)) for r in runs])
                    collapsed.append(b" ".join([names[w] for w in left.tolist()]))
                    size += len(collapsed[-1])
                    if size > PIECE_BYTES:
                        break
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(at, len(counts)), pa.array(counts, pa.int64()), pa.array(lists, pa.list_(_RUN)), pa.array(collapsed, pa.large_binary()).cast(pa.large_string()).cast(pa.string())],
                    names=["id", "words", "runs", "collapsed"],
                )
                at += len(counts)

    return find


def periodic_runs(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    least_words: int = LEAST_WORDS,
    least_power: int = LEAST_POWER,
    rewrite: Callable[[object, np.ndarray], np.ndarray] | None = None,
) -> DataFrame:
    """One row per row of ``docs``: id, words (long), runs (array of start,
    length, period, by start, then period), collapsed (the words that no run
    has after its first period, joined by one space).

    A run has ``max(least_words, least_power * period)`` words or more, counted
    from word 0; ``least_power`` is 3 or more and ``least_words`` 24 or more, so
    that a period up to 8 overlaps by the 16 words of a seed.  Words are compared
    byte by byte.  ``rewrite(id, word numbers)`` may change a document's words first.

    Null, empty and white-space texts have no words, no runs and an empty
    collapsed text.  Rows that share an id, or have none, are searched each by
    itself and returned each.  Other columns are ignored, whatever their names;
    an empty table gives no rows.  A document is searched in one task, in memory
    that grows with its words; nothing is shuffled.
    """
    if least_words < LEAST_WORDS or least_power < LEAST_POWER:
        raise ValueError(f"runs have {LEAST_WORDS} words and {LEAST_POWER} periods at least")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = _SCHEMA.format(id_type=rows.schema["id"].dataType.simpleString())
    return rows.mapInArrow(_finder(rewrite, least_words, least_power), schema).withColumnRenamed("id", id_col)


def strongest(runs: Column | str) -> Column:
    """The run with the greatest length / period (compared exactly); of ties
    that of the smallest start, then period.  Null if there is none."""

    def order(x: Column, y: Column) -> Column:
        a, b = x["length"] * y["period"], y["length"] * x["period"]
        first = (a > b) | ((a == b) & ((x["start"] < y["start"]) | ((x["start"] == y["start"]) & (x["period"] < y["period"]))))
        equal = (a == b) & (x["start"] == y["start"]) & (x["period"] == y["period"])
        return F.when(first, -1).when(equal, 0).otherwise(1)

    return F.try_element_at(F.array_sort(runs, order), F.lit(1))
