"""Token-id output: best-fit-decreasing packing of encoded documents.

Documents are encoded where they are read and packed in windows of a bounded
number of tokens, so nothing is shuffled and a lost executor costs its tasks
only.  In a window, documents longer than a row are split into full rows and
a rest, losslessly; the pieces, longest first, go each to the fullest row that
still takes them.  Free room is searched in a segment tree over capacities:
leaf ``c`` counts the open rows with ``c`` free places, and a descent finds the
smallest sufficient one in log(row length) steps.

A packed row is a fixed-length run of ids (the rest padded), the cumulative
lengths of its segments and, from these, positions that start anew in each.
``packed_files`` writes the rows to the shared folder, as files that a trainer
reads without this package.
"""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferry.llm.bpe import opened, shipped_lexicon, text_chunks
from ferry.llm.shared import bounded_batches, saved

ROW_TOKENS = 2048
#: Tokens of a window that is packed on its own.
WINDOW_TOKENS = 1 << 20
#: Id that fills the unused end of a row (the tokenizer's end of text).
PAD = 49407
#: Binary forms, little-endian.
TOKEN, POSITION = "<u4", "<u2"


class CapacityTree:
    """How many open rows have each number of free places; finds the smallest
    number of at least ``need`` that some row has."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.rows: dict[int, list[int]] = {}

    def add(self, free: int, row: int) -> None:
        self.rows.setdefault(free, []).append(row)
        self._move(free, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """(free places, row) of a fullest row that takes ``need``, removed from the tree."""
        node = self.leaves + need
        if not self.count[node]:
            while node > 1 and (node & 1 or not self.count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if self.count[2 * node] else 2 * node + 1
        free = node - self.leaves
        self._move(free, -1)
        return free, self.rows[free].pop()

    def _move(self, free: int, by: int) -> None:
        node = self.leaves + free
        while node:
            self.count[node] += by
            node >>= 1


def best_fit_decreasing(sizes: list[int], capacity: int) -> list[list[int]]:
    """Rows of piece numbers; every size is from 1 to ``capacity``.  Equal
    sizes keep their order."""
    tree, rows = CapacityTree(capacity), []
    for piece in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        found = tree.take(sizes[piece])
        free, row = found if found else (capacity, len(rows))
        if not found:
            rows.append([])
        rows[row].append(piece)
        if free > sizes[piece]:
            tree.add(free - sizes[piece], row)
    return rows


def pack_window(docs: list[tuple[int | None, np.ndarray]], row_tokens: int = ROW_TOKENS, pad: int = PAD) -> Iterator[dict]:
    """Packed rows of a window of (id, token ids); documents without tokens
    take no place."""
    pieces = [(k, at) for k, (_, ids) in enumerate(docs) for at in range(0, len(ids), row_tokens)]
    sizes = [min(row_tokens, len(docs[k][1]) - at) for k, at in pieces]
    for row in best_fit_decreasing(sizes, row_tokens):
        matrix = np.full(row_tokens, pad, dtype=TOKEN)
        ends = np.cumsum([sizes[p] for p in row])
        for p, end in zip(row, ends):
            k, at = pieces[p]
            matrix[end - sizes[p] : end] = docs[k][1][at : at + sizes[p]]
        yield {
            "ids": matrix.tobytes(),
            "cu_seqlens": [0, *ends.tolist()],
            "doc_ids": [docs[pieces[p][0]][0] for p in row],
            "doc_offsets": [pieces[p][1] for p in row],
        }


def position_ids(cu_seqlens: list[int], row_tokens: int = ROW_TOKENS) -> np.ndarray:
    """Positions of a packed row: from 0 in each segment and in the padding."""
    ends = np.array([*cu_seqlens[1:], row_tokens])
    starts = np.array(cu_seqlens)
    return np.arange(row_tokens) - np.repeat(starts, ends - starts)


_FIELDS = [
    ("window", pa.string()),
    ("row", pa.int32()),
    ("n_tokens", pa.int32()),
    ("ids", pa.binary()),
    ("cu_seqlens", pa.list_(pa.int32())),
    ("position_ids", pa.binary()),
    ("doc_ids", pa.list_(pa.int64())),
    ("doc_offsets", pa.list_(pa.int64())),
]
_SCHEMA = "window string, row int, n_tokens int, ids binary, cu_seqlens array<int>, position_ids binary, doc_ids array<bigint>, doc_offsets array<bigint>"


def _packer(name: str, row_tokens: int, window_tokens: int, pad: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def packed(docs: list, number: int) -> pa.RecordBatch:
        from pyspark import TaskContext

        window = f"{TaskContext.get().partitionId()}-{number}"
        rows = [
            (window, r, x["cu_seqlens"][-1], x["ids"], x["cu_seqlens"], position_ids(x["cu_seqlens"], row_tokens).astype(POSITION).tobytes(), x["doc_ids"], x["doc_offsets"])
            for r, x in enumerate(pack_window(docs, row_tokens, pad))
        ]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), _FIELDS)], names=[n for n, _ in _FIELDS])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = opened(name)
        gc.disable()  # as in encode_decode: no cycles are made here
        held: list[tuple[int | None, np.ndarray]] = []
        tokens = number = 0
        for part, texts in text_chunks(batches):
            for doc, ids in zip(part.column(0).to_pylist(), lexicon.encode(texts)):
                if ids:
                    held.append((doc, np.frombuffer(ids, dtype=TOKEN)))
                    tokens += len(ids) // 4
                if tokens >= window_tokens:
                    yield packed(held, number)
                    held, tokens, number = [], 0, number + 1
        if held:
            yield packed(held, number)

    return pack


def packed_tokens(
    docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", row_tokens: int = ROW_TOKENS, window_tokens: int = WINDOW_TOKENS, pad: int = PAD
) -> DataFrame:
    """Packed rows: window, row, n_tokens (without padding), ids (``row_tokens``
    little-endian unsigned 32-bit integers), position_ids (as many 16-bit ones),
    cu_seqlens (0, ..., n_tokens), and per segment doc_ids and doc_offsets
    (first token of the segment in its document).

    Every token of every document is in one segment.  Null and empty texts
    have no tokens and no segment; repeated rows and null ids are packed like
    others; other columns are ignored.  Windows follow the input's partitions.
    """
    if not 1 <= row_tokens <= 1 << 16:
        raise ValueError("a row holds from 1 to 65,536 tokens")
    bounded_batches(docs.sparkSession)
    # One pass over the texts: without a lexicon of their frequent words each worker merges a word when it meets it.
    name = shipped_lexicon(docs.sparkSession, tokenizer_path, [])
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_packer(name, row_tokens, window_tokens, pad), _SCHEMA)


def packed_files(docs: DataFrame, tokenizer_path: str, **options) -> DataFrame:
    """The rows of ``packed_tokens`` (same options), written as Parquet files
    in the shared folder and read back: id matrices and positions as binary
    columns, cumulative segment lengths as integers."""
    return saved(packed_tokens(docs, tokenizer_path, **options), "packed")


def unpacked(rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, offset, ids) per segment of packed rows: the way back."""
    segment = F.explode(F.arrays_zip("doc_ids", "doc_offsets", F.slice("cu_seqlens", 1, F.size("doc_ids")).alias("a"), F.slice("cu_seqlens", 2, F.size("doc_ids")).alias("b")))
    return rows.select("ids", segment.alias("s")).select(
        F.col("s.doc_ids").alias(id_col), F.col("s.doc_offsets").alias("offset"), F.expr("substring(ids, s.a * 4 + 1, (s.b - s.a) * 4)").alias("ids")
    )
