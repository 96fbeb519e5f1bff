"""Word and shingle hashes of whole Arrow string columns, as numpy arrays.

A word is a maximal run of bytes outside 0x20 and 0x09-0x0D, lower-cased in
A-Z only; since UTF-8 continuation bytes are all above 0x7F, working on bytes
gives the same words as working on code points.  Null texts count as empty.

Everything runs on blocks of a bounded number of bytes, so a batch of long
texts, or one very long text, needs the memory of a block and of its word
hashes, never a Python object per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SHINGLE_WORDS = 5
BLOCK_BYTES = 1 << 19

_U = np.uint64
_BASE = 0x9E3779B97F4A7C55  # odd, so it has an inverse modulo 2**64
_BASE_INV = pow(_BASE, -1, 1 << 64)
_LANE = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=_U)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift and multiply, three rounds)."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(20, (n - 1).bit_length())
    if size not in _POWERS:
        up, down = np.full(size, _U(_BASE)), np.full(size, _U(_BASE_INV))
        up[0] = down[0] = 1
        made = np.multiply.accumulate(up), np.multiply.accumulate(down)
        if size > 1 << 20:
            return made  # one huge word; not worth keeping
        _POWERS[size] = made
    return _POWERS[size]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, where, body = column.buffers()
    offsets = np.frombuffer(where, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if where else np.zeros(1, np.int64)
    if not len(offsets):
        offsets = np.zeros(1, np.int64)
    data = np.frombuffer(body, dtype=np.uint8)[offsets[0] : offsets[-1]] if body else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def blocks(offsets: np.ndarray, size: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``size`` bytes each (one row at least)."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1
        last = min(n, max(first + 1, last))
        yield first, last
        first = last


def spans(lower: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a block; no word crosses a row."""
    n = len(lower)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~SPACE[lower]
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    edge = offsets[(offsets > 0) & (offsets < n)]
    opens[edge] = inside[edge]
    closes[edge - 1] = inside[edge - 1]
    return np.flatnonzero(opens), np.flatnonzero(closes) + 1


def span_hashes(lower: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, from one running polynomial sum."""
    if not len(starts):
        return np.zeros(0, _U)
    up, down = _powers(len(lower))
    total = np.empty(len(lower) + 1, dtype=_U)
    total[0] = 0
    np.cumsum((lower.astype(_U) + _U(1)) * up[: len(lower)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(_U) * _LANE[0])


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, index of each row's first word plus the total).

    Rows longer than a block are hashed in pieces cut at white space.
    """
    if len(offsets) == 2 and len(data) > 2 * BLOCK_BYTES:
        parts, at = [], 0
        while at < len(data):
            end = min(len(data), at + BLOCK_BYTES)
            if end < len(data):
                gaps = np.flatnonzero(SPACE[data[at:end]])
                if len(gaps):
                    end = at + int(gaps[-1]) + 1
                else:  # a word longer than a block: take all of it
                    while end < len(data) and not SPACE[data[end]]:
                        nxt = np.flatnonzero(SPACE[data[end : end + BLOCK_BYTES]])
                        end = end + int(nxt[0]) if len(nxt) else min(len(data), end + BLOCK_BYTES)
            piece = LOWER[data[at:end]]
            parts.append(span_hashes(piece, *spans(piece, np.array([0, len(piece)]))))
            at = end
        words = np.concatenate(parts)
        return words, np.array([0, len(words)])
    lower = LOWER[data]
    starts, ends = spans(lower, offsets)
    return span_hashes(lower, starts, ends), np.searchsorted(starts, offsets)


def shingles(words: np.ndarray, first: np.ndarray, size: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(shingle hashes with repeats, index of each row's first one plus the total).

    A row with 1 to ``size - 1`` words has its whole sequence as its only
    shingle; a row without words has none.
    """
    counts = np.diff(first)
    made = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    at = np.concatenate([[0], np.cumsum(made)])
    out = np.empty(at[-1], dtype=_U)
    if len(words) >= size:
        rolled = words[: len(words) - size + 1] * _LANE[0]
        for k in range(1, size):
            rolled += words[k : len(words) - size + 1 + k] * _LANE[k]
        rolled = mix(rolled)
        keep = np.zeros(len(rolled) + 1, dtype=np.int32)
        long = counts >= size
        np.add.at(keep, first[:-1][long], 1)
        np.add.at(keep, first[:-1][long] + counts[long] - size + 1, -1)
        body = rolled[np.cumsum(keep[:-1]) > 0]
    else:
        body = np.zeros(0, _U)
    slot = np.ones(at[-1], dtype=bool)
    for row in np.flatnonzero((counts > 0) & (counts < size)):
        own = words[first[row] : first[row + 1]]
        slot[at[row]] = False
        out[at[row]] = mix(np.array([np.sum(own * _LANE[: len(own)]) + _U(len(own))], dtype=_U) + _U(1))[0]
    out[slot] = body
    return out, at


def row_shingles(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, shingle hashes, indexes) block by block of a string column."""
    data, offsets = utf8(column)
    for a, b in blocks(offsets):
        own = offsets[a : b + 1] - offsets[a]
        words, first = word_hashes(data[offsets[a] : offsets[b]], own)
        yield a, *shingles(words, first)
