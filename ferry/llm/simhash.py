"""SimHash near duplicates by BK-trees over shards of fingerprints.

1. A document's fingerprint takes, bit by bit, the majority of the XXH64
   hashes of its 3-word shingles, repeats included.  Documents with equal
   fingerprints are one entry from here on, named by their smallest id.
2. Fingerprints that differ in at most ``radius`` bits agree in all but
   ``radius`` of any blocks into which the bits are cut, so with ``BLOCKS``
   blocks each such pair shares the ``BLOCKS - radius`` blocks of some choice.
   A shard is a choice and the value of its blocks.
3. Every shard's fingerprints are dealt into parts of bounded size.  The BK-tree
   of a part (children keyed by their distance to the parent) goes to each part
   of the same shard, whose fingerprints search it, following only the edges
   within the radius.  A shard that is large becomes many tasks, none larger.
4. Of the pairs that a search finds, a task hands on only those that join what
   it has not joined yet, so a group of near copies gives links in proportion to
   its members.  Components follow by large-star and small-star.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferry.llm.components import connected_components
from ferry.llm.shared import runs, saved

SHINGLE_WORDS = 3
SEED = 42
RADIUS = 2
BLOCKS = 4
#: Fingerprints of a BK-tree, and of the part that searches it: twice this at most, about.
PART = 1024
#: Bytes of a text, and shingles, that are handled at a time.
PIECE_BYTES = 1 << 20
HELD_SHINGLES = 1 << 14

_LINK = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def _word_pieces(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, lower-cased in A-Z, piece by piece; each piece but
    the first begins with the last words of the one before."""
    carry: list[bytes] = []
    at = 0
    while at < len(text):
        end = at + PIECE_BYTES
        while end < len(text) and not text[end - 1 : end].isspace():
            end += 1
        carry = carry + text[at:end].lower().split()
        at = end
        if len(carry) >= SHINGLE_WORDS or at >= len(text):
            yield carry
            carry = carry[len(carry) - SHINGLE_WORDS + 1 :] if len(carry) >= SHINGLE_WORDS else carry


def shingle_hashes(text: bytes) -> Iterator[np.ndarray]:
    """XXH64 hashes of a text's shingles, with repeats, in arrays of bounded size."""
    digest = xxhash.xxh64_intdigest
    for words in _word_pieces(text):
        if not words:
            continue
        body = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        size = min(SHINGLE_WORDS, len(words))
        left, right = starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist()
        for at in range(0, len(left), HELD_SHINGLES):
            a, b = left[at : at + HELD_SHINGLES], right[at : at + HELD_SHINGLES]
            yield np.fromiter((digest(body[i:j], SEED) for i, j in zip(a, b)), np.uint64, len(a))


def simhash(text: bytes) -> int:
    """The 64-bit fingerprint of a UTF-8 text; 0 if it has no words."""
    total, ones = 0, np.zeros(64, np.int64)
    for hashes in shingle_hashes(text):
        total += len(hashes)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > total, bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = np.array([simhash(t.as_py() or b"") for t in batch.column(1).cast(pa.large_binary())], dtype=np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made.view(np.int64))], names=["doc", "fp"])


class BKTree:
    """Fingerprints as nodes; the children of a node are keyed by their
    Hamming distance to it."""

    def __init__(self) -> None:
        self.points: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, point: int) -> None:
        """Insert a point; equal points may be inserted again."""
        node, new = 0, len(self.points)
        self.points.append(point)
        self.children.append({})
        while node < new:
            away = (point ^ self.points[node]).bit_count()
            node = self.children[node].setdefault(away, new)

    def near(self, point: int, radius: int) -> Iterator[int]:
        """Numbers of the points within ``radius``: by the triangle inequality
        they are below edges whose key differs from the node's distance by no more."""
        open_nodes = [0] if self.points else []
        while open_nodes:
            node = open_nodes.pop()
            away = (point ^ self.points[node]).bit_count()
            if away <= radius:
                yield node
            children = self.children[node]
            for key in range(max(0, away - radius), away + radius + 1):
                if key in children:
                    open_nodes.append(children[key])


def _root(parent: list[int], x: int) -> int:
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def _searcher(radius: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by (choice, key, left, right): the part ``left`` is the
        tree, the part ``right`` searches it."""
        u: list[int] = []
        v: list[int] = []
        for t in runs(batches, ["choice", "key", "left", "right"]):
            if t.num_rows < 2:
                continue
            reps, parts = t["rep"].to_pylist(), t["part"].to_pylist()
            points = [x & 0xFFFFFFFFFFFFFFFF for x in t["fp"].to_pylist()]
            left, right = t["left"][0].as_py(), t["right"][0].as_py()
            own = [i for i, p in enumerate(parts) if p == left]
            parent = list(range(len(reps)))
            tree = BKTree()
            for i in own:
                tree.add(points[i])
            for i in own if left == right else (i for i, p in enumerate(parts) if p == right):
                for hit in tree.near(points[i], radius):
                    a, b = _root(parent, i), _root(parent, own[hit])
                    if a != b:
                        parent[b] = a
                        u.append(reps[i])
                        v.append(reps[own[hit]])
            if len(u) >= 1 << 14:
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], schema=_LINK)
                u, v = [], []
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], schema=_LINK)

    return search


def _shards(points: DataFrame, blocks: int, radius: int) -> DataFrame:
    """(choice, key, rep, fp): a row per fingerprint and choice of blocks."""
    edges = [64 * k // blocks for k in range(blocks + 1)]
    masks = []
    for chosen in combinations(range(blocks), blocks - radius):
        mask = sum((1 << edges[k + 1]) - (1 << edges[k]) for k in chosen)
        masks.append(mask - (1 << 64) if mask >> 63 else mask)
    choice = F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m).cast("long")) for m in masks])).alias("choice", "key")
    return points.select("rep", "fp", choice)


def _in_parts(shards: DataFrame) -> DataFrame:
    """Shards of two or more, dealt into parts, with a row for every pair of
    parts (``left``, ``right``) that a part belongs to."""
    parts = shards.groupBy("choice", "key").agg(F.count("*").alias("n")).where("n > 1")
    parts = parts.select("choice", "key", F.ceil(F.col("n") / PART).cast("int").alias("parts"))
    dealt = shards.join(parts, ["choice", "key"]).withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    dealt = dealt.select("choice", "key", "rep", "fp", "part", other)
    return dealt.select("choice", "key", F.least("part", "other").alias("left"), F.greatest("part", "other").alias("right"), "part", "rep", "fp")


def links(points: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """Links (u, v) between the ids of ``points(rep long, fp long)`` with which
    the components are those of all pairs within ``radius`` bits."""
    if not 0 <= radius < blocks <= 64:
        raise ValueError("there must be more blocks than differing bits, and 64 at most")
    group = ["choice", "key", "left", "right"]
    return _in_parts(_shards(points, blocks, radius)).repartition(*group).sortWithinPartitions(*group).mapInArrow(_searcher(radius), "u long, v long")


def hex_digits(fp: Column | str) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row per row of ``docs``: id, fingerprint (16 lowercase hex digits),
    component_id (long, the smallest id reachable, itself included).

    Texts whose fingerprints differ in at most ``radius`` bits are linked.  Null,
    empty and white-space texts have the fingerprint zero and are linked like
    any other; a text of one or two words has one shingle, the whole sequence.
    Rows that share an id are linked by it, so an id has one component, but
    each row has its own fingerprint.  Rows without an id link nothing; they get
    the component of the documents with the same fingerprint, null if there is
    none.  Other columns are ignored, whatever their names; an empty table gives
    no rows.  A long text is hashed in pieces.
    """
    named = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    made = saved(named.mapInArrow(_fingerprints, "doc long, fp long"), "fingerprints")
    points = saved(made.where("doc is not null").groupBy("fp").agg(F.min("doc").alias("rep")), "points")
    found = links(points, radius)
    # An id with several fingerprints links them; its rows are few wherever ids are unique.
    several = made.where("doc is not null").groupBy("doc").agg(F.min("fp").alias("a"), F.max("fp").alias("b")).where("a <> b").select("doc")
    bridges = made.join(several, "doc", "left_semi").distinct().join(points, "fp").select(F.col("doc").alias("u"), F.col("rep").alias("v"))
    components = connected_components(found.union(bridges))
    placed = saved(
        points.join(components, F.col("rep") == F.col("node"), "left").select("fp", F.coalesce("component", "rep").alias("component_id")), "placed"
    )
    return made.join(placed, "fp", "left").select(F.col("doc").alias(id_col), hex_digits("fp").alias("fingerprint"), "component_id")
