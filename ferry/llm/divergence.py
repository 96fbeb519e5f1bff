"""Source divergence audit by count cells.

Every language keeps the terms found in enough of its documents.  A group
(language, source) gives each kept term the smoothed share
``1 + floor(SCALE * (count + 5) / (N + 5 * V))``; two shares differ by their
absolute difference ``f``.

1. A task counts terms and their documents per group in dictionaries that it
   empties when they are full; Spark deals the parts by language and term, adds
   them up and keeps a term, with its language's count, in the same stage.
2. *Group against language*: ``f`` depends on a term's two counts alone, so the
   terms of a group are grouped by (group count, language count) and ``f`` is
   evaluated once per cell.  Cells of equal value are merged, ranked by value
   with their cumulative number of terms, and only cells that begin within the
   asked ranks are expanded into terms, in UTF-8 order.
3. *Group against group*: a term that one of the two lacks has that one's share
   of count zero, so those terms are added up from the cells of one group
   (share, number of terms).  Only terms that both groups have are compared
   one by one, within the task that holds the term.

Shares are exact integers (decimal arithmetic); orders are those of UTF-8.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferry.llm.shared import saved

#: Documents of a language that a term must be found in.
LEAST_DOCUMENTS = 30
SCALE = 1_000_000_000
SMOOTHING = 5
#: Ranks that the report of terms has (a feature of the report).
TOP_TERMS = 50
#: Dictionary entries that a task holds before it hands them on.
HELD_TERMS = 1 << 18
#: Bytes of a text that are split into terms at a time.
PIECE_BYTES = 1 << 20
#: Pairs of counts that are compared at a time.
HELD_PAIRS = 1 << 20

_LETTER = np.zeros(256, dtype=bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = _LETTER[0x80:] = True
_TO_TERMS = bytes((b + 32 if 0x41 <= b <= 0x5A else b) if _LETTER[b] else 0x20 for b in range(256))

_TALLY = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])
_SUMS = "lang string, a int, b int, part long"


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a UTF-8 text, piece by piece: maximal runs of letters A-Z
    (lower-cased) and of characters outside ASCII."""
    at = 0
    while at < len(text):
        piece = text[at : at + PIECE_BYTES].translate(_TO_TERMS)
        end = at + len(piece)
        while end < len(text) and piece and not piece.endswith(b" "):
            cut = piece.rfind(b" ") + 1
            if cut:  # leave the term that may go on
                piece, end = piece[:cut], at + cut
                break
            more = text[end : end + PIECE_BYTES].translate(_TO_TERMS)
            piece, end = piece + more, end + len(more)
        yield piece.split()
        at = end


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs): occurrences per group and term and the
    group's documents with the term; an empty term stands for the group itself."""
    counts: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    held = 0  # entries at most

    def made() -> pa.RecordBatch:
        groups, sizes = list(counts), [len(n) for n, _ in counts.values()]
        row = pa.array(np.repeat(np.arange(len(groups)), sizes))
        terms = [t for n, _ in counts.values() for t in n]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([g[0] for g in groups], pa.string()).take(row),
                pa.array([g[1] for g in groups], pa.string()).take(row),
                pa.array(terms, pa.binary()).cast(pa.string()),
                pa.array([k for n, _ in counts.values() for k in n.values()], pa.int64()),
                pa.array([docs[t] for n, docs in counts.values() for t in n], pa.int64()),
            ],
            schema=_TALLY,
        )

    for batch in batches:
        langs, sources = batch.column(1).to_pylist(), batch.column(2).to_pylist()
        for text, lang, source in zip(batch.column(0).cast(pa.large_binary()), langs, sources):
            n, docs = counts.setdefault((lang or "", source or ""), (Counter(), Counter()))
            own = {b""}
            n[b""] += 1
            for terms in terms_of(text.as_py() or b""):
                n.update(terms)
                own.update(terms)
            docs.update(own)
            held += len(own)
            if held > HELD_TERMS:
                held = sum(len(n) for n, _ in counts.values())
                if held > HELD_TERMS // 2:
                    yield made()
                    counts, held = {}, 0
    yield made()


def share(count: Column | str, total: Column | str, terms: Column | str) -> Column:
    """``1 + floor(SCALE * (count + 5) / (total + 5 * terms))``, exactly."""
    c, n, v = (F.coalesce(F.col(x) if isinstance(x, str) else x, F.lit(0)).cast("decimal(20,0)") for x in (count, total, terms))
    above = ((c + SMOOTHING).cast("decimal(21,0)") * F.lit(SCALE).cast("decimal(10,0)")).alias("above")
    below = (n + v * SMOOTHING).cast("decimal(21,0)")
    return F.try_divide(above - above % below, below).cast("long") + 1


def _shared_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For terms (lang, own: list of (no, p, p0), by no), the sums over the
    terms that two groups share of what the sums by cells have wrong there."""
    for batch in batches:
        langs = batch.column(0).dictionary_encode()
        lists = batch.column(1)
        where = lists.offsets.to_numpy().astype(np.int64)
        flat = lists.values
        no, p, p0 = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3))
        code = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        sizes = np.diff(where)
        keys: list[np.ndarray] = []
        parts: list[np.ndarray] = []
        held = 0

        def emitted() -> pa.RecordBatch:
            key, place = np.unique(np.concatenate(keys), return_inverse=True) if keys else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            total = np.zeros(len(key), np.int64)
            if keys:
                np.add.at(total, place, np.concatenate(parts))
            names = langs.dictionary.take(pa.array(key >> 42)).cast(pa.string())
            return pa.RecordBatch.from_arrays(
                [names, pa.array((key >> 21 & 0x1FFFFF).astype(np.int32)), pa.array((key & 0x1FFFFF).astype(np.int32)), pa.array(total)], names=["lang", "a", "b", "part"]
            )

        for size in np.unique(sizes[sizes > 1]):
            rows = np.flatnonzero(sizes == size)
            for step in range(1, size):  # the groups that stand ``step`` places apart in the lists
                for at in range(0, len(rows), max(1, HELD_PAIRS // int(size - step))):
                    mine = rows[at : at + max(1, HELD_PAIRS // int(size - step))]
                    a = (where[mine][:, None] + np.arange(size - step)).ravel()
                    b = a + step
                    zero = np.abs(p0[a] - p0[b])
                    parts.append(np.abs(p[a] - p[b]) - np.abs(p[a] - p0[b]) - np.abs(p[b] - p0[a]) + zero)
                    keys.append(np.repeat(code[mine], size - step) << 42 | no[a] << 21 | no[b])
                    held += len(a)
                    if held > HELD_PAIRS:
                        yield emitted()
                        keys, parts, held = [], [], 0
        yield emitted()


def _one_sided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For groups (lang, a, cells: list of (p, k), zeros: list of (no, p0)), the
    sum over the group's terms of the distance to each other group's p0."""
    for batch in batches:
        for lang, a, cells, zeros in zip(*(batch.column(k) for k in range(4))):
            p, k = (cells.values.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(2))
            no, p0 = (zeros.values.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(2))
            order = np.argsort(p)
            p, k = p[order], k[order]
            terms, sums = np.concatenate([[0], np.cumsum(k)]), np.concatenate([[0], np.cumsum(p * k)])
            below = np.searchsorted(p, p0)
            part = p0 * terms[below] - sums[below] + (sums[-1] - sums[below]) - p0 * (terms[-1] - terms[below])
            other = no != a.as_py()
            least, most = np.minimum(no, a.as_py())[other], np.maximum(no, a.as_py())[other]
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang.as_py()] * int(other.sum()), pa.string()), pa.array(least.astype(np.int32)), pa.array(most.astype(np.int32)), pa.array(part[other])],
                names=["lang", "a", "b", "part"],
            )


def _pairs(counts: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) for every two sources of a language."""
    shares = counts.join(groups.select("lang", "source", "no", "total", "terms", "p0"), ["lang", "source"]).withColumn("p", share("n", "total", "terms"))
    shared = shares.groupBy("lang", "term").agg(F.array_sort(F.collect_list(F.struct("no", "p", "p0"))).alias("own"))
    cells = shares.groupBy("lang", "no", "p").agg(F.count("*").alias("k")).groupBy("lang", "no").agg(F.collect_list(F.struct("p", "k")).alias("cells"))
    zeros = groups.groupBy("lang").agg(F.collect_list(F.struct("no", "p0")).alias("zeros"))
    sums = (
        shared.select("lang", "own")
        .mapInArrow(_shared_terms, _SUMS)
        .union(cells.join(zeros, "lang").select("lang", F.col("no").alias("a"), "cells", "zeros").mapInArrow(_one_sided, _SUMS))
        .groupBy("lang", "a", "b")
        .agg(F.sum("part").alias("part"))
    )
    one = groups.select("lang", F.col("no").alias("a"), F.col("source").alias("x"), F.col("p0").alias("x0"), F.col("own_terms").alias("xn"), "terms")
    two = groups.select("lang", F.col("no").alias("b"), F.col("source").alias("y"), F.col("p0").alias("y0"), F.col("own_terms").alias("yn"))
    # The result has a row for every two sources of a language, so this join makes only rows of the result.
    pairs = one.join(two, "lang").where("a < b").join(sums, ["lang", "a", "b"], "left")
    absent = (F.col("terms") - F.col("xn") - F.col("yn")) * F.abs(F.col("x0") - F.col("y0"))
    value = F.when(F.col("terms") > 0, F.coalesce("part", F.lit(0)) + absent).otherwise(0).cast("long")
    sides = F.explode(F.array(F.struct(F.col("x").alias("source"), F.col("y").alias("item")), F.struct(F.col("y").alias("source"), F.col("x").alias("item"))))
    return pairs.select("lang", value.alias("value"), sides.alias("s")).select("lang", "s.source", "s.item", "value")


def _terms(counts: DataFrame, groups: DataFrame, top: int) -> DataFrame:
    """(lang, source, item, value, rank): the terms that a group has more of than its language."""
    rows = counts.select("lang", "term", "source", "n", "m")
    stats = groups.select("lang", "source", "total", "lang_total", "terms")
    cells = rows.groupBy("lang", "source", "n", "m").agg(F.count("*").alias("k")).join(stats, ["lang", "source"])
    p, q = share("n", "total", "terms"), share("m", "lang_total", "terms")
    cells = saved(cells.select("lang", "source", "n", "m", "k", (p - q).alias("value")).where("value > 0"), "cells")
    group = Window.partitionBy("lang", "source")
    merged = cells.groupBy("lang", "source", "value").agg(F.sum("k").alias("k"))
    # Each value has a term at least, so no more values than ranks are needed.
    merged = merged.withColumn("at", F.row_number().over(group.orderBy(F.desc("value")))).where(F.col("at") <= top)
    begun = F.sum("k").over(group.orderBy(F.desc("value")).rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("k")
    wanted = merged.withColumn("begun", begun).where(F.col("begun") < top).select("lang", "source", "value", "begun")
    wanted = cells.join(wanted, ["lang", "source", "value"]).select("lang", "source", "n", "m", "value", "begun")
    place = F.row_number().over(Window.partitionBy("lang", "source", "value").orderBy("term"))
    listed = rows.join(wanted, ["lang", "source", "n", "m"]).withColumn("place", place).where(F.col("place") <= top)
    rank = (F.col("begun") + F.col("place")).cast("int")
    return listed.select("lang", "source", F.col("term").alias("item"), "value", rank.alias("rank")).where(F.col("rank") <= top)


def source_divergence(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    least_documents: int = LEAST_DOCUMENTS,
    top_terms: int = TOP_TERMS,
) -> DataFrame:
    """Rows (lang, source, part, item, value long, rank int).

    Part ``pair``: for each group and each other source of its language, the
    sum over the language's kept terms of the difference of their shares, all
    ranks.  Part ``term``: the terms whose share in the group is above that in
    the language, the ``top_terms`` with the greatest difference.  Ranks go
    from 1 per group and part, by value (greatest first), then by item.

    Null text, lang and source count as empty.  A repeated row is a document of
    its own, whatever its id; a text without terms still makes its group occur.
    A language without kept terms has pairs of value 0 and no terms.  Equal
    values are ranked by item, so the result is the same for any input order.
    Other columns are ignored, whatever their names; an empty table gives no
    rows.  A text is split in pieces; a task holds one text's distinct terms.
    """
    named = docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"))
    tally = named.mapInArrow(_tally, "lang string, source string, term string, n long, docs long")
    # Dealt once, by language and term: the sums of the groups and those of the language need no other shuffle.
    tally = tally.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")
    sums = [F.sum("docs").over(term).alias("in_docs"), F.sum("n").over(term).alias("m"), (F.col("source") == F.min("source").over(term)).alias("first")]
    tally = saved(tally.select("lang", "term", "source", "n", *sums).where((F.col("term") == "") | (F.col("in_docs") >= least_documents)), "tally")
    counts = tally.where("term <> ''").select("lang", "source", "term", "n", "m", "first")

    per_group = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("own_terms"))
    per_lang = per_group.groupBy("lang").agg(F.sum("total").alias("lang_total"))
    vocabulary = counts.where("first").groupBy("lang").agg(F.count("*").alias("terms"))
    groups = tally.where("term = ''").select("lang", "source")
    groups = groups.join(per_group, ["lang", "source"], "left").join(per_lang, "lang", "left").join(vocabulary, "lang", "left").na.fill(0)
    no = (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).alias("no")
    groups = saved(groups.select("*", no, F.when(F.col("terms") > 0, share(F.lit(0), "total", "terms")).otherwise(0).alias("p0")), "groups")

    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = _pairs(counts, groups).select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    terms = _terms(counts, groups, top_terms).select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")
    return pairs.union(terms)
