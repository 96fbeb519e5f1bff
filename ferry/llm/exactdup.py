"""Exact duplicates by progressive refinement, DataFrame functions only.

Level 1 counts texts per length, level 2 counts texts per length and hash of
the first characters, and only where a (length, prefix) group still has two
members is the whole text hashed (level 3).  Levels 1 and 2 move a long or
two per row, written once as a narrow table.  Level 3 must know, while reading
texts, which rows survive: the surviving (length, prefix) values are set in a
bit map, a table of a few thousand bytes a row that is broadcast and joined by
the number of its row, so no text goes through a shuffle to find that out.  Only
rows whose group still has two members are joined with the result.  The map has as
many bits as the survivors ask for, up to a bound; a value that shares a bit by
chance costs a hash and changes nothing.  All aggregates combine before the
shuffle.  The joins back have a key of their own: joined by the columns that the
groups are aggregated by, Spark would skip a shuffle and could not split a hot
group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferry.llm.shared import saved

PREFIX_CHARS = 64
#: Bits of the map for each surviving value, and its least and greatest size.  The greatest is 64 MiB: with far more
#: than 2**29 survivors the map is full, and hashing every text is then cheaper than moving texts to find them out.
FILTER_BITS_EACH, FILTER_LEAST, FILTER_MOST = 16, 1 << 15, 1 << 29
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def normalised(text: Column) -> Column:
    """Null as empty; A-Z in lower case, all else as it is."""
    return F.translate(F.coalesce(text, F.lit("")), _UPPER, _UPPER.lower())


def _levels(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` with _id, _body, _len and _prefix."""
    rows = docs.select("*", F.col(id_col).alias("_id"), normalised(F.col(text_col)).alias("_body"))
    return rows.select("*", F.octet_length("_body").alias("_len"), F.xxhash64(F.substring("_body", 1, PREFIX_CHARS)).alias("_prefix"))


def _alike(narrow: DataFrame) -> DataFrame:
    """The (_len, _prefix) of two rows or more: level 1 by length, level 2 by prefix."""
    lengths = narrow.groupBy("_len").agg(F.count("*").alias("_n")).where("_n > 1").select("_len")
    alike = narrow.groupBy("_len", "_prefix").agg(F.count("*").alias("_n")).where("_n > 1")
    return alike.join(lengths, "_len", "left_semi").select("_len", "_prefix")


def _place(bits: int) -> Column:
    """The bit of a row, from 1 to ``bits``."""
    return F.pmod(F.xxhash64("_len", "_prefix"), F.lit(bits)) + 1


def _bit_map(alike: DataFrame) -> tuple[DataFrame, int]:
    """(the map, its bits): rows of 4 KiB, 16,384 at most."""
    wanted = max(1, alike.count()) * FILTER_BITS_EACH
    bits = min(FILTER_MOST, max(FILTER_LEAST, 1 << (wanted - 1).bit_length()))
    places = alike.select(_place(bits).alias("_at")).select(F.bitmap_bucket_number("_at").alias("_bucket"), F.bitmap_bit_position("_at").alias("_bit"))
    return places.groupBy("_bucket").agg(F.bitmap_construct_agg("_bit").alias("_map")), bits


def _refined(rows: DataFrame, alike: DataFrame) -> DataFrame:
    """``rows`` of ``_levels`` with _full, which is null where levels 1 and 2
    have settled the row."""
    table, bits = _bit_map(alike)
    marked = rows.withColumn("_bucket", F.bitmap_bucket_number(_place(bits))).join(F.broadcast(table), "_bucket", "left")
    bit = F.bitmap_bit_position(_place(bits))
    byte = F.conv(F.hex(F.substring("_map", (F.shiftright(bit, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    survives = F.getbit(byte, F.pmod(bit, F.lit(8)).cast("int")) == 1
    return marked.withColumn("_full", F.when(survives, _full_hash())).drop("_bucket", "_map")


def _full_hash() -> Column:
    return F.sha2(F.encode("_body", "UTF-8"), 256)


def _with_groups(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """``rows`` with _keep, _same and _size, null for texts without copies."""
    key = F.concat_ws(" ", *[F.col(c).cast("string") for c in _LEVELS]).alias("_group")
    return rows.select("*", key).join(groups.select("_keep", "_same", "_size", key), "_group", "left")


def _groups(rows: DataFrame) -> DataFrame:
    """Groups of two or more equal texts: _keep, _size and how many rows share the kept id."""
    per_id = rows.where("_full is not null").groupBy("_len", "_prefix", "_full", "_id").agg(F.count("*").alias("_n"))
    best = F.max(F.struct(F.col("_id").isNotNull(), "_id", "_n")).alias("_best")
    return (
        per_id.groupBy("_len", "_prefix", "_full")
        .agg(best, F.sum("_n").alias("_size"))
        .where("_size > 1")
        .select("_len", "_prefix", "_full", F.col("_best._id").alias("_keep"), F.col("_best._n").alias("_same"), "_size")
    )


_LEVELS = ["_len", "_prefix", "_full"]


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_all: bool = False) -> DataFrame:
    """One row per row of ``docs``: id, keep_id (largest id of the equal
    texts), group_size (long), kept (bool), text_sha256.

    Texts are equal when identical after lower-casing A-Z; a null text equals
    an empty one.  Rows that share an id and a text are copies too: all count
    in group_size and each is marked kept if its id is keep_id
    (``drop_exact_duplicates`` keeps one of them).  Null ids come after every
    id: only a group without any id has a null keep_id.  ``text_sha256`` is
    null where refinement ended before the full hash, unless ``hash_all``.
    Other columns are ignored; an empty table gives an empty result.
    """
    levels = _levels(docs.select(id_col, text_col), id_col, text_col)
    if hash_all:
        # Every row is hashed in the one pass over the texts; refinement goes on with the narrow rows.
        rows = saved(levels.select("_id", "_len", "_prefix", _full_hash().alias("text_sha256")), "levels")
        alike = saved(_alike(rows), "alike").withColumn("_open", F.lit(True))
        rows = rows.join(alike, ["_len", "_prefix"], "left").withColumn("_full", F.when(F.col("_open"), F.col("text_sha256")))
    else:
        alike = saved(_alike(levels), "alike")
        rows = _refined(levels, alike).select("_id", *_LEVELS, F.col("_full").alias("text_sha256"))
    groups = _groups(rows)
    size = F.coalesce("_size", F.lit(1).cast("long"))
    keep = F.when(F.col("_size").isNull(), F.col("_id")).otherwise(F.col("_keep"))
    return _with_groups(rows, groups).select(
        F.col("_id").alias(id_col), keep.alias("keep_id"), size.alias("group_size"), F.col("_id").eqNullSafe(keep).alias("kept"), "text_sha256"
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with the columns of ``docs``.

    Of equal texts the row with the largest id stays; of several such rows, one.
    """
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    levels = _levels(plain, f"c{names.index(id_col)}", f"c{names.index(text_col)}")
    rows = _refined(levels, saved(_alike(levels), "alike")).drop("_body")
    groups = saved(_groups(rows), "groups")
    # Only rows that levels 1 and 2 left open take part in the join, and in its shuffle; the others pass as they are.
    settled = rows.where("_full is null").select(plain.columns)
    rows = _with_groups(rows.where("_full is not null"), groups)
    kept = settled.union(rows.where("_size is null or (_id <=> _keep and _same = 1)").select(plain.columns))
    if not groups.where("_same > 1").isEmpty():  # some kept id is that of several rows with the text
        repeated = rows.where("_size is not null and _id <=> _keep and _same > 1").dropDuplicates(_LEVELS).select(plain.columns)
        kept = kept.union(repeated)
    return kept.toDF(*names)
