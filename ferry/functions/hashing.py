"""Order-free content fingerprints of a table.

``row_hash`` is one ``xxhash64`` per row over every column.  The sum of the
row hashes (read as unsigned 64-bit numbers) is a multiset hash: independent
of row order and of how rows are split into files and partitions, and
computed with partial aggregation (no shuffle of table data).

The sum is kept as four ``bigint`` sums of the hash's 16-bit slices
(:func:`hash_slices`): plain long additions in generated code, no decimal
arithmetic per row, and no overflow below 2^47 (1.4e14) rows even with ANSI
mode on.  :func:`combine_slices` folds the four sums into the exact total.

``xxhash64`` skips nulls and runs neighbouring arrays together.  A null mask
(one boolean per column) therefore goes into the hash, and nested values
carry their null flags and sizes with them at every depth.  Maps are not
hashable and have no entry order, so their sorted entries stand for them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

SLICE_BITS = 16
SLICES = 4


NESTED = (ArrayType, MapType, StructType)


def _tagged(c: Column, t: DataType) -> Column:
    """A value whose ``xxhash64`` tells nested values apart: ``xxhash64``
    skips nulls and runs neighbouring arrays together, so every null flag and
    every array's size is hashed with the values, at each depth."""
    if isinstance(t, MapType):
        # The entries in the order of their keys; a map has no order of its own.
        entries = F.transform(
            F.map_entries(c),
            lambda e: F.struct(_tagged(e["key"], t.keyType).alias("k"), _tagged(e["value"], t.valueType).alias("v")),
        )
        return F.struct(c.isNull().alias("z"), F.size(c).alias("n"), F.array_sort(entries).alias("e"))
    if isinstance(t, ArrayType):
        if not isinstance(t.elementType, NESTED) and t.elementType.typeName() != "variant":
            flags = F.transform(c, lambda x: x.isNull())
            return F.struct(c.isNull().alias("z"), F.size(c).alias("n"), flags.alias("f"), c.alias("e"))
        items = F.transform(c, lambda x: _tagged(x, t.elementType))
        return F.struct(c.isNull().alias("z"), F.size(c).alias("n"), items.alias("e"))
    if isinstance(t, StructType):
        fields = [_tagged(c.getField(f.name), f.dataType).alias(f"f{i}") for i, f in enumerate(t.fields)]
        return F.struct(c.isNull().alias("z"), *fields)
    value = F.to_json(c) if t.typeName() == "variant" else c
    return F.struct(c.isNull().alias("z"), value.alias("v"))


def hashable(c: Column, t: DataType) -> Column:
    """Top-level scalars stay as they are (their null flags are in the mask)."""
    if isinstance(t, NESTED):
        return _tagged(c, t)
    return F.to_json(c) if t.typeName() == "variant" else c


def row_hash(df: DataFrame, columns: list[str] | None = None) -> Column:
    """64-bit hash of each row over ``columns`` (default: all, in the
    DataFrame's order; callers compare tables by name-aligned columns)."""
    fields = {f.name: f.dataType for f in df.schema.fields}
    names = columns if columns is not None else list(fields)
    values = [hashable(F.col(f"`{n}`"), fields[n]) for n in names]
    null_mask = [F.col(f"`{n}`").isNull() for n in names]
    return F.xxhash64(*values, *null_mask)


def hash_slices(h: Column) -> list[Column]:
    """The four unsigned 16-bit slices of a 64-bit hash, low to high."""
    mask = (1 << SLICE_BITS) - 1
    return [F.shiftrightunsigned(h, SLICE_BITS * i).bitwiseAND(F.lit(mask)) for i in range(SLICES)]


def content_hash_aggs(df: DataFrame, columns: list[str] | None = None, prefix: str = "h") -> list[Column]:
    """Aggregates ``{prefix}0..{prefix}3``: slice sums of :func:`row_hash`."""
    return [F.sum(s).alias(f"{prefix}{i}") for i, s in enumerate(hash_slices(row_hash(df, columns)))]


def combine_slices(sums) -> int | None:
    """Exact unsigned sum of the row hashes from the four slice sums."""
    if any(s is None for s in sums):
        return None
    return sum(int(s) << (SLICE_BITS * i) for i, s in enumerate(sums))
