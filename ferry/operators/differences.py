"""Where two tables differ, down to the rows.

A tree of hash sums leads to them.  Its root has one sum per partition value, the
next level one sum per bucket of row hashes within a partition, and only buckets
whose sums differ are opened:

1. one pass over both tables gives (rows, hash slice sums) per partition;
2. a second pass reads the differing partitions alone (a semi-join on the
   partition columns, so others are pruned) and sums per bucket, with as many
   buckets as the partition's rows ask for;
3. a third pass keeps the rows of differing buckets, counts equal rows on both
   sides and returns those whose counts differ.

All sums combine before the shuffle; rows are shuffled in step 3 only, and only
those of differing buckets.  Equal tables end after step 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, MapType

from ferry.functions.hashing import NESTED, SLICES, hash_slices, hashable, row_hash
from ferry.functions.identifiers import split_fqn
from ferry.functions.types import stored_type
from ferry.operators.migrate import MigrationError
from ferry.sources.catalog import table_provider
from ferry.sources.partitions import partition_columns

#: Rows that a bucket has on average.
BUCKET_ROWS = 4096
#: Differing partitions up to which their list is broadcast; a longer one is joined by a shuffle.
BROADCAST_PARTITIONS = 100_000


def _aligned(spark: SparkSession, source: str, target: str) -> tuple[DataFrame, DataFrame]:
    """Both tables with the source's column names, in its order."""
    src, tgt = spark.table(source), spark.table(target)
    by_lower = {c.lower(): c for c in tgt.columns}
    if sorted(by_lower) != sorted(c.lower() for c in src.columns):
        raise MigrationError(f"rows cannot be compared: {source} and {target} have other columns")
    tgt = tgt.select(*[F.col(f"`{by_lower[c.lower()]}`").alias(c) for c in src.columns])
    provider = table_provider(spark, target)
    for a, b in zip(src.schema.fields, tgt.schema.fields):
        if a.dataType == b.dataType:
            continue
        if stored_type(a.dataType, provider).simpleString() != b.dataType.simpleString():
            raise MigrationError(f"rows cannot be compared: column {a.name} is {a.dataType.simpleString()} and {b.dataType.simpleString()}")
        src = src.withColumn(a.name, F.col(f"`{a.name}`").cast(b.dataType))
    return src, tgt


def _sums(df: DataFrame, keys: list[str], prefix: str) -> DataFrame:
    slices = [F.sum(s).alias(f"{prefix}{i}") for i, s in enumerate(hash_slices(F.col("__hash")))]
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(f"{prefix}n"), *slices)


def _differing(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, rows) of the groups whose rows or hash sums differ."""
    both = _sums(left, keys, "a").join(_sums(right, keys, "b"), keys, "full_outer")
    same = F.col("an").eqNullSafe(F.col("bn"))
    for i in range(SLICES):
        same = same & F.col(f"a{i}").eqNullSafe(F.col(f"b{i}"))
    return both.where(~same).select(*keys, F.greatest(F.coalesce("an", F.lit(0)), F.coalesce("bn", F.lit(0))).alias("__rows"))


def _groupable(c: Column, kind: DataType) -> Column:
    """A value by which rows can be grouped: maps have no order of their own
    and are nowhere comparable, so their tagged entries stand for them."""
    def holds_map(t: DataType) -> bool:
        parts = [f.dataType for f in getattr(t, "fields", [])] + [getattr(t, n) for n in ("elementType", "keyType", "valueType") if hasattr(t, n)]
        return isinstance(t, MapType) or t.typeName() == "variant" or any(map(holds_map, parts))

    return hashable(c, kind) if holds_map(kind) else c


def row_differences(spark: SparkSession, source: str, target: str, partition_cols: list[str] | None = None, *, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """The rows in which two tables differ: ``side`` (``missing`` for rows that
    the source has more often, ``extra`` for rows that the target has more
    often), ``copies`` (how much more often) and the source's columns.

    Tables are bags of rows: order does not matter, repetition does, and NULL
    equals NULL.  Column order does not matter either; other column names, or
    types that the target's provider does not make of the source's, are refused.
    ``partition_cols`` are the columns of the tree's first level (default: the
    source's partition columns).  Equal tables give no rows.
    """
    split_fqn(source)
    split_fqn(target)
    src, tgt = _aligned(spark, source, target)
    names, kinds = src.columns, {f.name: f.dataType for f in tgt.schema.fields}
    own = partition_columns(spark, source).columns if partition_cols is None else partition_cols
    by_lower = {c.lower(): c for c in names}
    parts = [by_lower[c.lower()] for c in own if not isinstance(kinds[by_lower[c.lower()]], NESTED)]

    # Two keys per partition column that are never NULL, so that all joins are plain ones.
    keys = [f"__{x}{i}" for i in range(len(parts)) for x in "kz"] or ["__k0"]
    values = [v for c in parts for v in (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")), F.col(f"`{c}`").isNull())] or [F.lit("")]

    def keyed(df: DataFrame) -> DataFrame:
        return df.select("*", *[v.alias(k) for v, k in zip(values, keys)], row_hash(df, names).alias("__hash"))

    left, right = keyed(src), keyed(tgt)
    whole = _differing(left, right, keys)
    buckets = F.greatest(F.lit(1), F.ceil(F.col("__rows") / bucket_rows)).cast("bigint")
    opened = whole.select(*keys, buckets.alias("__buckets"))
    # A row per differing partition.  A list of bounded size becomes a literal table; a longer one is worked out again
    # by the passes below.
    few = opened.limit(BROADCAST_PARTITIONS + 1).collect()
    if not few:
        return src.limit(0).select(F.lit("missing").alias("side"), F.lit(1).cast("bigint").alias("copies"), "*")
    listed = F.broadcast(spark.createDataFrame(few, opened.schema)) if len(few) <= BROADCAST_PARTITIONS else opened

    def bucketed(df: DataFrame) -> DataFrame:
        return df.join(listed, keys).withColumn("__bucket", F.pmod("__hash", "__buckets"))

    left, right = bucketed(left), bucketed(right)
    where = [*keys, "__bucket"]
    differing = _differing(left, right, where).select(*where)

    def signed(df: DataFrame, sign: int) -> DataFrame:
        return df.join(differing, where, "left_semi").select(*names, F.lit(sign).alias("__sign"))

    rows = signed(left, 1).union(signed(right, -1))
    group = [_groupable(F.col(f"`{c}`"), kinds[c]).alias(f"__g{i}") for i, c in enumerate(names)]
    value = [F.first(F.col(f"`{c}`")).alias(c) for c in names]
    net = rows.groupBy(*group).agg(F.sum("__sign").cast("bigint").alias("__net"), *value).where("__net <> 0")
    side = F.when(F.col("__net") > 0, "missing").otherwise("extra").alias("side")
    return net.select(side, F.abs("__net").alias("copies"), *[f"`{c}`" for c in names])
