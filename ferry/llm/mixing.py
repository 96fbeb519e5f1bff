"""Mixing sources to target weights: Pfair scheduling with DataFrame functions.

Source ``s`` with weight ``w = parts / total`` releases its block ``k``
(0, 1, ...) at slot ``floor(k / w)`` with deadline ``ceil((k + 1) / w)``;
every slot goes to the released block with the earliest deadline.  Windows
repeat every ``total`` slots, so one period (``aggregate`` over a sequence;
the targets are a parameter, so its size is bounded by it) is the schedule of
any number of blocks: block ``k`` runs at
``(k div parts) * total + place[k mod parts]``.

At every slot each source has had its weight times the slots so far, give or
take less than one block.  When a source has no blocks left its slots are
skipped; the others keep their proportions.  All rows stay.

A document's number within its source comes from counts per (source, bucket),
with documents dealt to buckets by hash: a source that holds a third of all
rows is sorted in as many parts as there are buckets.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ferry.llm.shared import saved

BLOCK_ROWS = 64
BUCKETS = 1024
REST = "*"
MAX_PARTS = 10_000
RESULT = ("mix_class", "mix_block", "mix_slot", "mix_position")


def schedule(spark: SparkSession, targets: Mapping[str, int]) -> DataFrame:
    """One period: (place, class, number, before): at slot ``place`` runs the
    class's block ``number``; ``before`` has each class's blocks run so far."""
    parts = list(targets.values())
    total = sum(parts)
    if not parts or min(parts) < 1 or total > MAX_PARTS:
        raise ValueError(f"targets must be positive integers with a sum of at most {MAX_PARTS}")
    one = spark.range(1).select(F.array(*[F.lit(p).cast("long") for p in parts]).alias("parts"))

    def step(state, slot):
        ready = F.transform(
            F.col("parts"),
            lambda p, i: F.when(
                (F.get(state["done"], i) < p) & (F.floor(F.get(state["done"], i) * total / p) <= slot),
                F.struct(F.ceil((F.get(state["done"], i) + 1) * total / p).alias("deadline"), i.alias("i")),
            ),
        )
        best = F.array_min(F.filter(ready, lambda x: x.isNotNull()))["i"]
        done = F.transform(state["done"], lambda d, i: F.when(i == best, d + 1).otherwise(d))
        row = F.struct(slot.cast("long").alias("place"), best.cast("int").alias("class"), F.get(state["done"], best).alias("number"), state["done"].alias("before"))
        return F.struct(done.alias("done"), F.concat(state["rows"], F.array(row)).alias("rows"))

    zero = F.expr(
        "named_struct('done', transform(parts, p -> 0L), 'rows', "
        "cast(array() as array<struct<place: bigint, class: int, number: bigint, before: array<bigint>>>))"
    )
    made = one.select(F.aggregate(F.sequence(F.lit(0).cast("long"), F.lit(total - 1).cast("long")), zero, step)["rows"].alias("rows"))
    return made.select(F.inline("rows"))


def mix(
    docs: DataFrame, targets: Mapping[str, int], id_col: str = "doc_id", source_col: str = "source", block_rows: int = BLOCK_ROWS, buckets: int = BUCKETS, seed: int = 0
) -> DataFrame:
    """``docs`` with mix_class, mix_block, mix_slot and mix_position (from 0,
    without gaps): read by position, any prefix of whole slots holds each
    source's weight give or take less than one block, until a source ends.

    ``targets`` maps sources to integer parts; ``"*"`` is the part of all
    other sources and of null together, 1 if not given; the bound holds for
    them together, not for each.  Documents of a class
    come in an order set by hash of the id and ``seed``, repeated ids and rows
    in any order among themselves; null ids are ordinary ids.  Source names
    are compared as they are.  No row is dropped or repeated.  An empty table
    gives an empty result.  Columns of ``docs`` keep their names; one that has
    the name of a column of the result is refused (``toDF`` renames it).
    """
    spark = docs.sparkSession
    if clashes := sorted({c for c in docs.columns if c.lower() in RESULT}):
        raise ValueError(f"columns of the mixture have these names: {', '.join(clashes)}")
    targets = dict(targets)
    targets.setdefault(REST, 1)
    names = list(targets)
    total = sum(targets.values())
    period = schedule(spark, targets)

    source = F.col(f"_d.{source_col}")
    klass = F.coalesce(*[F.when(source == n, F.lit(i)) for i, n in enumerate(names) if n != REST], F.lit(names.index(REST))).cast("int")
    order = F.xxhash64(F.col(f"_d.{id_col}"), F.lit(seed))
    keyed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_d")).select("_d", klass.alias("mix_class"), order.alias("_order"))
    keyed = keyed.withColumn("_bucket", F.pmod(F.shiftright("_order", 32), F.lit(buckets)).cast("int"))

    counts = keyed.groupBy("mix_class", "_bucket").agg(F.count("*").alias("n"))
    running = Window.partitionBy("mix_class").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("mix_class", "_bucket", F.coalesce(F.sum("n").over(running), F.lit(0)).alias("_start"))
    # Bounded by the targets: a size per class, a start per class and bucket, a row per slot of a period.
    found = {r["mix_class"]: r["n"] for r in counts.groupBy("mix_class").agg(F.sum("n").alias("n")).collect()}
    sizes = F.array(*[F.lit(found.get(i, 0)).cast("long") for i in range(len(names))])
    rank = Window.partitionBy("mix_class", "_bucket").orderBy("_order")
    placed = keyed.withColumn("_i", F.row_number().over(rank) - 1).join(F.broadcast(starts), ["mix_class", "_bucket"])
    placed = placed.withColumn("_nth", F.col("_start") + F.col("_i"))
    parts = F.array(*[F.lit(p).cast("long") for p in targets.values()])
    share = F.get(parts, F.col("mix_class"))
    placed = placed.withColumn("mix_block", F.expr(f"_nth div {block_rows}")).withColumn("_share", share)
    placed = placed.withColumn("number", F.pmod("mix_block", "_share")).withColumn("_round", F.expr("mix_block div _share"))
    period = period.withColumnRenamed("class", "mix_class")
    placed = placed.join(F.broadcast(period), ["mix_class", "number"])
    earlier = F.aggregate(
        F.transform(
            F.col("before"),
            lambda b, i: F.least((F.col("_round") * F.get(parts, i) + b) * block_rows, F.get(sizes, i)),
        ),
        F.lit(0).cast("long"),
        lambda a, x: a + x,
    )
    return placed.select(
        "_d.*",
        "mix_class",
        "mix_block",
        (F.col("_round") * total + F.col("place")).alias("mix_slot"),
        (earlier + F.col("_nth") % block_rows).alias("mix_position"),
    )


def mixed_files(docs: DataFrame, targets: Mapping[str, int], **options) -> DataFrame:
    """``mix(docs, targets)``, its whole rows written to the shared folder in
    the order of ``mix_position`` (files by name, rows within) and read back."""
    mixed = mix(docs, targets, **options)
    return saved(mixed.repartitionByRange("mix_position").sortWithinPartitions("mix_position"), "mixed", compression="zstd")
