"""Near duplicates: many universal hash minima, banding, signature and full
verification, components by large-star and small-star.

1. Every document's set of 5-word shingles gives ``MINIMA`` minima of
   universal hashes, in bands of ``ROWS``; two sets of likeness 0.75 share no
   band with a chance of ``(1 - 0.75**ROWS)**BANDS`` = 2e-6.
2. Documents with equal sets form one class (an aggregate on the set's
   128-bit hash, combined before the shuffle); only a class's smallest id goes on.
3. In each band value shared by several classes, each is linked with the
   smallest one: links grow with the number of copies, not with its square.
   Links whose signatures say "clearly below" go; the others are confirmed on
   the full sets.  Components of these links come next.
4. Where a band value still holds members of different components, members
   are compared in blocks of bounded size: first by signature, each pair only
   in the first band that it shares, then on full sets, in tasks.  Only
   confirmed links leave a task.  This is the exact way for pairs that step 3
   did not test, so no confirmed link is missing beyond the chance of step 1.

Full sets are made only for documents that still have a candidate.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferry.llm.components import connected_components
from ferry.llm.shared import bounded_batches, id_filter, id_filter_column, in_filter, runs, saved
from ferry.llm.words import mix, row_shingles

ROWS, BANDS = 5, 48
MINIMA = ROWS * BANDS
#: A pair of likeness 0.75 has a share of equal minima below this with a chance of 2e-6.
SIGNATURE_LEAST = 0.62
#: Members of a band value that are compared in one task: twice this at most.
BLOCK = 1024
#: Links of one hub document that one task confirms.
STAR = 2048

_RNG = np.random.default_rng(20240607)
_A = _RNG.integers(0, 1 << 32, MINIMA, dtype=np.uint32) | np.uint32(1)
_B = _RNG.integers(0, 1 << 32, MINIMA, dtype=np.uint32)
_LANES = _RNG.integers(0, 1 << 63, ROWS, dtype=np.uint64) | np.uint64(1)
_BAND = mix(np.arange(1, BANDS + 1, dtype=np.uint64))

_SKETCH = pa.schema(
    [("doc", pa.int64()), ("n_shingles", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("bands", pa.list_(pa.int64())), ("signature", pa.binary())]
)
_SETS = pa.schema([("doc", pa.int64()), ("shingles", pa.binary())])


def _minima(distinct: np.ndarray) -> np.ndarray:
    x = (distinct >> np.uint64(32)).astype(np.uint32)
    least = np.full(MINIMA, 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(x), 1024):
        h = np.multiply.outer(_A, x[at : at + 1024])
        h += _B[:, None]
        np.minimum(least, h.min(axis=1), out=least)
    return least


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        for first, hashes, at in row_shingles(texts):
            n = len(at) - 1
            sizes, sums = np.zeros(n, np.int64), np.zeros((n, 2), np.uint64)
            least = np.zeros((n, MINIMA), np.uint32)
            for r in range(n):
                own = np.unique(hashes[at[r] : at[r + 1]])
                sizes[r] = len(own)
                if len(own):
                    sums[r] = mix(own).sum(), mix(own ^ _LANES[0]).sum()
                    least[r] = _minima(own)
            full = sizes > 0
            bands = mix((least.reshape(n, BANDS, ROWS).astype(np.uint64) * _LANES).sum(axis=2) + _BAND).view(np.int64)
            low = least.astype(np.uint8)
            yield pa.RecordBatch.from_arrays(
                [
                    ids.slice(first, n),
                    pa.array(sizes),
                    pa.array(sums[:, 0].view(np.int64)),
                    pa.array(sums[:, 1].view(np.int64)),
                    pa.array([b if f else None for b, f in zip(bands, full)], type=pa.list_(pa.int64())),
                    pa.array([s.tobytes() if f else None for s, f in zip(low, full)], type=pa.binary()),
                ],
                schema=_SKETCH,
            )


def _set_maker(wanted: bytes):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(in_filter(batch.column(2).to_numpy(zero_copy_only=False), wanted)))
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for first, hashes, at in row_shingles(batch.column(1)):
                n = len(at) - 1
                sets = [np.unique(hashes[at[r] : at[r + 1]]).tobytes() for r in range(n)]
                yield pa.RecordBatch.from_arrays([pa.array(ids[first : first + n]), pa.array(sets, type=pa.binary())], schema=_SETS)

    return make


def shingle_sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc, shingles): the full shingle sets of the documents in ``ids(doc)``,
    one per row with shingles (a repeated id has several).

    A fixed-size bit map of the ids spares the other documents' texts the
    way through a shuffle; the join then makes it exact.
    """
    maker = _set_maker(id_filter(ids, "doc"))
    made = docs.select("doc", "text", id_filter_column("doc").alias("place")).mapInArrow(maker, "doc long, shingles binary")
    return made.where("octet_length(shingles) > 0").join(ids, "doc", "left_semi")


def _matches(a: np.ndarray, b: np.ndarray, threshold: int) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= threshold * (len(a) + len(b) - common)


def _star_confirmer(threshold: int):
    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by (hub, salt, is_hub desc): the hub's sets come first,
        one per text of its id."""
        hub, sets = None, {}
        for batch in batches:
            u, v = [], []
            rows = zip(*(batch.column(k).to_pylist() for k in range(4)), batch.column(4))
            for h, salt, is_hub, doc, raw in rows:
                own = np.frombuffer(raw.as_buffer(), dtype=np.uint64)
                if is_hub:
                    if hub != (h, salt):
                        hub, sets = (h, salt), {}
                    sets.setdefault(raw.as_py(), own.copy())
                elif hub == (h, salt) and any(_matches(x, own, threshold) for x in sets.values()):
                    u.append(doc)
                    v.append(h)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return confirm


def _confirm_stars(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """Links (u, v) among ``pairs(doc, hub)`` whose full sets are alike.

    A hub's links are dealt over as many tasks as ``STAR`` asks for, with its
    set sent once to each.
    """
    salts = pairs.groupBy("hub").agg(F.ceil(F.count("*") / STAR).cast("int").alias("n"))
    members = pairs.join(salts, "hub").select("hub", F.pmod(F.xxhash64("doc", F.lit(1)), "n").cast("int").alias("salt"), F.lit(False).alias("is_hub"), "doc")
    hubs = salts.select("hub", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("salt"), F.lit(True).alias("is_hub"), F.col("hub").alias("doc"))
    rows = members.union(hubs).join(sets, "doc").select("hub", "salt", "is_hub", "doc", "shingles")
    return (
        rows.repartition("hub", "salt")
        .sortWithinPartitions("hub", "salt", F.desc("is_hub"))
        .mapInArrow(_star_confirmer(threshold), "u long, v long")
    )


def _in_blocks(members: DataFrame) -> DataFrame:
    """Deal the members of each ``key`` into blocks and each block into its
    pairs of blocks (``left``, ``right``): groups of at most about 2 * BLOCK rows."""
    counts = members.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("n"))
    own = F.pmod(F.xxhash64("doc", F.lit(2)), F.col("n")).cast("int")
    dealt = members.join(counts, "key").withColumn("block", own)
    return dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).select(
        "key", F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right"), *[c for c in members.columns if c != "key"], "block"
    )


def _pair_mask(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, int, int]:
    block, comp = t["block"].to_numpy(), t["component"].to_numpy()
    return t["doc"].to_numpy(), comp, block, int(t["left"][0].as_py()), int(t["right"][0].as_py())


def _flag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members with a pair of another component whose signatures are alike
    and whose first shared band, by the full band keys, is this one."""
    for t in runs(batches, ["key", "left", "right"]):
        docs, comp, block, left, right = _pair_mask(t)
        if comp.min() == comp.max():
            continue
        sig = np.frombuffer(b"".join(t["signature"].to_pylist()), dtype=np.uint8).reshape(len(docs), MINIMA)
        bands = t["bands"].combine_chunks().flatten().to_numpy().reshape(len(docs), BANDS)
        band = int(t["band"][0].as_py())
        hit = np.zeros(len(docs), dtype=bool)
        rows = np.flatnonzero(block == left)
        others = np.flatnonzero(block == right)
        for i in rows:
            far = others[(comp[others] != comp[i]) & ((others > i) | (left != right))]
            if not len(far):
                continue
            far = far[(sig[far] == sig[i]).mean(axis=1) >= SIGNATURE_LEAST]
            if len(far):
                # The signature's low bytes can agree in a band that the pair does not share.
                far = far[(bands[far] == bands[i]).argmax(axis=1) == band]
                if len(far):
                    hit[i] = True
                    hit[far] = True
        yield pa.RecordBatch.from_arrays([pa.array(t["key"].to_numpy()[hit]), pa.array(docs[hit]), pa.array(comp[hit])], names=["key", "doc", "component"])


def _block_confirmer(threshold: int):
    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, ["key", "left", "right"]):
            docs, comp, block, left, right = _pair_mask(t)
            sets = [np.frombuffer(x, dtype=np.uint64) for x in t["shingles"].to_pylist()]
            sizes = np.array([len(x) for x in sets])
            at = np.concatenate([[0], np.cumsum(sizes)])[:-1]
            _, places = np.unique(np.concatenate(sets), return_inverse=True)
            mark = np.zeros(len(places) + 1, dtype=np.int32)
            own = np.split(places, at[1:])
            u, v = [], []
            for i in np.flatnonzero(block == left):
                mark[own[i]] = 1
                common = np.add.reduceat(mark[places], at)
                mark[own[i]] = 0
                good = (100 * common >= threshold * (sizes + sizes[i] - common)) & (comp != comp[i]) & (block == right)
                far = np.flatnonzero(good)
                u.append(np.full(len(far), docs[i]))
                v.append(docs[far])
            links = np.unique(np.sort(np.stack([np.concatenate(u), np.concatenate(v)], axis=1).astype(np.int64), axis=1), axis=0) if u else np.zeros((0, 2), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(links[:, 1]), pa.array(links[:, 0])], names=["u", "v"])

    return confirm


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = 75) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles (long), component_id (long,
    smallest id reachable over links, itself included), kept (bool).

    Two documents are linked when ``100 * |A & B| >= threshold * |A | B|`` on
    their 5-word shingle sets.  Null, empty and white-space texts have no
    shingles and no link.  Rows with a null id are returned with their size,
    a null component and kept true, since no other row can name them.
    Repeated rows of one id are linked with each other by their id and give
    one row each; if their texts differ, the id has the links of either.
    Other columns are ignored, whatever their names.  ``threshold`` (percent)
    must be 75 or more for the stated chance of a missed link.
    """
    bounded_batches(docs.sparkSession)
    named = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    sketch = saved(named.mapInArrow(_sketches, "doc long, n_shingles long, s1 long, s2 long, bands array<long>, signature binary"), "sketches")
    usable = sketch.where("doc is not null and n_shingles > 0")
    # Written, so that the joins below deal the rows of a hot class anew and Spark can split them.
    classes = saved(usable.groupBy("s1", "s2").agg(F.min("doc").alias("rep")), "classes")
    members = usable.select("doc", "s1", "s2").join(classes, ["s1", "s2"]).select("doc", "rep").distinct()
    reps = usable.join(classes.select(F.col("rep").alias("doc"), "s1", "s2"), ["doc", "s1", "s2"], "left_semi").dropDuplicates(["doc", "s1", "s2"])

    banded = reps.select("doc", F.posexplode("bands").alias("band", "key"))
    hubs = saved(banded.groupBy("key").agg(F.min("doc").alias("hub"), F.count("*").alias("n")).where("n > 1"), "hubs")
    shared = saved(banded.join(hubs, "key").select("key", F.col("band").cast("int").alias("band"), "doc", "hub", "n"), "bands")

    named = named.where("doc is not null")
    signatures = reps.select("doc", "signature")
    star = shared.where("doc <> hub").select("doc", "hub").distinct()
    star = star.join(signatures, "doc").join(signatures.select(F.col("doc").alias("hub"), F.col("signature").alias("hub_signature")), "hub")
    star = saved(star.mapInArrow(_alike, "doc long, hub long"), "stars")
    ends = star.select("doc").union(star.select(F.col("hub").alias("doc"))).distinct()
    links = saved(_confirm_stars(star, shingle_sets(named, ends), threshold), "links")
    first = connected_components(links)

    rest = shared.where("n > 2 and doc <> hub").select("key", "band", "doc").join(first, F.col("doc") == F.col("node"), "left")
    rest = rest.select("key", "band", "doc", F.coalesce("component", "doc").alias("component"))
    open_keys = rest.groupBy("key").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a < b").select("key")
    rest = rest.join(open_keys, "key", "left_semi").join(reps.select("doc", "signature", "bands"), "doc")
    flagged = saved(
        _in_blocks(rest.select("key", "band", "doc", "component", "signature", "bands"))
        .repartition("key", "left", "right")
        .sortWithinPartitions("key", "left", "right")
        .mapInArrow(_flag, "key long, doc long, component long")
        .distinct(),
        "flagged",
    )
    sets = shingle_sets(named, flagged.select("doc").distinct())
    more = (
        _in_blocks(flagged)
        .join(sets, "doc")
        .repartition("key", "left", "right")
        .sortWithinPartitions("key", "left", "right")
        .mapInArrow(_block_confirmer(threshold), "u long, v long")
    )
    same_class = members.where("doc <> rep").select(F.col("doc").alias("u"), F.col("rep").alias("v"))
    joined = connected_components(first.select(F.col("node").alias("u"), F.col("component").alias("v")).union(more).union(same_class))

    return (
        sketch.select("doc", "n_shingles")
        .join(joined.withColumnRenamed("node", "doc"), "doc", "left")
        .select(F.col("doc").alias(id_col), "n_shingles", F.coalesce("component", "doc").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))
    )


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidate links whose signatures do not speak against them."""
    for b in batches:
        by = {n: b.column(b.schema.get_field_index(n)) for n in ("doc", "hub", "signature", "hub_signature")}
        x, y = (np.frombuffer(b"".join(by[n].to_pylist()), dtype=np.uint8).reshape(b.num_rows, MINIMA) for n in ("signature", "hub_signature"))
        keep = pa.array((x == y).mean(axis=1) >= SIGNATURE_LEAST) if b.num_rows else pa.array([], pa.bool_())
        yield pa.RecordBatch.from_arrays([by["doc"].filter(keep), by["hub"].filter(keep)], names=["doc", "hub"])
