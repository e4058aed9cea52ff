"""Near-duplicate documents by b-bit MinHash.

A document is the set of its shingles of ``size`` words. Every document gets
``BANDS * ROWS`` minima; the minima of a band form its bucket key, and the two
low bits of each (mixed) minimum are kept, packed into five words. Documents
that share a bucket are compared by counting agreeing bit pairs, corrected for
chance agreement; what passes is confirmed on the full sets.

A document also keeps, per place of a table of ``PARITY`` bits, whether an even or
odd number of its shingles hash there. Two sets that differ in few shingles
differ in as few of these bits at most, so a pair with more differing bits than
its sizes allow is ruled out for certain.

With 32 bands of 5 rows, a pair at similarity 0.8 misses all buckets with
probability 3e-6; the estimate has a standard error of 0.038 there, and the
bound on it lies more than five of them below the threshold.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeloom.llm.common import _ODD, blocks, fresh, mix64, shingle_hashes, stored, text_buffers, words_of
from gradeloom.llm.graph import components

BANDS, ROWS, BITS, PARITY = 32, 5, 2, 1024
_WORDS = BANDS * ROWS * BITS // 64
_RANDOM = np.random.RandomState(5)
_FACTORS = _RANDOM.randint(0, 2**31, size=BANDS * ROWS).astype(np.uint32) * np.uint32(2) + np.uint32(1)
_SHIFTS = _RANDOM.randint(0, 2**31, size=BANDS * ROWS).astype(np.uint32)


def _salt(i: int) -> np.uint64:
    return np.uint64(i * int(_ODD) & 0xFFFFFFFFFFFFFFFF)


def shingle_sets(raw: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of every text, sorted, end to end, and their numbers.

    A text with fewer than ``size`` words, but one at least, has its whole word
    sequence as its only shingle; a text without words has none.
    """
    _, _, _, words, first = words_of(raw, bounds)
    runs = shingle_hashes(words, size)
    sets, counts = [], np.zeros(len(bounds) - 1, dtype=np.int64)
    for i in range(len(counts)):
        a, b = int(first[i]), int(first[i + 1])
        if b - a >= size:
            one = np.unique(runs[a : b - size + 1])
        elif b > a:
            one = mix64(reduce(lambda h, w: mix64(h * _ODD + w), words[a:b], np.full(1, b - a, dtype=np.uint64)))
        else:
            continue
        sets.append(one)
        counts[i] = len(one)
    return (np.concatenate(sets) if sets else np.zeros(0, dtype=np.uint64)), counts


def signatures(sets: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket keys (one column per band) and packed low bits of every non-empty set."""
    starts = np.concatenate(([0], np.cumsum(counts)[:-1]))[counts > 0]
    x = (sets >> np.uint64(32)).astype(np.uint32)
    keys = np.empty((len(starts), BANDS), dtype=np.uint64)
    packed = np.zeros((len(starts), _WORDS), dtype=np.uint64)
    for band in range(BANDS):
        key = np.full(len(starts), band + 1, dtype=np.uint64)
        for row in range(ROWS):
            i = band * ROWS + row
            least = np.minimum.reduceat(x * _FACTORS[i] + _SHIFTS[i], starts) if len(starts) else np.zeros(0, np.uint32)
            mixed = mix64(least.astype(np.uint64) + _salt(i))
            key = key * _ODD + mixed
            packed[:, i * BITS // 64] |= (mixed & np.uint64((1 << BITS) - 1)) << np.uint64(i * BITS % 64)
        keys[:, band] = mix64(key)
    return keys, packed


def parities(sets: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The parity bits of every non-empty set, in 64-bit words."""
    full = counts[counts > 0]
    at = np.repeat(np.arange(len(full)), full) * PARITY + (sets % np.uint64(PARITY)).astype(np.int64)
    odd = np.bincount(at, minlength=len(full) * PARITY) & 1
    return np.packbits(odd.astype(bool).reshape(len(full), PARITY), axis=1, bitorder="little").view(np.uint64).reshape(len(full), PARITY // 64)


def _sketch(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, bounds = text_buffers(batch.column(1))
        for a, b in blocks(bounds, rows=2048):
            sets, counts = shingle_sets(raw, bounds[a : b + 1], size)
            full = counts > 0
            starts = np.concatenate(([0], np.cumsum(counts)[:-1]))[full]
            keys, packed = signatures(sets, counts)
            prints = np.zeros((b - a, 2), dtype=np.uint64)
            if len(starts):
                for j in range(2):
                    prints[full, j] = np.add.reduceat(mix64(sets + _salt(j + 1)), starts)
            lists = []
            for values, width in ((keys, BANDS), (packed, _WORDS), (parities(sets, counts), PARITY // 64)):
                at = np.concatenate(([0], np.cumsum(full) * width)).astype(np.int32)
                lists.append(pa.ListArray.from_arrays(pa.array(at), pa.array(values.reshape(-1).view(np.int64))))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(a, b - a), pa.array(counts), *(pa.array(prints[:, j].copy().view(np.int64)) for j in range(2)), *lists],
                names=["doc_id", "n_shingles", "p0", "p1", "keys", "bits", "odd"])


def _collect_sets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, bounds = text_buffers(batch.column(1))
        for a, b in blocks(bounds):
            sets, counts = shingle_sets(raw, bounds[a : b + 1], size)
            at = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(pa.array(at), pa.array(sets.view(np.int64)))],
                names=["rep", "shingles"])


def estimate(left: Column, right: Column) -> Column:
    """Similarity from two packed signatures: agreeing slots, less those by chance."""
    same = None
    for i in range(_WORDS):
        differs = left[i].bitwiseXOR(right[i])
        slots = F.bit_count(differs.bitwiseOR(F.shiftrightunsigned(differs, 1)).bitwiseAND(F.lit(0x5555555555555555)))
        same = slots if same is None else same + slots
    share = 1 - same / F.lit(float(BANDS * ROWS))
    chance = 2.0 ** -BITS
    return (share - chance) / (1 - chance)


def differing(left: Column, right: Column) -> Column:
    """Differing parity bits; two sets differ in so many shingles at least."""
    return reduce(Column.__add__, (F.bit_count(left[i].bitwiseXOR(right[i])) for i in range(PARITY // 64)))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80,
                hubs: int = 3, margin: float = 0.2) -> DataFrame:
    """The group of near duplicates that every row belongs to.

    Two rows are linked if ``100 * shared shingles >= percent * shingles of
    either``; groups are what links connect. Returns one row per input row:
    ``doc_id``, ``n_shingles``, ``component_id`` (smallest id of the group) and
    ``kept`` (it is this row's). A null or wordless text is linked with nothing.
    Repeated rows share one decision; rows with one id but different texts are
    decided each by its text. A null id is returned with a null ``component_id``
    and kept. Other columns are not read; an empty table gives an empty one.

    Rows with equal sets fold into one representative first. In a bucket, every
    member is compared with ``hubs`` of the members, not with every other. Buckets
    whose members are then still in different groups are compared member by
    member, so no link is lost to the choice of hubs. Pairs are ruled out by the sizes of the sets, by the
    estimate from the packed bits (less than ``percent / 100 - margin``) and by
    the parity bits; in the last comparison that happens inside the join, which
    so emits little more than links between groups.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = "doc_id long, n_shingles long, p0 long, p1 long, keys array<long>, bits array<long>, odd array<long>"
    sketch = stored(source.mapInArrow(partial(_sketch, size=size), schema), "sketch")
    classes = stored(sketch.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("n_shingles", "p0", "p1")
                     .agg(F.min("doc_id").alias("rep")), "classes")
    sketched = sketch.where("n_shingles > 0").join(
        classes.withColumnRenamed("rep", "doc_id"), ["doc_id", "n_shingles", "p0", "p1"], "left_semi")
    exploded = sketched.select(F.col("doc_id").alias("rep"), F.explode("keys").alias("key"))
    busy = exploded.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    members = stored(exploded.join(busy, "key", "left_semi"), "members")
    bits = sketched.select(F.col("doc_id").alias("rep"), "n_shingles", "bits", "odd")
    needed = members.select("rep").distinct()
    bits = stored(bits.join(needed, "rep", "left_semi"), "bits")
    # Only texts that share a bucket travel.
    wanted = source.join(needed.withColumnRenamed("rep", "doc_id"), "doc_id", "left_semi")
    sets = stored(wanted.mapInArrow(partial(_collect_sets, size=size), "rep long, shingles array<long>"), "sets")

    floor = percent / 100 - margin

    def possible(na: str, nb: str, bits_a: str, bits_b: str, odd_a: str, odd_b: str) -> Column:
        sizes = F.least(na, nb) * 100 >= F.greatest(na, nb) * percent
        differ = differing(F.col(odd_a), F.col(odd_b)) * (100 + percent) <= (F.col(na) + F.col(nb)) * (100 - percent)
        return sizes & differ & (estimate(F.col(bits_a), F.col(bits_b)) >= floor)

    def close(pairs: DataFrame) -> DataFrame:
        """Pairs whose sketches allow a link."""
        left, right = (bits.select(F.col("rep").alias(x), *(F.col(c).alias(c + x) for c in ("n_shingles", "bits", "odd"))) for x in "ab")
        return (pairs.join(left, "a").join(right, "b")
                .where(possible("n_shinglesa", "n_shinglesb", "bitsa", "bitsb", "odda", "oddb")).select("a", "b"))

    def confirmed(pairs: DataFrame) -> DataFrame:
        left = sets.select(F.col("rep").alias("a"), F.col("shingles").alias("sa"))
        right = sets.select(F.col("rep").alias("b"), F.col("shingles").alias("sb"))
        both = F.size(F.array_intersect("sa", "sb"))
        return (pairs.join(left, "a").join(right, "b")
                .where(both * 100 >= (F.size("sa") + F.size("sb") - both) * percent).select("a", "b"))

    # First every member meets the hubs of its buckets: the smallest one and others at random.
    picks = [F.min_by("rep", F.xxhash64("rep", F.lit(i)) if i else F.col("rep")) for i in range(hubs)]
    stars = members.groupBy("key").agg(F.array_distinct(F.array(*picks)).alias("hub")).select("key", F.explode("hub").alias("hub"))
    pairs = (members.join(stars, "key").where("rep <> hub")
             .select(F.least("rep", "hub").alias("a"), F.greatest("rep", "hub").alias("b")).distinct())
    links = stored(confirmed(close(pairs)), "confirmed")
    parts = stored(components(links), "parts")
    # Then buckets that hold several groups are compared member by member, but for members of one group.
    grouped_members = members.join(parts, members.rep == parts.node, "left").select("rep", "key", F.coalesce("component", "rep").alias("comp"))
    apart = grouped_members.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key")
    rest = stored(grouped_members.join(apart, "key", "left_semi").join(bits, "rep"), "rest")
    x, y = rest.alias("x"), rest.alias("y")
    across = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.rep") < F.col("y.rep")) & (F.col("x.comp") != F.col("y.comp"))
                    & possible("x.n_shingles", "y.n_shingles", "x.bits", "y.bits", "x.odd", "y.odd"))
    more = stored(confirmed(across.select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")).distinct()), "confirmed")
    if not more.isEmpty():
        # Only the groups that new links join are labelled again.
        label = {c: parts.select(F.col("node").alias(c), F.col("component").alias(f"{c}_group")) for c in "ab"}
        joined = more.join(label["a"], "a", "left").join(label["b"], "b", "left").select(
            F.coalesce("a_group", "a").alias("a"), F.coalesce("b_group", "b").alias("b"))
        merged = components(joined).select(F.col("node").alias("group"), F.col("component").alias("to"))
        alone = merged.select(F.col("group").alias("node"), F.col("group").alias("component")).join(parts.select("node"), "node", "left_anti")
        known = parts.union(alone)
        parts = known.join(merged, known.component == merged.group, "left").select("node", F.coalesce("to", "component").alias("component"))

    grouped = classes.join(parts, classes.rep == parts.node, "left")
    of_class = grouped.select("n_shingles", "p0", "p1", "component", "rep")
    rows = sketch.select("doc_id", "n_shingles", "p0", "p1").join(of_class, ["n_shingles", "p0", "p1"], "left")
    out = rows.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """One row of ``docs`` per group of near duplicates, that with the smallest id.

    Rows that are linked with nothing stay, as do null and wordless texts and rows
    without an id. All columns stay as they are.
    """
    key = fresh(docs, "_near_id")
    gone = near_groups(docs, id_col, text_col, size, percent).where("NOT kept").select(F.col("doc_id").alias(key)).distinct()
    return docs.join(gone, F.col(id_col).cast("long") == F.col(key), "left_anti")
