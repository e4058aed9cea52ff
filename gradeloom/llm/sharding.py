"""Rendezvous hashing of records over weighted shards."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradeloom.llm.common import fresh, stored

#: Buckets that the rows of a shard are numbered in, side by side.
_BUCKETS = 4096
#: Equal rows that are numbered as one.
_TOGETHER = 4096


def _checked(shards: Mapping[int, float]) -> dict[int, float]:
    if not shards or any(not 0 < w < float("inf") for w in shards.values()):
        raise ValueError("shards maps the number of each shard to its positive weight")
    return dict(sorted(shards.items()))


def shard_of(key: Column, shards: Mapping[int, float]) -> Column:
    """The shard of a key: the one with the largest score -weight / ln(u).

    ``u`` is a hash of (key as text, number of the shard) as a fraction between 0
    and 1. The score of a shard does not depend on the other shards, so a new
    shard takes keys from all others and moves none between them, and a removed
    one spreads its own keys over the rest. A shard's share follows its weight.
    Equal scores go to the smaller number; a null key is a key like any other.
    """
    text = key.cast("string")
    scores = []
    for number, weight in _checked(shards).items():
        bits = F.shiftrightunsigned(F.xxhash64(text, F.lit(number)), 11)
        u = (bits.cast("double") + F.lit(0.5)) * F.lit(2.0**-53)
        scores.append(F.struct((F.lit(float(weight)) / -F.ln(u)).alias("score"), F.lit(-number).alias("minus")))
    best = scores[0] if len(scores) == 1 else F.greatest(*scores)
    return (-best["minus"]).cast("int")


def assign_shards(docs: DataFrame, shards: Mapping[int, float], key_col: str = "doc_id", out: str = "shard") -> DataFrame:
    """``docs`` with the column ``out``, the shard of each row by its key.

    Rows keep their columns; a column of that name is an error. Rows with one
    key, a null key included, share a shard. There is no shuffle.
    """
    if out.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"column {out} exists")
    return docs.withColumn(out, shard_of(F.col(key_col), shards))


def moved(docs: DataFrame, before: Mapping[int, float], after: Mapping[int, float], key_col: str = "doc_id") -> DataFrame:
    """The rows whose shard changes, with ``shard_before`` and ``shard_after``.

    A change of the shards copies these rows and no others.
    """
    both = assign_shards(assign_shards(docs, before, key_col, "shard_before"), after, key_col, "shard_after")
    return both.where("shard_before <> shard_after")


def write_shards(docs: DataFrame, path: str, shards: Mapping[int, float], key_col: str = "doc_id",
                 files: int = 1) -> None:
    """Write every row into the folder of its shard, ``shard=<number>``, as Parquet.

    A shard has at most ``files`` files; rows are dealt to them by a hash of all
    their columns, so a key that holds a large part of the rows fills all the
    files of its shard alike.
    """
    part, own = fresh(docs, "_part"), docs.columns
    dealt = assign_shards(docs, shards, key_col).withColumn(part, F.pmod(F.xxhash64(*own), F.lit(files)))
    (dealt.repartition(len(shards) * files, "shard", part).drop(part)
     .write.partitionBy("shard").mode("errorifexists").parquet(path))


def numbered(rows: DataFrame, shard_col: str = "shard") -> DataFrame:
    """``rows`` with ``slot``, the number of each row in its shard, without gaps from 0.

    The order is fixed by the rows' values, not by how they are stored, so the
    same table always gives the same numbers; equal rows share theirs out. Rows
    should be narrow, for all columns are compared. An empty table gives an empty
    one.

    Equal rows fold on the map side, which also takes care of a key that holds a
    large part of the table. What is left is numbered inside 4096 buckets per
    shard, and a bucket starts where the counts of those before it end. No task
    numbers a shard alone.
    """
    own = rows.columns
    n, chunk, bucket, start, end, slot = (fresh(rows, c) for c in ("_n", "_chunk", "_bucket", "_start", "_end", "slot"))
    folded = rows.groupBy(*own).agg(F.count("*").alias(n))
    cut = folded.withColumn(chunk, F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(n) - 1) / _TOGETHER))))
    cut = cut.withColumn(n, F.least(F.lit(_TOGETHER), F.col(n) - F.col(chunk) * _TOGETHER).cast("int"))
    cut = stored(cut.withColumn(bucket, F.pmod(F.xxhash64(*own, chunk), F.lit(_BUCKETS)).cast("int")), "slots")
    before = Window.partitionBy(shard_col).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    sizes = cut.groupBy(shard_col, bucket).agg(F.sum(n).alias(start))
    starts = sizes.select(shard_col, bucket, F.coalesce(F.sum(start).over(before), F.lit(0)).alias(start))
    so_far = Window.partitionBy(shard_col, bucket).orderBy(*own, chunk).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = cut.withColumn(end, F.sum(n).over(so_far)).join(starts, [shard_col, bucket])
    first = F.col(start) + F.col(end) - F.col(n)
    return placed.select(*own, F.explode(F.sequence(first, first + F.col(n) - 1)).alias(slot))
