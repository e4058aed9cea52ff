"""Exact deduplication by content hash, checked byte by byte."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeloom.llm.common import fresh

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalized(text: Column) -> Column:
    """The text with A-Z in lower case; null is empty."""
    return F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """The group of equal texts that each row belongs to.

    Returns one row per input row: ``doc_id``, ``keep_id`` (the smallest id of
    the group, or the largest with ``keep="max"``), ``group_size``, ``kept``,
    ``text_sha256``. Null texts count as empty and so equal each other. Rows with
    one id and one text are counted each and share the decision of their id;
    a null id loses against any other. An empty table gives an empty one; other
    columns are not read.

    Rows fold to (128-bit hash, text) before and after one shuffle, so a group
    that holds a third of the rows arrives as one row per task, and equality of
    bytes, not of hashes, forms the groups. The decision travels back by the
    pair of MD5 and SHA-256; two different texts with both equal stop the query
    instead of being merged.
    """
    if keep not in ("min", "max"):
        raise ValueError("keep is 'min' or 'max'")
    best = F.min if keep == "min" else F.max
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), normalized(F.col(text_col)).alias("_norm"))
    texts = (rows.groupBy(F.unhex(F.md5("_norm")).alias("_hash"), "_norm")
             .agg(F.count("*").alias("_n"), best("doc_id").alias("_best")))
    groups = (texts.select("_hash", F.sha2("_norm", 256).alias("text_sha256"), "_n", "_best")
              .groupBy("_hash", "text_sha256")
              .agg(F.count("*").alias("_texts"), F.sum("_n").alias("_size"), best("_best").alias("keep_id"))
              .select("_hash", "text_sha256", "keep_id",
                      F.when(F.col("_texts") == 1, F.col("_size"))
                      .otherwise(F.raise_error(F.lit("different texts share MD5 and SHA-256")).cast("long")).alias("group_size")))
    keys = rows.select("doc_id", F.unhex(F.md5("_norm")).alias("_hash"), F.sha2("_norm", 256).alias("text_sha256"))
    return keys.join(groups, ["_hash", "text_sha256"]).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """One row of ``docs`` per different text, with all its columns as they were.

    The row with the smallest (largest) id stays. Where several rows carry that
    id and an equal text, one of them stays, the first by the hash of its
    columns. Nulls and empty tables as in ``exact_groups``.
    """
    id_name, sha, n, rank = (fresh(docs, c) for c in ("_id", "_sha", "_copies", "_rank"))
    kept = (exact_groups(docs, id_col, text_col, keep).where("kept")
            .groupBy(F.col("doc_id").alias(id_name), F.col("text_sha256").alias(sha)).agg(F.count("*").alias(n)))
    marked = docs.withColumn(rank, F.sha2(normalized(F.col(text_col)), 256))
    joined = marked.join(kept, F.col(id_col).cast("long").eqNullSafe(F.col(id_name)) & (F.col(rank) == F.col(sha)))
    single = joined.where(F.col(n) == 1)
    several = joined.where(F.col(n) > 1).dropDuplicates([id_name, sha])
    return single.union(several).select(*docs.columns)
