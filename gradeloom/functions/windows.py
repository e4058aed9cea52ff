"""Look-back and percentiles that do not gather a key's rows in memory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradeloom.session import materialized


def in_parts(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``_part``, the number of the range of ``order`` that holds them, written once.

    The ranges are cut where a global sort cuts its partitions, so they hold about
    the same number of rows whatever the keys are. They are written because the
    bounds come from a sample: a second evaluation could cut elsewhere.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return materialized(cut.withColumn("_part", F.spark_partition_id()), "parts")


def lag_in_parts(parts: DataFrame, keys: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """``lag(value)`` per key along ``order`` over the rows of ``in_parts(rows, [*keys, *order])``.

    Rows look back inside their part; the first row of a key in a part looks at the
    last one of the key in the part before, which is the only row of a part that
    takes part in the second look-back.
    """
    inner = Window.partitionBy("_part", *keys).orderBy(*order)
    ranked = parts.select("*", F.lag(value).over(inner).alias("_near"), F.row_number().over(inner).alias("_pos"))
    tails = parts.groupBy("_part", *keys).agg(F.max_by(value, F.struct(*order)).alias("_tail"))
    links = tails.select("_part", *keys, F.lag("_tail").over(Window.partitionBy(*keys).orderBy("_part")).alias("_far"))
    links = links.where("_far IS NOT NULL").select(F.col("_part").alias("_p"), *[F.col(k).alias(f"_k_{k}") for k in keys], "_far")
    same = [F.col("_part") == F.col("_p"), F.col("_pos") == 1, *[F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]]
    return ranked.join(links, same, "left").withColumn(out, F.coalesce("_near", "_far")).select(*parts.columns, out)


def number_parts(parts: DataFrame, order: list[str], existing: DataFrame, out: str = "id", where: str = "true") -> DataFrame:
    """The rows of ``in_parts(rows, order)`` that meet ``where``, with ids above the largest of ``existing``.

    Ids follow ``order`` over the whole table and have no gaps: the counts of the
    parts tell each one where its numbers start.
    """
    chosen = parts.where(where)
    sizes = chosen.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    top = existing.agg(F.coalesce(F.max("id"), F.lit(0))).scalar()
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return chosen.withColumn("_pos", place).join(starts, "_part").withColumn(out, top + F.col("_start") + F.col("_pos")).drop("_pos", "_start")


def number_rows(rows: DataFrame, key: str, order: list[str], existing: DataFrame, out: str = "id") -> DataFrame:
    """Ids above the largest one of ``existing``, in the order of key and ``order``."""
    in_order = [key, *order]
    return number_parts(in_parts(rows, in_order), in_order, existing, out).drop("_part")


def value_counts(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, value, n): the histogram of a whole-number column per key."""
    return rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))


def percentiles_of_counts(value: str, points: list[float]) -> Column:
    """Linearly interpolated percentiles over ``value_counts`` rows, as an array.

    The counts of a hot key are added up in parallel, by (key, value); the task
    that finds its percentiles sees each distinct value once.
    """
    return F.percentile(value, F.array(*[F.lit(p) for p in points]), F.col("n"))
