"""The model catalogue: look-up, seeding, patching, pruning, call cost."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest_models(models: DataFrame) -> DataFrame:
    """Newest catalogue row of each name.

    The row number filter lets Spark keep one row per name and input partition
    before it shuffles, so a name with very many versions is not gathered.
    """
    newest = Window.partitionBy("name").orderBy(F.desc("created_at"), F.desc("id"))
    return (
        models.withColumn("_rank", F.row_number().over(newest))
        .where("_rank = 1").drop("_rank")
    )


def unknown_models(requested: DataFrame, models: DataFrame) -> DataFrame:
    """Requested names that have no catalogue row."""
    return requested.select("name").distinct().join(models, "name", "left_anti")


def absent_models(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """The incoming rows whose (provider, name, version) is absent, once each.

    Keys compare with plain equality: a row without a version never matches, as
    under a unique key over a nullable column.
    """
    key = ["provider", "name", "version"]
    rest = F.struct(*[c for c in incoming.columns if c not in key])
    dated = incoming.where("version IS NOT NULL").groupBy(*key).agg(F.min(rest).alias("_rest")).select(*key, "_rest.*")
    fresh = dated.unionByName(incoming.where("version IS NULL"))
    return fresh.join(existing, key, "left_anti")


def upsert_catalog(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Existing rows plus the incoming ones that are absent."""
    return existing.unionByName(absent_models(existing, incoming), allowMissingColumns=True)


def patch_catalog(models: DataFrame, patch: DataFrame, on: list[str] | None = None) -> DataFrame:
    """Overwrite catalogue columns with the non-NULL values of a patch, by name.

    Two patch rows for one name are an error.
    """
    on = on or ["name"]
    changed = [c for c in patch.columns if c not in on]
    twice = F.raise_error(F.concat_ws(" ", F.lit("two patch rows for"), *on)).cast("boolean")
    fixes = (patch.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"), *[F.any_value(c).alias(f"_new_{c}") for c in changed])
             .where(F.when(F.col("_n") > 1, twice).otherwise(True)).drop("_n"))
    return models.join(fixes, on, "left").select(
        *[F.coalesce(f"_new_{c}", c).alias(c) if c in changed else F.col(c) for c in models.columns]
    )


def prune_catalog(models: DataFrame, results: DataFrame, provider: str) -> DataFrame:
    """Drop one provider's rows that no result refers to."""
    used = results.select(F.col("model_id").alias("id")).distinct()
    doomed = models.where(F.col("provider").ilike(provider)).select("id").join(used, "id", "left_anti")
    return models.join(doomed, "id", "left_anti")


def call_cost(results: DataFrame, models: DataFrame) -> DataFrame:
    """Result rows with the exact cost of their tokens at catalogue prices.

    A result of a model that the catalogue lacks stays, with a NULL cost;
    ``unpriced`` counts such rows.
    """
    prices = models.select(F.col("id").alias("model_id"), "input_cost", "output_cost")
    cost = (F.col("input_tokens").cast("decimal(10,0)") * F.col("input_cost").cast("decimal(18,12)")
            + F.col("output_tokens").cast("decimal(10,0)") * F.col("output_cost").cast("decimal(18,12)"))
    return (
        results.join(prices, "model_id", "left")
        .withColumn("cost", cost.cast("decimal(18,9)"))
        .drop("input_cost", "output_cost")
    )


def unpriced(results: DataFrame, models: DataFrame) -> DataFrame:
    """Model ids that results refer to and the catalogue lacks, with their rows."""
    counts = results.groupBy("model_id").agg(F.count(F.lit(1)).alias("n_results"))
    return counts.join(models.select(F.col("id").alias("model_id")), "model_id", "left_anti")
