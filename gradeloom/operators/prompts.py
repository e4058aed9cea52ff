"""Prompt versions: validation, hashing, sync, history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradeloom.functions.text import content_hash, is_blank, strip
from gradeloom.functions.windows import in_parts, lag_in_parts, number_parts
from gradeloom.operators.cases import violations


def validate_prompts(staged: DataFrame) -> DataFrame:
    """One row per broken rule of a staged template (source, name, version, content)."""
    return violations(staged, ["source"], [
        ("name_missing", is_blank(F.col("name"))),
        ("version_missing", F.col("version").isNull()),
        ("content_missing", is_blank(F.col("content"))),
    ])


def hashed(staged: DataFrame) -> DataFrame:
    """Staged templates with trimmed name, text version and content hash."""
    return staged.withColumns({
        "name": strip(F.col("name")),
        "version": F.col("version").cast("string"),
        "hash": content_hash(F.col("content")),
    })


def sync_prompts(prompts: DataFrame, staged: DataFrame, now) -> DataFrame:
    """Action per staged template: unchanged, new_version or initial.

    ``now`` is the literal creation time of new rows. Staged templates of one
    name are taken in ``source`` order, each new one replacing the one before,
    and a repeat of a text is the version already made for it. An unchanged
    template comes back as the stored row: its version, its predecessor and its
    time of creation.
    """
    staged = hashed(staged).select("source", "name", "version", "content", "hash")
    before = F.col("previous_version_id") if "previous_version_id" in prompts.columns else F.lit(None)
    known = prompts.select("name", "hash", F.struct(
        "id", F.col("version").cast("string").alias("version"), before.cast("bigint").alias("previous"),
        F.col("created_at").cast("timestamp_ntz").alias("created_at")).alias("_known"))
    # Known and staged rows of one text meet in one window; each text's first source is the one that counts.
    of_text = Window.partitionBy("name", "hash")
    met = staged.unionByName(known, allowMissingColumns=True).select(
        "source", "name", "version", "content", "hash", F.min("_known").over(of_text).alias("_known"),
        F.min("source").over(of_text).alias("_first"), F.col("_known").isNull().alias("_staged"))
    # The rows are read three times below, and the parts number the new ones.
    parts = in_parts(met.where("_staged").drop("_staged"), ["name", "source"])
    newest = prompts.groupBy("name").agg(F.max_by("id", F.struct("created_at", "id")).alias("_latest"))
    fresh = number_parts(parts.select("name", "source", "hash", "version", "_first", "_known", "_part"), ["name", "source"], prompts,
                         where="_known IS NULL AND source = _first")
    made = fresh.join(newest, "name", "left").select(
        F.col("name").alias("_name"), F.col("hash").alias("_hash"), F.struct(
            "id", "version", F.coalesce(F.lag("id").over(Window.partitionBy("name").orderBy("id")), "_latest").alias("previous"),
            F.lit(str(now)).cast("timestamp_ntz").alias("created_at")).alias("_made"))
    row, is_new = F.coalesce("_known", "_made"), F.col("_known").isNull() & (F.col("source") == F.col("_first"))
    return parts.join(made, (F.col("name") == F.col("_name")) & (F.col("hash") == F.col("_hash")), "left").select(
        "source", "name", row["version"].alias("version"), "hash", "content",
        F.when(~is_new, "unchanged").when(row["previous"].isNull(), "initial").otherwise("new_version").alias("action"),
        row["id"].alias("id"), row["previous"].alias("previous_version_id"), row["created_at"].alias("created_at"))


def latest_prompts(prompts: DataFrame) -> DataFrame:
    """Newest version of each name."""
    newest = Window.partitionBy("name").orderBy(F.desc("created_at"), F.desc("id"))
    return prompts.withColumn("_rank", F.row_number().over(newest)).where("_rank = 1").drop("_rank")


def prompt_names(prompts: DataFrame) -> DataFrame:
    return prompts.select("name").distinct().orderBy("name")


def prompt_history(prompts: DataFrame, name: str | Column | None = None) -> DataFrame:
    """Versions oldest first, of one name or of all."""
    chosen = prompts if name is None else prompts.where(F.col("name") == name)
    return chosen.orderBy("name", "created_at", "id")


def prompts_history(prompts: DataFrame) -> DataFrame:
    """The history view: every version with a short hash."""
    return prompts.select(
        "id", "name", "version", F.substring("hash", 1, 12).alias("hash_short"), "hash",
        "previous_version_id", "created_at",
    ).orderBy("name", "created_at")


def version_chain(prompts: DataFrame) -> DataFrame:
    """Each version with the id of the one before it."""
    order = ["created_at", "id"]
    chain = lag_in_parts(in_parts(prompts.select("name", *order), ["name", *order]), ["name"], order, "id", "previous_version_id")
    return prompts.drop("previous_version_id").join(chain.select("id", "previous_version_id"), "id")
