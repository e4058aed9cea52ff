"""Case tables: validation, discovery, balanced subsets, call plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradeloom.functions.text import is_blank, strip


def violations(df: DataFrame, keys: list[str], rules: list[tuple[str, Column]]) -> DataFrame:
    """One row per broken rule and input row, in a single pass over the input."""
    broken = F.filter(
        F.array(*[F.when(bad, F.lit(rule)) for rule, bad in rules]), lambda r: r.isNotNull()
    )
    return df.select(*keys, F.explode(broken).alias("rule"))


def validate_cases(headers: DataFrame, cases: DataFrame) -> DataFrame:
    """Every broken rule of every data set.

    ``headers``: (source, name, version, description), one row per file.
    ``cases``: (source, position, case_id, prompt). A repeated id is reported
    once per id, from counts, so the copies of an id never meet in one task.
    """
    head = violations(headers, ["source"], [
        ("name_missing", is_blank(F.col("name"))),
        ("version_missing", F.col("version").isNull()),
    ])
    rows = violations(cases, ["source", "position", "case_id"], [
        ("id_missing", is_blank(F.col("case_id"))),
        ("prompt_missing", is_blank(F.col("prompt"))),
    ])
    twice = (
        cases.where(~is_blank(F.col("case_id"))).groupBy("source", "case_id")
        .agg(F.count(F.lit(1)).alias("n"), F.min("position").alias("position")).where("n > 1")
        .select("source", "position", "case_id", F.lit("duplicate_id").alias("rule"))
    )
    empty = headers.join(cases.select("source").distinct(), "source", "left_anti").select(
        "source", F.lit("no_cases").alias("rule")
    )
    return (
        rows.unionByName(twice)
        .unionByName(head, allowMissingColumns=True)
        .unionByName(empty, allowMissingColumns=True)
    )


def discover_datasets(headers: DataFrame, cases: DataFrame) -> DataFrame:
    """Data sets without a violation, by source."""
    bad = validate_cases(headers, cases).select("source").distinct()
    return headers.join(bad, "source", "left_anti").orderBy("source")


def balanced_subset(questions: DataFrame, per_subcategory: int = 17) -> DataFrame:
    """First N questions per subcategory by uid, shaped as judged main cases.

    N rows per subcategory and input partition are kept before the shuffle.
    """
    by_uid = Window.partitionBy("subcategory").orderBy("uid")
    return (
        questions.withColumn("_rank", F.row_number().over(by_uid))
        .where(F.col("_rank") <= per_subcategory)
        .select(
            F.col("uid").alias("case_id"), F.col("subcategory").alias("category"), "subcategory",
            F.lit("main").alias("kind"), "prompt", F.lit("judge").alias("check"),
        )
    )


def call_plan(requests: DataFrame, cases: DataFrame) -> DataFrame:
    """One row per call to make: each case of a run's data set, model and sample.

    ``requests``: (run_id, dataset, model_id, samples); ``cases``: (dataset,
    case_id, ...). The fan-out is the job; it is an equi-join on the data set.
    """
    return (
        requests.join(cases, "dataset")
        .where("samples > 0")  # a sequence to -1 would count down
        .withColumn("sample_idx", F.explode(F.sequence(F.lit(0), F.greatest(F.col("samples").cast("int"), F.lit(1)) - 1)))
        .drop("samples")
    )


def planned_counts(requests: DataFrame, cases: DataFrame) -> DataFrame:
    """Size of each run's plan, by arithmetic."""
    sizes = cases.groupBy("dataset").agg(F.count(F.lit(1)).alias("_cases"))
    asked = requests.groupBy("run_id", "dataset").agg(F.sum(F.greatest("samples", F.lit(0))).alias("_calls"))
    return asked.join(sizes, "dataset", "left").select(
        "run_id", (F.col("_calls") * F.coalesce("_cases", F.lit(0))).alias("n_planned")
    )


def missing_calls(plan: DataFrame, results: DataFrame) -> DataFrame:
    """Planned calls that left no result row."""
    done = results.select("run_id", "model_id", "case_id", "sample_idx")
    return plan.join(done, ["run_id", "model_id", "case_id", "sample_idx"], "left_anti")


def failed_calls(plan: DataFrame, results: DataFrame) -> DataFrame:
    """Number of planned calls without a result row, per run that has any."""
    return missing_calls(plan, results).groupBy("run_id").agg(F.count(F.lit(1)).alias("failed"))


def failed_counts(requests: DataFrame, cases: DataFrame, results: DataFrame) -> DataFrame:
    """``failed_calls`` without the plan: its size by arithmetic, less the calls of it that were answered.

    The facts fold to different calls, which meet the requests and the cases, so the
    work is that of the facts. One request per run and model, one row per case of a
    data set.
    """
    answered = results.where("sample_idx >= 0").select("run_id", "model_id", "case_id", "sample_idx").distinct()
    done = (answered.join(requests, ["run_id", "model_id"]).where("sample_idx < samples")
            .join(cases.select("dataset", "case_id"), ["dataset", "case_id"])
            .groupBy("run_id").agg(F.count(F.lit(1)).alias("_done")))
    lost = F.col("n_planned") - F.coalesce("_done", F.lit(0))
    return planned_counts(requests, cases).join(done, "run_id", "left").select("run_id", lost.alias("failed")).where("failed > 0")


def call_inputs(plan: DataFrame, system: str | Column) -> DataFrame:
    """Plan rows with the text sent to the model."""
    system = F.lit(system) if isinstance(system, str) else system
    return plan.withColumn("call_text", F.concat(strip(system), F.lit("\n\n"), F.col("prompt")))


def judge_inputs(results: DataFrame, rubric: str | Column) -> DataFrame:
    """Result rows with the text sent to the judge."""
    rubric = F.lit(rubric) if isinstance(rubric, str) else rubric
    return results.withColumn("judge_text", F.concat(
        strip(rubric), F.lit("\n\nQ: "), F.col("question"), F.lit("\n\nR: "), F.col("response")))
