"""The board queries: one function per panel, over the operators' views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeloom.functions.text import preview
from gradeloom.operators import rollups


def latest_run(runs: DataFrame) -> Column:
    """Id of the newest run, as a scalar subquery."""
    return runs.agg(F.max("id")).scalar()


def run_picker(runs: DataFrame) -> DataFrame:
    return runs.select(
        F.col("id").alias("value"), F.concat("dataset", F.lit(" #"), F.col("id").cast("string")).alias("text")
    ).orderBy(F.desc("value"))


def repeated_spread(stddev: str) -> Column:
    """The spread, blank unless some case was judged more than once."""
    return F.when(F.col("n_judged") > F.col("n_cases"), F.col(stddev))


def panel(metrics: DataFrame, measure: str, run_id: int | Column | None = None, descending: bool = True) -> DataFrame:
    """One figure per model of a run (or of all runs), sorted."""
    rows = metrics if run_id is None else metrics.where(F.col("run_id") == run_id)
    order = F.desc_nulls_last(measure) if descending else F.asc_nulls_last(measure)
    return rows.where(F.col(measure).isNotNull()).select("run_id", "model", measure).orderBy("run_id", order, "model")


def mean_and_spread(metrics: DataFrame) -> DataFrame:
    return metrics.where("avg_judge_score IS NOT NULL").select(
        "run_id", "model", F.col("avg_judge_score").alias("mean_score"),
        repeated_spread("stddev_judge_score").alias("stddev_score"), "n_cases", F.col("n_judged").alias("n_samples"),
    ).orderBy("run_id", F.desc("mean_score"), "model")


def detail_log(results: DataFrame, models: DataFrame, run_id: int | Column, with_style: bool = False,
               limit: int = 500) -> DataFrame:
    """The newest rows of a run; the row id settles equal times.

    Each task keeps at most ``limit`` rows, and only those meet the catalogue.
    """
    chosen = results.where(F.col("run_id") == run_id)
    top = chosen.orderBy(F.desc("created_at"), F.desc("id")).limit(limit)
    style = ["prompt_style"] if with_style else []
    return rollups.named_results(top, models).select(
        "id", "created_at", "case_id", "model", *style, "question", "response",
        F.col("judge_score").cast("double").alias("judge_score"), "judge_reasoning",
    ).orderBy(F.desc("created_at"), F.desc("id"))


def decision_cards(by_profile: DataFrame) -> DataFrame:
    """Winner, confidence, top score and justification per run and profile."""
    return by_profile.select(
        "run_id", "profile", "recommended_model", "confidence", "top_score",
        "determinant_metrics", "tradeoffs", "reasoning",
    )


def decision_overview(by_profile: DataFrame) -> DataFrame:
    return by_profile.select(
        "run_id", "profile", "recommended_model", "confidence", F.col("top_score").alias("score"),
        F.col("mean_judge_score").alias("quality"), "efficiency", "avg_latency_ms", "reasoning",
    ).orderBy("run_id", "profile")


def profile_picker(by_profile: DataFrame, run_id: int | Column) -> DataFrame:
    return by_profile.where(F.col("run_id") == run_id).select("profile").distinct().orderBy("profile")


def full_comparison(metrics: DataFrame) -> DataFrame:
    """All figures, most efficient first, models without a cost last."""
    return metrics.select(
        "run_id", "model", "n_judged", F.col("mean_judge_score").alias("quality"),
        repeated_spread("stddev_judge_score").alias("stddev"), "efficiency", "avg_total_tokens",
        "avg_latency_ms", "ctx_pct", "avg_cost",
    ).orderBy("run_id", F.desc_nulls_last("efficiency"), "model")


def usd(amount: Column) -> Column:
    return F.concat(F.lit("$"), F.regexp_replace(F.format_number(amount, 6), ",", ""))


def clock(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def latest_run_header(runs: DataFrame) -> DataFrame:
    return runs.orderBy(F.desc("id")).limit(1).select(
        F.col("id").alias("run_id"), "dataset", "prompt_id",
        clock(F.col("started_at")).alias("started"), clock(F.col("finished_at")).alias("finished"),
    )


def run_breakdown(results: DataFrame, models: DataFrame, run_id: int | Column) -> DataFrame:
    """Per model of one run: calls, latency, tokens and cost, dearest first."""
    lat, n = F.sum(F.col("latency_ms").cast("bigint")), F.count(F.lit(1))
    g = results.where(F.col("run_id") == run_id).groupBy("model_id").agg(
        n.alias("n"), lat.alias("lat"), F.sum(F.col("input_tokens").cast("bigint")).alias("in_tok"),
        F.sum(F.col("output_tokens").cast("bigint")).alias("out_tok"), F.sum("cost").alias("cost"),
    )
    named = rollups.named_results(g, models).groupBy("model").agg(
        *[F.sum(c).alias(c) for c in ("n", "lat", "in_tok", "out_tok", "cost")])
    return named.orderBy(F.desc("cost")).select(
        "model", "n", F.round(F.col("lat") / F.col("n"), 0).alias("avg_ms"), "in_tok", "out_tok",
        usd(F.col("cost")).alias("cost"),
    )


def case_previews(results: DataFrame, models: DataFrame, run_id: int | Column) -> DataFrame:
    rows = results.where(F.col("run_id") == run_id)
    return rollups.named_results(rows, models).select(
        "id", "case_id", "model", F.col("latency_ms").alias("ms"), preview(F.col("response")).alias("response")
    ).orderBy("case_id", "model")


def last_runs(runs: DataFrame, results: DataFrame, n: int = 5) -> DataFrame:
    """Roll-ups of the newest runs; only their rows are aggregated."""
    newest = runs.orderBy(F.desc("id")).limit(n)
    rows = results.join(newest.select(F.col("id").alias("run_id")), "run_id", "left_semi")
    return rollups.run_metrics(newest, rows).select(
        "run_id", "n_results", "n_models", "n_cases", "duration_ms", usd(F.col("total_cost")).alias("total_cost"),
        F.col("total_input_tokens").alias("in_tok"), F.col("total_output_tokens").alias("out_tok"),
        "avg_latency_ms", "p50_latency_ms", "p95_latency_ms",
    ).orderBy(F.desc("run_id"))


def run_decisions(by_profile: DataFrame, run_id: int | Column) -> DataFrame:
    return by_profile.where(F.col("run_id") == run_id).select(
        "profile", "recommended_model", "confidence").orderBy("profile")
