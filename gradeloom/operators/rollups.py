"""Run, model and style roll-ups over the results fact table.

Facts are reduced on their own keys first and meet the model catalogue only
afterwards, as a handful of partial rows per run and model. Every figure is
carried as an additive whole-number sum until the last step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradeloom import schema
from gradeloom.functions import numeric as N
from gradeloom.functions import text
from gradeloom.functions.windows import percentiles_of_counts, value_counts


_SCORE_SUMS = [
    "count(judge_score) AS n_judged", f"sum({N.TENTHS}) AS score_sum", f"sum({N.TENTHS} * {N.TENTHS}) AS score_sq",
]


def _aggs(*expressions: str) -> list[Column]:
    return [F.expr(e) for e in expressions]


def _merge(*names: str) -> list[Column]:
    return _aggs(*[f"sum({n}) AS {n}" for n in names])


def _names(models: DataFrame, *extra: str) -> DataFrame:
    return models.select(F.col("id").alias("model_id"), F.col("name").alias("model"), *extra)


def named_results(results: DataFrame, models: DataFrame) -> DataFrame:
    """Result rows with their model's name; rows of unknown models drop out."""
    return results.join(_names(models), "model_id")


def _mean_score(scale: int = 1) -> Column:
    return N.mean_of_sums("score_sum", "n_judged", scale, unit=10)


def _stddev_score() -> Column:
    return F.round(N.stddev_of_sums("n_judged", "score_sum", "score_sq", unit=10), 2)


# --- run level ---------------------------------------------------------------

def run_metrics(runs: DataFrame, results: DataFrame) -> DataFrame:
    """Per run: counts, totals and latency distribution of its raw rows.

    All latency figures come from the (run, latency) histogram, so each column
    of the facts is read by one scan only. Models and cases are counted on the
    (run, model, case) cells that the facts fold to, not on the facts.
    """
    cells = results.groupBy("run_id", "model_id", "case_id").agg(*_aggs(
        "count(1) AS n", "sum(cost) AS cost", "sum(cast(input_tokens as bigint)) AS tin", "sum(cast(output_tokens as bigint)) AS tout",
    ))
    totals = cells.groupBy("run_id").agg(*_aggs(
        "sum(n) AS n_results", "count(DISTINCT model_id) AS n_models", "count(DISTINCT case_id) AS n_cases",
        "sum(cost) AS total_cost", "sum(tin) AS total_input_tokens", "sum(tout) AS total_output_tokens",
    ))
    latency = value_counts(results, ["run_id"], "latency_ms").groupBy("run_id").agg(
        N.mean_of_sums("sum(latency_ms * n)", "sum(n)", 2).alias("avg_latency_ms"),
        percentiles_of_counts("latency_ms", [0.5, 0.95]).alias("_p"),
        *_aggs("min(latency_ms) AS min_latency_ms", "max(latency_ms) AS max_latency_ms"),
    )
    zero = {c: F.coalesce(F.col(c), F.lit(0)) for c in (
        "n_results", "n_models", "n_cases", "total_cost", "total_input_tokens", "total_output_tokens")}
    return (
        runs.withColumnRenamed("id", "run_id")
        .join(totals, "run_id", "left")
        .join(latency, "run_id", "left")
        .select(
            "run_id", "dataset", "prompt_id", "started_at", "finished_at",
            N.duration_ms(F.col("started_at"), F.col("finished_at")).alias("duration_ms"),
            *[zero[c].alias(c) for c in ("n_results", "n_models", "n_cases")],
            zero["total_cost"].cast("double").alias("total_cost"),
            *[zero[c].alias(c) for c in ("total_input_tokens", "total_output_tokens")],
            "avg_latency_ms",
            F.col("_p")[0].alias("p50_latency_ms"), F.col("_p")[1].alias("p95_latency_ms"),
            "min_latency_ms", "max_latency_ms",
        )
    )


def cost_by_dataset(runs: DataFrame, results: DataFrame) -> DataFrame:
    """Mean total cost of a dataset's runs."""
    per_run = results.groupBy("run_id").agg(F.sum("cost").alias("total_cost"))
    return (
        runs.join(per_run, runs["id"] == per_run["run_id"], "left")
        .groupBy("dataset")
        .agg(F.sum(F.coalesce("total_cost", F.lit(0).cast("decimal(28,9)"))).alias("_sum"), F.count(F.lit(1)).alias("n_runs"))
        .select("dataset", "n_runs", N.mean_cost("_sum", "n_runs").alias("avg_total_cost"))
    )


# --- fairness: cases every model of the run completed ------------------------

def complete_cases(results: DataFrame) -> DataFrame:
    """(run, case) pairs comparable across all models of the run."""
    cells = results.groupBy("run_id", "case_id", "model_id").agg(
        F.max(F.col("judge_score").isNotNull()).alias("scored")
    )
    cases = cells.groupBy("run_id", "case_id").agg(
        F.count(F.lit(1)).alias("n_present"), F.count_if("scored").alias("n_scored")
    )
    # The roster comes from the same cells: the facts are read once.
    per_model = cells.groupBy("run_id", "model_id").agg(F.max("scored").alias("scored"))
    roster = per_model.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_models"), F.max("scored").alias("is_judged"))
    return (
        cases.join(roster, "run_id")
        .where("n_present = n_models AND (NOT is_judged OR n_scored = n_models)")
        .select("run_id", "case_id")
    )


def fair_results(results: DataFrame, complete: DataFrame) -> DataFrame:
    """Result rows of complete cases; a NULL case matches a NULL case.

    The keys are plain columns, so rows that are bucketed by run and case stay where
    they are. The few rows without a case are found by their run.
    """
    with_case = results.join(complete.where("case_id IS NOT NULL"), ["run_id", "case_id"], "left_semi")
    without = results.where("case_id IS NULL").join(complete.where("case_id IS NULL").select("run_id"), "run_id", "left_semi")
    return with_case.select(*results.columns).unionByName(without.select(*results.columns))


def _fair_sums(results: DataFrame) -> DataFrame:
    """Per (run, model id): additive sums over complete cases.

    One scan and no self-join. Rows collapse to (run, case, model) cells; each
    cell learns how many models of its case are present and scored; cells then
    fold by (run, model, present, scored), which leaves only a few rows per run
    to compare with the run's number of models. No step gathers a run's facts.
    """
    measures = {"in": "cast(input_tokens as bigint)", "out": "cast(output_tokens as bigint)",
                "lat": "cast(latency_ms as bigint)", "cost": "cost"}
    cells = results.groupBy("run_id", "case_id", "model_id").agg(*_aggs(
        "count(1) AS n_results", *_SCORE_SUMS,
        "sum(cast(latency_ms as bigint)) AS lat_all", "sum(cost) AS cost_all",
        "sum(cast(input_tokens as bigint) + output_tokens) AS tok_all",
        *[f"sum(CASE WHEN judge_score IS NOT NULL THEN {m} END) AS {k}_judged" for k, m in measures.items()],
    ))
    of_case = Window.partitionBy("run_id", "case_id")
    cells = cells.withColumns({
        "n_present": F.count(F.lit(1)).over(of_case),
        "n_scored": F.count_if(F.col("n_judged") > 0).over(of_case),
        "n_cases": F.col("case_id").isNotNull().cast("bigint"),
    })
    sums = ["n_results", "n_judged", "score_sum", "score_sq", "lat_all", "tok_all", "cost_all",
            "in_judged", "out_judged", "lat_judged", "cost_judged", "n_cases"]
    folded = cells.groupBy("run_id", "model_id", "n_present", "n_scored").agg(*_merge(*sums))
    # A run has at most models x (models + 1)^2 folded rows, whatever its size.
    of_run = Window.partitionBy("run_id")
    folded = folded.withColumns({
        "n_models": F.size(F.collect_set("model_id").over(of_run)),
        "is_judged": F.sum("n_judged").over(of_run) > 0,
    })
    fair = folded.where("n_present = n_models AND (NOT is_judged OR n_scored = n_models)")
    return fair.groupBy("run_id", "model_id").agg(*_merge(*sums))


_V7_SUMS = ["n_results", "n_judged", "score_sum", "score_sq", "lat_all", "tok_all", "cost_all"]
_V8_SUMS = ["n_judged", "score_sum", "score_sq", "lat_judged", "in_judged", "out_judged", "cost_judged"]


def model_metrics(results: DataFrame, models: DataFrame) -> DataFrame:
    """Per (model, run) on complete cases: the comparison board's figures.

    A complete case holds every model id of its run, so the ids that share a
    name have equal case counts and their maximum is the distinct count.
    """
    g = (
        _fair_sums(results).join(_names(models), "model_id")
        .groupBy("run_id", "model")
        .agg(*_merge(*_V7_SUMS), F.max("n_cases").alias("n_cases"))
    )
    return g.select(
        "model", "n_results",
        N.mean_of_sums("lat_all", "n_results", 2).alias("avg_latency_ms"),
        F.col("cost_all").cast("double").alias("total_cost"),
        _mean_score().alias("avg_judge_score"),
        "n_cases", _stddev_score().alias("stddev_judge_score"), "n_judged",
        N.mean_of_sums("tok_all", "n_results", 1).alias("avg_total_tokens"),
        "run_id",
    )


def model_decision_metrics(results: DataFrame, models: DataFrame) -> DataFrame:
    """Per (run, model, context window): judged rows of complete cases."""
    g = (
        _fair_sums(results).where("n_judged > 0")
        .join(_names(models, "context_window"), "model_id")
        .groupBy("run_id", "model", "context_window")
        .agg(*_merge(*_V8_SUMS), F.max("n_cases").alias("n_cases"))
    )
    efficiency = ("cast(round(cast(cast(score_sum as decimal(16,0)) / 10 as decimal(17,1))"
                  " / nullif(cast(cost_judged as decimal(24,9)), 0), 4) as double) AS efficiency")
    return g.select(
        "model", "n_judged", "n_cases",
        N.mean_of_sums("in_judged", "n_judged", 1).alias("avg_input_tokens"),
        N.mean_of_sums("out_judged", "n_judged", 1).alias("avg_output_tokens"),
        N.mean_of_sums("in_judged + out_judged", "n_judged", 1).alias("avg_total_tokens"),
        N.mean_of_sums("lat_judged", "n_judged", 2).alias("avg_latency_ms"),
        _mean_score().alias("mean_judge_score"),
        _stddev_score().alias("stddev_judge_score"),
        F.expr(efficiency),
        N.mean_of_sums("in_judged * 100", "n_judged * cast(context_window as bigint)", 3).alias("ctx_pct"),
        N.mean_cost("cost_judged", "n_judged").alias("avg_cost"),
        "run_id",
    )


# --- within-model diagnostics ------------------------------------------------

def style_metrics(results: DataFrame, models: DataFrame) -> DataFrame:
    """Per (model, prompt style) across all runs: judged and styled rows."""
    part = (
        results.where("prompt_style IS NOT NULL AND judge_score IS NOT NULL")
        .groupBy("model_id", "prompt_style")
        .agg(*_aggs(*_SCORE_SUMS[:2], f"min({N.TENTHS}) AS lo", f"max({N.TENTHS}) AS hi"))
    )
    return (
        part.join(_names(models), "model_id")
        .groupBy("model", "prompt_style")
        .agg(*_merge("n_judged", "score_sum"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        .select(
            "model", "prompt_style", F.col("n_judged").alias("n_results"),
            _mean_score().alias("avg_judge_score"),
            (F.col("lo") / F.lit(10)).alias("min_judge_score"),
            (F.col("hi") / F.lit(10)).alias("max_judge_score"),
        )
    )


def result_variance(results: DataFrame, models: DataFrame) -> DataFrame:
    """Per (run, model, case): spread of the repeated samples."""
    part = results.groupBy("run_id", "model_id", "case_id").agg(*_aggs(
        *_SCORE_SUMS, f"min({N.TENTHS}) AS lo", f"max({N.TENTHS}) AS hi",
        "count(1) AS n", "sum(cast(latency_ms as bigint)) AS lat", "sum(cost) AS cost",
    ))
    g = part.join(_names(models), "model_id").groupBy("run_id", "model", "case_id").agg(
        *_merge("n_judged", "score_sum", "score_sq", "n", "lat", "cost"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return g.select(
        "run_id", "model", "case_id", F.col("n_judged").alias("n_samples"),
        _mean_score().alias("mean_score"), _stddev_score().alias("stddev_score"),
        (F.col("lo") / F.lit(10)).alias("min_score"), (F.col("hi") / F.lit(10)).alias("max_score"),
        N.mean_of_sums("lat", "n", 2).alias("avg_latency_ms"),
        N.mean_cost("cost", "n").alias("avg_cost"),
    )


# The figures whose relation to the score is examined, as whole numbers.
_CONFOUNDERS = {"len": "output_tokens", "headers": "resp_style_headers", "bold": "resp_style_bold",
                "lists": "resp_style_ordered + resp_style_unordered"}


def style_confound(results: DataFrame, models: DataFrame) -> DataFrame:
    """Per (model, run): does the score move with length or formatting?

    Rows fold to whole-number moments by model id; only these meet the catalogue
    and are added up over the ids of a name, so no figure depends on the partitions.
    """
    names = [f"{k}_{m}" for k in _CONFOUNDERS for m in N.MOMENTS]
    part = results.where("judge_score IS NOT NULL").groupBy("run_id", "model_id").agg(
        F.count(F.lit(1)).alias("n_judged"), *[c for k, x in _CONFOUNDERS.items() for c in N.moments(N.TENTHS, x, k)])
    g = part.join(_names(models), "model_id").groupBy("model", "run_id").agg(*_merge("n_judged", *names))
    corr = lambda k: F.round(N.corr_of_moments(k), 3).alias(f"corr_score_{k}")
    return g.select("model", "run_id", "n_judged", corr("len"), F.round(N.slope_of_moments("len") / 10, 8).alias("slope_score_per_token"),
                    corr("headers"), corr("bold"), corr("lists"))


def result_review(results: DataFrame, models: DataFrame) -> DataFrame:
    """Every row with a failure label derived from the judge's wording."""
    rows = results.withColumn("_wording", F.lower("judge_reasoning"))
    return named_results(rows, models).select(
        "run_id", "model", "case_id", "sample_idx",
        F.col("judge_score").cast("double").alias("judge_score"),
        text.failure_type(F.col("judge_score"), F.col("_wording")).alias("failure_type"),
        "output_tokens", "question", "response", "judge_reasoning", "created_at",
    )


def failure_counts(results: DataFrame, models: DataFrame, max_score: float = 5.0) -> DataFrame:
    """Rows per failure label below a score cap."""
    return (
        result_review(results, models).where(F.col("judge_score") < max_score)
        .groupBy("failure_type").agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), "failure_type")
    )


# --- run summaries and gates -------------------------------------------------

def score_stats(results: DataFrame, models: DataFrame) -> DataFrame:
    """Per (run, model): unrounded mean, sample spread (0 for one draw), n."""
    part = results.where("judge_score IS NOT NULL").groupBy("run_id", "model_id").agg(*_aggs(*_SCORE_SUMS))
    g = (
        part.join(_names(models), "model_id").groupBy("run_id", "model")
        .agg(*_merge("n_judged", "score_sum", "score_sq"))
    )
    spread = N.stddev_of_sums("n_judged", "score_sum", "score_sq", unit=10)
    return g.select(
        "run_id", "model",
        (F.col("score_sum") / (F.col("n_judged") * 10)).alias("mean_score"),
        F.coalesce(spread, F.lit(0.0)).alias("stddev_score"),
        F.col("n_judged").alias("n"),
    )


def style_averages(results: DataFrame, models: DataFrame) -> DataFrame:
    """Per (run, model, prompt style): unrounded mean score and n."""
    part = (
        results.where("judge_score IS NOT NULL AND prompt_style <> ''")
        .groupBy("run_id", "model_id", "prompt_style").agg(*_aggs(*_SCORE_SUMS[:2]))
    )
    return (
        part.join(_names(models), "model_id").groupBy("run_id", "model", "prompt_style")
        .agg(*_merge("n_judged", "score_sum"))
        .select("run_id", "model", "prompt_style",
                (F.col("score_sum") / (F.col("n_judged") * 10)).alias("mean_score"),
                F.col("n_judged").alias("n"))
    )


def style_delta(results: DataFrame, models: DataFrame, baseline: str = "zero-shot",
                by: tuple[str, ...] = ()) -> DataFrame:
    """Each style's mean score minus the baseline style's, per model.

    ``by`` adds result columns (such as a case group) to the comparison. Both
    means come from the same partial sums, so there is no second scan.
    """
    keys = ["model", *by]
    part = (
        results.where("prompt_style IS NOT NULL AND judge_score IS NOT NULL")
        .groupBy("model_id", *by, "prompt_style").agg(*_aggs(*_SCORE_SUMS[:2]))
    )
    g = (
        part.join(_names(models), "model_id").groupBy(*keys, "prompt_style")
        .agg(*_merge("n_judged", "score_sum"))
        .withColumn("mean_score", F.col("score_sum") / (F.col("n_judged") * 10))
    )
    # One row per style in each window.
    base = F.max(F.when(F.col("prompt_style") == baseline, F.col("mean_score"))).over(Window.partitionBy(*keys))
    return g.select(*keys, "prompt_style", F.col("n_judged").alias("n"), "mean_score",
                    (F.col("mean_score") - base).alias("delta"))


def run_summary(planned: DataFrame, results: DataFrame, failed: DataFrame) -> DataFrame:
    """Per run: inserted and failed calls, spend and latency; zeros when empty.

    ``planned`` has a row per run; ``failed`` has (run_id, failed), the planned
    calls without a result row. Rows that were not planned, or stored twice, count
    as inserted and hide no failure.
    """
    got = results.groupBy("run_id").agg(*_aggs(
        "count(1) AS inserted", "sum(cost) AS total_cost",
        "sum(cast(input_tokens as bigint)) AS total_input_tokens",
        "sum(cast(output_tokens as bigint)) AS total_output_tokens",
        "min(cast(latency_ms as bigint)) AS min_latency_ms", "max(cast(latency_ms as bigint)) AS max_latency_ms",
        "sum(cast(latency_ms as bigint)) AS _lat",
    ))
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    return planned.select("run_id").join(got, "run_id", "left").join(failed, "run_id", "left").select(
        "run_id", z("inserted").alias("inserted"), z("failed").alias("failed"),
        z("total_cost").cast("double").alias("total_cost"),
        z("total_input_tokens").alias("total_input_tokens"),
        z("total_output_tokens").alias("total_output_tokens"),
        z("min_latency_ms").alias("min_latency_ms"),
        F.coalesce(F.col("_lat") / F.col("inserted"), F.lit(0.0)).alias("avg_latency_ms"),
        z("max_latency_ms").alias("max_latency_ms"),
    )


def regression_gate(stats: DataFrame, threshold: float | None) -> DataFrame:
    """Models whose unrounded mean is strictly below the threshold."""
    below = F.lit(False) if threshold is None else F.col("mean_score") < threshold
    return stats.where(below).select("run_id", "model", "mean_score").orderBy("run_id", "model")


def run_status(summary: DataFrame, gate: DataFrame) -> DataFrame:
    """Exit status per run: a failed gate outranks failed calls."""
    failed_gate = gate.select("run_id").distinct().withColumn("_gate", F.lit(True))
    return summary.join(failed_gate, "run_id", "left").select(
        "run_id",
        F.when(F.col("_gate"), schema.STATUS_REGRESSION)
        .when(F.col("failed") > 0, schema.STATUS_PARTIAL)
        .otherwise(schema.STATUS_OK).alias("status"),
    )
