"""The views of an evaluation store, for use from SQL text."""

from __future__ import annotations

from pyspark.sql import SparkSession

from gradeloom.operators import decisions, prompts, rollups
from gradeloom.sources.tables import EvalTables


def register_views(spark: SparkSession, tables: EvalTables) -> list[str]:
    """Make the five tables and the eleven views known to ``spark.sql`` by name.

    A view is a plan: a filter in the query, such as one on ``run_id``, reaches
    its scans. Returns the names.
    """
    t = tables
    metrics = rollups.model_decision_metrics(t.results, t.models)
    frames = {
        "models": t.models, "prompts": t.prompts, "runs": t.runs, "results": t.results, "decisions": t.decisions,
        "run_metrics": rollups.run_metrics(t.runs, t.results),
        "style_metrics": rollups.style_metrics(t.results, t.models),
        "result_variance": rollups.result_variance(t.results, t.models),
        "style_confound": rollups.style_confound(t.results, t.models),
        "result_review": rollups.result_review(t.results, t.models),
        "complete_cases": rollups.complete_cases(t.results),
        "model_metrics": rollups.model_metrics(t.results, t.models),
        "model_decision_metrics": metrics,
        "decision_summary": decisions.decision_summary(t.decisions, metrics),
        "decision_by_profile": decisions.decision_by_profile(t.decisions, metrics),
        "prompts_history": prompts.prompts_history(t.prompts),
    }
    for name, frame in frames.items():
        frame.createOrReplaceTempView(name)
    return list(frames)
