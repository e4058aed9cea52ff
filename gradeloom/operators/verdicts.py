"""Judge answers: parsing, scaling, attaching to result rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeloom.functions.numeric import scale_verdict
from gradeloom.functions.verdict_json import parse_justification, parse_verdict


def parse_verdicts(raw: DataFrame, column: str = "raw") -> DataFrame:
    """Score on the 0..5 scale and reasoning, or a reject reason."""
    return (
        raw.withColumn("_v", parse_verdict(F.col(column)))
        .withColumns({
            "judge_score": scale_verdict(F.col("_v.score_text")),
            "judge_reasoning": F.col("_v.reasoning"),
            "reject": F.col("_v.reject"),
        })
        .drop("_v", column)
    )


def parse_justifications(raw: DataFrame, column: str = "raw") -> DataFrame:
    """Determinant metrics, trade-offs and reasoning, or a reject reason."""
    return raw.withColumn("_j", parse_justification(F.col(column))).select(
        *[c for c in raw.columns if c != column], "_j.*"
    )


def apply_verdicts(results: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Write valid verdicts (id, judge_score, judge_reasoning) onto result rows.

    Several verdicts for one row fold to the last by ``judged_at``, equal times by
    score and reasoning. Without that column a second valid verdict for a row is
    an error. A rejected verdict changes nothing. Verdicts with a ``run_id`` join
    on (run_id, id), which a store clustered by run answers from those runs.
    """
    valid = verdicts.where("judge_score IS NOT NULL")
    key = ["run_id", "id"] if "run_id" in verdicts.columns else ["id"]
    timed = ["judged_at"] if "judged_at" in verdicts.columns else []
    last = F.max_by(F.struct("judge_score", "judge_reasoning"), F.struct(*timed, "judge_score", "judge_reasoning"))
    several = F.lit(False) if timed else F.count(F.lit(1)) > 1
    new = valid.groupBy(*key).agg(last.alias("_last"), several.alias("_several")).select(
        *key, F.when(F.col("_several"), F.raise_error(F.concat(F.lit("several verdicts, in no order, for row "), F.col("id"))).cast(
            "struct<judge_score:decimal(3,1),judge_reasoning:string>")).otherwise(F.col("_last")).alias("_new"))
    return results.join(new, key, "left").withColumns({
        "judge_score": F.coalesce("_new.judge_score", "judge_score"),
        "judge_reasoning": F.when(F.col("_new").isNotNull(), F.col("_new.judge_reasoning")).otherwise(F.col("judge_reasoning")),
    }).drop("_new")
