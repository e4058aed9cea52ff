"""Per-profile ranking of models and the reproducible decision log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gradeloom import schema
from gradeloom.functions.windows import number_rows
from gradeloom.operators.cases import violations

METRICS = list(schema.METRIC_DIRECTION)


# --- profiles ----------------------------------------------------------------

def shipped_profiles(spark: SparkSession) -> DataFrame:
    """The shipped profiles as (profile, metric, weight)."""
    rows = [(p, m, w) for p, ws in schema.PROFILE_WEIGHTS.items() for m, w in ws.items()]
    return spark.createDataFrame(rows, schema.PROFILES)


def validate_profiles(profiles: DataFrame) -> DataFrame:
    """One row per broken rule of a profile table whose weights are still text."""
    number = F.expr("try_cast(weight AS double)")
    rows = violations(profiles.where("metric IS NOT NULL"), ["profile", "metric"], [
        ("unknown_metric", ~F.col("metric").isin(METRICS)),
        ("bad_weight", F.coalesce((number < 0) | number.isNull() | F.isnan(number), F.lit(True))),
    ])
    whole = profiles.groupBy("profile").agg(
        F.count("metric").alias("_n"), F.sum(F.when(number > 0, number)).alias("_sum")
    )
    empty = whole.where("_n = 0").select("profile", F.lit("no_weights").alias("rule"))
    zero = whole.where("_n > 0 AND coalesce(_sum, 0) <= 0").select("profile", F.lit("all_zero").alias("rule"))
    return rows.unionByName(empty.unionByName(zero), allowMissingColumns=True)


def profile_named(profiles: DataFrame, name: str) -> DataFrame:
    """The weights of one profile; an unknown name is an error that lists the known ones."""
    is_it = F.col("profile") == name
    found = profiles.agg(
        F.collect_list(F.when(is_it, F.struct("profile", "metric", "weight"))).alias("w"),
        F.array_join(F.array_sort(F.collect_set("profile")), ", ").alias("known"))
    missing = F.raise_error(F.concat(F.lit(f"no profile {name!r}; known: "), F.col("known")))
    return found.select(F.explode(F.when(F.size("w") > 0, F.col("w")).otherwise(missing)).alias("e")).select("e.*")


def profile_fingerprints(profiles: DataFrame) -> DataFrame:
    """Hash of name and weights per profile; the order of weights is irrelevant.

    The hashed text is JSON with every digit of the weights, so no two profiles
    share a text and an edit of any digit changes it (at most seven weights).
    """
    weights = F.array_sort(F.collect_list(F.struct("metric", F.col("weight").cast("double").alias("weight"))))
    return profiles.groupBy("profile").agg(weights.alias("weights")).select(
        "profile", F.sha2(F.to_json(F.struct("profile", "weights")), 256).alias("fingerprint")
    )


# --- ranking -----------------------------------------------------------------

def _scaled(metrics: DataFrame, by: tuple[str, ...], keep: tuple[str, ...] = ()) -> DataFrame:
    """Metrics min-max scaled within a run and oriented so that 1 is best.

    NULL values and metrics without spread become 0.5. A window holds the
    models of one run, so its size is bounded by the catalogue.
    """
    of_run = Window.partitionBy(*by)
    scaled = []
    for name, higher_better in schema.METRIC_DIRECTION.items():
        v = F.col(name).cast("double")
        lo, hi = F.min(v).over(of_run), F.max(v).over(of_run)
        x = (v - lo) / F.nullif(hi - lo, F.lit(0.0))
        x = x if higher_better else 1.0 - x
        scaled.append(F.coalesce(x, F.lit(0.5)).alias(name))
    return metrics.select(*by, "model", *keep, *scaled)


def normalize_metrics(metrics: DataFrame, by: tuple[str, ...] = ("run_id",)) -> DataFrame:
    """Scaled metrics as rows (keys, model, metric, normalized)."""
    return _scaled(metrics, by).unpivot([*by, "model"], METRICS, "metric", "normalized")


def _weight_maps(profiles: DataFrame) -> Column:
    """The positive weights of every profile, as one array (an entry per profile).

    Unknown metrics and profiles without a positive weight are errors.
    """
    positive = F.col("weight") > 0
    known = F.when(F.col("metric").isin(METRICS), F.col("metric")).otherwise(
        F.raise_error(F.concat(F.lit("unknown metric "), F.col("metric"))))
    maps = profiles.groupBy("profile").agg(F.map_from_entries(
        F.collect_list(F.when(positive, F.struct(known.alias("metric"), "weight")))).alias("w"))
    checked = F.when(F.size("w") > 0, F.col("w")).otherwise(
        F.raise_error(F.concat(F.lit("no positive weight in profile "), F.col("profile"))))
    return maps.agg(F.collect_list(F.struct("profile", checked.alias("weights")))).scalar()


def rank_models(metrics: DataFrame, profiles: DataFrame, by: tuple[str, ...] = ("run_id",),
                keep: tuple[str, ...] = ()) -> DataFrame:
    """Weighted score and rank of each model, per run and profile.

    score = sum(weight * normalized) / sum(weight) over positive weights, added
    in metric order, so the double result never depends on the shuffle. The
    profiles ride along as one small array; every key starts with the run, so
    the exchange of the scaling also serves the ranking. ``keep`` names metrics
    columns to carry along.
    """
    rows = _scaled(metrics, by, keep).withColumn("_p", F.explode(_weight_maps(profiles)))
    weight = lambda m: F.coalesce(F.try_element_at(F.col("_p.weights"), F.lit(m)), F.lit(0.0))
    total, mass = F.lit(0.0), F.lit(0.0)
    for m in sorted(METRICS):
        total, mass = total + weight(m) * F.col(m), mass + weight(m)
    best_first = Window.partitionBy(*by, "profile").orderBy(F.desc("score"), "model")
    return rows.select(*by, "_p.profile", "model", *keep, (total / mass).alias("score")).withColumn(
        "rank", F.row_number().over(best_first)
    )


def _ranking() -> Column:
    """[{model, score}] best first, scores to four digits (one entry per model)."""
    ordered = F.array_sort(F.collect_list(F.struct("rank", "model", F.round("score", 4).alias("score"))))
    return F.transform(ordered, lambda r: F.struct(r["model"].alias("model"), r["score"].alias("score")))


def _confidence(margin: Column) -> Column:
    return (
        F.when(margin >= schema.CONFIDENCE_HIGH_MARGIN, schema.CONFIDENCE_HIGH)
        .when(margin >= schema.CONFIDENCE_MEDIUM_MARGIN, schema.CONFIDENCE_MEDIUM)
        .otherwise(schema.CONFIDENCE_LOW)
    )


def recommend(ranked: DataFrame, by: tuple[str, ...] = ("run_id",), more: tuple[Column, ...] = ()) -> DataFrame:
    """Winner, margin, confidence and ranking per run and profile.

    ``more`` adds aggregates over the ranked rows.
    """
    best = F.max(F.when(F.col("rank") == 1, F.col("score")))
    second = F.max(F.when(F.col("rank") == 2, F.col("score")))
    return ranked.groupBy(*by, "profile").agg(
        F.max(F.when(F.col("rank") == 1, F.col("model"))).alias("recommended_model"),
        (best - second).alias("margin"),
        _ranking().alias("weighted_scores"),
        *more,
    ).withColumn("confidence", _confidence(F.col("margin")))


# --- cache key ---------------------------------------------------------------

# Digits kept of each figure in the canonical text.
_CANONICAL = {
    "n_judged": 0, "n_cases": 0, "avg_input_tokens": 1, "avg_output_tokens": 1, "avg_total_tokens": 1,
    "avg_latency_ms": 2, "mean_judge_score": 1, "stddev_judge_score": 2, "efficiency": 4,
    "ctx_pct": 3, "avg_cost": 6,
}


def _metrics_json() -> Column:
    """One metrics row as JSON text, keys sorted, digits fixed."""
    figures = {
        c: F.coalesce(F.col(c).cast(f"decimal(28,{s})").cast("string"), F.lit("null"))
        for c, s in _CANONICAL.items()
    }
    return F.to_json(F.struct(*[{**figures, "model": F.col("model")}[k].alias(k) for k in sorted([*figures, "model"])]))


def _snapshot(json: Column) -> Column:
    """The JSON rows of a run as one array text, by model (one entry per model)."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col("model").alias("m"), json.alias("j"))))
    return F.concat(F.lit("["), F.array_join(F.transform(ordered, lambda r: r["j"]), ","), F.lit("]"))


def canonical_metrics(metrics: DataFrame) -> DataFrame:
    """Per run: its metrics as one JSON text, rows by model, keys sorted."""
    return metrics.groupBy("run_id").agg(_snapshot(_metrics_json()).alias("input_snapshot"))


def _input_hash(fingerprint: Column) -> Column:
    return F.sha2(F.concat_ws("\x1e", "input_snapshot", fingerprint, F.col("run_id").cast("string")), 256)


def _fingerprint_list(profiles: DataFrame) -> Column:
    """Fingerprint of every profile, as one small array."""
    return profile_fingerprints(profiles).agg(F.collect_list(F.struct("profile", "fingerprint"))).scalar()


def decision_keys(metrics: DataFrame, profiles: DataFrame) -> DataFrame:
    """Cache key per (run, profile) over metrics, profile weights and run."""
    pairs = canonical_metrics(metrics).withColumn("_p", F.explode(_fingerprint_list(profiles)))
    return pairs.select("run_id", "_p.profile", "input_snapshot",
                        _input_hash(F.col("_p.fingerprint")).alias("input_hash"))


# --- decide or replay --------------------------------------------------------

def keyed_recommendations(metrics: DataFrame, profiles: DataFrame) -> DataFrame:
    """Recommendation, metrics snapshot and cache key per (run, profile).

    The snapshot is gathered from the ranked rows themselves, so the metrics
    are computed once for the ranking and the key.
    """
    ranked = rank_models(metrics.withColumn("_json", _metrics_json()), profiles, keep=("_json",))
    reco = recommend(ranked, more=(_snapshot(F.col("_json")).alias("input_snapshot"),))
    prints = F.map_from_entries(_fingerprint_list(profiles))
    return reco.withColumn("input_hash", _input_hash(F.element_at(prints, F.col("profile"))))


def decide(metrics: DataFrame, profiles: DataFrame, decisions: DataFrame, prompt_id: int | None,
           force: bool = False, justifications: DataFrame | None = None) -> DataFrame:
    """One decision per run and profile: replayed from the log or computed.

    A logged decision with the same cache key, prompt and profile is replayed,
    the newest first, with every column as it was stored; ``force`` ignores the
    log. ``justifications`` adds the written columns (determinant_metrics,
    tradeoffs, reasoning) to new rows only.
    """
    fresh = (
        keyed_recommendations(metrics, profiles)
        .withColumn("prompt_id", F.lit(prompt_id).cast("bigint"))
    )
    if justifications is not None:
        fresh = fresh.join(justifications, ["run_id", "profile"], "left")
    log = decisions.where(F.lit(False)) if force else decisions
    stored = [c for c in schema.DECISIONS.fieldNames()
              if c in decisions.columns and c not in ("id", "input_hash", "prompt_id", "profile", "run_id")]
    last = (
        log.groupBy("input_hash", "prompt_id", "profile")
        .agg(F.max_by(
            F.struct("id", *stored),
            F.struct("created_at", "id")).alias("_hit"))
        .select(F.col("input_hash").alias("_h"), F.col("prompt_id").alias("_q"), F.col("profile").alias("_f"), "_hit")
    )
    same = (
        (fresh["input_hash"] == F.col("_h")) & fresh["prompt_id"].eqNullSafe(F.col("_q"))
        & fresh["profile"].eqNullSafe(F.col("_f"))
    )
    hit = F.col("_hit").isNotNull()
    kept = {c: F.when(hit, F.col(f"_hit.{c}")).otherwise(F.col(c) if c in fresh.columns else F.lit(None)) for c in stored}
    return (
        fresh.join(last, same, "left")
        .withColumns({**kept, "replayed": F.col("_hit").isNotNull(), "decision_id": F.col("_hit.id")})
        .drop("_h", "_q", "_f", "_hit")
    )


def decisions_to_insert(decided: DataFrame, log: DataFrame, now) -> DataFrame:
    """The computed, not replayed, decisions as rows of the log."""
    new = number_rows(decided.where(~F.col("replayed")), "input_hash", ["profile"], log)
    new = new.withColumn("created_at", F.lit(str(now)).cast("timestamp_ntz"))
    return new.select(*[
        (F.col(f.name) if f.name in new.columns else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in schema.DECISIONS
    ])


def logged_once(log: DataFrame, new: DataFrame, timed: bool = False) -> DataFrame:
    """``log`` and the new decisions whose input hash, prompt and profile it lacks.

    With ``timed`` the time of creation belongs to the key, so that a forced
    decision stands beside the one before it.
    """
    key = ["input_hash", "prompt_id", "profile", *(["created_at"] if timed else [])]
    known = log.select(*[F.col(c).alias(f"_{c}") for c in key]).distinct()
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in key]
    return log.unionByName(new.join(known, same, "left_anti").select(*log.columns))


def metrics_feed(metrics: DataFrame, run_id: int | Column) -> DataFrame:
    """One run's metrics, by model; the run may be a scalar subquery."""
    return metrics.where(F.col("run_id") == run_id).orderBy("model")


# --- views over the log ------------------------------------------------------

def _one_per_model(metrics: DataFrame) -> DataFrame:
    """One metrics row per (run, model): the largest context-window group."""
    keep = Window.partitionBy("run_id", "model").orderBy(F.desc("n_judged"), "avg_cost")
    return metrics.withColumn("_rank", F.row_number().over(keep)).where("_rank = 1").drop("_rank")


def _with_metrics(decisions: DataFrame, metrics: DataFrame, columns: list[str]) -> DataFrame:
    m = _one_per_model(metrics).select(
        F.col("model").alias("_model"), F.col("run_id").alias("_run"), *columns)
    same = (decisions["recommended_model"] == m["_model"]) & decisions["run_id"].eqNullSafe(m["_run"])
    return decisions.join(m, same, "left").drop("_model", "_run")


def decision_summary(decisions: DataFrame, metrics: DataFrame) -> DataFrame:
    """The latest decision of all, with its model's metrics in the same run."""
    last = decisions.orderBy(F.desc("created_at"), F.desc("id")).limit(1)
    figures = ["mean_judge_score", "stddev_judge_score", "avg_total_tokens", "efficiency",
               "avg_latency_ms", "ctx_pct", "avg_cost", "n_judged"]
    return _with_metrics(last, metrics, figures).select(
        F.col("id").alias("decision_id"), "recommended_model", "confidence", "reasoning", "tradeoffs",
        "determinant_metrics", "created_at", *figures, "run_id",
    )


def latest_per_profile(decisions: DataFrame) -> DataFrame:
    """Newest decision of each (run, profile); rows without a profile drop out."""
    newest = Window.partitionBy("run_id", "profile").orderBy(F.desc("created_at"), F.desc("id"))
    return (
        decisions.where("profile IS NOT NULL")
        .withColumn("_rank", F.row_number().over(newest)).where("_rank = 1").drop("_rank")
    )


def decision_by_profile(decisions: DataFrame, metrics: DataFrame) -> DataFrame:
    """Newest decision per (run, profile) with top score and model metrics."""
    figures = ["mean_judge_score", "efficiency", "avg_total_tokens", "avg_latency_ms",
               "ctx_pct", "avg_cost", "n_judged"]
    return _with_metrics(latest_per_profile(decisions), metrics, figures).select(
        "profile", "recommended_model", "confidence",
        F.round(F.get("weighted_scores", F.lit(0))["score"], 4).alias("top_score"),
        "reasoning", "tradeoffs", "determinant_metrics", "weighted_scores", "created_at", *figures, "run_id",
    )


def ranking_rows(by_profile: DataFrame) -> DataFrame:
    """The stored ranking as rows, best first."""
    return by_profile.select("run_id", "profile", F.explode("weighted_scores").alias("_e")).select(
        "run_id", "profile", "_e.model", "_e.score"
    ).orderBy("run_id", "profile", F.desc("score"))
