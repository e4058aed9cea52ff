"""Queries over the roll-up views, the rankings, the gates and the boards."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gradeloom import schema
from gradeloom.functions.text import content_hash
from gradeloom.operators import cases as C
from gradeloom.operators import catalog as K
from gradeloom.operators import decisions as D
from gradeloom.operators import rollups as R
from gradeloom.operators import style as S
from gradeloom.plans import boards as B
from gradeloom.plans import oracle as O
from gradeloom.plans.basic_queries import (
    _NAN, _OBS, _PLAN, CANONICAL, by_profile, dataset_cases, decision_metrics, requests,
)
from gradeloom.plans.registry import query
from gradeloom.session import materialized
from gradeloom.sources import bed
from gradeloom.sources.tables import EvalTables
from gradeloom.sources.views import register_views


def _pair(spark, d):
    return bed.results(spark, d), bed.models(spark, d)


def _joined(df):
    """The list of metrics as one text, which every engine compares alike."""
    return df.withColumn("determinant_metrics", F.array_join("determinant_metrics", ","))


def _model_metrics(spark, d):
    return R.model_metrics(*_pair(spark, d))


# --- views -------------------------------------------------------------------

_P = "round(p50_latency_ms, 4) AS p50_latency_ms, round(p95_latency_ms, 4) AS p95_latency_ms"


@query("v01_run_metrics", f"""SELECT run_id, dataset, prompt_id, started_at, finished_at, duration_ms, n_results, n_models, n_cases,
    total_cost, total_input_tokens, total_output_tokens, avg_latency_ms, {_P}, min_latency_ms, max_latency_ms FROM run_metrics""")
def run_metrics(spark, d):
    p = {c: F.round(c, 4) for c in ("p50_latency_ms", "p95_latency_ms")}
    return R.run_metrics(bed.runs(spark, d), bed.results(spark, d)).withColumns(p)


@query("v02_style_metrics", f"""SELECT model, prompt_style, count(*) AS n_results, {O.mean('sum(tenths)', 'count(*)', 1, 10)} AS avg_judge_score,
    min(tenths) / 10.0 AS min_judge_score, max(tenths) / 10.0 AS max_judge_score FROM named
    WHERE prompt_style IS NOT NULL AND tenths IS NOT NULL GROUP BY model, prompt_style""")
def style_metrics(spark, d):
    return R.style_metrics(*_pair(spark, d))


_CORR = lambda x: _NAN.format(f"corr(tenths, {x})", 3)


@query("v04_style_confound", f"""SELECT model, count(tenths) AS n_judged, {_CORR('output_tokens')} AS corr_score_len,
    {_NAN.format('regr_slope(tenths / 10.0, output_tokens)', 8)} AS slope_score_per_token,
    {_CORR('resp_style_headers')} AS corr_score_headers, {_CORR('resp_style_bold')} AS corr_score_bold,
    {_CORR('resp_style_ordered + resp_style_unordered')} AS corr_score_lists, run_id
    FROM named WHERE tenths IS NOT NULL GROUP BY model, run_id""")
def style_confound(spark, d):
    return R.style_confound(*_pair(spark, d))


@query("v05_result_review", "SELECT * FROM review")
def result_review(spark, d):
    return R.result_review(*_pair(spark, d))


@query("v06_complete_cases", "SELECT run_id, case_id FROM complete")
def complete_cases(spark, d):
    return R.complete_cases(bed.results(spark, d))


@query("v07_model_metrics", "SELECT * FROM mm")
def model_metrics(spark, d):
    return _model_metrics(spark, d)


@query("v08_model_decision_metrics", "SELECT * FROM mdm")
def model_decision_metrics(spark, d):
    return decision_metrics(spark, d)


@query("v08_context_windows", "SELECT m.*, n.n AS n_windows FROM mdm m JOIN (SELECT run_id, model, count(*) AS n FROM mdm GROUP BY run_id, model) n ON n.run_id = m.run_id AND n.model = m.model",
       models=O.TWO_WINDOWS)
def context_windows(spark, d):
    """A name whose ids have two context windows gives two rows per run."""
    models = bed.models(spark, d).withColumn("context_window", F.expr("CASE WHEN id <> 7 THEN 100000 * id END").cast("int"))
    metrics = R.model_decision_metrics(bed.results(spark, d), models)
    return metrics.withColumn("n_windows", F.count(F.lit(1)).over(Window.partitionBy("run_id", "model")))


@query("v09_decision_summary", """SELECT d.id AS decision_id, d.recommended_model, d.confidence, d.reasoning, d.tradeoffs, array_to_string(d.determinant_metrics, ',') AS determinant_metrics,
    d.created_at, m.mean_judge_score, m.stddev_judge_score, m.avg_total_tokens, m.efficiency, m.avg_latency_ms, m.ctx_pct, m.avg_cost,
    m.n_judged, d.run_id FROM decisions d LEFT JOIN mdm m ON m.model = d.recommended_model AND m.run_id IS NOT DISTINCT FROM d.run_id
    ORDER BY d.created_at DESC, d.id DESC LIMIT 1""")
def decision_summary(spark, d):
    return _joined(D.decision_summary(bed.decisions(spark, d), decision_metrics(spark, d)))


@query("v10_decision_by_profile", """SELECT profile, recommended_model, confidence, top_score, reasoning, tradeoffs, array_to_string(determinant_metrics, ',') AS determinant_metrics,
    created_at, mean_judge_score, efficiency, avg_total_tokens, avg_latency_ms, ctx_pct, avg_cost, n_judged, run_id FROM by_profile""")
def decision_by_profile(spark, d):
    return _joined(by_profile(spark, d).drop("weighted_scores"))


# --- ranking, cache, feed ----------------------------------------------------

@query("m01_call_cost", """SELECT r.id, CAST((r.input_tokens + 3 * r.output_tokens) * m.price AS DOUBLE) / 1000000 AS cost
    FROM results r JOIN models m ON m.id = r.model_id""")
def call_cost(spark, d):
    rows, models = _pair(spark, d)
    return K.call_cost(rows.drop("cost"), models).select("id", F.col("cost").cast("double").alias("cost"))


@query("m07_rank_models", "SELECT run_id, profile, model, round(score, 9) AS score, CAST(rank AS INTEGER) AS rank FROM ranked")
def rank_models(spark, d):
    return D.rank_models(decision_metrics(spark, d), D.shipped_profiles(spark)).withColumn("score", F.round("score", 9))


@query("m08_confidence", "SELECT run_id, profile, recommended_model, confidence FROM reco")
def confidence(spark, d):
    ranked = D.rank_models(decision_metrics(spark, d), D.shipped_profiles(spark))
    return D.recommend(ranked).select("run_id", "profile", "recommended_model", "confidence")


_KNOWN = ", ".join(f"'{m}'" for m in schema.METRIC_DIRECTION)
_PROFILE_FILE = f"""WITH file AS (SELECT p_brand || '/' || p_type AS profile,
        CASE WHEN p_size = 1 THEN NULL ELSE [{_KNOWN}, 'tokens_per_line'][CAST(p_partkey % 8 AS INTEGER) + 1] END AS metric,
        CASE WHEN p_size = 50 THEN 'true' WHEN p_size < 25 THEN '0' ELSE CAST(p_size - 27 AS VARCHAR) END AS weight FROM part),
    typed AS (SELECT *, TRY_CAST(weight AS DOUBLE) AS w FROM file)
    """


@query("m09_validate_profiles", _PROFILE_FILE + f"""SELECT profile, metric, 'unknown_metric' AS rule FROM typed WHERE metric NOT IN ({_KNOWN})
    UNION ALL SELECT profile, metric, 'bad_weight' FROM typed WHERE metric IS NOT NULL AND (w IS NULL OR w < 0 OR weight = 'true')
    UNION ALL SELECT profile, NULL, 'no_weights' FROM typed GROUP BY profile HAVING count(metric) = 0
    UNION ALL SELECT profile, NULL, 'all_zero' FROM typed GROUP BY profile HAVING count(metric) > 0
        AND coalesce(sum(w) FILTER (WHERE w > 0 AND weight <> 'true'), 0) <= 0""")
def validate_profiles(spark, d):
    names = ", ".join(f"'{m}'" for m in schema.METRIC_DIRECTION)
    file = bed.table(spark, d, "part").selectExpr(
        "concat(p_brand, '/', p_type) AS profile",
        f"CASE WHEN p_size = 1 THEN NULL ELSE element_at(array({names}, 'tokens_per_line'), cast(p_partkey % 8 as int) + 1) END AS metric",
        "CASE WHEN p_size = 50 THEN 'true' WHEN p_size < 25 THEN '0' ELSE cast(p_size - 27 as string) END AS weight")
    return D.validate_profiles(file)


_PRINT = """SELECT profile, sha256('{"profile":' || to_json(profile) || ',"weights":[' || string_agg('{"metric":' || to_json(metric)
    || ',"weight":' || CAST(CAST(weight AS DOUBLE) AS VARCHAR) || '}', ',' ORDER BY metric) || ']}') AS fingerprint"""


@query("m10_profile_fingerprint", f"""{_PRINT} FROM (SELECT p_brand AS profile, p_type AS metric, sum(p_size) / 100.0 AS weight
    FROM part GROUP BY p_brand, p_type) GROUP BY profile""")
def profile_fingerprint(spark, d):
    weights = bed.table(spark, d, "part").groupBy(F.col("p_brand").alias("profile"), F.col("p_type").alias("metric")).agg(
        (F.sum("p_size") / F.lit(100)).alias("weight"))
    return D.profile_fingerprints(weights)


@query("m11_decision_keys", f"""WITH texts AS ({CANONICAL}), prints AS ({_PRINT} FROM profiles GROUP BY profile)
    SELECT t.run_id, p.profile, sha256(t.input_snapshot || chr(30) || p.fingerprint || chr(30) || t.run_id) AS input_hash
    FROM texts t, prints p""")
def decision_keys(spark, d):
    return D.decision_keys(decision_metrics(spark, d), D.shipped_profiles(spark)).drop("input_snapshot")


@query("m12_decide_or_replay", """SELECT run_id, profile, CASE WHEN profile IN ('rapide', 'economie') THEN 'logged' ELSE recommended_model END AS recommended_model,
    confidence, profile IN ('rapide', 'economie') AS replayed, CASE WHEN profile IN ('rapide', 'economie') THEN 'as stored' ELSE 'new' END AS reasoning,
    CASE WHEN profile IN ('rapide', 'economie') THEN TIMESTAMP '2024-06-01' END AS created_at FROM reco""")
def decide_or_replay(spark, d):
    # The metrics serve the log of the earlier decisions and the decision itself.
    metrics, profiles = materialized(decision_metrics(spark, d), "metrics"), D.shipped_profiles(spark)
    logged = profiles.where("profile IN ('rapide', 'economie')")
    log = D.keyed_recommendations(metrics, logged).selectExpr(
        "run_id AS id", "'logged' AS recommended_model", "confidence", "weighted_scores", "input_hash",
        "cast(7 as bigint) AS prompt_id", "profile", "timestamp_ntz'2024-06-01 00:00:00' AS created_at", "'as stored' AS reasoning")
    log = materialized(log, "log")
    prose = bed.runs(spark, d).select(F.col("id").alias("run_id"), F.lit("new").alias("reasoning"),
                                      F.explode(F.array(*map(F.lit, schema.PROFILE_WEIGHTS))).alias("profile"))
    decided = D.decide(metrics, profiles, log, prompt_id=7, justifications=prose)
    return decided.select("run_id", "profile", "recommended_model", "confidence", "replayed", "reasoning", "created_at")


@query("m13_metrics_feed", "SELECT * FROM mdm WHERE run_id = (SELECT max(run_id) FROM results WHERE tenths IS NOT NULL)")
def metrics_feed(spark, d):
    newest = bed.results(spark, d).where("judge_score IS NOT NULL").agg(F.max("run_id")).scalar()
    return D.metrics_feed(decision_metrics(spark, d), newest)


# --- style control -----------------------------------------------------------

@query("m03_style_observations", _OBS.format(keys="run_id, ", more=""))
def style_observations(spark, d):
    return S.style_observations(*_pair(spark, d), by=("run_id",))


def _least_squares() -> str:
    """Slopes by successive residuals: features are cleared of the model means,
    then of each other in turn; the slopes follow by back-substitution."""
    f = S.FEATURES
    cols = [*f, "judge_score"]
    base = _OBS.format(keys="", more="")
    parts = [f"WITH obs AS (SELECT *, ln(1 + output_tokens) AS log1p_tokens FROM ({base}))",
             "s0 AS (SELECT model, case_id, " + ", ".join(f"{c} - avg({c}) OVER (PARTITION BY model) AS {c}" for c in cols) + " FROM obs)"]
    for i, name in enumerate(f):
        rest = cols[i + 1:]
        ratio = lambda c: f"(SELECT sum({c} * {name}) / sum({name} * {name}) FROM s{i})"
        parts.append(f"r{i} AS (SELECT " + ", ".join(f"{ratio(c)} AS {c}" for c in rest) + ")")
        parts.append(f"s{i + 1} AS (SELECT s.model, s.case_id{''.join(f', s.{c}' for c in f[:i + 1])}, "
                     + ", ".join(f"s.{c} - r.{c} * s.{name} AS {c}" for c in rest) + f" FROM s{i} s, r{i} r)")
    slopes = {}
    for i in reversed(range(len(f))):
        later = "".join(f" - (SELECT {g} FROM r{i}) * b_{g}" for g in f[i + 1:])
        slopes[f[i]] = f"(SELECT judge_score FROM r{i}){later}"
    prev = None
    for name in reversed(f):
        source = f" FROM b{prev}" if prev else ""
        keep = f"b{prev}.*, " if prev else ""
        parts.append(f"b{name} AS (SELECT {keep}{slopes[name]} AS b_{name}{source})")
        prev = name
    return ", ".join(parts) + " "


_FIT = _least_squares()
_GRAND = " + ".join(f"b_{c} * (SELECT avg({c}) FROM obs)" for c in S.FEATURES)
_OWN = " + ".join(f"b_{c} * avg(o.{c})" for c in S.FEATURES)
_ADJUSTED = f"avg(o.judge_score) - ({_OWN}) + ({_GRAND})"


@query("m04_style_fit", _FIT + "SELECT o.model, count(*) AS n, round(avg(o.judge_score), 6) AS raw_mean, "
       f"round({_ADJUSTED}, 6) AS adjusted, "
       + ", ".join(f"round(b_{c}, 6) AS slope_{c}" for c in S.FEATURES)
       + ", (SELECT count(*) FROM obs) AS n_obs, false AS rank_deficient"
       + f" FROM obs o, b{S.FEATURES[0]} GROUP BY o.model, " + ", ".join(f"b_{c}" for c in S.FEATURES))
def style_fit(spark, d):
    fit = S.fit_style_model(S.style_observations(*_pair(spark, d)))
    return fit.withColumns({c: F.round(c, 6) for c in fit.columns if c.startswith(("slope_", "raw", "adj"))})


@query("m04_fit_status", f"""SELECT run_id, count(*) AS n_obs, count(DISTINCT model) AS n_models,
    CASE WHEN count(*) < 90 THEN 'only ' || count(*) || ' observations, 90 are needed' END AS reason
    FROM ({_OBS.format(keys="run_id, ", more="")}) GROUP BY run_id""")
def fit_status(spark, d):
    return S.fit_status(S.style_observations(*_pair(spark, d), by=("run_id",)), by=("run_id",), min_obs=90)


@query("m05_style_report", _FIT + f"SELECT o.model, round(avg(o.judge_score), 6) AS raw_mean, round({_ADJUSTED}, 6) AS adjusted, "
       f"round({_ADJUSTED} - avg(o.judge_score), 6) AS delta, count(*) AS n, false AS rank_deficient FROM obs o, b{S.FEATURES[0]} "
       + "GROUP BY o.model, " + ", ".join(f"b_{c}" for c in S.FEATURES))
def style_report(spark, d):
    fit = S.style_report(S.fit_style_model(S.style_observations(*_pair(spark, d))))
    return fit.withColumns({c: F.round(c, 6) for c in ("raw_mean", "adjusted", "delta")})


@query("m05_style_slopes", _FIT + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, round(b_{c}, 6) AS slope FROM b{S.FEATURES[0]}" for c in S.FEATURES))
def style_slopes(spark, d):
    fit = S.fit_style_model(S.style_observations(*_pair(spark, d)))
    return S.style_slopes(fit).withColumn("slope", F.round("slope", 6))


# --- run summaries and gates -------------------------------------------------

_SUMMARY = _PLAN.format(samples=8) + """, planned AS (SELECT run_id, count(*) AS n_planned FROM plan GROUP BY run_id),
    lost AS (SELECT run_id, count(*) AS n FROM plan p WHERE NOT EXISTS (SELECT 1 FROM results r WHERE r.run_id = p.run_id
        AND r.model_id = p.model_id AND r.case_id = p.case_id AND r.sample_idx = p.sample_idx) GROUP BY run_id),
    summary AS (SELECT p.run_id, count(r.id) AS inserted, coalesce((SELECT n FROM lost l WHERE l.run_id = p.run_id), 0) AS failed,
        CAST(coalesce(sum(r.micro), 0) AS DOUBLE) / 1000000 AS total_cost,
        coalesce(sum(r.input_tokens), 0)::BIGINT AS total_input_tokens, coalesce(sum(r.output_tokens), 0)::BIGINT AS total_output_tokens,
        coalesce(min(r.latency_ms), 0)::BIGINT AS min_latency_ms, coalesce(CAST(sum(r.latency_ms) AS DOUBLE) / count(r.id), 0.0) AS avg_latency_ms,
        coalesce(max(r.latency_ms), 0)::BIGINT AS max_latency_ms
        FROM planned p LEFT JOIN results r ON r.run_id = p.run_id GROUP BY p.run_id, p.n_planned)
    """


def _summary(spark, d):
    asked, cases, results = requests(spark, d, 8), dataset_cases(spark, d), bed.results(spark, d)
    return R.run_summary(C.planned_counts(asked, cases), results, C.failed_counts(asked, cases, results))


@query("m14_run_summary", _SUMMARY + "SELECT * FROM summary")
def run_summary(spark, d):
    return _summary(spark, d)


@query("m15_score_stats", "SELECT run_id, model, mean_score, round(stddev_score, 9) AS stddev_score, n FROM stats")
def score_stats(spark, d):
    return R.score_stats(*_pair(spark, d)).withColumn("stddev_score", F.round("stddev_score", 9))


@query("m16_style_averages", """SELECT run_id, model, prompt_style, CAST(sum(tenths) AS DOUBLE) / CAST(count(*) * 10 AS DOUBLE) AS mean_score,
    count(*) AS n FROM named WHERE tenths IS NOT NULL AND prompt_style IS NOT NULL GROUP BY run_id, model, prompt_style""")
def style_averages(spark, d):
    return R.style_averages(*_pair(spark, d))


@query("m17_regression_gate", "SELECT run_id, model, mean_score FROM stats WHERE mean_score < 2.5")
def regression_gate(spark, d):
    return R.regression_gate(R.score_stats(*_pair(spark, d)), 2.5)


@query("m18_run_status", _SUMMARY + """SELECT s.run_id, CASE WHEN EXISTS (SELECT 1 FROM stats t WHERE t.run_id = s.run_id AND t.mean_score < 2.3)
    THEN 5 WHEN s.failed > 0 THEN 3 ELSE 0 END AS status FROM summary s""")
def run_status(spark, d):
    return R.run_status(_summary(spark, d), R.regression_gate(R.score_stats(*_pair(spark, d)), 2.3))


@query("m22_style_delta", """WITH means AS (SELECT model, prompt_style, count(*) AS n, CAST(sum(tenths) AS DOUBLE) / CAST(count(*) * 10 AS DOUBLE) AS mean_score
        FROM named WHERE tenths IS NOT NULL AND prompt_style IS NOT NULL GROUP BY model, prompt_style)
    SELECT a.model, a.prompt_style, a.n, a.mean_score, round(a.mean_score - b.mean_score, 9) AS delta FROM means a
    LEFT JOIN means b ON b.model = a.model AND b.prompt_style = 'zero-shot'""")
def style_delta(spark, d):
    return R.style_delta(*_pair(spark, d)).withColumn("delta", F.round("delta", 9))


@query("m22_style_delta_by_run", """WITH means AS (SELECT model, run_id, prompt_style, count(*) AS n, CAST(sum(tenths) AS DOUBLE) / CAST(count(*) * 10 AS DOUBLE) AS mean_score
        FROM named WHERE tenths IS NOT NULL AND prompt_style IS NOT NULL GROUP BY model, run_id, prompt_style)
    SELECT a.model, a.run_id, a.prompt_style, a.n, a.mean_score, round(a.mean_score - b.mean_score, 9) AS delta FROM means a
    LEFT JOIN means b ON b.model = a.model AND b.run_id = a.run_id AND b.prompt_style = 'zero-shot'""")
def style_delta_by_run(spark, d):
    return R.style_delta(*_pair(spark, d), by=("run_id",)).withColumn("delta", F.round("delta", 9))


# --- boards ------------------------------------------------------------------

@query("q01_run_picker", "SELECT id AS value, dataset || ' #' || id AS text FROM runs")
def run_picker(spark, d):
    return B.run_picker(bed.runs(spark, d))


def _panel(name: str, measure: str, descending: bool = True) -> None:
    @query(name, f"SELECT run_id, model, {measure} FROM mm WHERE {measure} IS NOT NULL")
    def panel(spark, d):
        return B.panel(_model_metrics(spark, d), measure, descending=descending)


_panel("q02_latency_panel", "avg_latency_ms", descending=False)
_panel("q02_score_panel", "avg_judge_score")
_panel("q02_cost_panel", "total_cost")
_panel("q02_tokens_panel", "avg_total_tokens")


@query("q03_mean_and_spread", """SELECT run_id, model, avg_judge_score AS mean_score, CASE WHEN n_judged > n_cases THEN stddev_judge_score END AS stddev_score,
    n_cases, n_judged AS n_samples FROM mm WHERE avg_judge_score IS NOT NULL""")
def mean_and_spread(spark, d):
    return B.mean_and_spread(_model_metrics(spark, d))


_LOG = """SELECT id, created_at, case_id, model, {style}question, response, tenths / 10.0 AS judge_score, judge_reasoning
    FROM named WHERE run_id = (SELECT max(id) FROM runs) ORDER BY created_at DESC, id DESC LIMIT 500"""


@query("q04_detail_log", _LOG.format(style=""))
def detail_log(spark, d):
    return B.detail_log(*_pair(spark, d), B.latest_run(bed.runs(spark, d)))


@query("q04_detail_log_styled", _LOG.format(style="prompt_style, "))
def detail_log_styled(spark, d):
    return B.detail_log(*_pair(spark, d), B.latest_run(bed.runs(spark, d)), with_style=True)


@query("q05_decision_cards", """SELECT run_id, profile, recommended_model, confidence, top_score, array_to_string(determinant_metrics, ',') AS determinant_metrics, tradeoffs, reasoning
    FROM by_profile""")
def decision_cards(spark, d):
    return _joined(B.decision_cards(by_profile(spark, d)))


@query("q06_weighted_ranking", """SELECT run_id, profile, e.model AS model, e.score AS score
    FROM (SELECT run_id, profile, unnest(weighted_scores) AS e FROM newest) WHERE profile = 'equilibre'""")
def weighted_ranking(spark, d):
    return D.ranking_rows(D.latest_per_profile(bed.decisions(spark, d)).where("profile = 'equilibre'"))


@query("q07_decision_overview", """SELECT run_id, profile, recommended_model, confidence, top_score AS score, mean_judge_score AS quality,
    efficiency, avg_latency_ms, reasoning FROM by_profile""")
def decision_overview(spark, d):
    return B.decision_overview(by_profile(spark, d))


@query("q07_profile_picker", "SELECT DISTINCT profile FROM by_profile WHERE run_id = (SELECT max(run_id) FROM decisions)")
def profile_picker(spark, d):
    log = bed.decisions(spark, d)
    return B.profile_picker(D.latest_per_profile(log), log.agg(F.max("run_id")).scalar())


@query("q08_full_comparison", """SELECT run_id, model, n_judged, mean_judge_score AS quality, CASE WHEN n_judged > n_cases THEN stddev_judge_score END AS stddev,
    efficiency, avg_total_tokens, avg_latency_ms, ctx_pct, avg_cost FROM mdm""")
def full_comparison(spark, d):
    return B.full_comparison(decision_metrics(spark, d))


@query("q09_failure_counts", "SELECT failure_type, count(*) AS n FROM review WHERE judge_score < 5 GROUP BY failure_type")
def failure_counts(spark, d):
    return R.failure_counts(*_pair(spark, d))


@query("q10_run_header", """SELECT id AS run_id, dataset, prompt_id, strftime(started_at, '%Y-%m-%d %H:%M:%S') AS started,
    strftime(finished_at, '%Y-%m-%d %H:%M:%S') AS finished FROM runs ORDER BY id DESC LIMIT 1""")
def run_header(spark, d):
    return B.latest_run_header(bed.runs(spark, d))


@query("q10_run_breakdown", f"""SELECT model, count(*) AS n, round(CAST(sum(latency_ms) AS DOUBLE) / count(*), 0) AS avg_ms, sum(input_tokens)::BIGINT AS in_tok,
    sum(output_tokens)::BIGINT AS out_tok, {O.usd('sum(micro)::BIGINT / 1000000.0')} AS cost
    FROM named WHERE run_id = (SELECT max(id) FROM runs) GROUP BY model""")
def run_breakdown(spark, d):
    return B.run_breakdown(*_pair(spark, d), B.latest_run(bed.runs(spark, d)))


@query("q10_case_previews", """SELECT id, case_id, model, latency_ms AS ms, left(regexp_replace(response, '[\\n\\r]+', ' ', 'g'), 55) AS response
    FROM named WHERE run_id = (SELECT max(id) FROM runs)""")
def case_previews(spark, d):
    return B.case_previews(*_pair(spark, d), B.latest_run(bed.runs(spark, d)))


@query("q10_last_runs", f"""SELECT run_id, n_results, n_models, n_cases, duration_ms, {O.usd('total_cost')} AS total_cost, total_input_tokens AS in_tok,
    total_output_tokens AS out_tok, avg_latency_ms, {_P} FROM run_metrics ORDER BY run_id DESC LIMIT 5""")
def last_runs(spark, d):
    return B.last_runs(*(bed.runs(spark, d), bed.results(spark, d))).withColumns(
        {c: F.round(c, 4) for c in ("p50_latency_ms", "p95_latency_ms")})


@query("q10_run_decisions", """SELECT profile, recommended_model, confidence FROM by_profile
    WHERE run_id = (SELECT max(run_id) FROM decisions)""")
def run_decisions(spark, d):
    log = bed.decisions(spark, d)
    return B.run_decisions(D.latest_per_profile(log), log.agg(F.max("run_id")).scalar())


@query("q11_cost_by_dataset", f"""SELECT dataset, count(*) AS n_runs, {O.mean('sum(micro)', 'count(*)', 0)} / 1000000 AS avg_total_cost FROM
    (SELECT u.id, u.dataset, coalesce(sum(r.micro), 0)::BIGINT AS micro FROM runs u LEFT JOIN results r ON r.run_id = u.id GROUP BY u.id, u.dataset)
    GROUP BY dataset""")
def cost_by_dataset(spark, d):
    return R.cost_by_dataset(bed.runs(spark, d), bed.results(spark, d))


# --- panels as SQL text over the registered views -----------------------------

def _registered(spark, d):
    before = F.lag("id").over(Window.partitionBy("name").orderBy("created_at", "id"))
    turns = bed.prompts(spark, d).withColumns({"previous_version_id": before, "hash": content_hash(F.col("content"))})
    register_views(spark, EvalTables(bed.models(spark, d), turns, bed.runs(spark, d), bed.results(spark, d), bed.decisions(spark, d)))


@query("q02_score_sql", "SELECT run_id, model, avg_judge_score, avg_latency_ms FROM mm WHERE avg_judge_score >= 2.5")
def score_sql(spark, d):
    _registered(spark, d)
    return spark.sql("SELECT run_id, model, avg_judge_score, avg_latency_ms FROM model_metrics WHERE avg_judge_score >= 2.5")


@query("q08_comparison_sql", """SELECT m.run_id, u.dataset, m.model, m.mean_judge_score, m.avg_cost FROM mdm m JOIN runs u ON u.id = m.run_id
    WHERE m.n_judged >= 3""")
def comparison_sql(spark, d):
    _registered(spark, d)
    return spark.sql("""SELECT m.run_id, u.dataset, m.model, m.mean_judge_score, m.avg_cost FROM model_decision_metrics m
        JOIN runs u ON u.id = m.run_id WHERE m.n_judged >= 3""")


@query("q05_cards_sql", "SELECT profile, recommended_model, count(*) AS n, max(top_score) AS best FROM by_profile GROUP BY profile, recommended_model")
def cards_sql(spark, d):
    _registered(spark, d)
    return spark.sql("SELECT profile, recommended_model, count(*) AS n, max(top_score) AS best FROM decision_by_profile GROUP BY profile, recommended_model")


@query("q09_failures_sql", "SELECT model, failure_type, count(*) AS n FROM review WHERE judge_score < 4 GROUP BY model, failure_type")
def failures_sql(spark, d):
    _registered(spark, d)
    return spark.sql("SELECT model, failure_type, count(*) AS n FROM result_review WHERE judge_score < 4 GROUP BY model, failure_type")
