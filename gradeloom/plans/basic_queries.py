"""Queries over the single joins, filters, aggregates, windows and functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gradeloom.functions import numeric as N
from gradeloom.functions import text
from gradeloom.functions.windows import percentiles_of_counts, value_counts
from gradeloom.operators import cases as C
from gradeloom.operators import decisions as D
from gradeloom.operators import rollups as R
from gradeloom.operators import style as S
from gradeloom.plans import boards as B
from gradeloom.plans import oracle as O
from gradeloom.plans.registry import query
from gradeloom.sources import bed


def n_rows():
    return F.count(F.lit(1))



def decision_metrics(spark, d):
    return R.model_decision_metrics(bed.results(spark, d), bed.models(spark, d))


def by_profile(spark, d):
    return D.decision_by_profile(bed.decisions(spark, d), decision_metrics(spark, d))


# --- filters and predicates --------------------------------------------------

@query("b01_judged_styled_rows", """SELECT run_id, count(*) AS n FROM results
    WHERE tenths IS NOT NULL AND prompt_style IS NOT NULL AND resp_style_headers IS NOT NULL GROUP BY run_id""")
def judged_styled_rows(spark, d):
    return bed.results(spark, d).where(
        "judge_score IS NOT NULL AND prompt_style IS NOT NULL AND resp_style_headers IS NOT NULL"
    ).groupBy("run_id").agg(n_rows().alias("n"))


@query("b02_null_safe_keys", """SELECT d.id, k.newest_id FROM decisions d JOIN
    (SELECT run_id, profile, max(id) AS newest_id FROM decisions GROUP BY run_id, profile) k
    ON k.run_id IS NOT DISTINCT FROM d.run_id AND k.profile IS NOT DISTINCT FROM d.profile""")
def null_safe_keys(spark, d):
    log = bed.decisions(spark, d).select("id", "run_id", "profile")
    keys = log.groupBy("run_id", "profile").agg(F.max("id").alias("newest_id")).alias("k")
    log = log.alias("l")
    same = F.col("l.run_id").eqNullSafe(F.col("k.run_id")) & F.col("l.profile").eqNullSafe(F.col("k.profile"))
    return log.join(keys, same).select("id", "newest_id")


@query("b03_failure_labels", "SELECT run_id, failure_type, count(*) AS n FROM review GROUP BY run_id, failure_type")
def failure_labels(spark, d):
    return R.result_review(bed.results(spark, d), bed.models(spark, d)).groupBy("run_id", "failure_type").agg(n_rows().alias("n"))


@query("b04_ilike_keywords", """SELECT lang, count(*) FILTER (WHERE judge_reasoning ILIKE '%décline%') AS n_decline,
    count(*) FILTER (WHERE judge_reasoning ILIKE '%n''atteint pas%') AS n_short,
    count(*) FILTER (WHERE response ILIKE '%THAT%') AS n_that FROM responses GROUP BY lang""")
def ilike_keywords(spark, d):
    has = lambda c, w: F.count_if(F.col(c).ilike(f"%{w}%"))
    return bed.responses(spark, d).groupBy("lang").agg(
        has("judge_reasoning", "décline").alias("n_decline"),
        has("judge_reasoning", "n'atteint pas").alias("n_short"), has("response", "THAT").alias("n_that"))


@query("b05_guarded_ratios", """SELECT run_id, CAST(sum(input_tokens) AS DOUBLE) / nullif(count(tenths), 0) AS tokens_per_verdict,
    coalesce(sum(tenths), 0)::BIGINT AS tenths FROM results GROUP BY run_id""")
def guarded_ratios(spark, d):
    judged = F.count("judge_score")
    return bed.results(spark, d).groupBy("run_id").agg(
        (F.sum("input_tokens") / F.nullif(judged, F.lit(0))).alias("tokens_per_verdict"),
        F.coalesce(F.sum(F.expr(N.TENTHS)), F.lit(0)).alias("tenths"))


@query("b06_rounded_means", f"""SELECT run_id, case_id, {O.mean('sum(tenths)', 'count(tenths)', 1, 10)} AS mean_score,
    {O.mean('sum(latency_ms)', 'count(*)', 2)} AS avg_latency_ms FROM results GROUP BY run_id, case_id""")
def rounded_means(spark, d):
    return bed.results(spark, d).groupBy("run_id", "case_id").agg(
        N.mean_of_sums(f"sum({N.TENTHS})", "count(judge_score)", 1, unit=10).alias("mean_score"),
        N.mean_of_sums("sum(cast(latency_ms as bigint))", "count(1)", 2).alias("avg_latency_ms"))


_OBS = """SELECT {keys}model, case_id, CAST(sum(tenths) AS DOUBLE) / CAST(count(*) * 10 AS DOUBLE) AS judge_score,
    avg(output_tokens) AS output_tokens, avg(resp_style_headers) AS headers, avg(resp_style_bold) AS bold,
    avg(resp_style_ordered) AS ordered, avg(resp_style_unordered) AS unordered, avg(resp_style_code_blocks) AS code_blocks
    FROM named WHERE tenths IS NOT NULL AND resp_style_headers IS NOT NULL {more} GROUP BY {keys}model, case_id"""


@query("b07_optional_filters", _OBS.format(
    keys="", more="AND run_id = (SELECT max(run_id) FROM results WHERE tenths IS NOT NULL) AND resp_style_code_blocks = 0"))
def optional_filters(spark, d):
    rows = bed.results(spark, d)
    newest = rows.where("judge_score IS NOT NULL").agg(F.max("run_id")).scalar()
    return S.style_observations(rows, bed.models(spark, d), run_id=newest, exclude_code=True)


@query("b08_score_band", "SELECT run_id, model, case_id, sample_idx, judge_score, failure_type FROM review WHERE judge_score < 1.5")
def score_band(spark, d):
    return R.result_review(bed.results(spark, d), bed.models(spark, d)).where("judge_score < 1.5").select(
        "run_id", "model", "case_id", "sample_idx", "judge_score", "failure_type")


_VARIANCE = f"""SELECT run_id, model, case_id, count(tenths) AS n_samples,
    {O.mean('sum(tenths)', 'count(tenths)', 1, 10)} AS mean_score,
    round({O.spread('count(tenths)', 'sum(tenths)', 'sum(tenths * tenths)')}, 2) AS stddev_score,
    min(tenths) / 10.0 AS min_score, max(tenths) / 10.0 AS max_score,
    {O.mean('sum(latency_ms)', 'count(*)', 2)} AS avg_latency_ms, {O.mean('sum(micro)', 'count(*)', 0)} / 1000000 AS avg_cost
    FROM named GROUP BY run_id, model, case_id"""


@query("v03_result_variance", _VARIANCE)
def result_variance(spark, d):
    return R.result_variance(bed.results(spark, d), bed.models(spark, d))


@query("b09_blank_spread", f"SELECT run_id, model, case_id, CASE WHEN n_samples > 1 THEN stddev_score END AS stddev_score FROM ({_VARIANCE})")
def blank_spread(spark, d):
    rows = R.result_variance(bed.results(spark, d), bed.models(spark, d))
    return rows.withColumnRenamed("n_samples", "n_judged").withColumn("n_cases", F.lit(1)).select(
        "run_id", "model", "case_id", B.repeated_spread("stddev_score").alias("stddev_score"))


# --- joins -------------------------------------------------------------------

@query("c01_results_with_models", "SELECT model, count(*) AS n, sum(output_tokens)::BIGINT AS tokens FROM named GROUP BY model")
def results_with_models(spark, d):
    return R.named_results(bed.results(spark, d), bed.models(spark, d)).groupBy("model").agg(
        n_rows().alias("n"), F.sum(F.col("output_tokens").cast("bigint")).alias("tokens"))


@query("c02_runs_left_results", """SELECT u.id, u.dataset, count(r.id) AS n FROM runs u LEFT JOIN results r ON r.run_id = u.id
    AND r.tenths IS NOT NULL GROUP BY u.id, u.dataset""")
def runs_left_results(spark, d):
    judged = bed.results(spark, d).where("judge_score IS NOT NULL").groupBy("run_id").agg(n_rows().alias("n"))
    runs = bed.runs(spark, d)
    return runs.join(judged, runs["id"] == judged["run_id"], "left").select("id", "dataset", F.coalesce("n", F.lit(0)).alias("n"))


@query("c03_fair_results", "SELECT run_id, model_id, count(*) AS n, count(case_id) AS n_with_case FROM fair GROUP BY run_id, model_id")
def fair_results(spark, d):
    rows = bed.results(spark, d)
    return R.fair_results(rows, R.complete_cases(rows)).groupBy("run_id", "model_id").agg(
        n_rows().alias("n"), F.count("case_id").alias("n_with_case"))


@query("c04_decisions_left_metrics", """SELECT d.id, d.run_id, d.recommended_model, m.mean_judge_score, m.avg_cost
    FROM decisions d LEFT JOIN mdm m ON m.model = d.recommended_model AND m.run_id IS NOT DISTINCT FROM d.run_id""")
def decisions_left_metrics(spark, d):
    log, m = bed.decisions(spark, d).alias("d"), decision_metrics(spark, d).alias("m")
    same = (F.col("m.model") == F.col("d.recommended_model")) & F.col("m.run_id").eqNullSafe(F.col("d.run_id"))
    return log.join(m, same, "left").select("d.id", "d.run_id", "recommended_model", "mean_judge_score", "avg_cost")


@query("c05_facts_against_run", """SELECT r.run_id, count(*) AS n FROM results r JOIN
    (SELECT run_id, sum(latency_ms)::BIGINT AS s, count(*) AS n FROM results GROUP BY run_id) t ON t.run_id = r.run_id
    WHERE r.latency_ms * t.n > t.s GROUP BY r.run_id""")
def facts_against_run(spark, d):
    rows = bed.results(spark, d).select("run_id", F.col("latency_ms").cast("bigint").alias("lat"))
    cells = rows.groupBy("run_id", "lat").agg(n_rows().alias("c"))
    total = rows.groupBy("run_id").agg(F.sum("lat").alias("s"), n_rows().alias("n"))
    return cells.join(total, "run_id").where(F.col("lat") * F.col("n") > F.col("s")).groupBy("run_id").agg(F.sum("c").alias("n"))


@query("c06_semi_and_anti", """SELECT m.id, m.name, EXISTS (SELECT 1 FROM results r WHERE r.model_id = m.id AND r.tenths = 50) AS perfect
    FROM models m""")
def semi_and_anti(spark, d):
    models = bed.models(spark, d)
    best = bed.results(spark, d).where("judge_score = 5.0").select(F.col("model_id").alias("id")).distinct()
    with_flag = lambda how, flag: models.join(best, "id", how).select("id", "name", F.lit(flag).alias("perfect"))
    return with_flag("left_semi", True).unionByName(with_flag("left_anti", False))


@query("c07_latest_run_rows", """SELECT model, count(*) AS n FROM named WHERE run_id = (SELECT max(id) FROM runs) GROUP BY model""")
def latest_run_rows(spark, d):
    rows = R.named_results(bed.results(spark, d), bed.models(spark, d))
    return rows.where(F.col("run_id") == B.latest_run(bed.runs(spark, d))).groupBy("model").agg(n_rows().alias("n"))


def requests(spark, d, samples: int):
    """Which models each run asked for, as seen in its results."""
    runs = bed.runs(spark, d).select(F.col("id").alias("run_id"), "dataset")
    asked = bed.results(spark, d).select("run_id", "model_id").distinct()
    return asked.join(runs, "run_id").withColumn("samples", F.lit(samples).cast("bigint"))


def dataset_cases(spark, d):
    runs = bed.runs(spark, d).select(F.col("id").alias("run_id"), "dataset")
    seen = bed.results(spark, d).where("case_id IS NOT NULL").select("run_id", "case_id").distinct()
    return seen.join(runs, "run_id").select("dataset", "case_id").distinct()


_PLAN = """WITH asked AS (SELECT DISTINCT r.run_id, r.model_id, u.dataset FROM results r JOIN runs u ON u.id = r.run_id),
    cases AS (SELECT DISTINCT u.dataset, r.case_id FROM results r JOIN runs u ON u.id = r.run_id WHERE r.case_id IS NOT NULL),
    plan AS (SELECT a.run_id, a.dataset, a.model_id, c.case_id, CAST(s.i AS INTEGER) AS sample_idx
        FROM asked a JOIN cases c ON c.dataset = a.dataset, (SELECT unnest(range({samples})) AS i) s)
    """


@query("c08_call_plan", _PLAN.format(samples=3) + "SELECT run_id, dataset, model_id, case_id, sample_idx FROM plan")
def call_plan(spark, d):
    return C.call_plan(requests(spark, d, 3), dataset_cases(spark, d)).select(
        "run_id", "dataset", "model_id", "case_id", "sample_idx")


@query("m14_missing_calls", _PLAN.format(samples=3) + """SELECT run_id, model_id, case_id, sample_idx FROM plan p WHERE NOT EXISTS
    (SELECT 1 FROM results r WHERE r.run_id = p.run_id AND r.model_id = p.model_id AND r.case_id = p.case_id AND r.sample_idx = p.sample_idx)""")
def missing_calls(spark, d):
    plan = C.call_plan(requests(spark, d, 3), dataset_cases(spark, d)).drop("dataset")
    return C.missing_calls(plan, bed.results(spark, d)).select("run_id", "model_id", "case_id", "sample_idx")


@query("c09_ranking_rows", """SELECT run_id, profile, e.model AS model, e.score AS score
    FROM (SELECT run_id, profile, unnest(weighted_scores) AS e FROM by_profile)""")
def ranking_rows(spark, d):
    return D.ranking_rows(by_profile(spark, d))


# --- aggregates --------------------------------------------------------------

@query("d01_counts", """SELECT run_id, count(*) AS n_rows, count(tenths) AS n_judged, count(DISTINCT model_id) AS n_models,
    count(DISTINCT case_id) AS n_cases FROM results GROUP BY run_id""")
def counts(spark, d):
    return bed.results(spark, d).groupBy("run_id").agg(
        n_rows().alias("n_rows"), F.count("judge_score").alias("n_judged"),
        F.count_distinct("model_id").alias("n_models"), F.count_distinct("case_id").alias("n_cases"))


@query("d02_filtered_distinct", """SELECT run_id, case_id, count(DISTINCT model_id) AS n_models,
    count(DISTINCT model_id) FILTER (WHERE tenths IS NOT NULL) AS n_scored FROM results GROUP BY run_id, case_id""")
def filtered_distinct(spark, d):
    scored = F.when(F.col("judge_score").isNotNull(), F.col("model_id"))
    return bed.results(spark, d).groupBy("run_id", "case_id").agg(
        F.count_distinct("model_id").alias("n_models"), F.count_distinct(scored).alias("n_scored"))


@query("d03_sum_avg_min_max", """SELECT model_id, CAST(sum(micro) AS DOUBLE) / 1000000 AS cost, avg(latency_ms) AS avg_ms,
    min(latency_ms) AS min_ms, max(latency_ms) AS max_ms FROM results GROUP BY model_id""")
def sum_avg_min_max(spark, d):
    return bed.results(spark, d).groupBy("model_id").agg(
        F.sum("cost").cast("double").alias("cost"), F.avg("latency_ms").alias("avg_ms"),
        F.min("latency_ms").alias("min_ms"), F.max("latency_ms").alias("max_ms"))


@query("d04_sample_stddev", """SELECT run_id, model_id, case_id, sample_idx, round(stddev_samp(tenths / 10.0), 6) AS stddev
    FROM results GROUP BY run_id, model_id, case_id, sample_idx""")
def sample_stddev(spark, d):
    return bed.results(spark, d).groupBy("run_id", "model_id", "case_id", "sample_idx").agg(
        F.round(F.stddev_samp(F.col("judge_score").cast("double")), 6).alias("stddev"))


@query("d05_percentiles", """SELECT model_id, round(quantile_cont(latency_ms, 0.5), 4) AS p50, round(quantile_cont(latency_ms, 0.95), 4) AS p95
    FROM results GROUP BY model_id""")
def percentiles(spark, d):
    counts = value_counts(bed.results(spark, d), ["model_id"], "latency_ms")
    found = counts.groupBy("model_id").agg(percentiles_of_counts("latency_ms", [0.5, 0.95]).alias("p"))
    return found.select("model_id", F.round(F.col("p")[0], 4).alias("p50"), F.round(F.col("p")[1], 4).alias("p95"))


_NAN = "CASE WHEN NOT isnan({0}) THEN round({0}, {1}) END"


@query("d06_guarded_corr", f"""SELECT run_id, case_id, {_NAN.format('corr(tenths, resp_style_code_blocks)', 6)} AS c_code,
    {_NAN.format('corr(tenths, output_tokens)', 6)} AS c_len FROM results GROUP BY run_id, case_id""")
def guarded_corr(spark, d):
    y = F.col("judge_score").cast("double")
    return bed.results(spark, d).groupBy("run_id", "case_id").agg(
        F.round(N.guarded_corr(y, F.col("resp_style_code_blocks")), 6).alias("c_code"),
        F.round(N.guarded_corr(y, F.col("output_tokens")), 6).alias("c_len"))


@query("d07_regr_slope", f"""SELECT model_id, {_NAN.format('regr_slope(tenths / 10.0, output_tokens)', 8)} AS slope
    FROM results WHERE tenths IS NOT NULL GROUP BY model_id""")
def regr_slope(spark, d):
    return bed.results(spark, d).where("judge_score IS NOT NULL").groupBy("model_id").agg(
        F.round(F.regr_slope(F.col("judge_score").cast("double"), F.col("output_tokens").cast("double")), 8).alias("slope"))


@query("d08_having", """SELECT run_id, case_id, count(DISTINCT model_id) AS n FROM results
    GROUP BY run_id, case_id HAVING count(DISTINCT model_id) < 5""")
def having(spark, d):
    return bed.results(spark, d).groupBy("run_id", "case_id").agg(F.count_distinct("model_id").alias("n")).where("n < 5")


@query("d09_distinct_profiles", "SELECT DISTINCT run_id, profile FROM decisions")
def distinct_profiles(spark, d):
    return bed.decisions(spark, d).select("run_id", "profile").distinct()


# --- windows, sorts, limits --------------------------------------------------

@query("e01_latest_per_profile", "SELECT id, run_id, profile, recommended_model, created_at FROM newest")
def latest_per_profile(spark, d):
    return D.latest_per_profile(bed.decisions(spark, d)).select("id", "run_id", "profile", "recommended_model", "created_at")


@query("e02_latest_decision", "SELECT id, run_id, profile, recommended_model FROM decisions ORDER BY created_at DESC, id DESC LIMIT 1")
def latest_decision(spark, d):
    return bed.decisions(spark, d).orderBy(F.desc("created_at"), F.desc("id")).limit(1).select(
        "id", "run_id", "profile", "recommended_model")


@query("e03_first_per_group", """SELECT source, doc_id FROM (SELECT source, doc_id,
    row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents) WHERE rn <= 3""")
def first_per_group(spark, d):
    docs = bed.table(spark, d, "documents").selectExpr("source AS subcategory", "doc_id AS uid", "text AS prompt")
    return C.balanced_subset(docs, 3).select(F.col("subcategory").alias("source"), F.col("case_id").alias("doc_id"))


@query("e04_newest_rows", """SELECT id, created_at, model FROM named WHERE run_id = (SELECT max(id) FROM runs)
    ORDER BY created_at DESC, id DESC LIMIT 500""")
def newest_rows(spark, d):
    return B.detail_log(bed.results(spark, d), bed.models(spark, d), B.latest_run(bed.runs(spark, d))).select(
        "id", "created_at", "model")


@query("e05_nulls_last", """SELECT provider, name, ctx, CAST(row_number() OVER (PARTITION BY provider ORDER BY ctx DESC NULLS LAST, name) AS INTEGER) AS place
    FROM (SELECT provider, name, min(context_window) AS ctx FROM catalog GROUP BY provider, name)""")
def nulls_last(spark, d):
    groups = bed.catalog(spark, d).groupBy("provider", "name").agg(F.min("context_window").alias("ctx"))
    best_first = Window.partitionBy("provider").orderBy(F.desc_nulls_last("ctx"), "name")
    return groups.withColumn("place", F.row_number().over(best_first))


@query("e07_normalized_metrics", "SELECT run_id, model, metric, normalized FROM norms")
def normalized_metrics(spark, d):
    return D.normalize_metrics(decision_metrics(spark, d))


@query("m06_normalized_spread", """SELECT run_id, metric, min(normalized) AS lo, max(normalized) AS hi, count(*) AS n
    FROM norms GROUP BY run_id, metric""")
def normalized_spread(spark, d):
    return D.normalize_metrics(decision_metrics(spark, d)).groupBy("run_id", "metric").agg(
        F.min("normalized").alias("lo"), F.max("normalized").alias("hi"), n_rows().alias("n"))


@query("e08_rank", "SELECT run_id, profile, model, CAST(rank AS INTEGER) AS rank FROM ranked")
def rank(spark, d):
    return D.rank_models(decision_metrics(spark, d), D.shipped_profiles(spark)).select("run_id", "profile", "model", "rank")


@query("e09_margin", "SELECT run_id, profile, round(margin, 9) AS margin FROM reco")
def margin(spark, d):
    ranked = D.rank_models(decision_metrics(spark, d), D.shipped_profiles(spark))
    return D.recommend(ranked).select("run_id", "profile", F.round("margin", 9).alias("margin"))


# --- scalar functions and JSON -----------------------------------------------

@query("f01_duration", "SELECT id, CAST(epoch_us(finished_at) - epoch_us(started_at) AS DOUBLE) / 1000 AS duration_ms FROM runs")
def duration(spark, d):
    return bed.runs(spark, d).select("id", N.duration_ms(F.col("started_at"), F.col("finished_at")).alias("duration_ms"))


@query("f03_labels", "SELECT id AS value, dataset || ' #' || id AS text FROM runs")
def labels(spark, d):
    return B.run_picker(bed.runs(spark, d))


@query("f04_preview", """SELECT id, left(regexp_replace(response, '[\\n\\r]+', ' ', 'g'), 55) AS preview FROM responses""")
def preview(spark, d):
    return bed.responses(spark, d).select("id", text.preview(F.col("response")).alias("preview"))


@query("f05_formats", f"""SELECT u.id, strftime(u.started_at, '%Y-%m-%d %H:%M:%S') AS started,
    {O.usd('coalesce(sum(r.micro), 0)::BIGINT / 1000000.0')} AS cost FROM runs u LEFT JOIN results r ON r.run_id = u.id GROUP BY u.id, u.started_at""")
def formats(spark, d):
    return R.run_metrics(bed.runs(spark, d), bed.results(spark, d)).select(
        F.col("run_id").alias("id"), B.clock(F.col("started_at")).alias("started"), B.usd(F.col("total_cost")).alias("cost"))


@query("f07_log_means", """SELECT model_id, round(avg(ln(1 + output_tokens)), 6) AS mean_log,
    round(sum(tenths * ln(1 + output_tokens)), 3) AS dot FROM results GROUP BY model_id""")
def log_means(spark, d):
    log = F.log1p("output_tokens")
    return bed.results(spark, d).groupBy("model_id").agg(
        F.round(F.avg(log), 6).alias("mean_log"), F.round(F.sum(F.expr(N.TENTHS) * log), 3).alias("dot"))


@query("g01_first_score", "SELECT id, weighted_scores[1].score AS top_score FROM decisions")
def first_score(spark, d):
    as_json = F.to_json("weighted_scores")
    return bed.decisions(spark, d).select("id", F.get_json_object(as_json, "$[0].score").cast("double").alias("top_score"))


@query("g02_json_rows", """SELECT id, e.model AS model, e.score AS score FROM (SELECT id, unnest(weighted_scores) AS e FROM decisions)""")
def json_rows(spark, d):
    stored = F.to_json("weighted_scores").alias("stored")
    item = F.explode(F.from_json("stored", "array<struct<model:string,score:double>>")).alias("e")
    return bed.decisions(spark, d).select("id", stored).select("id", item).select("id", "e.model", "e.score")


@query("g03_ranking_json", """SELECT run_id, profile, '[' || string_agg('{"model":"' || model || '","score":' ||
    CAST(CAST(round(score, 4) AS DECIMAL(6,4)) AS VARCHAR) || '}', ',' ORDER BY rank) || ']' AS ranking FROM ranked GROUP BY run_id, profile""")
def ranking_json(spark, d):
    reco = D.recommend(D.rank_models(decision_metrics(spark, d), D.shipped_profiles(spark)))
    fixed = F.col("weighted_scores").cast("array<struct<model:string,score:decimal(6,4)>>")
    return reco.select("run_id", "profile", F.to_json(fixed).alias("ranking"))


_FIGURES = {"avg_cost": 6, "avg_input_tokens": 1, "avg_latency_ms": 2, "avg_output_tokens": 1, "avg_total_tokens": 1,
            "ctx_pct": 3, "efficiency": 4, "mean_judge_score": 1, "model": None, "n_cases": 0, "n_judged": 0, "stddev_judge_score": 2}
_JSON_ROW = " || ',' || ".join(
    f"""'"{c}":"' || """ + (c if s is None else f"coalesce(CAST(CAST({c} AS DECIMAL(28,{s})) AS VARCHAR), 'null')") + """ || '"'"""
    for c, s in _FIGURES.items())
CANONICAL = f"""SELECT run_id, '[' || string_agg('{{' || {_JSON_ROW} || '}}', ',' ORDER BY model) || ']' AS input_snapshot
    FROM mdm GROUP BY run_id"""


@query("g04_canonical_metrics", CANONICAL)
def canonical_metrics(spark, d):
    return D.canonical_metrics(decision_metrics(spark, d))
