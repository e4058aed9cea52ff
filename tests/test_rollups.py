import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from gradeloom.functions.numeric import stddev_of_sums
from gradeloom.operators import cases as C
from gradeloom.operators import rollups as R
from helpers import T0, models, results, rows, runs


def test_null_case_is_one_case_and_joins_null_safely(spark):
    r = results(spark, [{"model_id": m, "case_id": c, "judge_score": 4} for m in (1, 2) for c in (None, "a")])
    complete = R.complete_cases(r)
    assert rows(complete) == [(1, "a"), (1, None)] or rows(complete) == [(1, None), (1, "a")]
    assert R.fair_results(r, complete).count() == 4
    # A NULL case is a case, but a distinct count does not see it.
    assert rows(R.model_metrics(r, models(spark, "a", "b")), "model", "n_results", "n_cases") == [("a", 2, 1), ("b", 2, 1)]


def test_unjudged_run_is_complete_on_presence_alone(spark):
    r = results(spark, [{"model_id": m, "case_id": c} for m in (1, 2) for c in ("a", "b")] + [{"model_id": 1, "case_id": "c"}])
    assert rows(R.complete_cases(r)) == [(1, "a"), (1, "b")]
    m = models(spark, "a", "b")
    assert rows(R.model_metrics(r, m), "model", "n_results", "n_judged", "avg_judge_score") == [("a", 2, 0, None), ("b", 2, 0, None)]
    assert R.model_decision_metrics(r, m).count() == 0


def test_holes_and_unscored_cases_drop_out(spark):
    r = results(spark, [
        {"model_id": 1, "case_id": "a", "judge_score": 5}, {"model_id": 2, "case_id": "a", "judge_score": 3},
        {"model_id": 1, "case_id": "b", "judge_score": 5},  # model 2 never answered
        {"model_id": 1, "case_id": "c", "judge_score": 1}, {"model_id": 2, "case_id": "c"},  # never scored
        {"model_id": 2, "case_id": "a"},  # an extra unscored sample keeps the case
    ])
    assert rows(R.complete_cases(r)) == [(1, "a")]
    m = models(spark, "a", "b")
    assert rows(R.model_metrics(r, m), "model", "n_results", "n_judged", "avg_judge_score") == [("a", 1, 1, 5.0), ("b", 2, 1, 3.0)]
    assert rows(R.model_decision_metrics(r, m), "model", "n_judged", "mean_judge_score") == [("a", 1, 5.0), ("b", 1, 3.0)]


def test_two_ids_of_one_name_merge_but_count_as_two_models(spark):
    m = models(spark, "twin", "twin", windows={1: 1000, 2: 2000})
    r = results(spark, [
        {"model_id": 1, "case_id": "a", "judge_score": 2}, {"model_id": 2, "case_id": "a", "judge_score": 4},
        {"model_id": 1, "case_id": "b", "judge_score": 2},
    ])
    assert rows(R.complete_cases(r)) == [(1, "a")]
    assert rows(R.model_metrics(r, m), "model", "n_results", "n_cases", "avg_judge_score") == [("twin", 2, 1, 3.0)]
    # The decision figures keep the context windows apart.
    assert rows(R.model_decision_metrics(r, m), "mean_judge_score", "ctx_pct") == [(2.0, 1.0), (4.0, 0.5)]


def test_single_draw_has_no_stddev_in_views_and_zero_in_the_summary(spark):
    r, m = results(spark, [{"judge_score": 4}, {"judge_score": None, "case_id": "b"}]), models(spark, "solo")
    assert rows(R.result_variance(r, m), "case_id", "n_samples", "stddev_score") == [("b", 0, None), ("c1", 1, None)]
    assert rows(R.score_stats(r, m), "mean_score", "stddev_score", "n") == [(4.0, 0.0, 1)]


def test_score_stats_of_three_scaled_scores(spark):
    r = results(spark, [{"judge_score": s} for s in (1, 3, 5)])
    assert rows(R.score_stats(r, models(spark, "m")), "mean_score", "stddev_score", "n") == [(3.0, 2.0, 3)]


def test_means_round_once_and_half_away_from_zero(spark):
    m = models(spark, "m")
    tie = results(spark, [{"judge_score": s} for s in ("3.2", "3.3")])
    assert rows(R.model_metrics(tie, m), "avg_judge_score") == [(3.3,)]
    # 3.4499...: a mean first cut to five digits would become 3.45 and then 3.5.
    copies = lambda score, n: results(spark, [{"judge_score": score}]).withColumn("id", F.explode(F.sequence(F.lit(1), F.lit(n))))
    many = copies("3.4", 500_001).unionByName(copies("3.5", 499_999))
    assert rows(R.model_metrics(many, m), "avg_judge_score") == [(3.4,)]


def test_correlation_on_constant_length_is_null(spark):
    r = results(spark, [{"judge_score": s, "output_tokens": 7, "resp_style_bold": b} for s, b in ((1, 1), (2, 2), (3, 3), (4, 4))])
    got = rows(R.style_confound(r, models(spark, "m")), "n_judged", "corr_score_len", "slope_score_per_token", "corr_score_bold")
    assert got == [(4, None, None, 1.0)]


def test_empty_run_keeps_a_row_of_zeros(spark):
    u = runs(spark, (1, "d", T0, T0 + dt.timedelta(seconds=90)), (2, "d", T0, None))
    r = results(spark, [{"latency_ms": x} for x in (1, 2, 10)])
    got = rows(R.run_metrics(u, r), "run_id", "duration_ms", "n_results", "total_cost", "avg_latency_ms", "p50_latency_ms", "p95_latency_ms")
    assert got[0] == (1, 90000.0, 3, 0.003, 4.33, 2.0, pytest.approx(9.2))
    assert got[1] == (2, None, 0, 0.0, None, None, None)
    assert rows(R.cost_by_dataset(u, r)) == [("d", 2, 0.0015)]


def test_gate_is_strict_and_unrounded(spark):
    r = results(spark, [{"model_id": 1, "judge_score": s} for s in ("3.5", "3.5")]
                + [{"model_id": 2, "judge_score": s} for s in ("3.4", "3.5", "3.5")])
    stats = R.score_stats(r, models(spark, "level", "under"))
    assert rows(R.regression_gate(stats, 3.5), "model") == [("under",)]
    assert R.regression_gate(stats, None).count() == 0
    assert rows(R.model_metrics(r, models(spark, "level", "under")), "model", "avg_judge_score") == [("level", 3.5), ("under", 3.5)]


def test_run_summary_and_status(spark):
    asked = spark.createDataFrame([(1, "d", 1, 2), (1, "d", 2, 2), (2, "d", 1, 1)], "run_id long, dataset string, model_id long, samples long")
    cases = spark.createDataFrame([("d", "a"), ("d", "b")], "dataset string, case_id string")
    r = results(spark, [{"model_id": m, "case_id": c, "sample_idx": s, "judge_score": 3} for m in (1, 2) for c in "ab" for s in (0, 1)][:7])
    assert rows(C.failed_counts(asked, cases, r)) == rows(C.failed_calls(C.call_plan(asked, cases), r))
    summary = R.run_summary(C.planned_counts(asked, cases), r, C.failed_calls(C.call_plan(asked, cases), r))
    assert rows(summary, "run_id", "inserted", "failed", "avg_latency_ms") == [(1, 7, 1, 100.0), (2, 0, 2, 0.0)]
    plan = C.call_plan(asked, cases)
    assert plan.count() == 10
    assert rows(C.missing_calls(plan, r).where("run_id = 1"), "model_id", "case_id", "sample_idx") == [(2, "b", 1)]
    gate = R.regression_gate(R.score_stats(r, models(spark, "a", "b")), 4.0)
    assert rows(R.run_status(summary, gate)) == [(1, 5), (2, 3)]
    assert rows(R.run_status(summary, gate.where("run_id = 9"))) == [(1, 3), (2, 3)]


def test_a_row_stored_twice_hides_no_failure(spark):
    asked = spark.createDataFrame([(1, "d", 1, 2), (1, "d", 2, 0)], "run_id long, dataset string, model_id long, samples long")
    cases = spark.createDataFrame([("d", "a")], "dataset string, case_id string")
    plan = C.call_plan(asked, cases)
    assert rows(plan, "model_id", "sample_idx") == [(1, 0), (1, 1)] and rows(C.planned_counts(asked, cases)) == [(1, 2)]
    r = results(spark, [{"case_id": "a"}, {"case_id": "a"}, {"case_id": "a"}])
    assert rows(C.failed_counts(asked, cases, r)) == rows(C.failed_calls(plan, r))
    summary = R.run_summary(C.planned_counts(asked, cases), r, C.failed_calls(plan, r))
    assert rows(summary, "inserted", "failed") == [(3, 1)]


def test_spread_of_very_many_rows(spark):
    n = 4_000_000_000
    sql = stddev_of_sums(f"{n}L", f"{n}L", f"{2 * n}L")
    assert spark.range(1).select(sql).first()[0] == pytest.approx(1.0)


def test_failure_labels_take_the_first_match(spark):
    texts = ["Le modèle REFUSE", "Il manque la rime", "la rime est fausse", "C'est FAUX", "Bien", "N'atteint pas le but", None]
    r = results(spark, [{"judge_score": 1, "judge_reasoning": t, "case_id": f"c{i}"} for i, t in enumerate(texts)] + [{"case_id": "c9"}])
    got = dict(rows(R.result_review(r, models(spark, "m")), "case_id", "failure_type"))
    assert list(got.values()) == ["Refus / clarification", "Omission / incomplet", "Non-respect de forme", "Erreur de fond",
                                  "Autre", "Omission / incomplet", "Autre", "Non jugé"]


def test_style_delta_against_zero_shot(spark):
    r = results(spark, [{"judge_score": 2, "prompt_style": "zero-shot"}, {"judge_score": 4, "prompt_style": "few-shot"},
                        {"model_id": 2, "judge_score": 4, "prompt_style": "few-shot"}])
    got = rows(R.style_delta(r, models(spark, "a", "b")), "model", "prompt_style", "delta")
    assert got == [("a", "few-shot", 2.0), ("a", "zero-shot", 0.0), ("b", "few-shot", None)]


def test_roll_up_does_not_depend_on_the_number_of_partitions(spark):
    r = results(spark, [{"run_id": i % 3, "model_id": i % 2 + 1, "case_id": f"c{i % 7}", "judge_score": str(i % 50 / 10),
                         "cost": Decimal(i) / 1000} for i in range(600)])
    m, seen = models(spark, "a", "b"), []
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for n in ("1", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        seen.append((rows(R.model_decision_metrics(r, m)), rows(R.style_confound(r, m))))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert seen[0] == seen[1] and len(seen[0][0]) == 6
