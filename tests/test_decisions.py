import datetime as dt

import pytest
from pyspark.sql import functions as F

from gradeloom import schema
from gradeloom.operators import decisions as D
from helpers import T0, rows

_COLUMNS = ("run_id long, model string, n_judged long, n_cases long, avg_input_tokens double, avg_output_tokens double, "
            "avg_total_tokens double, avg_latency_ms double, mean_judge_score double, stddev_judge_score double, "
            "efficiency double, ctx_pct double, avg_cost double")


def metrics(spark, *rows_, run=1):
    """(model, score, latency, efficiency, tokens, cost)"""
    return spark.createDataFrame(
        [(run, m, 4, 4, 1.0, 1.0, tok, lat, score, None, eff, 0.5, cost) for m, score, lat, eff, tok, cost in rows_], _COLUMNS)


FAST = ("fast", 3.5, 500.0, 1.0, 400.0, 0.001)
SLOW = ("slow_good", 4.5, 5000.0, 0.5, 900.0, 0.01)


def profiles(spark, **weights):
    return spark.createDataFrame([(p, m, float(w)) for p, ws in weights.items() for m, w in ws.items()], schema.PROFILES)


def test_normalisation_is_oriented_and_neutral_without_signal(spark):
    m = metrics(spark, ("a", 0.0, 100.0, 4.0, None, 1.0), ("b", 5.0, 200.0, 4.0, 0.0, 1.0), ("c", 10.0, 300.0, 4.0, 10.0, 1.0))
    got = {(r.model, r.metric): r.normalized for r in D.normalize_metrics(m).collect()}
    of = lambda metric: [got[(x, metric)] for x in "abc"]
    assert of("mean_judge_score") == [0, 0.5, 1]
    assert of("avg_latency_ms") == [1, 0.5, 0]
    assert of("efficiency") == [0.5, 0.5, 0.5]
    assert of("avg_total_tokens") == [0.5, 1, 0]
    assert of("stddev_judge_score") == [0.5, 0.5, 0.5]


def test_each_profile_has_its_own_winner(spark):
    p = profiles(spark, rapide={"avg_latency_ms": 0.8, "mean_judge_score": 0.2}, qualite={"mean_judge_score": 1.0})
    reco = D.recommend(D.rank_models(metrics(spark, FAST, SLOW), p))
    assert rows(reco, "profile", "recommended_model", "confidence") == [
        ("qualite", "slow_good", "élevée"), ("rapide", "fast", "élevée")]


def test_ties_rank_by_name_and_are_of_low_confidence(spark):
    p = profiles(spark, even={"avg_latency_ms": 1, "mean_judge_score": 1, "ctx_pct": 0})
    ranked = D.rank_models(metrics(spark, SLOW, FAST), p)
    assert rows(ranked, "rank", "model", "score") == [(1, "fast", 0.5), (2, "slow_good", 0.5)]
    assert rows(D.recommend(ranked), "confidence", "margin") == [("faible", 0.0)]


def test_a_single_candidate_is_of_low_confidence(spark):
    ranked = D.rank_models(metrics(spark, FAST), D.shipped_profiles(spark))
    assert {r.confidence for r in D.recommend(ranked).collect()} == {"faible"}


@pytest.mark.parametrize("weights, message", [({"speed": 1}, "unknown metric"), ({"efficiency": 0}, "no positive weight")])
def test_bad_profiles_are_errors(spark, weights, message):
    with pytest.raises(Exception, match=message):
        D.rank_models(metrics(spark, FAST, SLOW), profiles(spark, bad=weights)).collect()


def test_fingerprint_ignores_order_and_sees_weights(spark):
    def of(*items):
        return rows(D.profile_fingerprints(spark.createDataFrame([("p", m, w) for m, w in items], schema.PROFILES)))
    a = of(("efficiency", 0.3), ("avg_cost", 0.7))
    assert a == of(("avg_cost", 0.7), ("efficiency", 0.3)) != of(("avg_cost", 0.6), ("efficiency", 0.3))
    assert of(("efficiency", 0.12345671)) != of(("efficiency", 0.12345674))


def test_a_profile_is_found_by_name_or_the_known_ones_are_listed(spark):
    p = D.shipped_profiles(spark)
    assert {r.profile for r in D.profile_named(p, "rapide").collect()} == {"rapide"}
    with pytest.raises(Exception, match="economie, equilibre, etudiant, rapide"):
        D.profile_named(p, "fast").collect()


def test_cache_key_sees_metrics_weights_and_run_but_not_row_order(spark):
    def key(m, p):
        return rows(D.keyed_recommendations(m, p), "input_hash")[0][0]
    p = profiles(spark, p={"efficiency": 0.3})
    base = key(metrics(spark, FAST, SLOW), p)
    assert base == key(metrics(spark, SLOW, FAST), p)
    assert rows(D.decision_keys(metrics(spark, FAST, SLOW), p), "input_hash") == [(base,)]
    assert base != key(metrics(spark, FAST, SLOW, run=2), p)
    assert base != key(metrics(spark, FAST, SLOW), profiles(spark, p={"efficiency": 0.4}))
    assert base != key(metrics(spark, FAST, ("slow_good", 4.4, 5000.0, 0.5, 900.0, 0.01)), p)


def _log(spark, decided, prompt_id, days):
    return decided.select(
        F.lit(days).cast("long").alias("id"), F.lit(f"from-{days}").alias("recommended_model"), "confidence", "weighted_scores",
        "input_hash", F.lit(prompt_id).cast("long").alias("prompt_id"), "profile",
        F.lit(dt.datetime(2024, 1, days)).cast("timestamp_ntz").alias("created_at"))


def test_decisions_are_replayed_newest_first_unless_forced(spark):
    m, p = metrics(spark, FAST, SLOW), D.shipped_profiles(spark)
    keys = D.keyed_recommendations(m, p)
    log = _log(spark, keys, None, 2).unionByName(_log(spark, keys, None, 1)).unionByName(_log(spark, keys, 5, 3))
    seen = D.decide(m, p, log, prompt_id=None)
    assert {(r.recommended_model, r.replayed, r.decision_id) for r in seen.collect()} == {("from-2", True, 2)}
    assert D.decisions_to_insert(seen, log, T0).count() == 0
    assert {r.recommended_model for r in D.decide(m, p, log, prompt_id=5).collect()} == {"from-3"}
    fresh = D.decide(m, p, log, prompt_id=None, force=True)
    made = D.decisions_to_insert(fresh, log, T0)
    assert made.schema.fieldNames() == schema.DECISIONS.fieldNames()
    assert sorted(r.id for r in made.collect()) == [4, 5, 6, 7]
    # What was inserted is replayed the next time.
    again = D.decide(m, p, made, prompt_id=None)
    assert {r.replayed for r in again.collect()} == {True}
    prose = spark.createDataFrame([(1, n, "new prose", ["x"], "new") for n in schema.PROFILE_WEIGHTS],
                                  "run_id long, profile string, reasoning string, determinant_metrics array<string>, tradeoffs string")
    stored = made.withColumn("reasoning", F.lit("old prose")).withColumn("tradeoffs", F.lit(None).cast("string"))
    replayed = D.decide(m, p, stored, prompt_id=None, justifications=prose).collect()
    assert {(r.reasoning, r.tradeoffs, r.determinant_metrics, str(r.created_at)) for r in replayed} == {("old prose", None, None, str(T0))}
    # By hand: fast scores 0.6, 0.5 (a tie, first by name), 0.8 and 0.9.
    assert {r.recommended_model for r in fresh.collect()} == {"fast"}


def test_views_show_the_latest_decision(spark):
    day = lambda n: dt.datetime(2024, 1, n)
    score = [("fast", 0.8)]
    full = lambda i, model, profile, run, n: (i, model, "faible", [], "", "r", 1, None, None, day(n), profile, score, run)
    log = spark.createDataFrame([full(1, "slow_good", "p", 1, 1), full(2, "fast", "p", 1, 2), full(3, "fast", None, 1, 9),
                                 full(4, "fast", "p", None, 3), full(5, "slow_good", "p", None, 3)], schema.DECISIONS)
    m = metrics(spark, FAST, SLOW)
    assert rows(D.decision_by_profile(log, m), "run_id", "recommended_model", "top_score", "mean_judge_score") == [
        (1, "fast", 0.8, 3.5), (None, "slow_good", 0.8, None)]
    assert rows(D.decision_summary(log, m), "decision_id", "mean_judge_score") == [(3, 3.5)]
    assert rows(D.ranking_rows(D.latest_per_profile(log).where("run_id = 1")), "model", "score") == [("fast", 0.8)]


def test_profile_rules(spark):
    file = spark.createDataFrame([("ok", "efficiency", "0.3"), ("odd", "speed", "1"), ("neg", "efficiency", "-1"), ("neg", "avg_cost", "1"),
                                  ("flag", "efficiency", "true"), ("zero", "efficiency", "0"), ("none", None, None)],
                                 "profile string, metric string, weight string")
    assert rows(D.validate_profiles(file), "profile", "rule") == [
        ("flag", "all_zero"), ("flag", "bad_weight"), ("neg", "bad_weight"), ("none", "no_weights"), ("odd", "unknown_metric"), ("zero", "all_zero")]
