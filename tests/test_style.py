import numpy as np
import pytest
from pyspark.sql import functions as F

from gradeloom.operators import rollups as R
from gradeloom.operators import style as S
from gradeloom.schema import STYLE_COUNTS
from helpers import models, results, rows

FORMS = {
    "# a\n## b\n### c\n#### d\n##### e\n###### f": (6, 0, 0, 0, 0),
    "#notaheader\n####### seven": (0, 0, 0, 0, 0),
    "**x** and __y__ and **z**": (0, 3, 0, 0, 0),
    "1. a\n 2. b\n- c\n* d\n+ e": (0, 0, 2, 3, 0),
    "```\n# h\n- i\n**b**\n```\ntail": (0, 0, 0, 0, 1),
    "x\r# a": (0, 0, 0, 0, 0),
    "# wide": (1, 0, 0, 0, 0),
    "": (0, 0, 0, 0, 0),
    None: (0, 0, 0, 0, 0),
}


def test_markdown_counts(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(FORMS)], "i int, response string")
    got = S.with_style_features(df).orderBy("i").select(*[f"resp_style_{k}" for k in STYLE_COUNTS]).collect()
    assert [tuple(r) for r in got] == list(FORMS.values())


def _observations(spark, rows_):
    names = "model string, case_id string, judge_score double, output_tokens double, " + ", ".join(f"{k} double" for k in STYLE_COUNTS)
    return spark.createDataFrame(rows_, names)


def test_planted_slope_is_found_in_a_deficient_design(spark):
    obs = [(m, f"{m}{i}", 1 + 0.5 * float(np.log1p(t)), float(t), 0.0, 0.0, 0.0, 0.0, 0.0)
           for m, ts in (("A-short", range(10, 60, 10)), ("B-long", range(100, 600, 100))) for i, t in enumerate(ts)]
    fit = S.fit_style_model(_observations(spark, obs), min_obs=1).orderBy("model").collect()
    assert fit[0].slope_log1p_tokens == pytest.approx(0.5, abs=1e-6)
    assert fit[0].adjusted == pytest.approx(fit[1].adjusted, abs=1e-6)
    assert fit[0].rank_deficient and fit[0].raw_mean < fit[1].raw_mean


def test_planted_gap_between_models(spark):
    obs = [(m, str(i), top + 0.1 * i, 10.0 + i, 0.0, 0.0, 0.0, 0.0, 0.0) for m, top in (("good", 2), ("bad", 1)) for i in range(6)]
    fit = {r.model: r.adjusted for r in S.fit_style_model(_observations(spark, obs), min_obs=1).collect()}
    assert fit["good"] - fit["bad"] == pytest.approx(1.0, abs=1e-6)


def test_fit_equals_a_dense_least_squares_solution(spark):
    rng = np.random.default_rng(7)
    obs = [(f"m{i % 4}", f"c{i}", float(rng.uniform(0, 5)), float(rng.integers(1, 900)), *[float(x) for x in rng.integers(0, 6, 5)]) for i in range(80)]
    x = np.array([[1, np.log1p(o[3]), *o[4:], *[o[0] == f"m{k}" for k in (1, 2, 3)]] for o in obs], float)
    beta = np.linalg.lstsq(x, np.array([o[2] for o in obs]), rcond=None)[0]
    base = beta[0] + x[:, 1:7].mean(axis=0) @ beta[1:7]
    fit = S.fit_style_model(_observations(spark, obs)).orderBy("model").collect()
    assert [r.adjusted for r in fit] == pytest.approx([base, *(base + beta[7:])], abs=1e-9)
    assert [fit[0][f"slope_{f}"] for f in S.FEATURES] == pytest.approx(list(beta[1:7]), abs=1e-9)
    assert not fit[0].rank_deficient and fit[0].n_obs == 80
    assert S.style_slopes(S.fit_style_model(_observations(spark, obs))).count() == 6


def _dense(obs):
    names = sorted({o[0] for o in obs})
    x = np.array([[1, np.log1p(o[3]), *o[4:], *[o[0] == m for m in names[1:]]] for o in obs], float)
    beta, _, rank, _ = np.linalg.lstsq(x, np.array([o[2] for o in obs]), rcond=None)
    base = beta[0] + x[:, 1:7].mean(axis=0) @ beta[1:7]
    # How far two backward-stable solvers may differ: the condition number, rounding errors of the rows included.
    bound = 1e-8 if rank < x.shape[1] else max(1e-8, 30 * np.linalg.cond(x) * np.finfo(float).eps)
    return [base, *(base + beta[7:])], list(beta[1:7]), rank < x.shape[1], bound


@pytest.mark.parametrize("size, deficient", [(1e-3, False), (1e-10, False), (1e-19, True), (0.0, True)])
def test_rank_and_slopes_on_nearly_dependent_features(spark, size, deficient):
    """Ordered lists are the headers and a trace of noise. Normal equations square the
    noise and lose it at 1e-10; a QR decomposition does not."""
    rng = np.random.default_rng(3)
    obs = []
    for i in range(3000):
        h = float(rng.integers(0, 9))
        obs.append((f"m{i % 3}", f"c{i}", float(rng.uniform(0, 5)) + h, float(rng.integers(1, 900)), h, float(rng.integers(0, 6)),
                    h + size * float(rng.normal()), *[float(x) for x in rng.integers(0, 6, 2)]))
    adjusted, slopes, dense, bound = _dense(obs)
    assert dense == deficient
    table = _observations(spark, obs).repartition(7)
    fit = S.fit_style_model(table).orderBy("model").collect()
    assert fit[0].rank_deficient == deficient and fit[0].n_obs == 3000
    assert bound < 1e-2
    assert [fit[0][f"slope_{f}"] for f in S.FEATURES] == pytest.approx(slopes, rel=bound)
    assert [r.adjusted for r in fit] == pytest.approx(adjusted, rel=bound)


def test_fits_by_key_in_small_batches(spark):
    rng = np.random.default_rng(5)
    obs = {k: [(f"m{i % 3}", f"c{i}", float(rng.uniform(0, 5)), float(rng.integers(1, 900)), *[float(x) for x in rng.integers(0, 6, 5)]) for i in range(n)]
           for k, n in ((1, 400), (2, 60), (3, 5), (None, 30))}
    table = None
    for k, rows_ in obs.items():
        part = _observations(spark, rows_).selectExpr(f"cast({'null' if k is None else k} as bigint) AS run_id", "*")
        table = part if table is None else table.unionByName(part)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        got = {}
        for r in S.fit_style_model(table, by=("run_id",)).orderBy("model").collect():
            got.setdefault(r.run_id, []).append(r)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert set(got) == {1, 2, None}
    for k, rows_ in got.items():
        adjusted, slopes, *_ = _dense(obs[k])
        assert [r.adjusted for r in rows_] == pytest.approx(adjusted, abs=1e-9)
        assert [rows_[0][f"slope_{f}"] for f in S.FEATURES] == pytest.approx(slopes, abs=1e-9)
        assert sum(r.n for r in rows_) == rows_[0].n_obs == len(obs[k])
    status = S.fit_status(table, by=("run_id",))
    assert rows(status, "run_id", "n_obs", "n_models", "reason") == sorted(
        [(1, 400, 3, None), (2, 60, 3, None), (3, 5, 3, "only 5 observations, 20 are needed"), (None, 30, 3, None)], key=repr)


def test_too_few_observations_give_no_fit(spark):
    obs = _observations(spark, [("a", "c", 1.0, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0)])
    assert S.fit_style_model(obs).count() == 0
    assert rows(S.fit_status(obs)) == [(1, 1, "only 1 observations, 20 are needed")]
    assert rows(S.fit_status(obs.limit(0))) == [(0, 0, "only 0 observations, 20 are needed")]
    assert rows(S.fit_status(obs, min_obs=1)) == [(1, 1, None)]


def test_observations_without_a_figure_take_no_part(spark):
    obs = [("a", f"c{i}", 1.0 + i, float(i), 0.0, 0.0, 0.0, 0.0, 0.0) for i in range(4)] + [("a", "n", None, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0), ("b", "n", 1.0, None, 0.0, 0.0, 0.0, 0.0, 0.0)]
    assert [(r.model, r.n) for r in S.fit_style_model(_observations(spark, obs), min_obs=1).collect()] == [("a", 4)]


def test_figures_do_not_depend_on_the_partitions(spark):
    """Equal bits at 1, 8 and 200 partitions; the two ids of one name are one model."""
    rng = np.random.default_rng(1)
    r = results(spark, [{"run_id": i % 3, "model_id": 1 + i % 4, "case_id": f"c{i % 7}", "judge_score": int(rng.integers(0, 51)) / 10,
                         "output_tokens": int(rng.integers(1, 10**6)), **{f"resp_style_{k}": None if k == "bold" and i % 5 == 0 else int(rng.integers(0, 9)) for k in STYLE_COUNTS}}
                        for i in range(800)])
    m = models(spark, "a", "b", "a", "c")
    confound, observed, spread = [], [], []
    for n in (1, 8, 200):
        confound.append(rows(R.style_confound(r.repartition(n), m)))
        observed.append(rows(S.style_observations(r.repartition(n), m, by=("run_id",))))
        spread.append(rows(R.result_variance(r.repartition(n), m)))
    for found in (confound, observed, spread):
        assert found[0] == found[1] == found[2]
    assert len(confound[0]) == 9 and len(observed[0]) == 63
    pdf = r.select("run_id", "model_id", F.col("judge_score").cast("double").alias("y"), "output_tokens", "resp_style_bold").toPandas()
    pdf["model"] = pdf["model_id"].map({1: "a", 2: "b", 3: "a", 4: "c"})
    for row in R.style_confound(r, m).collect():
        own = pdf[(pdf.run_id == row.run_id) & (pdf.model == row.model)]
        bold = own.dropna()
        assert row.n_judged == len(own)
        assert row.corr_score_len == pytest.approx(np.corrcoef(own.y, own.output_tokens)[0, 1], abs=6e-4)
        assert row.corr_score_bold == pytest.approx(np.corrcoef(bold.y, bold.resp_style_bold)[0, 1], abs=6e-4)


def test_the_catalogue_meets_sums_only(spark):
    r, m = results(spark, [{"judge_score": 1}]), models(spark, "m")
    for df in (R.style_confound(r, m), R.result_variance(r, m), S.style_observations(r, m)):
        plan = df._jdf.queryExecution().optimizedPlan().toString().split("\n")
        join = next(i for i, ln in enumerate(plan) if "Join" in ln)
        assert "Aggregate" in plan[join + 1] or "Aggregate" in plan[join + 2], "\n".join(plan)


def test_observations_are_means_over_replicates(spark):
    r = results(spark, [
        {"judge_score": 1, "output_tokens": 10}, {"judge_score": 2, "output_tokens": 20},
        {"judge_score": 5, "resp_style_headers": None}, {"judge_score": None}, {"judge_score": 4, "case_id": "k", "resp_style_code_blocks": 1}])
    m = models(spark, "m")
    assert rows(S.style_observations(r, m), "case_id", "judge_score", "output_tokens") == [("c1", 1.5, 15.0), ("k", 4.0, 20.0)]
    assert rows(S.style_observations(r, m, exclude_code=True), "case_id") == [("c1",)]
    assert S.style_observations(r, m, run_id=2).count() == 0
