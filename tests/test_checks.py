import pytest
from pyspark.sql import functions as F

from gradeloom.operators import checks as K
from helpers import rows


def _spec(kind, **f):
    base = dict(kind=kind, values=None, pattern=None, required=None, properties=None, threshold=None, weight=None, case_sensitive=None)
    return {**base, **f}


def _score(spark, specs, response, outside=None, kind="main"):
    cases = spark.createDataFrame([("c", kind, "cat", [tuple(s.values()) for s in specs])], f"case_id string, kind string, category string, checks array<{K.CHECK}>")
    answers = spark.createDataFrame([("c", response, outside)], "case_id string, response string, outside_scores map<int,double>")
    return K.check_scores(answers, cases)


@pytest.mark.parametrize("spec, response, score", [
    (_spec("exact", values=["Canberra"]), "  canberra\n", 1.0), (_spec("exact", values=["Canberra"]), "Canberra.", 0.0),
    (_spec("contains", values=["ÉTÉ", "Montréal"]), "été à montréal", 1.0), (_spec("contains", values=["a", "z"]), "abc", 0.0),
    (_spec("contains", values=["ÉTÉ"], case_sensitive=True), "été", 0.0), (_spec("not_contains", values=["x", "B"]), "abc", 0.0),
    (_spec("not_contains", values=["x"]), "abc", 1.0), (_spec("regex", pattern=r"^\w+ [0-9]+$"), "Été 12 ", 1.0),
    (_spec("regex", pattern="^A$"), "a", 1.0), (_spec("regex", pattern="^A$", case_sensitive=True), "a", 0.0),
])
def test_text_checks(spark, spec, response, score):
    assert rows(_score(spark, [spec], response), "score") == [(score,)]


_JAPAN = _spec("json_schema", required=["pays", "monnaie"], properties={"pays": ("string", None), "monnaie": ("string", "^y"), "n": ("integer", None)})


@pytest.mark.parametrize("response, score", [
    ('{"pays": "Japon", "monnaie": "yen"}', 1.0), ('{"pays": "Japon", "monnaie": "yen", "n": 3}', 1.0), ('{"pays": "Japon"}', 0.0),
    ('{"pays": "Japon", "monnaie": 3}', 0.0), ('{"pays": "Japon", "monnaie": "eur"}', 0.0), ('{"pays": "J", "monnaie": "yen", "x": 1}', 0.0),
    ('{"pays": "J", "monnaie": "yen", "n": 3.5}', 0.0), ('Voici {"pays": 1}', 0.0), ("[]", 0.0),
])
def test_json_schema(spark, response, score):
    assert rows(_score(spark, [_JAPAN], response), "score") == [(score,)]


def test_weighted_score_can_be_high_and_still_fail(spark):
    scored = _score(spark, [_spec("code_test", weight=2.0), _spec("judge")], "code", {0: 1.0, 1: 0.5})
    assert rows(scored, "threshold", "verdict") == [(0.7, "FAIL"), (1.0, "PASS")]
    case = K.case_verdicts(scored, ["case_id"]).first()
    assert (round(case.score, 2), case.verdict) == (0.83, "FAIL")


def test_missing_scores_and_responses_are_errors(spark):
    half = _score(spark, [_spec("contains", values=["a"]), _spec("judge")], "a", None)
    assert rows(K.case_verdicts(half, ["case_id"]), "score", "verdict") == [(None, "ERROR")]
    assert rows(_score(spark, [_spec("exact", values=["a"])], None), "verdict") == [("ERROR",)]


@pytest.mark.parametrize("response", ['{"a": 1} and more', '{"a": 1}{"a": 1}', '{"a": 1}, {"a": 1}', '{"a": 1}]', '{"a": 1, "a": 2}', "", '{"a": 1'])
def test_json_schema_wants_one_document(spark, response):
    assert rows(_score(spark, [_spec("json_schema", required=["a"])], response), "score") == [(0.0,)]


def test_lost_calls_and_unknown_cases_fail_the_gate(spark):
    cases = spark.createDataFrame([("can", "canary", "x", [tuple(_spec("exact", values=["a"]).values())]), ("bare", "main", "x", [])],
                                  f"case_id string, kind string, category string, checks array<{K.CHECK}>")
    plan = spark.createDataFrame([("s", 1, "can"), ("s", 2, "can"), ("t", 3, "can"), ("u", 4, "can"), ("u", 5, "new"), ("v", 6, "bare")], "set string, call int, case_id string")
    answers = spark.createDataFrame([(1, "a"), (3, "a"), (4, "a"), (5, "a"), (6, "a")], "call int, response string")
    scored = K.check_scores(answers, cases, plan)
    assert rows(scored, "call", "verdict") == [(1, "PASS"), (2, "ERROR"), (3, "PASS"), (4, "PASS"), (5, "ERROR"), (6, "ERROR")]
    gate = {r.set: (r.n_canary, r.n_canary_pass, r.n_unknown, r.gate_ok) for r in K.dataset_gate(scored, ["set"]).collect()}
    assert gate == {"s": (2, 1, 0, False), "t": (1, 1, 0, True), "u": (1, 1, 1, False), "v": (0, 0, 0, False)}


def test_gate_needs_all_canaries_and_the_pass_rate(spark):
    rows_ = [("d", "canary", False, "PASS", 1.0), ("d", "main", False, "PASS", 1.0), ("d", "edge", False, "FAIL", 0.0), ("d", "main", True, "PASS", 0.8)]
    scored = spark.createDataFrame(rows_, "set string, case_kind string, is_judged boolean, verdict string, score double")
    assert K.dataset_gate(scored, ["set"], 0.5).first().gate_ok
    assert not K.dataset_gate(scored, ["set"], 0.6).first().gate_ok
    broken = scored.withColumn("verdict", F.when(F.col("case_kind") == "canary", "ERROR").otherwise(F.col("verdict")))
    assert not K.dataset_gate(broken, ["set"], 0.5).first().gate_ok
    assert rows(K.judged_quality(scored, ["set"])) == [("d", 0.8, 1)]


@pytest.mark.parametrize("spec, response, score, error", [
    (_spec("regex", pattern="(abc"), "abc", None, "invalid pattern"), (_spec("regex", pattern="[z-a]", case_sensitive=True), "a", None, "invalid pattern"),
    (_spec("regex", pattern=None), "a", None, "no score"), (_spec("regex", pattern="a"), None, None, "no response"),
    (_spec("contains", values=["a"], pattern="(abc"), "a", 1.0, None),
    (_spec("json_schema", required=["k"], properties={"k": ("string", "*")}), '{"k": "x"}', None, "invalid pattern"),
    (_spec("json_schema", required=["k"], properties={"k": ("string", None)}), '{"k": "x"}', 1.0, None),
])
def test_patterns_that_do_not_compile_are_errors_of_their_check(spark, spec, response, score, error):
    got = _score(spark, [spec, _spec("contains", values=["a"])], response)
    found = {r.check_no: (r.score, r.error, r.verdict) for r in got.collect()}
    assert found[0] == (score, error, "ERROR" if score is None else "PASS")
    other = None if response is None else float("a" in response)
    assert found[1][0] == other


def test_a_bad_pattern_does_not_stop_other_cases(spark):
    cases = spark.createDataFrame([(c, "main", "cat", [tuple(_spec("regex", pattern=p).values())]) for c, p in (("x", "(abc"), ("y", "b+"))],
                                  f"case_id string, kind string, category string, checks array<{K.CHECK}>")
    answers = spark.createDataFrame([("x", "abc"), ("y", "abc"), ("z", "abc")], "case_id string, response string")
    got = K.check_scores(answers, cases)
    assert rows(got, "case_id", "verdict", "error") == [("x", "ERROR", "invalid pattern"), ("y", "PASS", None), ("z", "ERROR", "no check")]


def test_code_work(spark):
    cases = spark.createDataFrame([("c", [tuple(_spec("regex", pattern="a").values()), tuple(_spec("code_test").values())]), ("d", [])], f"case_id string, checks array<{K.CHECK}>")
    answers = spark.createDataFrame([(1, "c", "see\n```python\nf = 1\n```\n```python\ng\n```"), (2, "c", "none"), (3, "c", None), (4, "d", "```python\nx\n```")],
                                    "id long, case_id string, response string")
    assert rows(K.code_work(answers, cases), "id", "check_no", "code") == [(1, 1, "f = 1\n"), (2, 1, None), (3, 1, None)]
