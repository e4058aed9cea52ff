import datetime as dt
import hashlib
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from gradeloom import schema
from gradeloom.functions.text import content_hash, normalize_content
from gradeloom.operators import cases as C
from gradeloom.operators import prompts as P
from gradeloom.operators import verdicts as V
from gradeloom.sources.tables import read_questions, rejected_questions
from helpers import results, rows

VERDICTS = {
    '{"score": 0.6, "reasoning": "ok"}': ("3.0", None),
    'Voici\n```json\n{"score": 0.63, "reasoning": "ok"}\n```': ("3.2", None),
    '{"score": 1, "reasoning": "ok"}': ("5.0", None),
    '{"score": 0.0, "reasoning": "ok"}': ("0.0", None),
    '{"score": 0.7, "reasoning": "ok"}': ("3.5", None),
    '{"score": 0.65, "reasoning": "ok"}': ("3.2", None),  # 3.25 goes to the even tenth
    "great answer": (None, "not_json"),
    '{"score": 1.2, "reasoning": "ok"}': (None, "score_range"),
    '{"score": -0.1, "reasoning": "ok"}': (None, "score_range"),
    '{"reasoning": "ok"}': (None, "bad_score"),
    '{"score": true, "reasoning": "ok"}': (None, "bad_score"),
    '{"score": "0.5", "reasoning": "ok"}': (None, "bad_score"),
    '{"score": 0.5, "reasoning": " \\u00a0 "}': (None, "bad_reasoning"),
    '{"score": 0.5, "reasoning": 3}': (None, "bad_reasoning"),
    "[0.5]": (None, "not_object"),
    '{"score": NaN, "reasoning": "ok"}': (None, "not_json"),
    '{"score": 0.5, "reasoning": "x"} trailing': (None, "not_json"),
    '{"score": 0.5, "reasoning": "x"}{"score": 1}': (None, "not_json"),
    '{"score": 0.5, "reasoning": "x"}, {"score": 1}': (None, "not_json"),
    '{"score": 0.5, "reasoning": "x"}]': (None, "not_json"),
    '```\n{"score": 0.5, "reasoning": "x"}\n```\n```\n{"score": 1}\n```': (None, "not_json"),
    # A repeated key is no choice to make for a judge: the text is rejected.
    '{"score": 0.5, "score": 0.6, "reasoning": "x"}': (None, "not_json"),
    None: (None, "not_json"),
}


def test_verdict_texts(spark):
    raw = spark.createDataFrame([(i, t) for i, t in enumerate(VERDICTS)], "id long, raw string")
    got = V.parse_verdicts(raw).orderBy("id").collect()
    assert [(None if r.judge_score is None else str(r.judge_score), r.reject) for r in got] == list(VERDICTS.values())


def test_valid_verdicts_are_attached_and_rejects_change_nothing(spark):
    r = results(spark, [{"judge_score": 1, "judge_reasoning": "old"}, {}, {}])
    raw = spark.createDataFrame([(1, '{"score": 0.5, "reasoning": "new"}'), (2, "junk")], "id long, raw string")
    got = V.apply_verdicts(r, V.parse_verdicts(raw))
    assert [(i, s and float(s), t) for i, s, t in rows(got, "id", "judge_score", "judge_reasoning")] == [
        (1, 2.5, "new"), (2, None, None), (3, None, None)]


def test_the_last_verdict_counts_and_needs_an_order(spark):
    r = results(spark, [{}, {}]).select("id", "run_id", "judge_score", "judge_reasoning")
    kind = "id long, run_id long, judge_score decimal(3,1), judge_reasoning string, judged_at int"
    twice = spark.createDataFrame([(1, 1, Decimal("4.0"), "old", 1), (1, 1, Decimal("1.0"), "new", 2), (2, 1, None, None, 3)], kind)
    assert [(i, s and float(s), t) for i, s, t in rows(V.apply_verdicts(r, twice), "id", "judge_score", "judge_reasoning")] == [(1, 1.0, "new"), (2, None, None)]
    with pytest.raises(Exception, match="several verdicts"):
        V.apply_verdicts(r, twice.drop("judged_at")).collect()
    assert V.apply_verdicts(r, twice.drop("judged_at").where("judge_reasoning = 'new'")).count() == 2


@pytest.mark.parametrize("raw, reject", [
    ('{"reasoning": "r", "determinant_metrics": ["a"], "tradeoffs": "t"}', None), ('{"reasoning": "r"}', None),
    ('{"reasoning": "r", "determinant_metrics": []}', None), ('{"reasoning": ""}', "bad_reasoning"),
    ('{"reasoning": "r", "determinant_metrics": "a"}', "bad_metrics"), ('{"reasoning": "r", "determinant_metrics": ["a", null]}', "bad_metrics"),
    ('{"reasoning": "r", "determinant_metrics": null}', "bad_metrics"), ('{"reasoning": "r", "tradeoffs": null}', "bad_tradeoffs"), ("[]", "not_object"),
])
def test_justification_texts(spark, raw, reject):
    row = V.parse_justifications(spark.createDataFrame([(1, raw)], "id long, raw string")).first()
    assert row.reject == reject and (row.tradeoffs is None) == (reject is not None)


def test_content_hash_ignores_editor_noise(spark):
    texts = ["a é\nb", "a é  \r\nb\t\r\n\n", "\n a é\rb ", "a  é\nb"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [tuple(r) for r in df.orderBy("i").select(normalize_content(F.col("t")), content_hash(F.col("t"))).collect()]
    assert got[0] == got[1] == got[2] == ("a é\nb", hashlib.sha256("a é\nb".encode()).hexdigest())
    assert got[3] != got[0]


def test_sync_finds_unchanged_new_and_initial_templates(spark):
    t = lambda n: dt.datetime(2024, 1, n)
    old = spark.createDataFrame([(1, "judge", "one", "1", t(1)), (4, "judge", "two", "2", t(2)), (9, "other", "x", "1", t(1))],
                                "id long, name string, content string, version string, created_at timestamp_ntz")
    table = old.withColumn("hash", content_hash(F.col("content")))
    staged = spark.createDataFrame([("a", " judge ", "2", "two \r\n"), ("b", "judge", "3", "three"), ("c", "judge", "4", "four"),
                                    ("d", "fresh", "1", "new"), ("e", "fresh", "1", "new\n")], "source string, name string, version string, content string")
    got = {r.source: r for r in P.sync_prompts(table, staged, now="2024-06-01").collect()}
    assert [got[s].action for s in "abcde"] == ["unchanged", "new_version", "new_version", "initial", "unchanged"]
    assert got["a"].id == 4 and got["b"].previous_version_id == 4
    assert got["c"].previous_version_id == got["b"].id and got["d"].previous_version_id is None
    assert got["e"].id == got["d"].id and sorted(got[s].id for s in "bcd") == [10, 11, 12]
    assert (got["a"].version, got["a"].previous_version_id, got["a"].created_at) == ("2", None, t(2))
    assert got["b"].created_at == dt.datetime(2024, 6, 1)
    # A second sync over the enlarged table changes nothing.
    made = [r for r in got.values() if r.action != "unchanged"]
    more = spark.createDataFrame([(r.id, r.name, r.content, r.version, r.created_at, r.hash) for r in made],
                                 "id long, name string, content string, version string, created_at timestamp_ntz, hash string")
    again = P.sync_prompts(table.unionByName(more), staged, now="2024-07-01")
    assert {r.action for r in again.collect()} == {"unchanged"}


def test_version_chain_crosses_buckets(spark):
    t = lambda h, m=0: dt.datetime(2024, 1, 1, h, m)
    df = spark.createDataFrame([(1, "a", t(1)), (2, "a", t(1, 30)), (3, "a", t(5)), (5, "a", t(5)), (4, "b", t(2))],
                               "id long, name string, created_at timestamp_ntz")
    assert rows(P.version_chain(df), "id", "previous_version_id") == [(1, None), (2, 1), (3, 2), (4, None), (5, 3)]


def test_case_and_prompt_rules(spark):
    heads = spark.createDataFrame([("good", "g", "1"), ("nameless", " ", "1"), ("dup", "d", None), ("empty", "e", "1")], "source string, name string, version string")
    cases = spark.createDataFrame([("good", 0, "a", "p"), ("good", 1, "b", "p"), ("nameless", 0, None, "p"), ("dup", 0, "x", "p"),
                                   ("dup", 1, "x", " \n"), ("dup", 2, "x", "p")], "source string, position int, case_id string, prompt string")
    assert rows(C.validate_cases(heads, cases), "source", "rule") == [
        ("dup", "duplicate_id"), ("dup", "prompt_missing"), ("dup", "version_missing"), ("empty", "no_cases"),
        ("nameless", "id_missing"), ("nameless", "name_missing")]
    assert rows(C.discover_datasets(heads, cases), "source") == [("good",)]
    staged = spark.createDataFrame([("f", "", "1", "c"), ("g", "n", None, None)], "source string, name string, version string, content string")
    assert rows(P.validate_prompts(staged)) == [("f", "name_missing"), ("g", "content_missing"), ("g", "version_missing")]


def test_questions_split_on_line_feeds_only_and_balance(spark, tmp_path):
    file = tmp_path / "q.jsonl"
    file.write_text('{"uid": "b", "subcategory": "math", "prompt": "one two"}\n\n{"uid": "a", "subcategory": "math", "prompt": "p"}\n'
                    '{"uid": "c", "subcategory": "coding", "prompt": "p"}\n', encoding="utf-8")
    q = read_questions(spark, str(file))
    assert rows(q, "uid", "prompt") == [("a", "p"), ("b", "one two"), ("c", "p")]
    assert rows(C.balanced_subset(q, 1), "case_id", "kind", "check") == [("a", "main", "judge"), ("c", "main", "judge")]


def test_bad_question_lines_stop_the_query(spark, tmp_path):
    file = tmp_path / "q.jsonl"
    file.write_text('{"uid": "b", "prompt": "p"}\n{"uid": \n  \n{"prompt": "no id"}\n', encoding="utf-8")
    assert rows(rejected_questions(spark, str(file))) == [('{"prompt": "no id"}',), ('{"uid": ',)]
    with pytest.raises(Exception, match="not a question"):
        read_questions(spark, str(file)).collect()


def test_call_and_judge_texts(spark):
    plan = spark.createDataFrame([("p",)], "prompt string")
    assert C.call_inputs(plan, " sys \n").first().call_text == "sys\n\np"
    asked = spark.createDataFrame([("q", "r")], "question string, response string")
    assert C.judge_inputs(asked, "rubric\n").first().judge_text == "rubric\n\nQ: q\n\nR: r"
    assert schema.QUESTIONS.fieldNames() == ["uid", "subcategory", "prompt"]
