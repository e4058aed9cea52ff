"""Evaluation tables derived from the given star-schema tables.

Every supplier is a run, so the number of runs grows with the data; every
line item is one answered call. All rows of a given table take part. The
expressions use whole numbers only, so any SQL engine derives the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Judge sentences that exercise the triage keywords.
REASONINGS = [
    "Le modèle refuse de répondre.",
    "La réponse DÉCLINE la demande.",
    "Une clarification est demandée.",
    "Il manque une étape du calcul.",
    "La réponse n'atteint pas le minimum.",
    "Réponse incomplète.",
    "Le nombre de mots est dépassé.",
    "La consigne n'est pas suivie.",
    "Le raisonnement contient une erreur.",
    "Propos incohérents sur la fin.",
    "La date est fausse.",
    "Réponse claire et fidèle.",
]
STYLES = ["zero-shot", "few-shot", "instructional", "contextual", "role-based"]
N_CASES, RUN_MODELS = 20, 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _array(words: list[str]) -> str:
    quoted = ", ".join("'" + w.replace("'", "\\'") + "'" for w in words)
    return f"array({quoted})"


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as results: 5 of 25 models and 20 cases per run.

    A tenth of the runs is never judged; one model slot is not judged on two
    cases, which leaves holes; one case has no id.
    """
    return results_of(table(spark, sf_dir, "lineitem"))


def results_of(line_items: DataFrame) -> DataFrame:
    """Line items, of a table or a stream, as results."""
    base = line_items.selectExpr(
        "*",
        f"cast(l_orderkey % {N_CASES} as int) AS case_no",
        f"cast(l_partkey % {RUN_MODELS} as int) AS slot",
        "cast(floor(l_extendedprice) as int) AS price",
        "20 + cast(l_partkey % 180 as int) AS in_tok",
    ).selectExpr(
        "*",
        f"slot * {RUN_MODELS} + l_suppkey % {RUN_MODELS} + 1 AS mid",
        "1 + price % 900 AS out_tok",
        "(l_suppkey % 10 = 9 OR (slot = 2 AND case_no % 10 = 7)) AS unjudged",
        "case_no % 11 = 10 AS unstyled",
    )
    key = ("concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey, "
           "cast(round(l_extendedprice * 100) as bigint))")
    count = lambda name, expr: f"CASE WHEN NOT unstyled THEN cast({expr} as int) END AS resp_style_{name}"
    return base.selectExpr(
        f"cast(conv(substr(md5({key}), 1, 15), 16, 10) as bigint) AS id",
        "l_suppkey + 1 AS run_id",
        "mid AS model_id",
        "concat('Answer to order ', l_orderkey, '\\n', 'line ', l_linenumber, ' shipped as ', l_returnflag, l_linestatus) AS response",
        "price AS latency_ms", "in_tok AS input_tokens", "out_tok AS output_tokens",
        "cast((in_tok + 3 * out_tok) * mid * 0.000001 as decimal(18,9)) AS cost",
        "CASE WHEN NOT unjudged THEN cast(cast(l_quantity as int) * 0.1 as decimal(3,1)) END AS judge_score",
        f"CASE WHEN NOT unjudged THEN element_at({_array(REASONINGS)}, cast(l_partkey % {len(REASONINGS)} as int) + 1) END AS judge_reasoning",
        "l_shipdate AS created_at",
        "CASE WHEN case_no < 19 THEN concat('case-', lpad(cast(case_no as string), 2, '0')) END AS case_id",
        f"CASE WHEN case_no % 7 <> 0 THEN element_at({_array(STYLES)}, case_no % 5 + 1) END AS prompt_style",
        "concat('Question ', case_no) AS question",
        "l_linenumber AS sample_idx",
        count("headers", "round(l_discount * 100)"), count("bold", "l_quantity % 7"),
        count("ordered", "round(l_tax * 100)"), count("unordered", "price % 5"),
        count("code_blocks", "price % 2"),
    )


def single_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as cases that five models answer once each; a tenth of the calls is lost.

    Facts of this kind hardly shrink when they fold to (run, case, model) cells.
    """
    lost = "(l_partkey + slot) % 11 = 0"
    calls = table(spark, sf_dir, "lineitem").selectExpr(
        "*", "cast(floor(l_extendedprice) as int) AS price", f"explode(sequence(0, {RUN_MODELS - 1})) AS slot").where(f"NOT ({lost} AND l_orderkey % 2 = 0)")
    return calls.selectExpr(
        "*", f"slot * {RUN_MODELS} + l_suppkey % {RUN_MODELS} + 1 AS mid", "20 + cast(l_partkey % 180 as int) AS in_tok",
        "1 + (price + 97 * slot) % 900 AS out_tok", "(l_suppkey % 10 = 9 OR (slot = 2 AND l_orderkey % 10 = 7)) AS unjudged",
    ).selectExpr(
        f"(l_orderkey * 10 + l_linenumber) * {RUN_MODELS} + slot AS id", "l_suppkey + 1 AS run_id", "mid AS model_id",
        "concat('Answer of model ', mid, ' to order ', l_orderkey, ' line ', l_linenumber) AS response",
        "price + slot AS latency_ms", "in_tok AS input_tokens", "out_tok AS output_tokens",
        "cast((in_tok + 3 * out_tok) * mid * 0.000001 as decimal(18,9)) AS cost",
        "CASE WHEN NOT unjudged THEN cast(((cast(l_quantity as int) + 7 * slot) % 51) * 0.1 as decimal(3,1)) END AS judge_score",
        "CASE WHEN NOT unjudged THEN 'judged' END AS judge_reasoning", "l_shipdate AS created_at",
        "CASE WHEN l_orderkey % 50 > 0 THEN concat('o', l_orderkey, '-', l_linenumber) END AS case_id",
        "cast(null as string) AS prompt_style", "concat('Order ', l_orderkey) AS question", "0 AS sample_idx",
        *[f"cast(null as int) AS resp_style_{k}" for k in ("headers", "bold", "ordered", "unordered", "code_blocks")],
    )


def models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as models; the last two ids of one run group share a name."""
    return table(spark, sf_dir, "nation").selectExpr(
        "cast(n_nationkey + 1 as bigint) AS id",
        "concat('provider-', n_regionkey) AS provider",
        "CASE WHEN n_nationkey = 24 THEN 'NATION_19' ELSE n_name END AS name",
        "concat('v', n_nationkey) AS version",
        "cast((n_nationkey + 1) * 0.000001 as decimal(18,12)) AS input_cost",
        "cast((n_nationkey + 1) * 0.000003 as decimal(18,12)) AS output_cost",
        "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(n_nationkey) AS created_at",
        "CASE WHEN n_nationkey <> 6 THEN 100000 * (least(n_nationkey, 19) + 1) END AS context_window",
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as runs over the data set of their nation; some never finish."""
    started = "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(cast(s_suppkey as int))"
    return table(spark, sf_dir, "supplier").selectExpr(
        "s_suppkey + 1 AS id",
        "cast(s_nationkey + 1 as bigint) AS prompt_id",
        "concat('set-', s_nationkey) AS dataset",
        f"{started} AS started_at",
        f"CASE WHEN s_suppkey % 10 <> 4 THEN {started} + make_dt_interval(0, 0, 0, cast((s_suppkey + 1) * 90 as int)) END AS finished_at",
    )


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as a catalogue with many dated rows per name; some have no version."""
    return table(spark, sf_dir, "part").selectExpr(
        "p_partkey AS id", "p_type AS provider", "p_brand AS name",
        "CASE WHEN p_size < 50 THEN concat(p_name, '-', p_size) END AS version",
        "cast(p_retailprice * 0.000001 as decimal(18,12)) AS input_cost",
        "cast(p_retailprice * 0.000003 as decimal(18,12)) AS output_cost",
        "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(p_size) AS created_at",
        "CASE WHEN p_size % 3 = 0 THEN p_size * 1000 END AS context_window",
    )


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as responses, each opened by one markdown form or none."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    opening = ("CASE doc_id % 5 WHEN 0 THEN '# Title\\n' WHEN 1 THEN '- item\\n* item\\n' "
               "WHEN 2 THEN '1. first\\n2. second\\n' WHEN 3 THEN '```\\n# code **x**\\n```\\n' ELSE '' END")
    return docs.join(labels, "doc_id", "left").selectExpr(
        "doc_id AS id", "lang", "source",
        f"concat({opening}, text) AS response",
        "CASE WHEN quality IS NOT NULL THEN cast(1 + 3 * quality + 0.1 * (doc_id % 10) as decimal(3,1)) END AS judge_score",
        f"element_at({_array(REASONINGS)}, cast(doc_id % {len(REASONINGS)} as int) + 1) AS judge_reasoning",
        "text AS question",
    )


def verdict_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as raw judge answers: valid forms and every kind of reject.

    The text of the document is carried inside the JSON as the reasoning.
    """
    return table(spark, sf_dir, "documents").selectExpr(
        "doc_id AS id",
        "to_json(named_struct('r', text)) AS quoted", "n_chars % 101 AS pct",
    ).selectExpr(
        "id", "substr(quoted, 6, length(quoted) - 6) AS reasoning",
        "CASE WHEN pct < 100 THEN concat('0.', lpad(cast(pct as string), 2, '0')) ELSE '1.00' END AS score",
    ).selectExpr(
        "id",
        "CASE id % 11"
        " WHEN 0 THEN concat('{\"score\": ', score, ', \"reasoning\": ', reasoning, '}')"
        " WHEN 1 THEN concat('Voici :\\n```json\\n{\"score\": ', score, ', \"reasoning\": ', reasoning, '}\\n```')"
        " WHEN 2 THEN concat('Score ', score, ' because ', reasoning)"
        " WHEN 3 THEN concat('{\"score\": 1', score, ', \"reasoning\": ', reasoning, '}')"
        " WHEN 4 THEN concat('{\"score\": true, \"reasoning\": ', reasoning, '}')"
        " WHEN 5 THEN concat('{\"score\": ', score, ', \"reasoning\": \"  \"}')"
        " WHEN 6 THEN concat('[', score, ', ', reasoning, ']')"
        " WHEN 8 THEN concat('{\"score\": ', score, ', \"reasoning\": ', reasoning, '} as asked')"
        " WHEN 9 THEN concat('{\"score\": ', score, ', \"reasoning\": ', reasoning, '}{\"score\": 1}')"
        " WHEN 10 THEN concat('```\n{\"score\": ', score, ', \"reasoning\": ', reasoning, '}\n```\n```\n{\"score\": 1}\n```')"
        " ELSE concat('{\"score\": 1, \"reasoning\": ', reasoning, '}') END AS raw",
    )


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as successive versions of one prompt per conversation."""
    return table(spark, sf_dir, "conversations").selectExpr(
        "conv_id * 1000 + turn AS id", "concat('conv-', conv_id) AS name", "text AS content",
        "concat('1.', turn) AS version", "role", "conv_id", "turn",
        "timestamp_ntz'2024-03-01 00:00:00' + make_dt_interval(0, cast(turn as int) * 7) AS created_at",
    )


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as questions by language."""
    return table(spark, sf_dir, "documents").selectExpr(
        "concat('q', lpad(cast(doc_id as string), 9, '0')) AS uid", "lang AS subcategory", "text AS prompt")


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A decision log: each run and profile was decided up to three times.

    The rank-3 and rank-2 models were recommended before the winner. The oldest
    rows of one profile carry no profile, those of another no run.
    """
    from gradeloom.operators import decisions as D
    from gradeloom.operators import rollups as R

    profiles = D.shipped_profiles(spark)
    metrics = R.model_decision_metrics(results(spark, sf_dir), models(spark, sf_dir))
    ranked = D.rank_models(metrics, profiles)
    number = "CASE profile WHEN 'economie' THEN 1 WHEN 'equilibre' THEN 2 WHEN 'etudiant' THEN 3 ELSE 4 END"
    return D.recommend(ranked).select(
        "*", F.posexplode("weighted_scores").alias("pos", "entry")
    ).where("pos < 3").selectExpr(
        "*", "pos + 1 AS rank", "entry.model AS model"
    ).selectExpr(
        f"run_id * 100 + ({number}) * 10 + 4 - rank AS id",
        "model AS recommended_model", "confidence",
        "array('mean_judge_score', 'efficiency') AS determinant_metrics",
        "'' AS tradeoffs", "concat('Le modèle ', model, ' est retenu.') AS reasoning",
        "cast(7 as bigint) AS prompt_id", "cast(null as string) AS input_hash",
        "cast(null as string) AS input_snapshot",
        "timestamp_ntz'2024-06-01 00:00:00' + make_dt_interval(4 - rank) AS created_at",
        "CASE WHEN NOT (profile = 'equilibre' AND rank = 3) THEN profile END AS profile",
        "weighted_scores",
        "CASE WHEN NOT (profile = 'rapide' AND rank = 3) THEN run_id END AS run_id",
    )
