"""Table schemas and the fixed values shared by the operators."""

from __future__ import annotations

from pyspark.sql import types as T

PRICE = T.DecimalType(18, 12)
COST = T.DecimalType(18, 9)
SCORE = T.DecimalType(3, 1)


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


_L, _I, _S, _TS = T.LongType(), T.IntegerType(), T.StringType(), T.TimestampNTZType()

MODELS = _struct(
    ("id", _L), ("provider", _S), ("name", _S), ("version", _S),
    ("input_cost", PRICE), ("output_cost", PRICE),
    ("created_at", _TS), ("context_window", _I),
)

PROMPTS = _struct(
    ("id", _L), ("name", _S), ("content", _S), ("version", _S), ("hash", _S),
    ("created_at", _TS), ("previous_version_id", _L),
)

RUNS = _struct(
    ("id", _L), ("prompt_id", _L), ("dataset", _S), ("started_at", _TS), ("finished_at", _TS),
)

RESULTS = _struct(
    ("id", _L), ("run_id", _L), ("model_id", _L), ("response", _S),
    ("latency_ms", _I), ("input_tokens", _I), ("output_tokens", _I), ("cost", COST),
    ("judge_score", SCORE), ("judge_reasoning", _S), ("created_at", _TS),
    ("case_id", _S), ("prompt_style", _S), ("question", _S), ("sample_idx", _I),
    ("resp_style_headers", _I), ("resp_style_bold", _I), ("resp_style_ordered", _I),
    ("resp_style_unordered", _I), ("resp_style_code_blocks", _I),
)

RANKING = T.ArrayType(_struct(("model", _S), ("score", T.DoubleType())))

DECISIONS = _struct(
    ("id", _L), ("recommended_model", _S), ("confidence", _S),
    ("determinant_metrics", T.ArrayType(_S)), ("tradeoffs", _S), ("reasoning", _S),
    ("prompt_id", _L), ("input_hash", _S), ("input_snapshot", _S), ("created_at", _TS),
    ("profile", _S), ("weighted_scores", RANKING), ("run_id", _L),
)

QUESTIONS = _struct(("uid", _S), ("subcategory", _S), ("prompt", _S))

PROFILES = _struct(("profile", _S), ("metric", _S), ("weight", T.DoubleType()))

STYLE_COUNTS = ["headers", "bold", "ordered", "unordered", "code_blocks"]

# Ranking metrics, True where a higher value is better.
METRIC_DIRECTION = {
    "mean_judge_score": True,
    "efficiency": True,
    "avg_total_tokens": False,
    "avg_latency_ms": False,
    "ctx_pct": False,
    "avg_cost": False,
    "stddev_judge_score": False,
}

# The shipped usage profiles and their metric weights.
DEFAULT_PROFILE = "equilibre"
PROFILE_WEIGHTS = {
    "equilibre": {
        "mean_judge_score": 0.4,
        "efficiency": 0.3,
        "avg_latency_ms": 0.2,
        "avg_total_tokens": 0.1,
    },
    "etudiant": {"mean_judge_score": 0.5, "efficiency": 0.3, "avg_cost": 0.2},
    "rapide": {"avg_latency_ms": 0.8, "mean_judge_score": 0.2},
    "economie": {"avg_total_tokens": 0.6, "efficiency": 0.3, "mean_judge_score": 0.1},
}

# Margin of the best model over the runner-up, and its label.
CONFIDENCE_HIGH_MARGIN = 0.15
CONFIDENCE_MEDIUM_MARGIN = 0.05
CONFIDENCE_HIGH, CONFIDENCE_MEDIUM, CONFIDENCE_LOW = "élevée", "moyenne", "faible"

# Triage labels and the keywords that select them, first match wins.
NOT_JUDGED = "Non jugé"
OTHER_FAILURE = "Autre"
FAILURE_KEYWORDS = [
    ("Refus / clarification",
     ["refus", "décline", "clarification", "pose des questions", "précision"]),
    ("Omission / incomplet",
     ["omet", "incomplet", "manque", "oublie", "n'atteint pas"]),
    ("Non-respect de forme",
     ["nombre de mots", "rime", "format", "longueur", "préambule", "consigne"]),
    ("Erreur de fond",
     ["erreur", "incorrect", "faux", "fausse", "incohér"]),
]

# Run status codes.
STATUS_OK, STATUS_PARTIAL, STATUS_REGRESSION = 0, 3, 5

# Check kinds of the case files and their default pass marks.
DETERMINISTIC_CHECKS = ["exact", "contains", "not_contains", "regex", "json_schema", "code_test"]
JUDGED_CHECKS = ["judge", "refusal"]
DETERMINISTIC_THRESHOLD, JUDGED_THRESHOLD = 1.0, 0.7
