"""Small result tables for the tests."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from gradeloom import schema

T0 = dt.datetime(2024, 1, 1)
_DEFAULT = {
    "response": "r", "latency_ms": 100, "input_tokens": 10, "output_tokens": 20, "cost": Decimal("0.001"),
    "judge_score": None, "judge_reasoning": None, "created_at": T0, "case_id": "c1", "prompt_style": None,
    "question": "q", "sample_idx": 0, **{f"resp_style_{k}": 0 for k in schema.STYLE_COUNTS},
}


def results(spark, rows):
    """Result rows from dicts; scores may be given as text."""
    out = []
    for i, row in enumerate(rows, start=1):
        full = {"id": i, "run_id": 1, "model_id": 1, **_DEFAULT, **row}
        if full["judge_score"] is not None:
            full["judge_score"] = Decimal(str(full["judge_score"]))
        out.append(tuple(full[f] for f in schema.RESULTS.fieldNames()))
    return spark.createDataFrame(out, schema.RESULTS)


def models(spark, *names, windows=None):
    rows = [(i, "p", n, "v", Decimal("0.000003"), Decimal("0.000015"), T0, (windows or {}).get(i, 1000))
            for i, n in enumerate(names, start=1)]
    return spark.createDataFrame(rows, schema.MODELS)


def runs(spark, *rows):
    return spark.createDataFrame([(i, 1, d, s, f) for i, d, s, f in rows], schema.RUNS)


def rows(df, *columns):
    """Rows as sorted tuples."""
    picked = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in picked.collect()), key=repr)
