"""Response style: markdown features and the style-controlled regression."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeloom.functions.text import style_counts
from gradeloom.operators.rollups import named_results
from gradeloom.schema import STYLE_COUNTS

FEATURES = ["log1p_tokens", *STYLE_COUNTS]


def with_style_features(responses: DataFrame, column: str = "response") -> DataFrame:
    """Adds the markdown counts of the response text."""
    return responses.withColumns(
        {f"resp_style_{k}": v for k, v in style_counts(F.col(column)).items()}
    )


def style_observations(results: DataFrame, models: DataFrame, run_id: int | Column | None = None,
                       exclude_code: bool = False, by: tuple[str, ...] = ()) -> DataFrame:
    """Per (model, case) means over the replicates of judged, styled rows.

    ``by`` keeps further keys apart, such as ``run_id`` for one fit per run.
    """
    rows = results.where("judge_score IS NOT NULL AND resp_style_headers IS NOT NULL")
    if run_id is not None:
        rows = rows.where(F.col("run_id") == run_id)
    if exclude_code:
        rows = rows.where("resp_style_code_blocks = 0")
    figures = {"output_tokens": "output_tokens", **{f"resp_style_{k}": k for k in STYLE_COUNTS}}
    sums = [F.sum(F.col(c).cast("bigint")).alias(f"{k}_sum") for c, k in figures.items()]
    counts = [F.count(c).alias(f"{k}_n") for c, k in figures.items()]
    # Whole-number sums by model id meet the catalogue and are added up over the ids of a name.
    part = rows.groupBy(*by, "model_id", "case_id").agg(
        F.sum((F.col("judge_score") * 10).cast("bigint")).alias("tenths"), F.count(F.lit(1)).alias("n"), *sums, *counts)
    both = ["tenths", "n", *[f"{k}_{s}" for k in figures.values() for s in ("sum", "n")]]
    return named_results(part, models).groupBy(*by, "model", "case_id").agg(*[F.sum(c).alias(c) for c in both]).select(
        *by, "model", "case_id", (F.col("tenths") / (F.col("n") * 10)).alias("judge_score"),
        *[F.try_divide(f"{k}_sum", f"{k}_n").alias(k) for k in figures.values()])


def _complete(observations: DataFrame) -> DataFrame:
    """Observations with every figure, and their token count on a log scale."""
    obs = observations.withColumn("log1p_tokens", F.log1p("output_tokens"))
    return obs.dropna(subset=["model", "judge_score", *FEATURES])


def _triangles(keys: list[str], wide: int):
    """Replaces the rows of a (fit, model) in a batch by the triangle of their QR decomposition.

    A row is (keys, model, r, n, sums): ``r`` is a row of the block's matrix, whose
    columns are one, the features and the score; ``n`` and ``sums`` say how many
    observations it stands for and what they add up to. Q is orthogonal, so least
    squares over the triangles have the singular values and the solution of those
    over the observations. Blocks that are no longer than a triangle stay.
    """
    columns = [*keys, "model", "r", "n", "sums"]

    def reduce(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            size = frame.groupby([*keys, "model"], dropna=False, sort=False)["n"].transform("size")
            small = size <= wide
            yield frame.loc[small, columns]
            for key, block in frame[~small].groupby([*keys, "model"], dropna=False, sort=False):
                triangle = np.linalg.qr(np.array(block["r"].tolist()), mode="r")
                head = np.arange(len(triangle)) == 0
                out = pd.DataFrame({"r": list(triangle), "n": np.where(head, int(block["n"].sum()), 0)})
                total = np.array(block["sums"].tolist()).sum(axis=0)
                out["sums"] = [total if h else total * 0.0 for h in head]
                for name, value in zip([*keys, "model"], key):
                    out[name] = value
                yield out[columns]

    return reduce


def _blocks(observations: DataFrame, keys: list[str]) -> DataFrame:
    """Per (fit, model): a matrix of a few rows that stands for its observations.

    Triangles are made per batch of rows in the tasks that hold the observations,
    and again per batch after one shuffle by (fit, model): a tree whose nodes take
    in a batch each, so no task gathers a fit.
    """
    row = [F.lit(1.0), *[F.col(f).cast("double") for f in FEATURES], F.col("judge_score").cast("double")]
    rows = _complete(observations).select(*keys, "model", F.array(*row).alias("r"), F.lit(1).cast("bigint").alias("n"), F.array(*row[1:]).alias("sums"))
    reduce, kind = _triangles(keys, len(row)), rows.schema
    once = rows.mapInPandas(reduce, kind)
    return once.repartition(*keys, "model").sortWithinPartitions(*keys, "model").mapInPandas(reduce, kind)


def _solve(blocks: pd.DataFrame, models: list[str], n: int) -> tuple[np.ndarray, int]:
    """Minimum-norm least squares and rank of the pooled fit.

    Columns: intercept, features, one indicator per model after the first. A row
    of a model's block has its first entry, that of the ones, in the intercept's
    column and in the model's. The cut-off is that of the whole design matrix.
    """
    r = np.array(blocks["r"].tolist())
    own = np.zeros((len(r), len(models)))
    own[np.arange(len(r)), blocks["model"].map({m: i for i, m in enumerate(models)})] = r[:, 0]
    design = np.hstack([r[:, :-1], own[:, 1:]])
    cut = np.finfo(float).eps * max(n, design.shape[1])
    beta, _, rank, _ = np.linalg.lstsq(design, r[:, -1], rcond=cut)
    return beta, int(rank)


_FIT_SCHEMA = (
    "model string, n bigint, raw_mean double, adjusted double, "
    + ", ".join(f"slope_{f} double" for f in FEATURES)
    + ", n_obs bigint, rank_deficient boolean"
)


def fit_style_model(observations: DataFrame, by: tuple[str, ...] = (), min_obs: int = 20) -> DataFrame:
    """Score on style features with one fixed effect per model, by least squares.

    One row per model: raw mean, score at the global-mean style, and the slopes
    common to the fit. The observations stay distributed; a solve receives a few
    rows per model of the catalogue. Observations without a figure take no part. Fits
    with fewer than ``min_obs`` observations give no rows; ``fit_status`` names them.
    """
    keys = list(by)
    columns = [*keys, *[c.split()[0] for c in _FIT_SCHEMA.split(", ")]]

    def fit(blocks: pd.DataFrame) -> pd.DataFrame:
        total = int(blocks["n"].sum())
        if total < min_obs:
            return pd.DataFrame(columns=columns)
        models = sorted(blocks["model"].unique())
        beta, rank = _solve(blocks, models, total)
        f = len(FEATURES)
        sums = pd.DataFrame(blocks["sums"].tolist(), index=blocks["model"]).groupby(level=0).sum().loc[models].to_numpy()
        n = blocks.groupby("model")["n"].sum().loc[models].to_numpy()
        base = beta[0] + beta[1:f + 1] @ (sums[:, :f].sum(axis=0) / total)
        out = pd.DataFrame({"model": models, "n": n, "raw_mean": sums[:, f] / n, "adjusted": base + np.concatenate([[0.0], beta[f + 1:]])})
        for i, name in enumerate(FEATURES):
            out[f"slope_{name}"] = beta[1 + i]
        out["n_obs"], out["rank_deficient"] = total, rank < len(beta)
        for k in keys:
            out[k] = blocks[k].iloc[0]
        return out[columns]

    blocks = _blocks(observations, keys)
    if not keys:
        return blocks.groupBy(F.lit(0).alias("_all")).applyInPandas(fit, _FIT_SCHEMA)
    head = ", ".join(f"{k} {dict(observations.dtypes)[k]}" for k in keys)
    return blocks.groupBy(*keys).applyInPandas(fit, f"{head}, {_FIT_SCHEMA}")


def fit_status(observations: DataFrame, by: tuple[str, ...] = (), min_obs: int = 20) -> DataFrame:
    """Per fit: its observations and models, and the ``reason`` when it is refused.

    Without keys there is one row, also over no observations.
    """
    g = _complete(observations).groupBy(*by, "model").agg(F.count(F.lit(1)).alias("n"))
    g = g.groupBy(*by).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_obs"), F.count(F.lit(1)).alias("n_models"))
    few = F.concat(F.lit("only "), F.col("n_obs"), F.lit(f" observations, {min_obs} are needed"))
    return g.withColumn("reason", F.when(F.col("n_obs") < min_obs, few))


def style_slopes(fit: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The judge's sensitivity to each style feature."""
    stack = ", ".join(f"'{f}', slope_{f}" for f in FEATURES)
    return fit.selectExpr(*by, f"stack({len(FEATURES)}, {stack}) AS (feature, slope)").distinct()


def style_report(fit: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Raw against style-adjusted score per model, best adjusted first."""
    return fit.select(
        *by, "model", "raw_mean", "adjusted", (F.col("adjusted") - F.col("raw_mean")).alias("delta"),
        "n", "rank_deficient",
    ).orderBy(*by, F.desc("adjusted"))
