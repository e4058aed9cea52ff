"""Run life cycle: finalising, snapshots per data set, purging."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeloom.functions.windows import number_rows
from gradeloom.sources.tables import append_decisions, append_results


def open_runs(runs: DataFrame, requested: DataFrame, now: dt.datetime) -> DataFrame:
    """New, unfinished runs for (request, prompt_id, dataset) rows; ids follow the last run."""
    return number_rows(requested, "request", [], runs).select(
        "request", "id", "prompt_id", "dataset", F.lit(str(now)).cast("timestamp_ntz").alias("started_at"),
        F.lit(None).cast("timestamp_ntz").alias("finished_at"),
    )


def finalize_runs(runs: DataFrame, results: DataFrame, now: dt.datetime) -> DataFrame:
    """Close open runs at their last row, or at ``now`` when they have none."""
    last = results.groupBy("run_id").agg(F.max("created_at").alias("_last"))
    return (
        runs.join(last, runs["id"] == last["run_id"], "left")
        .withColumn("finished_at", F.coalesce("finished_at", "_last", F.lit(str(now)).cast("timestamp_ntz")))
        .select(*runs.columns)
    )


def _rows_of(df: DataFrame, runs: DataFrame, how: str) -> DataFrame:
    """Rows of ``df`` whose run is (``left_semi``) or is not (``left_anti``) chosen."""
    return df.join(runs.select(F.col("id").alias("run_id")), "run_id", how)


def export_dataset(runs: DataFrame, results: DataFrame, decisions: DataFrame, name: str | Column,
                   path: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Runs, results and decisions of one data set, also written when a path is given.

    The name may be a scalar subquery. A data set without runs is refused: it is a misspelt name.
    """
    chosen = runs.where(F.col("dataset") == name)
    if chosen.isEmpty():
        raise ValueError(f"no run of data set {name!r}")
    parts = chosen, _rows_of(results, chosen, "left_semi"), _rows_of(decisions, chosen, "left_semi")
    if path:
        parts[0].write.mode("errorifexists").parquet(f"{path}/runs")
        append_results(parts[1], f"{path}/results")
        append_decisions(parts[2], f"{path}/decisions")
    return parts


def restore_dataset(current: tuple[DataFrame, DataFrame, DataFrame],
                    snapshot: tuple[DataFrame, DataFrame, DataFrame], name: str | Column
                    ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Current (runs, results, decisions) with one data set's rows replaced."""
    runs, results, decisions = current
    old = runs.where(F.col("dataset") == name)
    kept = (
        runs.where(~F.col("dataset").eqNullSafe(name)),
        _rows_of(results, old, "left_anti"), _rows_of(decisions, old, "left_anti"),
    )
    return tuple(k.unionByName(s) for k, s in zip(kept, snapshot))


def chosen_runs(today: dt.date | None = None, run_id: int | None = None,
                dataset: str | Column | None = None, everything: bool = False) -> Column:
    """Condition on the runs table for one of the four purge modes."""
    modes = [today is not None, run_id is not None, dataset is not None, everything]
    if sum(modes) != 1:
        raise ValueError("choose exactly one of today, run_id, dataset, everything")
    if today is not None:
        return F.to_date("started_at") == F.lit(today)
    if run_id is not None:
        return F.col("id") == run_id
    return F.col("dataset") == dataset if dataset is not None else F.lit(True)


def purge_preview(runs: DataFrame, results: DataFrame, condition: Column) -> DataFrame:
    """The runs a purge would drop, with their number of results."""
    doomed = runs.where(condition)
    counts = _rows_of(results, doomed, "left_semi").groupBy("run_id").agg(F.count(F.lit(1)).alias("results"))
    return (
        doomed.join(counts, doomed["id"] == counts["run_id"], "left")
        .select("id", "dataset", "started_at", F.coalesce("results", F.lit(0)).alias("results"))
        .orderBy("id")
    )


def purge_runs(runs: DataFrame, results: DataFrame, decisions: DataFrame, condition: Column
               ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What remains after dropping the chosen runs with their results and decisions."""
    doomed = runs.where(condition)
    return (
        runs.join(doomed.select("id"), "id", "left_anti"),
        _rows_of(results, doomed, "left_anti"), _rows_of(decisions, doomed, "left_anti"),
    )
