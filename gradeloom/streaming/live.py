"""Boards that fill while a run is under way, and the regression alert, on Spark's own state.

``start_board`` keeps counts per (run, model) as a streaming aggregation; each
trigger gives the totals that changed, and these replace their rows on the board.
``start_run_views`` keeps the figures that cannot be added up, from facts that are
stored by run. ``start_alerts`` follows the running mean of each model in event time
and emits each crossing of the threshold once.

What a trigger writes depends on its batch only, and is written over what the same
batch wrote before, so a replay after a failure changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gradeloom.operators.rollups import model_metrics

# --- counts as rows land ------------------------------------------------------

_SUMS = ["n_results", "n_judged", "score_tenths", "tokens"]
_BOARD = T.StructType([T.StructField("run_id", T.LongType()), T.StructField("model", T.StringType()),
                       *[T.StructField(name, T.LongType()) for name in _SUMS]])


def running_sums(results: DataFrame) -> DataFrame:
    """Whole-number totals per (run, model); of a stream, kept as its state.

    The state has a row per model of a run and no watermark: a row counts however
    late it lands.
    """
    tenths = (F.col("judge_score") * 10).cast("bigint")
    return results.groupBy("run_id", "model").agg(
        F.count(F.lit(1)).alias("n_results"), F.count("judge_score").alias("n_judged"),
        F.coalesce(F.sum(tenths), F.lit(0)).alias("score_tenths"),
        F.sum(F.col("output_tokens").cast("bigint")).alias("tokens"),
    )


def _among(column: str, values: list) -> Column:
    known = F.col(column).isin([v for v in values if v is not None])
    return F.coalesce(known, F.lit(False)) | F.col(column).isNull() if None in values else known


def _grouped(rows: DataFrame, runs_per_folder: int) -> DataFrame:
    return rows.withColumn("run_group", F.floor(F.col("run_id") / runs_per_folder).cast("long"))


def _values(rows: DataFrame, column: str) -> list:
    """Runs or run groups of a batch: no more than the folders that the driver lists for any read."""
    return [r[0] for r in rows.select(column).distinct().collect()]


def _overwrite(rows: DataFrame, path: str, *folders: str) -> None:
    """Replace the folders that ``rows`` has values for; the others stay."""
    (rows.hint("rebalance", folders[0]).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(*folders).parquet(path))


def _schema_with(schema: T.StructType, *more: str) -> T.StructType:
    return T.StructType([*schema.fields, *[T.StructField(name, T.LongType()) for name in more]])


def _prepared(spark: SparkSession, path: str, schema: T.StructType, *folders: str) -> None:
    spark.createDataFrame([], schema).write.mode("append").partitionBy(*folders).parquet(path)


#: Runs that share a folder of the small tables of figures.
_FIGURES = 1000


def _merge(rows: DataFrame, keys: list[str], path: str) -> None:
    """Rows of a figures table whose keys are in ``rows`` make way for these."""
    new = _grouped(rows, _FIGURES)
    groups = _values(new, "run_group")
    if groups:
        held = rows.sparkSession.read.schema(new.schema).parquet(path).where(_among("run_group", groups))
        key = rows.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()
        kept = held.join(key, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], "left_anti")
        _overwrite(kept.select(*new.columns).unionByName(new), path, "run_group")


def _started(writer, checkpoint: str, once: bool) -> StreamingQuery:
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def start_board(stream: DataFrame, out: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Keep the totals of a stream of result rows (run_id, model, judge_score, output_tokens) under ``out``.

    A trigger replaces the totals that changed; it reads and rewrites the folders,
    of a thousand runs each, that hold them.
    """
    _prepared(stream.sparkSession, out, _schema_with(_BOARD, "run_group"), "run_group")

    def write(changed: DataFrame, batch_id: int) -> None:
        changed.persist()
        _merge(changed, ["run_id", "model"], out)
        changed.unpersist()

    return _started(running_sums(stream).writeStream.outputMode("update").foreachBatch(write), checkpoint, once)


def read_board(spark: SparkSession, out: str) -> DataFrame:
    """Counts and mean score per (run, model) so far."""
    return spark.read.schema(_BOARD).parquet(out).select(
        "run_id", "model", "n_results", "n_judged", "tokens",
        F.try_divide(F.col("score_tenths"), F.col("n_judged") * 10).alias("mean_score"))


# --- figures that cannot be added up ------------------------------------------

def facts_of_runs(spark: SparkSession, facts: str, schema: T.StructType, runs: list, runs_per_folder: int = 1) -> DataFrame:
    """All stored rows of some runs; only the folders of these runs are opened."""
    groups = list({None if r is None else r // runs_per_folder for r in runs})
    return _facts_of_groups(spark, facts, schema, groups).where(_among("run_id", runs))


def _facts_of_groups(spark: SparkSession, facts: str, schema: T.StructType, groups: list) -> DataFrame:
    held = spark.read.schema(_schema_with(schema, "run_group")).parquet(facts)
    return held.where(_among("run_group", groups)).select(*schema.fieldNames())


def start_run_views(stream: DataFrame, models: DataFrame, out: str, checkpoint: str, runs_per_folder: int = 1,
                    once: bool = False) -> StreamingQuery:
    """Keep the model metrics on complete cases up to date under ``out``.

    Facts are stored by run (or by groups of small runs) and batch, and the metrics
    of the runs of a batch are computed anew from the folders of these runs. Of a batch
    the driver learns the folders; its runs meet the facts in a join.
    """
    spark, schema, facts, metrics = stream.sparkSession, stream.schema, f"{out}/facts", f"{out}/model_metrics"
    _prepared(spark, facts, _schema_with(schema, "run_group", "batch_id"), "run_group", "batch_id")
    kind = model_metrics(spark.createDataFrame([], schema), models).schema
    _prepared(spark, metrics, _schema_with(kind, "run_group"), "run_group")

    def write(batch: DataFrame, batch_id: int) -> None:
        # A replayed batch overwrites its own folders.
        rows = _grouped(batch, runs_per_folder).withColumn("batch_id", F.lit(batch_id).cast("long"))
        _overwrite(rows, facts, "run_group", "batch_id")
        # Of the batch only the runs are kept; the rest of it is in the folders.
        runs = batch.select("run_id").distinct().persist()
        groups = _values(_grouped(runs, runs_per_folder), "run_group")
        if groups:
            held, run = _facts_of_groups(batch.sparkSession, facts, schema, groups), runs.select(F.col("run_id").alias("_run"))
            touched = held.join(run, F.col("run_id").eqNullSafe(F.col("_run")), "left_semi")
            figures = model_metrics(touched, models).persist()
            _merge(figures, ["run_id"], metrics)
            figures.unpersist()
        runs.unpersist()

    return _started(stream.writeStream.foreachBatch(write), checkpoint, once)


def read_run_views(spark: SparkSession, out: str, models: DataFrame, results: DataFrame) -> DataFrame:
    """Model metrics of every run, as of the last batch that touched it; ``results`` gives the schema."""
    kind = model_metrics(results, models).schema
    return spark.read.schema(kind).parquet(f"{out}/model_metrics").select(*kind.fieldNames())


# --- raise and resolve --------------------------------------------------------

_DAY = "model string, ts timestamp, day date, closes bigint, n bigint, s bigint"
_STATE = "n long, s long, low boolean, closed long, days array<long>, ns array<long>, ss array<long>"
_ALERT = "model string, day date, mean_score double, event string"


def _folded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows added up per (model, day) before they are shuffled; the newest time stands for them."""
    keys = ["model", "day", "closes"]
    for batch in batches:
        sums = pa.Table.from_batches([batch]).group_by(keys).aggregate([("ts", "max"), ("n", "sum"), ("s", "sum")])
        sums = sums.rename_columns([c.removesuffix("_max").removesuffix("_sum") for c in sums.column_names])
        yield from sums.select(["model", "ts", "day", "closes", "n", "s"]).combine_chunks().to_batches()


#: Spark leaves out rows behind its watermark. It is set this far behind the newest row, so that it
#: leaves out none that is less late; the days are closed by a clock of their own, ``delay`` behind.
_REACH_DAYS = 3650


def _follow(threshold: float, behind: int):
    """The state of one model: sums and side of the threshold up to the last closed day, and the open days.

    The clock that closes days runs ``behind`` milliseconds ahead of the watermark.
    """

    def follow(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, s, low, closed, days, ns, ss = state.get if state.exists else (0, 0, False, -1, [], [], [])
        waiting = {d: (a, b) for d, a, b in zip(days, ns, ss)}
        for frame in frames:
            for closes, a, b in zip(frame["closes"], frame["n"], frame["s"]):
                # A row of a day that is closed counts from the next day on.
                if closes <= closed:
                    n, s = n + int(a), s + int(b)
                else:
                    before = waiting.get(int(closes), (0, 0))
                    waiting[int(closes)] = before[0] + int(a), before[1] + int(b)
        now, out = state.getCurrentWatermarkMs() + behind, []
        for closes in sorted(d for d in waiting if d <= now):
            a, b = waiting.pop(closes)
            n, s, closed = n + a, s + b, closes
            mean = s / (n * 10) if n else None
            below = mean is not None and mean < threshold
            if below != low:
                out.append((key[0], closes, mean, "raised" if below else "resolved"))
                low = below
        state.update((n, s, low, closed, sorted(waiting), [waiting[d][0] for d in sorted(waiting)], [waiting[d][1] for d in sorted(waiting)]))
        if waiting:
            # A group is called once the watermark is beyond its timeout, here: at the end of the day.
            state.setTimeoutTimestamp(max(min(waiting) - 1, now + 1) - behind)
        if out:
            yield pd.DataFrame(out, columns=["model", "closes", "mean_score", "event"])

    return follow


def alerts(stream: DataFrame, threshold: float = 3.5, delay: str = "1 day") -> DataFrame:
    """Days on which a model's running mean score fell below the threshold or recovered.

    A day is closed when the newest row is ``delay`` past its end; models then learn their mean up to that day, day by day, and each crossing
    is emitted once. A row that lands after its day was closed, up to ten years late,
    counts from the model's next day on. Days are those of the session's time zone. The
    state of a model holds its open days, about as many as ``delay`` spans.
    """
    day = F.to_date("created_at")
    rows = stream.where("model IS NOT NULL AND created_at IS NOT NULL").select(
        "model", F.col("created_at").cast("timestamp").alias("ts"), day.alias("day"),
        F.unix_millis(F.date_add(day, 1).cast("timestamp")).alias("closes"),
        F.col("judge_score").isNotNull().cast("bigint").alias("n"),
        F.coalesce((F.col("judge_score") * 10).cast("bigint"), F.lit(0)).alias("s"))
    watched = rows.mapInArrow(_folded, _DAY).withWatermark("ts", f"{_REACH_DAYS} days")
    behind = int((pd.Timedelta(days=_REACH_DAYS) - pd.Timedelta(delay)).total_seconds() * 1000)
    found = watched.groupBy("model").applyInPandasWithState(
        _follow(threshold, behind), "model string, closes bigint, mean_score double, event string", _STATE, "append", GroupStateTimeout.EventTimeTimeout)
    last = F.date_sub(F.timestamp_millis("closes").cast("date"), 1)
    return found.select("model", last.alias("day"), "mean_score", "event")


def start_alerts(stream: DataFrame, out: str, checkpoint: str, threshold: float = 3.5, delay: str = "1 day",
                 once: bool = False) -> StreamingQuery:
    """Append the ``alerts`` of a stream of result rows to the Parquet log under ``out``, each exactly once."""
    found = alerts(stream, threshold, delay)
    return _started(found.writeStream.outputMode("append").format("parquet").option("path", out), checkpoint, once)


def read_alerts(spark: SparkSession, out: str) -> DataFrame:
    """The log of alerts; empty before the first."""
    return spark.read.schema(_ALERT).parquet(out)
