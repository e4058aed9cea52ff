"""Reading and appending the evaluation tables."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradeloom import schema
from gradeloom.session import settings

_SCHEMAS = {
    "models": schema.MODELS, "prompts": schema.PROMPTS, "runs": schema.RUNS,
    "results": schema.RESULTS, "decisions": schema.DECISIONS,
}


@dataclass(frozen=True)
class EvalTables:
    """The five tables of an evaluation store."""

    models: DataFrame
    prompts: DataFrame
    runs: DataFrame
    results: DataFrame
    decisions: DataFrame


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.schema(_SCHEMAS[name]).parquet(f"{root}/{name}")


def read_tables(spark: SparkSession, root: str) -> EvalTables:
    return EvalTables(**{name: read_table(spark, root, name) for name in _SCHEMAS})


def _append(df: DataFrame, path: str, run_folders: bool) -> None:
    """Append rows, clustered and sorted by run.

    The rebalancing brings a run's rows together, splits a hot run over several
    tasks and lets small runs share a file. Row groups then cover narrow ranges
    of runs and a filter on the run skips the others by their statistics. With
    ``run_folders`` every run gets a folder of its own, which suits a store of
    few, large runs.
    """
    writer = df.hint("rebalance", "run_id").sortWithinPartitions("run_id", "id").write.mode("append")
    (writer.partitionBy("run_id") if run_folders else writer).parquet(path)


def append_results(df: DataFrame, path: str, run_folders: bool = False) -> None:
    """Append result rows to the fact table."""
    missing = [f for f in schema.RESULTS.fieldNames() if f not in df.columns]
    if missing:
        raise ValueError(f"result rows lack {missing}")
    _append(df.select(*[df[f.name].cast(f.dataType) for f in schema.RESULTS]), path, run_folders)


#: Bytes of rows that a task gathers before it packs them.
_PACKED = 96 << 20


def _packed(rows: pa.Table, kept: pa.Schema, order: list[str]) -> pa.RecordBatch:
    rows = rows.combine_chunks().to_batches()[0]
    rows = rows.take(pc.sort_indices(rows, [(name, "ascending") for name in order], null_placement="at_start"))
    bucket = rows.column(0).to_numpy()
    rows = pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(rows.columns[1:], kept)], schema=kept)
    cuts = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1))
    parts = [rows.slice(a, b - a).serialize() for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
    columns = [pa.array(bucket[cuts[:-1]], pa.int32()), pa.array([p.size for p in parts], pa.int64()),
               pa.array([pa.compress(p, "zstd", asbytes=True) for p in parts], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["bucket", "size", "packed"])


def _pack(batches: Iterator[pa.RecordBatch], kept: pa.Schema, order: list[str], most: int) -> Iterator[pa.RecordBatch]:
    """Rows, whose first column is their bucket, as compressed columns: a row per bucket of every ``most`` bytes."""
    waiting: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if batch.num_rows:
            waiting.append(batch)
            size += batch.nbytes
        if size >= most:
            yield _packed(pa.Table.from_batches(waiting), kept, order)
            waiting, size = [], 0
    if waiting:
        yield _packed(pa.Table.from_batches(waiting), kept, order)


def _unpack(batches: Iterator[pa.RecordBatch], kept: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for size, part in zip(batch.column(1).to_pylist(), batch.column(2)):
            yield pa.ipc.read_record_batch(pa.decompress(part.as_buffer(), size, "zstd"), kept)


def by_bucket(df: DataFrame, buckets: int, keys: list[str], then: list[str]) -> DataFrame:
    """The rows dealt to ``buckets`` partitions as ``bucketBy`` deals them to buckets.

    Tasks sort rows by ``keys`` and ``then`` and pack those of a bucket as compressed columns;
    the packs are shuffled, which takes half the bytes that rows take. A partition is made
    of sorted stretches.
    """
    kept = df.limit(0).toArrow().schema
    rows = df.select(F.pmod(F.hash(*keys), F.lit(buckets)).alias("_bucket"), "*")
    packs = rows.mapInArrow(partial(_pack, kept=kept, order=["_bucket", *keys, *then], most=_PACKED), "bucket int, size long, packed binary")
    return packs.repartitionById(buckets, "bucket").mapInArrow(partial(_unpack, kept=kept), df.schema)


def append_bucketed(df: DataFrame, table: str, path: str, buckets: int) -> DataFrame:
    """Append result rows to a table that is bucketed and sorted by run and case, and return it.

    For runs with few samples per case, whose facts hardly shrink when they fold to
    cells: the rows of a case lie in one file, so folding them, counting a case's
    models and keeping the complete cases need no exchange. One task reads a
    bucket; take at least ``spark.sql.shuffle.partitions`` buckets, and so many
    that one fits a task. A case is spread over no two buckets, a run over all.
    """
    keys, spark = ["run_id", "case_id"], df.sparkSession
    rows = by_bucket(df.select(*[df[f.name].cast(f.dataType) for f in schema.RESULTS]), buckets, keys, ["model_id"])
    writer = rows.write.bucketBy(buckets, *keys).sortBy(*keys, "model_id").option("path", path).option("compression", "zstd")
    # A limit in bytes has Spark add up a batch's columns for every row; fewer rows bound it as well.
    with settings(spark, spark__sql__execution__arrow__maxBytesPerBatch=str(2**31 - 1), spark__sql__execution__arrow__maxRecordsPerBatch="2000"):
        writer.mode("append").saveAsTable(table)
    return spark.table(table)


def append_decisions(df: DataFrame, path: str, run_folders: bool = False) -> None:
    """Append decisions to the log."""
    _append(df, path, run_folders)


def _question_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines that are not blank, read as questions; ``bad`` has one that is none."""
    fields = T.StructType([*schema.QUESTIONS.fields, T.StructField("_corrupt_record", T.StringType())])
    lines = spark.read.option("lineSep", "\n").text(path).where(F.trim(F.regexp_replace("value", r"\s", "")) != "")
    read = lines.withColumn("q", F.from_json("value", fields, {"columnNameOfCorruptRecord": "_corrupt_record"}))
    bad = F.col("q._corrupt_record").isNotNull() | F.col("q.uid").isNull()
    return read.select("q.*", F.when(bad, F.col("value")).alias("bad"))


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """Question JSON lines. Only a line feed ends a line; blank lines are skipped.

    A line that is not a JSON object with a uid stops the query;
    ``rejected_questions`` lists such lines.
    """
    failed = F.raise_error(F.concat(F.lit("not a question: "), F.substring("bad", 1, 200))).cast("string")
    lines = _question_lines(spark, path)
    return lines.select(F.when(F.col("bad").isNotNull(), failed).otherwise(F.col("uid")).alias("uid"),
                        *[f for f in schema.QUESTIONS.fieldNames() if f != "uid"])


def rejected_questions(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a question file that ``read_questions`` refuses."""
    return _question_lines(spark, path).where("bad IS NOT NULL").select(F.col("bad").alias("line"))
