"""Session settings and the shared scratch folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "gradeloom", master: str | None = None) -> SparkSession:
    """Session with the settings the operators are written for.

    Broadcasts are left to the size checks of the optimizer and of adaptive
    execution; no operator carries a broadcast hint.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.ansi.enabled", "true")
    )
    if master:
        builder = (
            builder.master(master)
            .config("spark.ui.enabled", "false")
            .config("spark.sql.shuffle.partitions", os.environ.get("GRADELOOM_SHUFFLE", "8"))
        )
    return builder.getOrCreate()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path under the folder named by ``spark.checkpoint.dir``.

    That folder has to be visible to every executor. Only a local session may
    fall back to a temporary folder, which goes when the program ends.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.mkdtemp(prefix="gradeloom-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """SQL settings, with ``__`` for the dots of their names, that hold inside the block only."""
    names = {k: k.replace("__", ".") for k in values}
    before = {k: spark.conf.get(name, None) for k, name in names.items()}
    for k, name in names.items():
        spark.conf.set(name, values[k])
    try:
        yield
    finally:
        for k, name in names.items():
            if before[k] is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, before[k])


def materialized(df: DataFrame, name: str) -> DataFrame:
    """The frame written under the scratch folder and read back: it is worked out once,
    and later changes of the tables it was read from do not change it."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
