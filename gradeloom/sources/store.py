"""An evaluation store on disk whose writes touch only the runs they are about.

Results and decisions lie in one folder per run, or per ``runs_per_folder`` runs where
runs are many and small; runs and models in one folder per thousand ids. A change reads
the folders it is about, writes them anew with Spark's dynamic partition overwrite and
leaves all others alone: their files keep their names. Every change can be repeated:
after a failure half way, the same call ends with the same tables.

Lists of folder numbers pass through the driver. They are no longer than the list
of folders that Spark's file index keeps there for any read of the table. Run numbers
stay in frames, which meet the rows in joins; only ``purge`` returns them.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradeloom import schema
from gradeloom.operators import catalog, decisions, lifecycle, prompts, verdicts
from gradeloom.session import materialized
from gradeloom.sources.tables import EvalTables

_SCHEMAS = {
    "models": schema.MODELS, "prompts": schema.PROMPTS, "runs": schema.RUNS,
    "results": schema.RESULTS, "decisions": schema.DECISIONS,
}
_IDS_PER_FOLDER = 1000
_NO_VALUE = "__HIVE_DEFAULT_PARTITION__"


def _id_group(column: str = "id") -> Column:
    return F.floor(F.col(column) / _IDS_PER_FOLDER).cast("long")


def _among(column: str, values: Iterable[int | None]) -> Column:
    """Whether a column has one of some numbers; None stands for null."""
    numbers = ", ".join(str(int(v)) for v in values if v is not None)
    known = F.expr(f"{column} IN ({numbers})") if numbers else F.lit(False)
    return F.coalesce(known, F.lit(False)) | F.col(column).isNull() if None in values else known


def _without(rows: DataFrame, column: str, ids: DataFrame, how: str = "left_anti") -> DataFrame:
    """Rows whose column has none of the ids, null being an id as others; with ``left_semi`` the rest."""
    return rows.join(ids.select(F.col("id").alias("_id")), F.col(column).eqNullSafe(F.col("_id")), how)


@dataclass(frozen=True)
class EvalStore:
    """The five tables under one folder that all executors share.

    ``runs_per_folder`` is a trait of the store: the folders carry it in their names, and
    Spark refuses to read a table that was written with two of them.
    """

    spark: SparkSession
    root: str
    runs_per_folder: int = 1

    # --- reading --------------------------------------------------------------

    def create(self) -> EvalStore:
        """Make the tables that do not exist yet, empty."""
        for name, kind in _SCHEMAS.items():
            self._write(name, self.spark.createDataFrame([], kind), "append")
        return self

    def read(self, name: str) -> DataFrame:
        """A table; a filter on ``run_id`` opens the folders of these runs only."""
        kind = _SCHEMAS[name]
        rows = self.spark.read.schema(kind).parquet(f"{self.root}/{name}")
        return rows.select(*kind.fieldNames())

    def tables(self) -> EvalTables:
        return EvalTables(**{name: self.read(name) for name in _SCHEMAS})

    # --- writing --------------------------------------------------------------

    def _folder(self, name: str) -> str | None:
        of_runs = "run_id" if self.runs_per_folder == 1 else f"by_{self.runs_per_folder}_runs"
        return {"results": of_runs, "decisions": of_runs, "runs": "id_group", "models": "id_group"}.get(name)

    def _number(self, name: str, column: str | None = None) -> Column:
        """The folder of a row, from its run id or from another column with such ids."""
        if self._folder(name) == "id_group":
            return _id_group(column or "id")
        run = F.col(column or "run_id")
        return run if self.runs_per_folder == 1 else F.floor(run / self.runs_per_folder).cast("long")

    def _held(self, name: str, folders: Iterable[int | None]) -> DataFrame:
        """The rows of some folders."""
        kind, folder = _SCHEMAS[name], self._folder(name)
        more = [] if folder in kind.fieldNames() else [T.StructField(folder, T.LongType())]
        rows = self.spark.read.schema(T.StructType([*kind.fields, *more])).parquet(f"{self.root}/{name}")
        return rows.where(_among(folder, folders)).select(*kind.fieldNames())

    def _write(self, name: str, rows: DataFrame, mode: str, stay: DataFrame | None = None) -> None:
        """Write rows; ``stay`` are rows read from folders that are written, which need no shuffle."""
        kind, folder = _SCHEMAS[name], self._folder(name)
        missing = [f for f in kind.fieldNames() if f not in rows.columns]
        if missing:
            raise ValueError(f"{name} rows lack {missing}")
        rows = rows.select(*[rows[f.name].cast(f.dataType).alias(f.name) for f in kind])
        if folder is not None:
            # A run's rows come together; a hot run is split over several files.
            rows = rows.withColumn(folder, self._number(name)).hint("rebalance", folder)
            if stay is not None:
                rows = rows.unionByName(stay.withColumn(folder, self._number(name)))
            rows = rows.sortWithinPartitions(*dict.fromkeys([folder, *(["run_id"] if "run_id" in kind.names else []), "id"]))
        writer = rows.write.mode(mode).option("partitionOverwriteMode", "dynamic")
        (writer if folder is None else writer.partitionBy(folder)).parquet(f"{self.root}/{name}")

    def append(self, name: str, rows: DataFrame) -> None:
        """Add rows to a table."""
        self._write(name, rows, "append")

    def _clear(self, name: str, folders: Iterable[int | None]) -> None:
        """Delete whole folders."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for value in folders:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}/{self._folder(name)}={_NO_VALUE if value is None else value}")
            path.getFileSystem(conf).delete(path, True)

    def replace(self, name: str, rows: DataFrame, folders: Iterable[int | None], stay: DataFrame | None = None) -> None:
        """``rows`` become all that the given folders hold; rows of other folders are refused.

        ``stay`` are further rows to hold, read from these folders: a filter of ``_held``.
        Folders that get no rows are deleted last.
        """
        folders = set(folders)
        if self._folder(name) is None:
            raise ValueError(f"{name} has no folders")
        number = self._number(name).alias("folder")
        found = set(self._values(rows if stay is None else rows.select(number).union(stay.select(number)), number if stay is None else "folder"))
        if not found <= folders:
            raise ValueError(f"rows of folders {sorted(map(str, found - folders))[:5]} that are not replaced")
        if found:
            self._write(name, rows, "overwrite", stay)
        self._clear(name, folders - found)

    def _values(self, rows: DataFrame, column: str | Column) -> list:
        """Different values of a column: run ids or id groups."""
        return [r[0] for r in rows.select(column).distinct().collect()]

    def _replace_ids(self, name: str, change, ids: DataFrame) -> None:
        """Change the id groups that hold ``ids`` (a frame of ``id``); ``change`` maps their old rows to the new."""
        groups = self._values(ids, _id_group())
        if groups:
            self.replace(name, change(self._held(name, groups)), groups)

    def _replace_runs(self, name: str, ids: DataFrame, new: DataFrame | None = None) -> None:
        """The runs ``ids`` (a frame of ``id``) lose their rows of a table and get those of ``new``.

        The other runs of their folders are written as they lie, without a shuffle.
        """
        folders = self._values(ids, self._number(name, "id"))
        if self.runs_per_folder == 1:
            self._clear(name, folders) if new is None else self.replace(name, new, folders)
        elif folders:
            held = self._held(name, folders)
            self.replace(name, held.limit(0) if new is None else new, folders, _without(held, "run_id", F.broadcast(ids)))

    # --- runs -----------------------------------------------------------------

    def open_runs(self, requested: DataFrame, now: dt.datetime) -> DataFrame:
        """Append unfinished runs for (request, prompt_id, dataset) rows and return them."""
        opened = materialized(lifecycle.open_runs(self.read("runs"), requested, now), "opened")
        self.append("runs", opened)
        return opened

    def finalize_runs(self, now: dt.datetime, run_ids: Iterable[int] | None = None) -> None:
        """Close the open runs, or those of the given ones, reading the results of these only."""
        chosen = F.col("finished_at").isNull() if run_ids is None else F.col("finished_at").isNull() & _among("id", run_ids)
        ids = materialized(self.read("runs").where(chosen).select("id").distinct(), "open")
        rows = self._held("results", self._values(ids, self._number("results", "id")))
        self._replace_ids("runs", lambda old: lifecycle.finalize_runs(old.where(chosen), rows, now).unionByName(old.where(~chosen)), ids)

    def purge(self, **mode) -> list[int]:
        """Drop the runs of one mode of ``lifecycle.chosen_runs`` with their results and decisions.

        ``everything`` empties the three tables, decisions without a run included.
        Models and prompts stay. The runs go last: a purge that was cut off finds
        them again. Returns the ids.
        """
        condition = lifecycle.chosen_runs(**mode)
        chosen = materialized(self.read("runs").where(condition).select("id").distinct(), "purged")
        if mode.get("everything"):
            for name in ("decisions", "results", "runs"):
                folder = self._folder(name)
                self._clear(name, self._values(self.spark.read.schema(f"{folder} long").parquet(f"{self.root}/{name}"), folder))
        else:
            for name in ("decisions", "results"):
                self._replace_runs(name, chosen)
            self._replace_ids("runs", lambda old: _without(old, "id", chosen), chosen)
        return self._values(chosen, "id")

    # --- snapshots ------------------------------------------------------------

    def export_dataset(self, name: str, path: str) -> None:
        """Write a data set's runs, results and decisions as a store of its own; no run is an error."""
        runs = self.read("runs").where(F.col("dataset") == name)
        ids = materialized(runs.select("id").distinct(), "exported")
        if ids.isEmpty():
            raise ValueError(f"no run of data set {name!r}")
        out = EvalStore(self.spark, path, self.runs_per_folder).create()
        out.append("runs", runs)
        for table in ("results", "decisions"):
            held = self._held(table, self._values(ids, self._number(table, "id")))
            out.append(table, _without(held, "run_id", ids, "left_semi"))

    def restore_dataset(self, name: str, path: str) -> None:
        """Replace a data set by a snapshot of it; twice does what once does.

        A snapshot without runs, with runs of another data set, or with the id of a
        run that another data set has now, is refused before anything is written.
        """
        snapshot, runs = EvalStore(self.spark, path, self.runs_per_folder), self.read("runs")
        of_name = F.col("dataset").eqNullSafe(F.lit(name))
        new = materialized(snapshot.read("runs").where(of_name).select("id").distinct(), "restored")
        if new.isEmpty() or not snapshot.read("runs").where(~of_name).isEmpty():
            raise ValueError(f"not a snapshot of data set {name!r}")
        if not _without(runs.where(~of_name), "id", new, "left_semi").isEmpty():
            raise ValueError(f"other data sets have runs with ids of {name!r}")
        ids = materialized(new.union(runs.where(of_name).select("id")).distinct(), "replaced")
        for table in ("results", "decisions"):
            if not _without(snapshot.read(table), "run_id", ids).isEmpty():
                raise ValueError(f"{table} of runs that data set {name!r} does not have")
        for table in ("results", "decisions"):
            self._replace_runs(table, ids, snapshot.read(table))
        self._replace_ids("runs", lambda old: old.where(~of_name).unionByName(snapshot.read("runs")), ids)

    # --- verdicts and decisions -----------------------------------------------

    def apply_verdicts(self, found: DataFrame) -> None:
        """Write valid verdicts (run_id, id, judge_score, judge_reasoning) onto the results of their runs."""
        valid = materialized(found.where("judge_score IS NOT NULL AND run_id IS NOT NULL"), "verdicts")
        ids = materialized(valid.select(F.col("run_id").alias("id")).distinct(), "judged")
        rows = _without(self._held("results", self._values(ids, self._number("results", "id"))), "run_id", ids, "left_semi")
        self._replace_runs("results", ids, verdicts.apply_verdicts(rows, valid))

    def decide(self, metrics: DataFrame, profiles: DataFrame, prompt_id: int | None, now: dt.datetime,
               force: bool = False, justifications: DataFrame | None = None) -> DataFrame:
        """Decide the runs of ``metrics`` per profile, log what was not logged, and return all decisions.

        The log takes a decision if it has none with the same input hash, prompt
        and profile, so a repeated call replays what the first one wrote and a call
        after a failure completes it. With ``force`` each decision is computed and
        logged anew; only an equal one with the same time is not logged again. Runs
        without judged metrics give no rows.
        """
        log = self.read("decisions")
        decided = materialized(decisions.decide(metrics, profiles, log, prompt_id, force, justifications), "decided")
        folders = self._values(decided.where("NOT replayed"), self._number("decisions"))
        if folders:
            mine = self._held("decisions", folders)
            new = decisions.decisions_to_insert(decided, log, now)
            self.replace("decisions", decisions.logged_once(mine, new, timed=force), folders)
        return decided

    # --- catalogue and prompts ------------------------------------------------

    def upsert_models(self, incoming: DataFrame) -> None:
        """Append the catalogue rows whose (provider, name, version) is absent."""
        models = self.read("models")
        self.append("models", catalog.absent_models(models, incoming.select(*models.columns)))

    def patch_models(self, patch: DataFrame, on: list[str] | None = None) -> None:
        """Overwrite catalogue columns with the non-NULL values of a patch, by name."""
        models = self.read("models")
        ids = models.join(patch, on or ["name"], "left_semi").select("id")
        self._replace_ids("models", lambda old: catalog.patch_catalog(old, patch, on), ids)

    def prune_models(self, provider: str) -> None:
        """Drop one provider's rows that no result refers to."""
        models = self.read("models")
        left = catalog.prune_catalog(models, self.read("results"), provider)
        ids = materialized(models.join(left.select("id"), "id", "left_anti").select("id").distinct(), "pruned")
        self._replace_ids("models", lambda old: _without(old, "id", ids), ids)

    def sync_prompts(self, staged: DataFrame, now) -> DataFrame:
        """Append the versions that staged templates make; returns the action per template.

        A repeated call finds every template unchanged.
        """
        synced = materialized(prompts.sync_prompts(self.read("prompts"), staged, now), "synced")
        self.append("prompts", synced.where("action <> 'unchanged'"))
        return synced
