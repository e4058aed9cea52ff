"""Run-scoped changes of a store on disk."""

import datetime as dt
from decimal import Decimal
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from gradeloom import schema
from gradeloom.functions.windows import in_parts, lag_in_parts, number_rows
from gradeloom.operators import decisions as D
from gradeloom.operators import rollups as R
from gradeloom.sources.store import EvalStore
from helpers import T0, models, results, rows, runs

_NOW = dt.datetime(2025, 1, 1)


def _decision(i, run):
    return (i, "m", "faible", [], "", "r", 1, f"h{i}", None, T0, "p", [], run)


@pytest.fixture
def store(spark, tmp_path):
    out = EvalStore(spark, str(tmp_path / "store")).create()
    out.append("runs", runs(spark, (1, "a 1%", T0, T0), (2, "b", T0 + dt.timedelta(days=1), None), (3, "a 1%", T0, None), (2500, None, T0, None)))
    out.append("results", results(spark, [{"run_id": 1}, {"run_id": 2, "created_at": T0 + dt.timedelta(days=3)}, {"run_id": 2}, {"run_id": 3}, {"run_id": 3}]))
    out.append("decisions", spark.createDataFrame([_decision(i, run) for i, run in enumerate((1, 2, None, 3), 1)], schema.DECISIONS))
    out.append("models", models(spark, "m", "k"))
    return out


def _files(store, name):
    """Path and time of every data file, by folder."""
    out = {}
    for path in Path(store.root, name).rglob("*.parquet"):
        out.setdefault(path.parent.name, set()).add((path.name, path.stat().st_mtime_ns))
    return out


def _rows(store, *names):
    return {n: rows(store.read(n)) for n in names or ("runs", "results", "decisions", "models")}


@pytest.mark.parametrize("mode, ids, left", [
    ({"run_id": 2}, {2}, (3, 3, 3)), ({"dataset": "a 1%"}, {1, 3}, (2, 2, 2)), ({"today": dt.date(2024, 1, 2)}, {2}, (3, 3, 3)),
    ({"dataset": "no such"}, set(), (4, 5, 4)), ({"everything": True}, {1, 2, 3, 2500}, (0, 0, 0))])
def test_purge_drops_folders_and_leaves_the_others_alone(store, mode, ids, left):
    before = {n: _files(store, n) for n in ("results", "decisions", "runs", "models")}
    for again in range(2):
        assert set(store.purge(**mode)) == (set() if again else ids)
        assert tuple(store.read(n).count() for n in ("runs", "results", "decisions")) == left
    after = {n: _files(store, n) for n in before}
    assert after["models"] == before["models"]
    for name in ("results", "decisions"):
        assert all(before[name][folder] == found for folder, found in after[name].items())
    if "everything" not in mode:
        assert set(before["results"]) - set(after["results"]) == {f"run_id={i}" for i in ids}


def test_verdicts_rewrite_the_runs_they_are_about(spark, store):
    before, old = _files(store, "results"), store.read("results").count()
    found = spark.createDataFrame([(2, 2, Decimal("4.5"), "good"), (2, 3, None, None), (77, 9, Decimal("1.0"), "no such run")],
                                  "run_id long, id long, judge_score decimal(3,1), judge_reasoning string")
    for _ in range(2):
        store.apply_verdicts(found)
        assert rows(store.read("results").where("judge_score IS NOT NULL"), "run_id", "id", "judge_score", "judge_reasoning") == [(2, 2, Decimal("4.5"), "good")]
    after = _files(store, "results")
    assert store.read("results").count() == old and set(after) == set(before)
    assert {f for f in after if after[f] != before[f]} == {"run_id=2"}
    store.apply_verdicts(found.where("run_id = 77"))
    assert _files(store, "results") == after


def test_finalise_reads_open_runs_only(store):
    before = _files(store, "runs")
    store.finalize_runs(_NOW, [2, 3])
    want = {1: T0, 2: T0 + dt.timedelta(days=3), 3: T0, 2500: None}
    assert {r.id: r.finished_at for r in store.read("runs").collect()} == want
    assert _files(store, "runs")["id_group=2"] == before["id_group=2"]
    store.finalize_runs(_NOW)
    assert {r.id: r.finished_at for r in store.read("runs").collect()} == {**want, 2500: _NOW}


def test_restore_replaces_one_dataset_and_once_is_twice(spark, store, tmp_path):
    whole, path = _rows(store), str(tmp_path / "snap")
    store.export_dataset("a 1%", path)
    store.purge(run_id=1)
    store.append("results", results(spark, [{"run_id": 3, "id": 99}]))
    store.append("decisions", spark.createDataFrame([_decision(50, 3)], schema.DECISIONS))
    store.append("runs", runs(spark, (4, "a 1%", T0, None)))
    store.append("results", results(spark, [{"run_id": 4, "id": 100}]))
    before = _files(store, "results")
    for _ in range(2):
        store.restore_dataset("a 1%", path)
        assert _rows(store) == whole
    assert _files(store, "results")["run_id=2"] == before["run_id=2"]


def test_restore_refuses_what_is_not_the_datasets_snapshot(spark, store, tmp_path):
    path, whole = str(tmp_path / "snap"), _rows(store)
    with pytest.raises(ValueError, match="no run"):
        store.export_dataset("typo", path)
    store.export_dataset("b", path)
    with pytest.raises(ValueError, match="not a snapshot"):
        store.restore_dataset("a 1%", path)
    store.purge(run_id=2)
    store.append("runs", runs(spark, (2, "other", T0, None)))
    with pytest.raises(ValueError, match="other data sets"):
        store.restore_dataset("b", path)
    assert rows(store.read("decisions")) == [r for r in whole["decisions"] if r[-1] != 2]


def test_replace_refuses_rows_of_other_folders(spark, store):
    with pytest.raises(ValueError, match="not replaced"):
        store.replace("results", results(spark, [{"run_id": 8}]), [1])
    with pytest.raises(ValueError, match="lack"):
        store.append("results", results(spark, [{}]).drop("cost"))


def test_a_filter_on_the_run_opens_its_folder_only(store):
    plan = store.read("results").where("run_id = 2")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(run_id" in plan
    assert {p.rsplit("/", 2)[1] for p in store.read("results").where("run_id = 2").inputFiles()} >= {"run_id=2"}


def test_catalogue_changes(spark, store):
    seed = models(spark, "m", "k", "z").where("id <> 2")
    for _ in range(2):
        store.upsert_models(seed)
        assert rows(store.read("models"), "id", "name") == [(1, "m"), (2, "k"), (3, "z")]
    store.patch_models(spark.createDataFrame([("k", 9), ("none", 1)], "name string, context_window int"))
    assert rows(store.read("models"), "id", "context_window") == [(1, 1000), (2, 9), (3, 1000)]
    store.prune_models("P")
    assert rows(store.read("models"), "id") == [(1,)]


def test_opened_runs_and_synced_prompts_are_appended(spark, store):
    asked = spark.createDataFrame([("x", 7, "d"), ("y", 7, "e")], "request string, prompt_id long, dataset string")
    assert rows(store.open_runs(asked, T0), "request", "id") == [("x", 2501), ("y", 2502)]
    assert store.read("runs").where("id > 2500").count() == 2
    staged = spark.createDataFrame([("f1", "n", "1", "text"), ("f2", "n", "2", "more"), ("f3", "n", "3", "text ")],
                                   "source string, name string, version string, content string")
    first = store.sync_prompts(staged, now="2024-06-01")
    assert rows(first, "source", "action", "id", "previous_version_id") == [
        ("f1", "initial", 1, None), ("f2", "new_version", 2, 1), ("f3", "unchanged", 1, None)]
    assert rows(store.sync_prompts(staged, now="2024-07-01"), "source", "action", "id") == [
        ("f1", "unchanged", 1), ("f2", "unchanged", 2), ("f3", "unchanged", 1)]
    assert store.read("prompts").count() == 2


def _judged(spark):
    made = results(spark, [{"run_id": r, "model_id": m, "case_id": c, "judge_score": 1 + m + r, "id": 100 * r + 10 * m + int(c)}
                           for r in (1, 2) for m in (1, 2) for c in "123"])
    return R.model_decision_metrics(made, models(spark, "m", "k"))


def test_decisions_are_logged_once(spark, store):
    metrics, profiles = _judged(spark), D.shipped_profiles(spark)
    log, n = store.read("decisions").count(), profiles.select("profile").distinct().count()
    before = _files(store, "decisions")
    first = store.decide(metrics, profiles, 7, _NOW)
    assert {r.replayed for r in first.collect()} == {False} and store.read("decisions").count() == log + 2 * n
    after = _files(store, "decisions")
    assert after["run_id=3"] == before["run_id=3"] and after["run_id=1"] != before["run_id=1"]
    again = store.decide(metrics, profiles, 7, _NOW + dt.timedelta(days=1))
    assert {(r.replayed, r.created_at) for r in again.collect()} == {(True, _NOW)} and _files(store, "decisions") == after
    # One decision was lost on the way: only that one is made again.
    lost = store.read("decisions").where("NOT (run_id = 1 AND profile = 'rapide' AND prompt_id = 7)").where("run_id = 1")
    store.replace("decisions", lost, [1])
    assert rows(store.decide(metrics, profiles, 7, _NOW).where("NOT replayed"), "run_id", "profile") == [(1, "rapide")]
    assert store.read("decisions").count() == log + 2 * n
    ids = [r.id for r in store.read("decisions").collect()]
    assert len(ids) == len(set(ids))
    # Another prompt is another key; force logs anew, once per time.
    store.decide(metrics.where("run_id = 1"), profiles, None, _NOW)
    assert store.read("decisions").count() == log + 3 * n
    for _ in range(2):
        forced = store.decide(metrics.where("run_id = 2"), profiles, 7, _NOW + dt.timedelta(days=2), force=True)
        assert {r.replayed for r in forced.collect()} == {False}
        assert store.read("decisions").count() == log + 4 * n
    newest = store.decide(metrics.where("run_id = 2"), profiles, 7, _NOW + dt.timedelta(days=3))
    assert {r.created_at for r in newest.collect()} == {_NOW + dt.timedelta(days=2)}
    assert store.decide(metrics.limit(0), profiles, 7, _NOW).count() == 0


def test_numbers_and_look_back_spread_a_hot_key(spark):
    """One name holds nearly all versions, loaded at one time: every part gets its share."""
    n, before = 20_000, spark.conf.get("spark.sql.shuffle.partitions")
    table = spark.range(1, n + 1).select("id", F.lit("hot").alias("name"), F.lit(T0).alias("created_at")).unionByName(
        spark.createDataFrame([(n + 1, "a", T0), (n + 2, "z", T0), (n + 3, None, T0), (n + 4, None, T0)], "id long, name string, created_at timestamp"))
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        parts = in_parts(table, ["name", "created_at", "id"])
        sizes = [r["count"] for r in parts.groupBy("_part").count().collect()]
        assert len(sizes) >= 14 and max(sizes) < 3 * n / 16
        got = {r.id: r.before for r in lag_in_parts(parts, ["name"], ["created_at", "id"], "id", "before").collect()}
        assert got == {i: i - 1 if 1 < i <= n else n + 3 if i == n + 4 else None for i in range(1, n + 5)}
        rows_ = number_rows(table.drop("id").withColumn("o", F.monotonically_increasing_id()), "name", ["o"], spark.createDataFrame([(5,)], "id long")).collect()
        assert sorted(r.id for r in rows_) == list(range(6, n + 10))
        in_order = sorted(rows_, key=lambda r: (r.name is not None, r.name or "", r.o))
        assert [r.id for r in in_order] == list(range(6, n + 10))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_a_folder_of_many_runs(spark, tmp_path):
    """Changes of some runs keep the others of their folder, and other folders keep their files."""
    store, path = EvalStore(spark, str(tmp_path / "many"), 1000).create(), str(tmp_path / "snap")
    store.append("runs", runs(spark, *[(i, "a" if i < 3 else "b", T0, None) for i in (1, 2, 3, 1500)]))
    store.append("results", results(spark, [{"run_id": r, "id": 10 * (r or 0) + k} for r in (1, 2, 3, 1500, None) for k in (1, 2)]))
    store.append("decisions", spark.createDataFrame([_decision(i, run) for i, run in enumerate((1, 3, None), 1)], schema.DECISIONS))
    names, before = ("runs", "results", "decisions"), _files(store, "results")
    assert set(before) == {"by_1000_runs=0", "by_1000_runs=1", "by_1000_runs=__HIVE_DEFAULT_PARTITION__"}
    found = spark.createDataFrame([(2, 21, Decimal("4.5"), "good"), (900, 9, Decimal("1.0"), "no such run")],
                                  "run_id long, id long, judge_score decimal(3,1), judge_reasoning string")
    store.apply_verdicts(found)
    assert rows(store.read("results").where("judge_score IS NOT NULL"), "run_id", "id") == [(2, 21)]
    whole = _rows(store, *names)
    store.export_dataset("a", path)
    assert store.purge(run_id=1) == [1]
    assert _rows(store, *names) == {n: [r for r in whole[n] if r[{"runs": 0, "results": 1, "decisions": -1}[n]] != 1] for n in names}
    store.append("results", results(spark, [{"run_id": 2, "id": 99}]))
    store.restore_dataset("a", path)
    assert _rows(store, *names) == whole
    assert {f for f, files in _files(store, "results").items() if files != before[f]} == {"by_1000_runs=0"}
    with pytest.raises(ValueError, match="not replaced"):
        store.replace("results", results(spark, [{"run_id": 1500}]), [0])
