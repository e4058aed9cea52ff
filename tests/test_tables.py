import datetime as dt
from decimal import Decimal

import pytest

from gradeloom import schema
from gradeloom.operators import catalog as K
from gradeloom.operators import lifecycle as L
from gradeloom.sources import tables
from helpers import T0, models, results, rows, runs


def _catalog(spark, *items):
    return spark.createDataFrame([(i, p, n, v, Decimal("0.000003"), Decimal("0.000015"), T0 + dt.timedelta(days=day), None)
                                  for i, p, n, v, day in items], schema.MODELS)


def test_latest_model_row_and_unknown_names(spark):
    c = _catalog(spark, (1, "p", "a", "1", 1), (2, "p", "a", "2", 2), (3, "p", "a", "3", 2), (4, "p", "b", "1", 0))
    assert rows(K.latest_models(c), "name", "id") == [("a", 3), ("b", 4)]
    assert rows(K.unknown_models(spark.createDataFrame([("a",), ("z",), ("z",)], "name string"), c)) == [("z",)]


def test_seeding_is_idempotent_but_never_matches_a_missing_version(spark):
    c = _catalog(spark, (1, "p", "a", "1", 1), (2, "p", "b", None, 1))
    seed = _catalog(spark, (5, "p", "a", "1", 1), (6, "p", "b", None, 1), (7, "p", "c", "1", 1), (8, "p", "c", "1", 1))
    assert rows(K.upsert_catalog(c, seed), "id") == [(1,), (2,), (6,), (7,)]


def test_patch_and_prune(spark):
    c = _catalog(spark, (1, "Old", "a", "1", 1), (2, "old", "b", "1", 1), (3, "new", "c", "1", 1))
    patch = spark.createDataFrame([("a", 9)], "name string, context_window int")
    assert rows(K.patch_catalog(c, patch), "id", "context_window") == [(1, 9), (2, None), (3, None)]
    with pytest.raises(Exception, match="two patch rows for a"):
        K.patch_catalog(c, patch.union(patch)).collect()
    used = results(spark, [{"model_id": 2}])
    assert rows(K.prune_catalog(c, used, "OLD"), "id") == [(2,), (3,)]


def test_call_cost_is_exact(spark):
    r = results(spark, [{"input_tokens": 1000, "output_tokens": 500}]).drop("cost")
    assert K.call_cost(r, models(spark, "m")).first().cost == Decimal("0.010500000")
    strange = results(spark, [{"model_id": 7}, {"model_id": 1}]).drop("cost")
    assert [x.cost is None for x in K.call_cost(strange, models(spark, "m")).orderBy("model_id").collect()] == [False, True]
    assert rows(K.unpriced(strange, models(spark, "m"))) == [(7, 1)]


def _store(spark):
    u = runs(spark, (1, "a", T0, T0), (2, "b", T0 + dt.timedelta(days=1), None), (3, "a", T0, None))
    r = results(spark, [{"run_id": 1}, {"run_id": 2, "created_at": T0 + dt.timedelta(days=3)}, {"run_id": 2}])
    d = spark.createDataFrame([(1, "m", "faible", [], "", "r", 1, None, None, T0, "p", [], run) for run in (1, 2, None)], schema.DECISIONS)
    return u, r, d


def test_runs_are_closed_at_their_last_row(spark):
    u, r, _ = _store(spark)
    now = dt.datetime(2025, 1, 1)
    assert rows(L.finalize_runs(u, r, now), "id", "finished_at") == [(1, T0), (2, T0 + dt.timedelta(days=3)), (3, now)]


def test_opened_runs_continue_the_ids(spark):
    u, _, _ = _store(spark)
    asked = spark.createDataFrame([("x", 7, "d"), ("y", 7, "e")], "request string, prompt_id long, dataset string")
    opened = L.open_runs(u, asked, T0)
    assert sorted(r.id for r in opened.collect()) == [4, 5]
    assert {(r.started_at, r.finished_at) for r in opened.collect()} == {(T0, None)}


def test_snapshot_restores_and_refuses_unknown_names(spark, tmp_path):
    u, r, d = _store(spark)
    parts = L.export_dataset(u, r, d, "b", str(tmp_path / "snap"))
    assert [p.count() for p in parts] == [1, 2, 1]
    again = tuple(tables.read_table(spark, str(tmp_path / "snap"), n) for n in ("runs", "results", "decisions"))
    now = u, r.where("id <> 2"), d
    for _ in range(2):
        now = L.restore_dataset(now, again, "b")
    assert [p.count() for p in now] == [3, 3, 3]
    with pytest.raises(ValueError, match="no run"):
        L.export_dataset(u, r, d, "typo")


@pytest.mark.parametrize("mode, left", [({"run_id": 2}, (2, 1, 2)), ({"dataset": "a"}, (1, 2, 2)), ({"today": dt.date(2024, 1, 2)}, (2, 1, 2)),
                                        ({"everything": True}, (0, 0, 1))])
def test_purging_cascades(spark, mode, left):
    u, r, d = _store(spark)
    kept = L.purge_runs(u, r, d, L.chosen_runs(**mode))
    assert tuple(p.count() for p in kept) == left


def test_purge_preview_counts_results(spark):
    u, r, _ = _store(spark)
    assert rows(L.purge_preview(u, r, L.chosen_runs(everything=True)), "id", "results") == [(1, 1), (2, 2), (3, 0)]
    with pytest.raises(ValueError):
        L.chosen_runs()


@pytest.mark.parametrize("folders", [False, True])
def test_appended_rows_come_back(spark, tmp_path, folders):
    _, r, d = _store(spark)
    for _ in range(2):
        tables.append_results(r, str(tmp_path / "results"), run_folders=folders)
    tables.append_decisions(d, str(tmp_path / "decisions"), run_folders=folders)
    back = tables.read_table(spark, str(tmp_path), "results")
    assert back.count() == 6 and set(back.columns) == set(r.columns)
    assert rows(back.where("run_id = 1"), "id", "cost") == [(1, Decimal("0.001000000"))] * 2
    assert tables.read_table(spark, str(tmp_path), "decisions").count() == 3
    with pytest.raises(ValueError, match="lack"):
        tables.append_results(r.drop("cost"), str(tmp_path / "x"))
