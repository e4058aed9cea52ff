import datetime as dt
from decimal import Decimal
from pathlib import Path

import pytest

from gradeloom.operators import rollups as R
from gradeloom.streaming import live
from helpers import models, results, rows

_SCHEMA = "run_id long, model string, created_at timestamp_ntz, judge_score decimal(3,1), output_tokens int"
_BOARD = ("run_id", "model", "n_results", "n_judged", "tokens", "mean_score")


def _land(spark, folder, items, number):
    """A file of (run, model, day, score) rows; files are taken in the order of their times."""
    data = [(r, m, None if d is None else dt.datetime(2024, 1, 1) + dt.timedelta(days=d - 1), None if s is None else Decimal(str(s)), 10) for r, m, d, s in items]
    spark.createDataFrame(data, _SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/{number}")


def _stream(spark, folder, per_batch=1):
    return (spark.readStream.schema(_SCHEMA).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_batch).parquet(folder))


@pytest.fixture
def paths(tmp_path):
    return tuple(str(tmp_path / n) for n in ("in", "out", "state"))


def _fill(spark, paths):
    live.start_board(_stream(spark, paths[0]), paths[1], paths[2], once=True).awaitTermination()
    return rows(live.read_board(spark, paths[1]), *_BOARD)


def test_board_fills_batch_by_batch(spark, paths):
    _land(spark, paths[0], [(1, "m", 1, 2), (1, "m", 1, None), (1, "k", 1, 4), (None, "m", 1, 1), (7000, "m", 1, None)], 1)
    first = [(1, "k", 1, 1, 10, 4.0), (1, "m", 2, 1, 20, 2.0), (7000, "m", 1, 0, 10, None), (None, "m", 1, 1, 10, 1.0)]
    assert _fill(spark, paths) == first
    assert _fill(spark, paths) == first  # no new rows
    before = {p: p.stat().st_mtime_ns for p in Path(paths[1]).rglob("run_group=7/*.parquet")}
    # Two batches in one start; rows older than all before, by years, count as well.
    _land(spark, paths[0], [(1, "m", 2, 5), (2, None, 1, 1)], 2)
    _land(spark, paths[0], [(1, "m", -3000, 2), (None, "m", None, 3)], 3)
    assert _fill(spark, paths) == [(1, "k", 1, 1, 10, 4.0), (1, "m", 4, 3, 40, 3.0), (2, None, 1, 1, 10, 1.0),
                                   (7000, "m", 1, 0, 10, None), (None, "m", 2, 2, 20, 2.0)]
    assert before and before == {p: p.stat().st_mtime_ns for p in Path(paths[1]).rglob("run_group=7/*.parquet")}


def _forget_last(state):
    """Undo the commit of the newest batch, as if the driver had died before it."""
    last = max((p for p in Path(state, "commits").iterdir() if p.name.isdigit()), key=lambda p: int(p.name))
    for p in (last, last.with_name(f".{last.name}.crc")):
        p.unlink(missing_ok=True)


def test_a_replayed_batch_changes_nothing(spark, paths):
    for i in (1, 2):
        _land(spark, paths[0], [(1, "m", i, 2 * i), (1, "k", i, 4), (i, "z", i, 1)], i)
    first = _fill(spark, paths)
    _forget_last(paths[2])
    assert _fill(spark, paths) == first


def test_run_views_read_the_touched_runs_and_survive_a_replay(spark, paths):
    parts = [[{"run_id": 1, "model_id": 1, "judge_score": 1}, {"run_id": 1, "model_id": 2, "judge_score": 3}, {"run_id": 2, "judge_score": 2}],
             [{"run_id": 1, "model_id": m, "judge_score": 5, "case_id": "c2"} for m in (1, 2)], [{"run_id": 1500, "judge_score": 4}]]
    catalogue, both = models(spark, "a", "b"), None
    for part in parts:
        part = results(spark, part)
        part.coalesce(1).write.mode("append").parquet(paths[0])
        both = part if both is None else both.unionByName(part)
    stream = lambda: spark.readStream.schema(both.schema).option("maxFilesPerTrigger", 1).parquet(paths[0])
    want = R.model_metrics(both, catalogue)
    for replay in range(2):
        live.start_run_views(stream(), catalogue, paths[1], paths[2], once=True).awaitTermination()
        got = live.read_run_views(spark, paths[1], catalogue, both)
        assert rows(got, *sorted(want.columns)) == rows(want, *sorted(want.columns))
        _forget_last(paths[2])
    facts = f"{paths[1]}/facts"
    assert spark.read.parquet(facts).count() == both.count()
    touched = live.facts_of_runs(spark, facts, both.schema, [2, 1500])
    assert touched.count() == 2
    plan = touched._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [run_group" in plan and "IN (2,1500)" in plan.replace(", ", ",")
    assert live.facts_of_runs(spark, facts, both.schema, [1], runs_per_folder=1).count() == 4


def _follow(spark, paths, threshold=3.5, delay="1 day"):
    live.start_alerts(_stream(spark, paths[0]), paths[1], paths[2], threshold, delay, once=True).awaitTermination()
    return sorted((r.model, r.day.day, round(r.mean_score, 3), r.event) for r in live.read_alerts(spark, paths[1]).collect())


def test_alerts_are_emitted_once_over_many_batches(spark, paths):
    _land(spark, paths[0], [(1, "m", 1, 4), (1, "k", 1, 1)], 1)
    assert _follow(spark, paths) == []  # no day is closed yet
    _land(spark, paths[0], [(1, "m", 2, 2), (1, "m", 3, 2)], 2)
    _land(spark, paths[0], [(1, "m", 4, 5)], 3)
    want = [("k", 1, 1.0, "raised"), ("m", 2, 3.0, "raised")]
    assert _follow(spark, paths) == want
    assert _follow(spark, paths) == want
    _land(spark, paths[0], [(1, "m", 5, 5), (1, "m", 6, None)], 4)
    _land(spark, paths[0], [(1, "m", 9, 5), (1, None, 9, 1), (1, "m", None, 1)], 5)
    # Means of m: 4, 3, 8/3, 13/4, 18/5, then a day without a score.
    assert _follow(spark, paths) == [*want, ("m", 5, 3.6, "resolved")]
    for _ in range(2):  # a replay of the last batch
        _forget_last(paths[2])
        assert _follow(spark, paths) == [*want, ("m", 5, 3.6, "resolved")]


def test_late_rows_count_from_the_next_day_on(spark, paths):
    _land(spark, paths[0], [(1, "m", 1, 4), (1, "m", 5, 4)], 1)
    assert _follow(spark, paths) == []
    # Day 1 is closed: the late row lowers day 5. A row inside the delay still belongs to its day.
    _land(spark, paths[0], [(1, "m", 1, 1), (1, "m", 4, 4)], 2)
    _land(spark, paths[0], [(1, "m", 8, 5)], 3)
    assert _follow(spark, paths) == [("m", 4, 3.0, "raised")]


def test_alerts_do_not_depend_on_how_rows_are_batched(spark, tmp_path):
    scores = [(1, m, d, (d * k) % 6) for d in range(1, 25) for m, k in (("m", 3), ("k", 5), ("z", 4))]
    found = []
    for name, cuts in (("whole", [72]), ("some", [10, 30, 31, 72]), ("end", [71, 72])):
        paths = tuple(str(tmp_path / name / n) for n in ("in", "out", "state"))
        for i, (a, b) in enumerate(zip([0, *cuts], cuts)):
            _land(spark, paths[0], scores[a:b], i)
        found.append(_follow(spark, paths, threshold=2.5))
    assert found[0] and found[0] == found[1] == found[2]


def test_a_load_of_the_run_views_is_written_by_many_tasks(spark, tmp_path, monkeypatch):
    from gradeloom.plans import text_queries

    d, n = str(tmp_path / "tables"), 400
    spark.createDataFrame([(i, f"N{i}", 0) for i in range(25)], "n_nationkey long, n_name string, n_regionkey long").write.parquet(f"{d}/nation.parquet")
    spark.range(n).selectExpr(
        "id AS l_orderkey", "id % 10 AS l_partkey", "id % 2 AS l_suppkey", "1 AS l_linenumber", "double(id % 50) AS l_quantity",
        "double(id) AS l_extendedprice", "0.01D AS l_discount", "0.02D AS l_tax", "'A' AS l_returnflag", "'F' AS l_linestatus",
        "timestamp_ntz'2024-01-01 00:00:00' AS l_shipdate").repartition(4).write.parquet(f"{d}/lineitem.parquet")
    monkeypatch.setattr(text_queries, "scratch_path", lambda spark, name: str(tmp_path / name))
    text_queries.run_views(spark, d)
    assert len([*(tmp_path / "landed").glob("*.parquet")]) > 3  # one task per load wrote three
    assert spark.read.parquet(str(tmp_path / "landed")).count() == n
    assert len([*(tmp_path / "views-state" / "commits").glob("[0-9]")]) == 3
