"""The plans keep the shape that the scale needs."""

import re

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from gradeloom import schema
from gradeloom.operators import catalog as K
from gradeloom.operators import cases as C
from gradeloom.operators import decisions as D
from gradeloom.operators import rollups as R
from gradeloom.sources import bed, tables

SF = "/root/testdata/sf0.001"


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("store"))
    tables.append_results(bed.results(spark, SF), f"{root}/flat/results")
    tables.append_results(bed.results(spark, SF), f"{root}/folders/results", run_folders=True)
    return root


VIEWS = {
    "run_metrics": lambda s, r: R.run_metrics(bed.runs(s, SF), r),
    "complete_cases": lambda s, r: R.complete_cases(r),
    "model_metrics": lambda s, r: R.model_metrics(r, bed.models(s, SF)),
    "model_decision_metrics": lambda s, r: R.model_decision_metrics(r, bed.models(s, SF)),
    "style_confound": lambda s, r: R.style_confound(r, bed.models(s, SF)),
    "result_variance": lambda s, r: R.result_variance(r, bed.models(s, SF)),
    "result_review": lambda s, r: R.result_review(r, bed.models(s, SF)),
    "score_stats": lambda s, r: R.score_stats(r, bed.models(s, SF)),
}


@pytest.mark.parametrize("name", VIEWS)
def test_a_run_filter_reaches_every_scan_of_the_facts(spark, stored, name):
    for layout, mark in (("folders", r"PartitionFilters: \[[^\]]*run_id#\d+L = 5"), ("flat", r"PushedFilters: \[[^\]]*EqualTo\(run_id,5\)")):
        facts = tables.read_table(spark, f"{stored}/{layout}", "results")
        df = VIEWS[name](spark, facts).where("run_id = 5")
        scans = [ln for ln in df._jdf.queryExecution().executedPlan().toString().split("\n") if "FileScan" in ln and layout in ln]
        assert scans and df.count() >= 0
        full = df._jdf.queryExecution().explainString(df._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        blocks = [b for b in re.split(r"\n\n", full) if "Scan parquet" in b and layout in b]
        assert len(blocks) == len(scans) and all(re.search(mark, b) for b in blocks), name


def test_roll_ups_read_no_text_and_scan_the_facts_once(spark, stored):
    facts = tables.read_table(spark, f"{stored}/flat", "results")
    plan = plan_of(R.model_decision_metrics(facts, bed.models(spark, SF)))
    assert plan.count("flat/results") == 1
    assert "response#" not in plan and "judge_reasoning" not in plan


def test_distinct_counts_run_on_cells(spark, stored):
    facts = tables.read_table(spark, f"{stored}/flat", "results")
    plan = plan_of(R.run_metrics(bed.runs(spark, SF), facts))
    below = plan[plan.index("Expand"):].split("\n")
    assert any("HashAggregate(keys=[run_id" in ln and "model_id" in ln and "case_id" in ln for ln in below)


def test_nothing_is_multiplied_out(spark):
    r, m = bed.results(spark, SF), bed.models(spark, SF)
    metrics = R.model_decision_metrics(r, m)
    for df in (metrics, D.rank_models(metrics, D.shipped_profiles(spark)), D.decide(metrics, D.shipped_profiles(spark), bed.decisions(spark, SF), 7),
               R.complete_cases(r), R.run_metrics(bed.runs(spark, SF), r)):
        plan = plan_of(df)
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "BatchEvalPython" not in plan


def test_top_rows_per_group_are_cut_before_the_shuffle(spark):
    for df in (K.latest_models(bed.catalog(spark, SF)), C.balanced_subset(bed.questions(spark, SF)), D.latest_per_profile(bed.decisions(spark, SF))):
        assert any("WindowGroupLimit" in ln and "Partial" in ln for ln in plan_of(df).split("\n"))


@pytest.fixture(scope="module")
def bucketed(spark, tmp_path_factory):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    path = str(tmp_path_factory.mktemp("buckets") / "results")
    for rows in (bed.single_samples(spark, SF), bed.single_samples(spark, SF).limit(5)):
        table = tables.append_bucketed(rows, "plan_bucketed", path, int(before))
    yield table
    spark.sql("DROP TABLE plan_bucketed")


def test_rows_travel_to_their_buckets_packed(spark, tmp_path):
    keys = ["run_id", "case_id"]
    rows = bed.single_samples(spark, SF).select(*[F.col(f.name).cast(f.dataType) for f in schema.RESULTS])
    rows = rows.union(rows.limit(7)).union(rows.limit(3).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in schema.RESULTS]))
    dealt = tables.by_bucket(rows, 6, keys, ["model_id"])
    assert dealt.schema.simpleString() == rows.schema.simpleString()
    assert dealt.exceptAll(rows).count() == rows.exceptAll(dealt).count() == 0
    assert dealt.where("spark_partition_id() <> pmod(hash(run_id, case_id), 6)").count() == 0
    lines = plan_of(dealt).split("\n")
    exchange = next(i for i, ln in enumerate(lines) if "Exchange" in ln)
    assert "response" not in lines[exchange] and "MapInArrow" in lines[exchange + 1]
    assert tables.by_bucket(rows.limit(0), 6, keys, ["model_id"]).count() == 0
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert tables.append_bucketed(rows, "plan_packed", str(tmp_path / "t"), 4).count() == rows.count()
    spark.sql("DROP TABLE plan_packed")
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
    files = [pq.ParquetFile(f) for f in (tmp_path / "t").glob("part-*")]
    assert len(files) == 4 and all(f.metadata.row_group(0).column(3).compression == "ZSTD" for f in files)


def test_packs_hold_few_rows_and_lose_none():
    rows = pa.record_batch({"_bucket": pa.array([2, 0, 2, 1, 0], pa.int32()), "k": [5, None, 1, 3, 3], "t": ["a", None, "", "d", "é"]})
    kept = pa.schema(list(rows.schema)[1:])
    for most in (1, 1 << 20):
        packs = list(tables._pack(iter([rows, rows.slice(0, 0), rows.slice(1, 3)]), kept, ["_bucket", "k"], most))
        assert [p.column(0).to_pylist() for p in packs] == ([[0, 1, 2]] * 2 if most == 1 else [[0, 1, 2]])
        back = sorted((r["k"] or 0, r["t"] or "") for p in packs for b in tables._unpack(iter([p]), kept) for r in b.to_pylist())
        assert back == [(0, ""), (0, ""), (1, ""), (1, ""), (3, "d"), (3, "d"), (3, "é"), (5, "a")]


def _without_broadcasts(spark, df) -> str:
    """The plan as it is when the small sides are too large to be broadcast."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        return plan_of(df())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_bucketed_facts_fold_without_an_exchange(spark, bucketed):
    assert bucketed.count() == bed.single_samples(spark, SF).count() + 5
    for view in (R.model_metrics, R.model_decision_metrics):
        lines = _without_broadcasts(spark, lambda: view(bucketed, bed.models(spark, SF))).split("\n")
        window = max(i for i, ln in enumerate(lines) if "Window " in ln)
        scan = next(i for i in range(window, len(lines)) if "FileScan" in lines[i])
        assert "Bucketed: true" in lines[scan]
        below = lines[window:scan]
        assert not any("Exchange" in ln for ln in below), "\n".join(below)


def test_bucketed_rows_of_complete_cases_stay_where_they_are(spark, bucketed):
    lines = _without_broadcasts(spark, lambda: R.fair_results(bucketed, R.complete_cases(bucketed))).split("\n")
    wide = [i for i, ln in enumerate(lines) if "FileScan" in ln and "response#" in ln]
    assert len(wide) == 2  # rows with and without a case
    first = next(i for i in range(wide[0], -1, -1) if "SortMergeJoin" in lines[i] and "case_id" in lines[i])
    assert not any("Exchange" in ln for ln in lines[first:wide[0]]), "\n".join(lines[first:wide[0] + 1])
    assert "isnull(case_id" in lines[wide[1]].lower()
