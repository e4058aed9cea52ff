"""Queries over sources, sinks and table maintenance."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from gradeloom.operators import cases as C
from gradeloom.operators import catalog as K
from gradeloom.operators import lifecycle as L
from gradeloom.operators import prompts as P
from gradeloom.operators import verdicts as V
from gradeloom.plans.registry import query
from gradeloom.session import scratch_path
from gradeloom.sources import bed, tables


@query("a01_latest_models", """SELECT id, provider, name, version, context_window, created_at FROM (
    SELECT *, row_number() OVER (PARTITION BY name ORDER BY created_at DESC, id DESC) AS rn FROM catalog) WHERE rn = 1""")
def latest_models(spark, d):
    return K.latest_models(bed.catalog(spark, d)).select(
        "id", "provider", "name", "version", "context_window", "created_at")


@query("a01_unknown_models", """SELECT DISTINCT p_type AS name FROM part
    WHERE p_type NOT IN (SELECT p_brand FROM part)""")
def unknown_models(spark, d):
    asked = bed.table(spark, d, "part").select(F.col("p_type").alias("name"))
    return K.unknown_models(asked, bed.catalog(spark, d))


_PER_RUN = """SELECT run_id, count(*) AS n, sum(input_tokens + output_tokens)::BIGINT AS tokens,
    CAST(sum(micro) AS DOUBLE) / 1000000 AS total_cost, count(tenths) AS n_judged FROM results"""


def _per_run(results):
    return results.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum((F.col("input_tokens") + F.col("output_tokens")).cast("bigint")).alias("tokens"),
        F.sum("cost").cast("double").alias("total_cost"), F.count("judge_score").alias("n_judged"))


@query("a02_append_results", f"{_PER_RUN} GROUP BY run_id")
def append_results(spark, d):
    path = scratch_path(spark, "results")
    rows = bed.results(spark, d)
    tables.append_results(rows.where("judge_score IS NOT NULL"), path)
    tables.append_results(rows.where("judge_score IS NULL"), path)
    return _per_run(spark.read.schema(tables.schema.RESULTS).parquet(path))


_RAW = """WITH quoted AS (SELECT doc_id AS id, to_json(text)::VARCHAR AS reasoning, n_chars % 101 AS pct FROM documents),
scored AS (SELECT id, reasoning, CASE WHEN pct < 100 THEN '0.' || lpad(CAST(pct AS VARCHAR), 2, '0') ELSE '1.00' END AS score FROM quoted),
raw AS (SELECT id, CASE id % 11
    WHEN 0 THEN '{"score": ' || score || ', "reasoning": ' || reasoning || '}'
    WHEN 1 THEN 'Voici :' || chr(10) || '```json' || chr(10) || '{"score": ' || score || ', "reasoning": ' || reasoning || '}' || chr(10) || '```'
    WHEN 2 THEN 'Score ' || score || ' because ' || reasoning
    WHEN 3 THEN '{"score": 1' || score || ', "reasoning": ' || reasoning || '}'
    WHEN 4 THEN '{"score": true, "reasoning": ' || reasoning || '}'
    WHEN 5 THEN '{"score": ' || score || ', "reasoning": "  "}'
    WHEN 6 THEN '[' || score || ', ' || reasoning || ']'
    WHEN 8 THEN '{"score": ' || score || ', "reasoning": ' || reasoning || '} as asked'
    WHEN 9 THEN '{"score": ' || score || ', "reasoning": ' || reasoning || '}{"score": 1}'
    WHEN 10 THEN '```' || chr(10) || '{"score": ' || score || ', "reasoning": ' || reasoning || '}' || chr(10) || '```' || chr(10) || '```' || chr(10) || '{"score": 1}' || chr(10) || '```'
    ELSE '{"score": 1, "reasoning": ' || reasoning || '}' END AS raw FROM scored),
inner_text AS (SELECT id, CASE WHEN regexp_matches(raw, '(?s)```(?:json)?\\s*(\\{.*\\})\\s*```')
    THEN regexp_extract(raw, '(?s)```(?:json)?\\s*(\\{.*\\})\\s*```', 1) ELSE raw END AS txt FROM raw),
doc AS (SELECT id, CASE WHEN json_valid(txt) THEN txt::JSON END AS doc FROM inner_text),
parts AS (SELECT id, doc, json_type(doc) AS kind, json_type(doc, '$.score') AS score_kind,
    TRY_CAST(json_extract_string(doc, '$.score') AS DOUBLE) AS score, json_type(doc, '$.reasoning') AS reasoning_kind,
    json_extract_string(doc, '$.reasoning') AS reasoning FROM doc),
verdicts AS (SELECT *, CASE WHEN doc IS NULL THEN 'not_json' WHEN kind <> 'OBJECT' THEN 'not_object'
    WHEN score_kind IS NULL OR score_kind NOT IN ('DOUBLE', 'BIGINT', 'UBIGINT') THEN 'bad_score'
    WHEN score > 1 OR score < 0 THEN 'score_range'
    WHEN reasoning_kind IS NULL OR reasoning_kind <> 'VARCHAR' OR trim(reasoning) = '' THEN 'bad_reasoning' END AS reject,
    CAST(round(score * 100) AS INTEGER) AS cents FROM parts),
judged AS (SELECT id, CASE WHEN reject IS NULL THEN (cents // 2 + CASE WHEN cents % 2 = 1 AND (cents // 2) % 2 = 1 THEN 1 ELSE 0 END) / 10.0 END AS judge_score,
    CASE WHEN reject IS NULL THEN reasoning END AS judge_reasoning, reject FROM verdicts)
"""


@query("a03_apply_verdicts", _RAW + """SELECT r.id, coalesce(j.judge_score, r.tenths / 10.0) AS judge_score,
    CASE WHEN j.judge_score IS NOT NULL THEN j.judge_reasoning ELSE r.judge_reasoning END AS judge_reasoning
    FROM responses r LEFT JOIN judged j ON j.id = r.id""")
def apply_verdicts(spark, d):
    verdicts = V.parse_verdicts(bed.verdict_texts(spark, d))
    rows = bed.responses(spark, d).select("id", "judge_score", "judge_reasoning")
    return V.apply_verdicts(rows, verdicts).withColumn("judge_score", F.col("judge_score").cast("double"))


@query("m21_parse_verdicts", _RAW + "SELECT id, judge_score, judge_reasoning, reject FROM judged")
def parse_verdicts(spark, d):
    return V.parse_verdicts(bed.verdict_texts(spark, d)).withColumn("judge_score", F.col("judge_score").cast("double"))


@query("g05_verdict_rejects", _RAW + "SELECT coalesce(reject, 'accepted') AS outcome, count(*) AS n FROM judged GROUP BY 1")
def verdict_rejects(spark, d):
    return V.parse_verdicts(bed.verdict_texts(spark, d)).groupBy(
        F.coalesce("reject", F.lit("accepted")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


@query("f10_verdict_scale", _RAW + "SELECT judge_score, count(*) AS n FROM judged WHERE judge_score IS NOT NULL GROUP BY 1")
def verdict_scale(spark, d):
    return V.parse_verdicts(bed.verdict_texts(spark, d)).where("judge_score IS NOT NULL").groupBy(
        F.col("judge_score").cast("double").alias("judge_score")).agg(F.count(F.lit(1)).alias("n"))


_NOW = dt.datetime(2024, 12, 31)


@query("a04_open_runs", """WITH d AS (SELECT DISTINCT s_nationkey FROM supplier), t AS (SELECT max(s_suppkey) + 1 AS top FROM supplier)
    SELECT count(*) AS n, count(*) AS n_ids, min(top) + 1 AS lowest, min(top) + count(*) AS highest, count(DISTINCT s_nationkey) AS n_datasets FROM d, t""")
def open_runs(spark, d):
    runs = bed.runs(spark, d)
    asked = runs.groupBy("dataset").agg(F.max("prompt_id").alias("prompt_id")).withColumn("request", F.col("dataset"))
    return L.open_runs(runs, asked, _NOW).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("n_ids"), F.min("id").alias("lowest"),
        F.max("id").alias("highest"), F.count_distinct("dataset").alias("n_datasets"))


@query("a04_finalize_runs", """SELECT u.id, u.dataset, coalesce(u.finished_at, max(r.created_at), TIMESTAMP '2024-12-31') AS finished_at
    FROM runs u LEFT JOIN results r ON r.run_id = u.id GROUP BY u.id, u.dataset, u.finished_at""")
def finalize_runs(spark, d):
    return L.finalize_runs(bed.runs(spark, d), bed.results(spark, d), _NOW).select("id", "dataset", "finished_at")


@query("a05_upsert_catalog", """WITH existing AS (SELECT * FROM catalog WHERE price < 1000),
    fresh AS (SELECT min(id) AS id, provider, name, version FROM catalog WHERE version IS NOT NULL GROUP BY provider, name, version
        UNION ALL SELECT id, provider, name, version FROM catalog WHERE version IS NULL)
    SELECT id, provider, name, version FROM existing UNION ALL
    SELECT f.id, f.provider, f.name, f.version FROM fresh f WHERE NOT EXISTS (SELECT 1 FROM existing e
        WHERE e.provider = f.provider AND e.name = f.name AND e.version = f.version)""")
def upsert_catalog(spark, d):
    incoming = bed.catalog(spark, d).select("id", "provider", "name", "version", "input_cost")
    existing = incoming.where("input_cost < 0.001")
    return K.upsert_catalog(existing, incoming).select("id", "provider", "name", "version")


@query("a06_patch_catalog", """SELECT c.id, c.name, coalesce(p.context_window, c.context_window) AS context_window, c.price AS price
    FROM catalog c LEFT JOIN (SELECT p_brand AS name, CASE WHEN max(p_retailprice) > 1000 THEN max(p_size) * 2000 END AS context_window
        FROM part GROUP BY p_brand) p ON p.name = c.name""")
def patch_catalog(spark, d):
    patch = bed.table(spark, d, "part").groupBy(F.col("p_brand").alias("name")).agg(
        F.when(F.max("p_retailprice") > 1000, F.max("p_size") * 2000).alias("context_window"))
    return K.patch_catalog(bed.catalog(spark, d), patch).select(
        "id", "name", "context_window", (F.col("input_cost").cast("decimal(18,9)") * 1000000).cast("double").alias("price"))


@query("a07_prune_catalog", """SELECT id, provider, name FROM catalog c WHERE NOT (provider ILIKE 'economy'
    AND NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_partkey = c.id))""")
def prune_catalog(spark, d):
    used = bed.table(spark, d, "lineitem").select(F.col("l_partkey").alias("model_id"))
    return K.prune_catalog(bed.catalog(spark, d), used, "economy").select("id", "provider", "name")


@query("a08_read_questions", """SELECT 'q' || lpad(CAST(doc_id AS VARCHAR), 9, '0') AS uid, lang AS subcategory, text AS prompt
    FROM documents""")
def read_questions(spark, d):
    path = scratch_path(spark, "questions")
    q = bed.questions(spark, d)
    q.select(F.to_json(F.struct(*q.columns)).alias("value")).write.option("lineSep", "\n").text(path)
    return tables.read_questions(spark, path)


_CASE_FILES = """WITH headers AS (SELECT conv_id AS source, CASE WHEN max(turn) > 6 THEN ' ' ELSE 'set-' || conv_id END AS name,
    CASE WHEN max(turn) <> 5 THEN '1' END AS version FROM conversations GROUP BY conv_id),
cases AS (SELECT conv_id AS source, turn AS position,
    CASE WHEN length(text) % 7 = 0 THEN ' ' ELSE 'len-' || length(text) % 5 END AS case_id,
    CASE WHEN length(text) % 11 = 0 THEN chr(10) ELSE text END AS prompt FROM conversations),
bad AS (SELECT source, position, case_id, 'id_missing' AS rule FROM cases WHERE trim(case_id) = ''
    UNION ALL SELECT source, position, case_id, 'prompt_missing' FROM cases WHERE prompt = chr(10)
    UNION ALL SELECT source, min(position), case_id, 'duplicate_id' FROM cases WHERE trim(case_id) <> '' GROUP BY source, case_id HAVING count(*) > 1
    UNION ALL SELECT source, NULL, NULL, 'name_missing' FROM headers WHERE trim(name) = ''
    UNION ALL SELECT source, NULL, NULL, 'version_missing' FROM headers WHERE version IS NULL
    UNION ALL SELECT source, NULL, NULL, 'no_cases' FROM headers WHERE source NOT IN (SELECT source FROM cases))
"""


def _case_files(spark, d):
    turns = bed.table(spark, d, "conversations")
    headers = turns.groupBy(F.col("conv_id").alias("source")).agg(F.max("turn").alias("t")).selectExpr(
        "source", "CASE WHEN t > 6 THEN ' ' ELSE concat('set-', source) END AS name",
        "CASE WHEN t <> 5 THEN '1' END AS version")
    rows = turns.selectExpr(
        "conv_id AS source", "turn AS position",
        "CASE WHEN length(text) % 7 = 0 THEN ' ' ELSE concat('len-', length(text) % 5) END AS case_id",
        "CASE WHEN length(text) % 11 = 0 THEN '\\n' ELSE text END AS prompt")
    return headers, rows


@query("a09_validate_cases", _CASE_FILES + "SELECT source, position, case_id, rule FROM bad")
def validate_cases(spark, d):
    return C.validate_cases(*_case_files(spark, d)).select("source", "position", "case_id", "rule")


@query("a10_discover_datasets", _CASE_FILES + """SELECT source, name, version FROM headers
    WHERE source NOT IN (SELECT source FROM bad)""")
def discover_datasets(spark, d):
    return C.discover_datasets(*_case_files(spark, d)).select("source", "name", "version")


@query("a11_validate_prompts", """WITH staged AS (SELECT doc_id AS source, CASE WHEN lang = 'de' THEN ' ' ELSE lang END AS name,
        CASE WHEN n_chars % 5 > 0 THEN '1' END AS version, CASE WHEN lang <> 'fr' THEN text END AS content FROM documents)
    SELECT source, 'name_missing' AS rule FROM staged WHERE trim(name) = ''
    UNION ALL SELECT source, 'version_missing' FROM staged WHERE version IS NULL
    UNION ALL SELECT source, 'content_missing' FROM staged WHERE content IS NULL OR trim(content) = ''""")
def validate_prompts(spark, d):
    staged = bed.table(spark, d, "documents").selectExpr(
        "doc_id AS source", "CASE WHEN lang = 'de' THEN ' ' ELSE lang END AS name",
        "CASE WHEN n_chars % 5 > 0 THEN '1' END AS version", "CASE WHEN lang <> 'fr' THEN text END AS content")
    return P.validate_prompts(staged)


def _first_dataset(spark, d) -> Column:
    return bed.runs(spark, d).agg(F.min_by("dataset", "id")).scalar()


_FIRST = "(SELECT arg_min(dataset, id) FROM runs)"


@query("a12_export_dataset", f"""WITH chosen AS (SELECT id FROM runs WHERE dataset = {_FIRST})
    SELECT c.id AS run_id, (SELECT count(*) FROM results r WHERE r.run_id = c.id) AS n_results,
        (SELECT count(*) FROM decisions x WHERE x.run_id = c.id) AS n_decisions FROM chosen c""")
def export_dataset(spark, d):
    path = scratch_path(spark, "snapshot")
    L.export_dataset(bed.runs(spark, d), bed.results(spark, d), bed.decisions(spark, d), _first_dataset(spark, d), path)
    count = lambda name, out: tables.read_table(spark, path, name).groupBy("run_id").agg(F.count(F.lit(1)).alias(out))
    kept = tables.read_table(spark, path, "runs").select(F.col("id").alias("run_id"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return (kept.join(count("results", "n_results"), "run_id", "left").join(count("decisions", "n_decisions"), "run_id", "left")
            .select("run_id", zero("n_results"), zero("n_decisions")))


@query("a13_restore_dataset", f"{_PER_RUN} GROUP BY run_id")
def restore_dataset(spark, d):
    name, runs, rows, log = _first_dataset(spark, d), bed.runs(spark, d), bed.results(spark, d), bed.decisions(spark, d)
    snapshot = L.export_dataset(runs, rows, log, name)
    damaged = rows.where("judge_score IS NULL OR judge_score > 2")
    untouched = rows.join(runs.where(F.col("dataset") != name).select(F.col("id").alias("run_id")), "run_id", "left_semi")
    lost = damaged.join(snapshot[0].select(F.col("id").alias("run_id")), "run_id", "left_semi")
    restored = L.restore_dataset((runs, untouched.unionByName(lost), log), snapshot, name)
    return _per_run(restored[1])


@query("a14_purge_runs", f"{_PER_RUN} WHERE run_id NOT IN (SELECT id FROM runs WHERE dataset = {_FIRST}) GROUP BY run_id")
def purge_runs(spark, d):
    doomed = L.chosen_runs(dataset=_first_dataset(spark, d))
    return _per_run(L.purge_runs(bed.runs(spark, d), bed.results(spark, d), bed.decisions(spark, d), doomed)[1])


@query("a14_purge_decisions", """SELECT id, run_id, profile FROM decisions
    WHERE run_id IS NULL OR run_id NOT IN (SELECT id FROM runs WHERE CAST(started_at AS DATE) = DATE '2024-01-05')""")
def purge_decisions(spark, d):
    doomed = L.chosen_runs(today=dt.date(2024, 1, 5))
    return L.purge_runs(bed.runs(spark, d), bed.results(spark, d), bed.decisions(spark, d), doomed)[2].select(
        "id", "run_id", "profile")


@query("a14_purge_preview", """SELECT u.id, u.dataset, u.started_at, count(r.id) AS results
    FROM runs u LEFT JOIN results r ON r.run_id = u.id GROUP BY u.id, u.dataset, u.started_at""")
def purge_preview(spark, d):
    return L.purge_preview(bed.runs(spark, d), bed.results(spark, d), L.chosen_runs(everything=True))


@query("f06_runs_of_a_day", """SELECT u.id, u.dataset, u.started_at, count(r.id) AS results
    FROM runs u LEFT JOIN results r ON r.run_id = u.id WHERE CAST(u.started_at AS DATE) = DATE '2024-01-05'
    GROUP BY u.id, u.dataset, u.started_at""")
def runs_of_a_day(spark, d):
    return L.purge_preview(bed.runs(spark, d), bed.results(spark, d), L.chosen_runs(today=dt.date(2024, 1, 5)))


@query("a15_append_decisions", "SELECT id, run_id, profile, recommended_model, confidence, created_at FROM decisions")
def append_decisions(spark, d):
    path = scratch_path(spark, "decisions")
    tables.append_decisions(bed.decisions(spark, d), path)
    return spark.read.schema(tables.schema.DECISIONS).parquet(path).select(
        "id", "run_id", "profile", "recommended_model", "confidence", "created_at")
