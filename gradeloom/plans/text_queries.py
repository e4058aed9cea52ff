"""Queries over response texts, prompt versions, checks and streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gradeloom.functions.text import content_hash, normalize_content
from gradeloom.operators import cases as C
from gradeloom.operators import checks as K
from gradeloom.operators import prompts as P
from gradeloom.operators import style as S
from gradeloom.operators import verdicts as V
from gradeloom.plans.registry import query
from gradeloom.session import scratch_path
from gradeloom.sources import bed
from gradeloom.streaming import live

# --- markdown features -------------------------------------------------------

_COUNTED = """WITH prose AS (SELECT id, response, regexp_replace(response, '```[^`]*```', '', 'g') AS prose FROM responses),
    counted AS (SELECT id, CAST(len(regexp_extract_all(prose, '(?m)^#{1,6}\\s')) AS INTEGER) AS resp_style_headers,
    CAST(len(regexp_extract_all(prose, '\\*\\*[^*\\n]+\\*\\*|__[^_\\n]+__')) AS INTEGER) AS resp_style_bold,
    CAST(len(regexp_extract_all(prose, '(?m)^\\s*\\d+\\.\\s')) AS INTEGER) AS resp_style_ordered,
    CAST(len(regexp_extract_all(prose, '(?m)^\\s*[-*+]\\s')) AS INTEGER) AS resp_style_unordered,
    CAST(len(regexp_extract_all(response, '```[^`]*```')) AS INTEGER) AS resp_style_code_blocks FROM prose)
    """


@query("m02_style_features", _COUNTED + "SELECT * FROM counted")
def style_features(spark, d):
    return S.with_style_features(bed.responses(spark, d)).select("id", *[f"resp_style_{k}" for k in S.STYLE_COUNTS])


@query("f08_markdown_totals", _COUNTED + """SELECT resp_style_headers AS headers, resp_style_code_blocks AS code_blocks, count(*) AS n,
    sum(resp_style_bold)::BIGINT AS bold FROM counted GROUP BY 1, 2""")
def markdown_totals(spark, d):
    return S.with_style_features(bed.responses(spark, d)).groupBy(
        F.col("resp_style_headers").alias("headers"), F.col("resp_style_code_blocks").alias("code_blocks")
    ).agg(F.count(F.lit(1)).alias("n"), F.sum("resp_style_bold").alias("bold"))


# --- prompt versions ---------------------------------------------------------

def _messy(text: str) -> str:
    """A text column with Windows line ends, trailing blanks and split accents."""
    return f"replace(replace({text}, 'é', 'é'), chr(10), ' ' || chr(13) || chr(10))"


def _clean_sql(text: str) -> str:
    lines = f"regexp_replace(nfc_normalize({text}), '\\r\\n?', chr(10), 'g')"
    return f"trim(regexp_replace({lines}, '(?m)[ \\t]+$', '', 'g'), ' ' || chr(9) || chr(10))"


@query("n01_normalized_content", f"SELECT id, {_clean_sql(_messy('content'))} AS content FROM prompts")
def normalized_content(spark, d):
    messy = bed.prompts(spark, d).withColumn("content", F.expr(_messy("content")))
    return messy.select("id", normalize_content(F.col("content")).alias("content"))


@query("n02_content_hash", f"SELECT id, sha256({_clean_sql('content')}) AS hash FROM prompts")
def prompt_hashes(spark, d):
    messy = bed.prompts(spark, d).withColumn("content", F.expr(_messy("content")))
    return messy.select("id", content_hash(F.col("content")).alias("hash"))


@query("f09_document_hash", f"SELECT doc_id, sha256({_clean_sql('text')}) AS hash FROM documents")
def document_hash(spark, d):
    return bed.table(spark, d, "documents").select("doc_id", content_hash(F.col("text")).alias("hash"))


def _versions(spark, d):
    """Prompt table: the turns of each conversation, chained by time."""
    turns = P.version_chain(bed.prompts(spark, d)).withColumn("hash", content_hash(F.col("content")))
    return turns.select("id", "name", "content", "version", "hash", "previous_version_id", "created_at")


def _hashed_turns(spark, d):
    return bed.prompts(spark, d).withColumn("hash", content_hash(F.col("content")))


_VERSIONS = f"""WITH versions AS (SELECT id, name, version, created_at, sha256({_clean_sql('content')}) AS hash,
    lag(id) OVER (PARTITION BY name ORDER BY created_at, id) AS previous_version_id FROM prompts p)
    """


# The prompt table of the sync: a conversation's last turn is not in it yet.
_KNOWN = f"""WITH known AS (SELECT id, name, version, created_at, sha256({_clean_sql('content')}) AS hash,
    lag(id) OVER (PARTITION BY name ORDER BY created_at, id) AS previous_version_id FROM prompts p WHERE turn < (SELECT max(turn) FROM prompts q WHERE q.name = p.name))
    """


def _known(spark, d):
    of_name = Window.partitionBy("name")
    turns = _hashed_turns(spark, d).withColumn("_last", F.max("turn").over(of_name)).where("turn < _last")
    return turns.withColumn("previous_version_id", F.lag("id").over(of_name.orderBy("created_at", "id"))).select(
        "id", "name", "content", "version", "hash", "previous_version_id", "created_at")


@query("n03_sync_prompts", _KNOWN + f""", staged AS (SELECT name, version, sha256({_clean_sql('content')}) AS hash FROM
        (SELECT *, row_number() OVER (PARTITION BY name ORDER BY CASE WHEN CAST(substring(name, 6) AS BIGINT) % 3 = 0 THEN turn ELSE -turn END) AS rn FROM prompts) WHERE rn = 1)
    SELECT s.name, coalesce(k.version, s.version) AS version, coalesce(k.created_at, TIMESTAMP '2024-06-01') AS created_at, s.hash, CASE WHEN k.id IS NOT NULL THEN 'unchanged' WHEN l.id IS NOT NULL THEN 'new_version' ELSE 'initial' END AS action,
        k.id AS known_id, CASE WHEN k.id IS NULL THEN l.id ELSE k.previous_version_id END AS previous_version_id
    FROM staged s LEFT JOIN (SELECT * FROM known o WHERE id = (SELECT min(id) FROM known i WHERE i.name = o.name AND i.hash = o.hash)) k ON k.name = s.name AND k.hash = s.hash
    LEFT JOIN (SELECT name, arg_max(id, created_at) AS id FROM known GROUP BY name) l ON l.name = s.name""")
def sync_prompts(spark, d):
    turns = bed.prompts(spark, d)
    order = F.expr("CASE WHEN CAST(substring(name, 6) AS BIGINT) % 3 = 0 THEN -turn ELSE turn END")
    staged = turns.groupBy("name").agg(F.max_by(F.struct("version", "content"), order).alias("s")).select(
        F.col("name").alias("source"), "name", "s.version", "s.content")
    synced = P.sync_prompts(_known(spark, d), staged, now="2024-06-01 00:00:00")
    return synced.select("name", "version", "created_at", "hash", "action",
                         F.when(F.col("action") == "unchanged", F.col("id")).alias("known_id"), "previous_version_id")


@query("n04_latest_prompts", _VERSIONS + """SELECT id, name, version, hash FROM
    (SELECT *, row_number() OVER (PARTITION BY name ORDER BY created_at DESC, id DESC) AS rn FROM versions) WHERE rn = 1""")
def latest_prompts(spark, d):
    return P.latest_prompts(_hashed_turns(spark, d)).select("id", "name", "version", "hash")


@query("n04_prompt_names", "SELECT DISTINCT name FROM prompts")
def prompt_names(spark, d):
    return P.prompt_names(bed.prompts(spark, d))


@query("n04_prompt_history", "SELECT id, name, version, created_at FROM prompts WHERE name = (SELECT max(name) FROM prompts)")
def prompt_history(spark, d):
    turns = bed.prompts(spark, d)
    return P.prompt_history(turns, turns.agg(F.max("name")).scalar()).select("id", "name", "version", "created_at")


@query("e06_version_chain", _VERSIONS + "SELECT id, name, previous_version_id FROM versions")
def version_chain(spark, d):
    return P.version_chain(bed.prompts(spark, d)).select("id", "name", "previous_version_id")


_HISTORY = "SELECT id, name, version, substring(hash, 1, 12) AS hash_short, hash, previous_version_id, created_at FROM versions"


@query("v11_prompts_history", _VERSIONS + _HISTORY)
def prompts_history(spark, d):
    return P.prompts_history(_versions(spark, d))


@query("f02_short_hash", _VERSIONS + "SELECT substring(hash, 1, 12) AS hash_short, count(*) AS n FROM versions GROUP BY 1")
def short_hash(spark, d):
    return P.prompts_history(_versions(spark, d)).groupBy("hash_short").agg(F.count(F.lit(1)).alias("n"))


# --- case curation and call texts --------------------------------------------

@query("m19_balanced_subset", """SELECT uid AS case_id, subcategory AS category, subcategory, 'main' AS kind, prompt, 'judge' AS "check" FROM
    (SELECT 'q' || lpad(CAST(doc_id AS VARCHAR), 9, '0') AS uid, lang AS subcategory, text AS prompt,
        row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rn FROM documents) WHERE rn <= 17""")
def balanced_subset(spark, d):
    return C.balanced_subset(bed.questions(spark, d))


@query("m20_call_texts", """SELECT doc_id AS id, md5('Answer briefly.' || chr(10) || chr(10) || text) AS call_md5 FROM documents""")
def call_texts(spark, d):
    plan = bed.table(spark, d, "documents").selectExpr("doc_id AS id", "text AS prompt")
    return C.call_inputs(plan, "  Answer briefly.\n").select("id", F.md5("call_text").alias("call_md5"))


@query("m20_judge_texts", """SELECT r.id, md5('Rate it.' || chr(10) || chr(10) || 'Q: ' || d.text || chr(10) || chr(10) || 'R: ' || r.response) AS judge_md5
    FROM responses r JOIN documents d ON d.doc_id = r.id""")
def judge_texts(spark, d):
    return C.judge_inputs(bed.responses(spark, d), "Rate it.\n").select("id", F.md5("judge_text").alias("judge_md5"))


# --- justifications ----------------------------------------------------------

_FORMS = [
    """'{"reasoning": ' || {r} || ', "determinant_metrics": ["efficiency", "avg_cost"], "tradeoffs": "latence"}'""",
    """'Voici :' || chr(10) || '```json' || chr(10) || '{"reasoning": ' || {r} || '}' || chr(10) || '```'""",
    """'{"reasoning": ' || {r} || ', "determinant_metrics": "efficiency"}'""",
    """'{"reasoning": ' || {r} || ', "determinant_metrics": ["efficiency", 1]}'""",
    """'{"reasoning": ' || {r} || ', "tradeoffs": 5}'""",
    """'{"reasoning": " ", "tradeoffs": ""}'""",
    """'{"reasoning": ' || {r} || '} voila'""",
    """'{"reasoning": ' || {r} || '}, {"reasoning": "b"}'""",
    """'Je retiens ' || {r}""",
]


def _justification(reasoning: str) -> str:
    whens = " ".join(f"WHEN {i} THEN " + f.replace("{r}", reasoning) for i, f in enumerate(_FORMS))
    return f"CASE doc_id % {len(_FORMS)} {whens} END"


@query("g06_parse_justifications", f"""WITH raw AS (SELECT doc_id AS id, {_justification("to_json(text)::VARCHAR")} AS raw FROM documents),
    texts AS (SELECT id, CASE WHEN regexp_matches(raw, '(?s)```(?:json)?\\s*(\\{{.*\\}})\\s*```')
        THEN regexp_extract(raw, '(?s)```(?:json)?\\s*(\\{{.*\\}})\\s*```', 1) ELSE raw END AS txt FROM raw),
    docs AS (SELECT id, CASE WHEN json_valid(txt) THEN txt::JSON END AS doc FROM texts),
    parts AS (SELECT id, CASE WHEN doc IS NULL THEN 'not_json' WHEN json_type(doc) <> 'OBJECT' THEN 'not_object'
            WHEN json_type(doc, '$.reasoning') IS DISTINCT FROM 'VARCHAR' OR trim(json_extract_string(doc, '$.reasoning')) = '' THEN 'bad_reasoning'
            WHEN json_type(doc, '$.determinant_metrics') IS NOT NULL AND (json_type(doc, '$.determinant_metrics') <> 'ARRAY'
                OR len(list_filter(json_extract(doc, '$.determinant_metrics[*]'), lambda m : json_type(m) <> 'VARCHAR')) > 0) THEN 'bad_metrics'
            WHEN json_type(doc, '$.tradeoffs') IS NOT NULL AND json_type(doc, '$.tradeoffs') <> 'VARCHAR' THEN 'bad_tradeoffs' END AS reject, doc FROM docs)
    SELECT id, CASE WHEN reject IS NULL THEN coalesce(array_to_string(json_extract_string(doc, '$.determinant_metrics[*]'), ','), '') END AS determinant_metrics,
        CASE WHEN reject IS NULL THEN coalesce(json_extract_string(doc, '$.tradeoffs'), '') END AS tradeoffs,
        CASE WHEN reject IS NULL THEN json_extract_string(doc, '$.reasoning') END AS reasoning, reject FROM parts""")
def parse_justifications(spark, d):
    quoted = "substr(to_json(named_struct('r', text)), 6, length(to_json(named_struct('r', text))) - 6)"
    raw = bed.table(spark, d, "documents").selectExpr("doc_id AS id", f"{_justification(quoted)} AS raw")
    return V.parse_justifications(raw).withColumn(
        "determinant_metrics", F.array_join("determinant_metrics", ","))


# --- checks ------------------------------------------------------------------

def _check(kind: str, **fields) -> str:
    named = {"kind": f"'{kind}'", "values": "NULL", "pattern": "NULL", "required": "NULL", "properties": "NULL",
             "threshold": "NULL", "weight": "NULL", "case_sensitive": "NULL", **fields}
    return f"cast(named_struct({', '.join(f'{k!r}, {v}' for k, v in named.items())}) AS {K.CHECK})"


def _language_cases(spark, d):
    """One case per document language: its kind and its checks."""
    checks = {
        "en": ("canary", [_check("contains", values="array('THE', 'of')")]),
        "fr": ("main", [_check("regex", pattern=r"'\\bla\\b'", weight="2"), _check("judge", threshold="0.7")]),
        "de": ("main", [_check("not_contains", values="array('stupid', ' und ')"), _check("exact", values="array('ja')", threshold="0.0")]),
        "es": ("edge", [_check("contains", values="array('Que')", case_sensitive="true"), _check("refusal")]),
    }
    case = lambda of: "CASE case_id " + " ".join(f"WHEN '{k}' THEN {of(v)}" for k, v in checks.items()) + " END"
    return bed.table(spark, d, "documents").select(F.col("lang").alias("case_id")).distinct().selectExpr(
        "case_id", case(lambda v: f"'{v[0]}'") + " AS kind", "concat('language-', case_id) AS category",
        case(lambda v: f"array({', '.join(v[1])})") + " AS checks")


def _scored(spark, d):
    """Answers to the cases; some are lost and some have a case that nobody knows."""
    docs, labels = bed.table(spark, d, "documents"), bed.table(spark, d, "labels")
    plan = docs.selectExpr("doc_id", "source", "CASE WHEN n_chars % 17 = 0 THEN 'unheard' ELSE lang END AS case_id")
    answers = docs.where("n_chars % 13 > 0").join(labels, "doc_id", "left").selectExpr(
        "doc_id", "text AS response",
        "CASE WHEN quality IS NOT NULL THEN map(1, cast(0.5 + 0.3 * quality as double)) END AS outside_scores")
    return K.check_scores(answers, _language_cases(spark, d), plan)


_SCORED = """WITH docs AS (SELECT d.doc_id, d.source, CASE WHEN d.n_chars % 17 = 0 THEN 'unheard' ELSE d.lang END AS lang,
        CASE WHEN d.n_chars % 13 > 0 THEN trim(d.text, ' ' || chr(9) || chr(10)) END AS t, CASE WHEN d.n_chars % 13 > 0 THEN 0.5 + 0.3 * l.quality END AS outside
        FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id),
    scored AS (
        SELECT doc_id, source, lang, NULL::INTEGER AS check_no, NULL AS case_kind, NULL AS check_kind, NULL::DOUBLE AS score, 1.0 AS threshold, 1.0 AS weight FROM docs WHERE lang = 'unheard'
        UNION ALL
        SELECT doc_id, source, lang, 0 AS check_no, 'canary' AS case_kind, 'contains' AS check_kind, (contains(lower(t), 'the') AND contains(lower(t), 'of'))::DOUBLE AS score, 1.0 AS threshold, 1.0 AS weight FROM docs WHERE lang = 'en'
        UNION ALL SELECT doc_id, source, lang, 0, 'main', 'regex', regexp_matches(t, '(?i)(^|[^\\p{L}\\p{N}_])la($|[^\\p{L}\\p{N}_])')::DOUBLE, 1.0, 2.0 FROM docs WHERE lang = 'fr'
        UNION ALL SELECT doc_id, source, lang, 1, 'main', 'judge', outside, 0.7, 1.0 FROM docs WHERE lang = 'fr'
        UNION ALL SELECT doc_id, source, lang, 0, 'main', 'not_contains', (NOT contains(lower(t), 'stupid') AND NOT contains(lower(t), 'und'))::DOUBLE, 1.0, 1.0 FROM docs WHERE lang = 'de'
        UNION ALL SELECT doc_id, source, lang, 1, 'main', 'exact', (lower(t) = 'ja')::DOUBLE, 0.0, 1.0 FROM docs WHERE lang = 'de'
        UNION ALL SELECT doc_id, source, lang, 0, 'edge', 'contains', contains(t, 'Que')::DOUBLE, 1.0, 1.0 FROM docs WHERE lang = 'es'
        UNION ALL SELECT doc_id, source, lang, 1, 'edge', 'refusal', outside, 0.7, 1.0 FROM docs WHERE lang = 'es'),
    verdicts AS (SELECT *, coalesce(check_kind IN ('judge', 'refusal'), false) AS is_judged,
        CASE WHEN score IS NULL THEN 'ERROR' WHEN score >= threshold THEN 'PASS' ELSE 'FAIL' END AS verdict FROM scored)
    """


@query("k01_text_checks", _SCORED + "SELECT doc_id, check_no, check_kind, score FROM verdicts WHERE NOT is_judged")
def text_checks(spark, d):
    return _scored(spark, d).where("NOT is_judged").select("doc_id", "check_no", "check_kind", "score")


@query("k03_verdicts", _SCORED + "SELECT doc_id, check_no, CAST(threshold AS DOUBLE) AS threshold, verdict FROM verdicts")
def verdicts(spark, d):
    return _scored(spark, d).select("doc_id", "check_no", "threshold", "verdict")


@query("k03_bad_patterns", """SELECT doc_id, check_no, CASE WHEN lang IN ('de', 'es') AND check_no = 0 THEN 'invalid pattern' END AS error,
        CASE WHEN lang IN ('de', 'es') AND check_no = 0 THEN NULL WHEN check_no = 0 THEN 0.0 ELSE contains(lower(text), 'la')::DOUBLE END AS score,
        CASE WHEN lang IN ('de', 'es') AND check_no = 0 THEN 'ERROR' WHEN check_no = 0 OR NOT contains(lower(text), 'la') THEN 'FAIL' ELSE 'PASS' END AS verdict
    FROM documents, (VALUES (0), (1)) AS c(check_no)""")
def bad_patterns(spark, d):
    """Patterns that do not compile make their own checks errors and no others."""
    bad = {"de": _check("regex", pattern="'(abc'"),
           "es": _check("json_schema", properties="map('k', named_struct('type', 'string', 'pattern', '[z-a]'))")}
    first = "CASE case_id " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in bad.items()) + " ELSE " + _check("regex", pattern="'^$'") + " END"
    docs = bed.table(spark, d, "documents").select("doc_id", F.col("lang").alias("case_id"), F.col("text").alias("response"))
    cases = docs.select("case_id").distinct().selectExpr(
        "case_id", "'main' AS kind", "'c' AS category", f"array({first}, {_check('contains', values="array('la')")}) AS checks")
    return K.check_scores(docs, cases).select("doc_id", "check_no", "error", "score", "verdict")


@query("k03_code_blocks", """SELECT doc_id, 1 AS check_no, CASE doc_id % 3 WHEN 0 THEN 'x = ' || doc_id || chr(10) WHEN 1 THEN '' END AS code FROM documents""")
def code_blocks(spark, d):
    docs = bed.table(spark, d, "documents").selectExpr(
        "doc_id", "lang AS case_id", "concat(replace(text, '`', ''), CASE doc_id % 3 WHEN 0 THEN concat('\n```python title\nx = ', doc_id, '\n```\n```python\ny\n```')"
        " WHEN 1 THEN '```python\n```' ELSE '```\ncode\n```' END) AS response")
    cases = docs.select("case_id").distinct().selectExpr("case_id", f"array({_check('regex')}, {_check('code_test')}) AS checks")
    return K.code_work(docs, cases).select("doc_id", "check_no", "code")


@query("k04_case_verdicts", _SCORED + """SELECT doc_id, CASE WHEN NOT bool_or(verdict = 'ERROR') THEN round(sum(score * weight) / sum(weight), 9) END AS score,
    CASE WHEN bool_or(verdict = 'ERROR') THEN 'ERROR' WHEN bool_and(verdict = 'PASS') THEN 'PASS' ELSE 'FAIL' END AS verdict
    FROM verdicts GROUP BY doc_id""")
def case_verdicts(spark, d):
    return K.case_verdicts(_scored(spark, d), ["doc_id"]).select("doc_id", F.round("score", 9).alias("score"), "verdict")


@query("k05_dataset_gate", _SCORED + """, g AS (SELECT source, count(*) FILTER (WHERE case_kind IS NULL) AS n_unknown, count(*) FILTER (WHERE case_kind = 'canary') AS n_canary,
        count(*) FILTER (WHERE case_kind = 'canary' AND verdict = 'PASS') AS n_canary_pass,
        count(*) FILTER (WHERE case_kind <> 'canary' AND NOT is_judged) AS n_checks,
        count(*) FILTER (WHERE case_kind <> 'canary' AND NOT is_judged AND verdict = 'PASS') AS n_pass FROM verdicts GROUP BY source)
    SELECT *, CAST(n_pass AS DOUBLE) / nullif(n_checks, 0) AS pass_rate,
        n_unknown = 0 AND n_canary = n_canary_pass AND coalesce(CAST(n_pass AS DOUBLE) / nullif(n_checks, 0), 1.0) >= 0.5 AS gate_ok FROM g""")
def dataset_gate(spark, d):
    return K.dataset_gate(_scored(spark, d), ["source"], 0.5)


@query("k05_judged_quality", _SCORED + """SELECT source, 'language-' || lang AS category, round(avg(score), 9) AS mean_score, count(score) AS n
    FROM verdicts WHERE is_judged AND case_kind <> 'canary' GROUP BY source, lang""")
def judged_quality(spark, d):
    return K.judged_quality(_scored(spark, d), ["source", "category"]).withColumn("mean_score", F.round("mean_score", 9))


@query("k02_json_schema", """SELECT event_id, event_type, CASE event_type
    WHEN 'click' THEN (json_type(props, '$.k') IN ('UBIGINT', 'BIGINT'))::DOUBLE
    WHEN 'view' THEN (json_type(props, '$.k') = 'VARCHAR')::DOUBLE
    WHEN 'signup' THEN (json_exists(props, '$.plan'))::DOUBLE
    WHEN 'purchase' THEN regexp_matches(json_extract_string(props, '$.k'), '^[0-4]')::DOUBLE
    ELSE (json_array_length(json_keys(props)::JSON) = 0)::DOUBLE END AS score FROM events""")
def json_schema(spark, d):
    prop = lambda kind, pattern="NULL": f"map('k', named_struct('type', {kind}, 'pattern', {pattern}))"
    schemas = {
        "click": _check("json_schema", required="array('k')", properties=prop("'integer'")),
        "view": _check("json_schema", required="array('k')", properties=prop("'string'")),
        "signup": _check("json_schema", required="array('plan')", properties=prop("'integer'")),
        "purchase": _check("json_schema", required="array('k')", properties=prop("'number'", "'^[0-4]'")),
        "error": _check("json_schema"),
    }
    case = "CASE case_id " + " ".join(f"WHEN '{k}' THEN array({v})" for k, v in schemas.items()) + " END AS checks"
    events = bed.table(spark, d, "events")
    cases = events.select(F.col("event_type").alias("case_id")).distinct().selectExpr(
        "case_id", "'main' AS kind", "case_id AS category", case)
    answers = events.selectExpr("event_id", "event_type", "event_type AS case_id", "props AS response")
    return K.check_scores(answers, cases).select("event_id", "event_type", "score")


# --- streams -----------------------------------------------------------------

def _event_results(events):
    """Events as result rows: user as run, type as model, value as score."""
    return events.selectExpr(
        "user_id AS run_id", "event_type AS model", "ts AS created_at",
        "cast(least(cast(floor(value) as int), 50) * 0.1 as decimal(3,1)) AS judge_score",
        "cast(length(props) as int) AS output_tokens")


def _event_stream(spark, d):
    schema = bed.table(spark, d, "events").schema
    return _event_results(spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d))


_TENTHS = "least(CAST(floor(value) AS INTEGER), 50)"


@query("s01_live_metrics", f"""SELECT user_id AS run_id, event_type AS model, count(*) AS n_results, count(*) AS n_judged,
    sum(length(props))::BIGINT AS tokens, CAST(sum({_TENTHS}) AS DOUBLE) / CAST(count(*) * 10 AS DOUBLE) AS mean_score
    FROM events GROUP BY user_id, event_type""")
def live_metrics(spark, d):
    out = scratch_path(spark, "board")
    live.start_board(_event_stream(spark, d), out, scratch_path(spark, "board-state"), once=True).awaitTermination()
    return live.read_board(spark, out)


@query("s01_run_views", "SELECT * FROM mm")
def run_views(spark, d):
    """The results land in three loads, a batch each; every batch touches every run.

    A load is written by as many tasks as the table has, and the stream takes all its files as one batch.
    """
    models, landed, out, state = bed.models(spark, d), scratch_path(spark, "landed"), scratch_path(spark, "views"), scratch_path(spark, "views-state")
    rows = bed.results(spark, d)
    load = F.pmod(F.xxhash64("latency_ms", "input_tokens", "created_at", "case_id", "sample_idx"), F.lit(3))
    for i in range(3):
        rows.where(load == i).write.mode("append").parquet(landed)
        stream = spark.readStream.schema(rows.schema).parquet(landed)
        live.start_run_views(stream, models, out, state, runs_per_folder=50, once=True).awaitTermination()
    return live.read_run_views(spark, out, models, rows)


# A day is closed once the newest event is a day and a half behind its end.
@query("s02_regression_alerts", f"""WITH daily AS (SELECT event_type AS model, CAST(ts AS DATE) AS day, count(*) AS n, sum({_TENTHS}) AS s FROM events
        WHERE CAST(ts AS DATE) + INTERVAL 1 DAY <= (SELECT date_trunc('milliseconds', max(ts)) FROM events) - INTERVAL 36 HOUR GROUP BY 1, 2),
    running AS (SELECT model, day, CAST(sum(s) OVER w AS DOUBLE) / CAST(sum(n) OVER w * 10 AS DOUBLE) AS mean_score FROM daily WINDOW w AS (PARTITION BY model ORDER BY day)),
    states AS (SELECT *, mean_score < 3.1 AS low, coalesce(lag(mean_score < 3.1) OVER (PARTITION BY model ORDER BY day), false) AS was FROM running)
    SELECT model, CAST(day AS VARCHAR) AS day, mean_score, CASE WHEN low THEN 'raised' ELSE 'resolved' END AS event FROM states WHERE low <> was""")
def regression_alerts(spark, d):
    out = scratch_path(spark, "alerts")
    live.start_alerts(_event_stream(spark, d), out, scratch_path(spark, "alerts-state"), threshold=3.1, delay="36 hours", once=True).awaitTermination()
    return live.read_alerts(spark, out).withColumn("day", F.col("day").cast("string"))
