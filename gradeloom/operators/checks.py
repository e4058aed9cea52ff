"""Deterministic checks on responses, case verdicts and the data set gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeloom import schema
from gradeloom.functions.text import first_python_block, strip
from gradeloom.functions.verdict_json import is_object, let, strict_json

# Shape of one check of a case. ``values`` and ``pattern`` serve the text
# checks, ``required`` and ``properties`` the flat JSON schema.
CHECK = (
    "struct<kind:string, `values`:array<string>, pattern:string, required:array<string>, "
    "properties:map<string,struct<type:string,pattern:string>>, "
    "threshold:double, weight:double, case_sensitive:boolean>"
)

# JSON schema type names and the VARIANT type names they admit.
_JSON_TYPES = {
    "string": "^STRING$",
    "integer": "^BIGINT$",
    "number": "^(BIGINT|DECIMAL|DOUBLE|FLOAT)",
    "boolean": "^BOOLEAN$",
    "array": "^ARRAY",
    "object": "^OBJECT",
    "null": "^VOID$",
}


def _text_passed(response: Column, check: Column) -> Column:
    """exact, contains, not_contains and regex after trimming and case folding."""
    as_is = F.coalesce(check["case_sensitive"], F.lit(False))
    fold = lambda t: F.when(as_is, strip(t)).otherwise(F.lower(strip(t)))
    text = fold(response)
    has = lambda v: F.contains(text, fold(v))
    pattern = F.concat(_flags(check), check["pattern"])
    kind = check["kind"]
    return (
        F.when(kind == "exact", text == fold(F.get(check["values"], F.lit(0))))
        .when(kind == "contains", F.forall(check["values"], has))
        .when(kind == "not_contains", ~F.exists(check["values"], has))
        .when(kind == "regex", F.regexp_like(strip(response), pattern))
    )


def _schema_passed(response: Column, check: Column) -> Column:
    """Flat JSON schema: required keys present, no others, types and patterns met."""
    none = F.array().cast("array<string>")
    required = F.coalesce(check["required"], none)
    properties = F.coalesce(check["properties"], F.map_from_arrays(none, F.array().cast(
        "array<struct<type:string,pattern:string>>")))
    named = F.array_union(required, F.map_keys(properties))
    type_pattern = F.create_map(*[F.lit(x) for pair in _JSON_TYPES.items() for x in pair])

    def fits(member: Column, spec: Column) -> Column:
        typed = F.regexp_like(F.schema_of_variant(member), F.element_at(type_pattern, spec["type"]))
        matched = F.regexp_like(member.cast("string"), spec["pattern"])
        return F.coalesce(typed, spec["type"].isNull()) & F.coalesce(matched, spec["pattern"].isNull())

    def conforms(members: Column) -> Column:
        keys = F.map_keys(members)
        present = F.forall(required, lambda k: F.array_contains(keys, k))
        expected = F.forall(keys, lambda k: F.array_contains(named, k))
        typed = F.forall(F.map_entries(properties), lambda r: ~F.array_contains(keys, r["key"])
                         | fits(F.element_at(members, r["key"]), r["value"]))
        return F.coalesce(present & expected & typed, F.lit(False))

    valid = is_object(strict_json(response))
    return valid & let(F.from_json(F.when(valid, response), "map<string,variant>"), conforms)


def _flags(check: Column) -> Column:
    return F.when(F.coalesce(check["case_sensitive"], F.lit(False)), "(?U)").otherwise("(?iU)")


def _with_known_patterns(checks: Column) -> Column:
    """Checks with ``bad``: whether a pattern of theirs does not compile; such patterns are taken out.

    The regular expressions are Java's. ``Pattern.compile`` decides, called on the
    case table, so once per check and not per response.
    """
    broken = lambda p: p.isNotNull() & F.try_reflect(
        F.lit("java.util.regex.Pattern"), F.lit("compile"), p).isNull()

    def marked(c: Column) -> Column:
        own = F.when(c["kind"] == "regex", broken(F.concat(_flags(c), c["pattern"])))
        inner = F.when(c["kind"] == "json_schema", F.exists(F.map_values(c["properties"]), lambda p: broken(p["pattern"])))
        bad = F.coalesce(own, inner, F.lit(False))
        fields = {f: c[f] for f in ("kind", "values", "pattern", "required", "properties", "threshold", "weight", "case_sensitive")}
        fields |= {f: F.when(~bad, c[f]) for f in ("pattern", "properties")}
        return F.struct(*[v.alias(k) for k, v in fields.items()], bad.alias("bad"))

    return F.transform(checks, marked)


def check_scores(responses: DataFrame, cases: DataFrame, plan: DataFrame | None = None) -> DataFrame:
    """One row per response and check: score, threshold, weight and verdict.

    ``cases``: (case_id, kind, category, checks ARRAY<CHECK>). Code tests and
    judged checks are scored elsewhere: their scores come with the response, as
    ``outside_scores`` by check number. A missing response or score is a
    technical ERROR, a low score is a FAIL. ``plan`` lists the calls that were to
    be made: one that left no response is an ERROR of each of its checks. A case
    that is unknown or has no checks is one ERROR row without a check, and a check
    whose pattern does not compile is an ERROR; the others are judged. ``error``
    says why a row is one.
    """
    if plan is not None:
        responses = plan.join(responses, [c for c in plan.columns if c in responses.columns], "left")
    spec = cases.select("case_id", F.col("kind").alias("case_kind"), "category", _with_known_patterns(F.col("checks")).alias("checks"))
    rows = responses.join(spec, "case_id", "left").select("*", F.posexplode_outer("checks").alias("check_no", "c")).drop("checks")
    c, response = F.col("c"), F.col("response")
    text_kinds = ["exact", "contains", "not_contains", "regex"]
    outside = F.lit(None).cast("double")
    if "outside_scores" in responses.columns:
        outside = F.try_element_at(F.col("outside_scores"), F.col("check_no"))
    score = (
        F.when(c["bad"], None)
        .when(c["kind"].isin(text_kinds), _text_passed(response, c).cast("double"))
        .when((c["kind"] == "json_schema") & response.isNotNull(), _schema_passed(response, c).cast("double"))
        .when(response.isNotNull(), outside)
    )
    judged = F.coalesce(c["kind"].isin(schema.JUDGED_CHECKS), F.lit(False))
    threshold = F.coalesce(c["threshold"], F.when(judged, schema.JUDGED_THRESHOLD).otherwise(schema.DETERMINISTIC_THRESHOLD))
    return rows.withColumns({
        "check_kind": c["kind"], "is_judged": judged, "score": score, "threshold": threshold,
        "weight": F.coalesce(c["weight"], F.lit(1.0)),
        "error": F.when(c.isNull(), "no check").when(c["bad"], "invalid pattern").when(response.isNull(), "no response")
        .when(score.isNull(), "no score"),
    }).withColumn("verdict", verdict(F.col("score"), F.col("threshold"))).drop("c")


def code_work(responses: DataFrame, cases: DataFrame) -> DataFrame:
    """One row per response and code test of its case, with the ``code`` to run elsewhere.

    NULL code means that the response has no Python block. The scores come back by
    ``check_no`` as ``outside_scores``.
    """
    spec = cases.select("case_id", F.posexplode("checks").alias("check_no", "c")).where("c.kind = 'code_test'")
    coded = responses.withColumn("code", first_python_block(F.col("response"))).drop("response")
    return coded.join(spec.select("case_id", "check_no"), "case_id")


def verdict(score: Column, threshold: Column) -> Column:
    """PASS at or above the threshold, FAIL below, ERROR without a score."""
    return F.when(score.isNull(), "ERROR").when(score >= threshold, "PASS").otherwise("FAIL")


def case_verdicts(scored: DataFrame, keys: list[str]) -> DataFrame:
    """Weighted mean score per case; PASS only when every check passes."""
    failed = F.max(F.col("verdict") != "PASS")
    error = F.max(F.col("verdict") == "ERROR")
    return scored.groupBy(*keys).agg(
        F.when(~error, F.try_divide(F.sum(F.col("score") * F.col("weight")), F.sum("weight"))).alias("score"),
        F.when(error, "ERROR").when(failed, "FAIL").otherwise("PASS").alias("verdict"),
        F.max("case_kind").alias("case_kind"), F.max("category").alias("category"),
    )


def dataset_gate(scored: DataFrame, keys: list[str], min_pass_rate: float = 0.9) -> DataFrame:
    """Canaries all pass, every case is known and enough deterministic checks pass."""
    canary, det = F.col("case_kind") == "canary", ~F.col("is_judged")
    passed = F.col("verdict") == "PASS"
    g = scored.groupBy(*keys).agg(
        F.count_if(F.col("case_kind").isNull()).alias("n_unknown"), F.count_if(canary).alias("n_canary"), F.count_if(canary & passed).alias("n_canary_pass"),
        F.count_if(det & ~canary).alias("n_checks"), F.count_if(det & ~canary & passed).alias("n_pass"),
    )
    rate = F.try_divide(F.col("n_pass"), F.col("n_checks"))
    return g.withColumn("pass_rate", rate).withColumn(
        "gate_ok", (F.col("n_unknown") == 0) & (F.col("n_canary") == F.col("n_canary_pass")) & (F.coalesce(rate, F.lit(1.0)) >= min_pass_rate)
    )


def judged_quality(scored: DataFrame, keys: list[str]) -> DataFrame:
    """Mean score of the judged checks outside the canaries."""
    return (
        scored.where(F.col("is_judged") & (F.col("case_kind") != "canary"))
        .groupBy(*keys).agg(F.avg("score").alias("mean_score"), F.count("score").alias("n"))
    )
