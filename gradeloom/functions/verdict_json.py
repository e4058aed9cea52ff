"""Typed reading of the judge's JSON answers, bare or inside a code fence."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from gradeloom.functions.text import is_blank

# Fixed value: a fenced JSON object, greedy to the last closing brace.
FENCED_OBJECT = r"(?sU)```(?:json)?\s*(\{.*\})\s*```"
NUMBER_TYPES = "^(BIGINT|DECIMAL|DOUBLE|FLOAT)"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, however often it is used."""
    return F.transform(F.array(value), body)[0]


_MARK = "end of the document 7c1f"


def strict_json(text: Column) -> Column:
    """The text as VARIANT; NULL unless all of it is one JSON document.

    The parser stops behind the first value. So the text is read as the first
    element of an array of two, the second a mark: what follows the first value
    moves the mark or spoils the array. A key that occurs twice in one object is
    rejected like any other text that is not JSON.
    """
    both = F.try_parse_json(F.concat(F.lit("["), text, F.lit(f',"{_MARK}"]')))
    member = lambda i, kind: F.try_variant_get(both, f"$[{i}]", kind)
    whole = (member(1, "string") == _MARK) & member(2, "variant").isNull() & ~F.contains(text, F.lit(_MARK))
    return F.when(whole, member(0, "variant"))


def json_document(raw: Column) -> Column:
    """The answer as VARIANT; NULL when it is not JSON."""
    inner = F.nullif(F.regexp_extract(raw, FENCED_OBJECT, 1), F.lit(""))
    return strict_json(F.coalesce(inner, raw))


def type_of(doc: Column, path: str) -> Column:
    """Type name of one member; NULL when it is missing."""
    return F.schema_of_variant(F.try_variant_get(doc, path, "variant"))


def is_object(doc: Column) -> Column:
    return F.coalesce(F.schema_of_variant(doc).startswith("OBJECT"), F.lit(False))


def _members(doc: Column, **paths: str) -> Column:
    """Root type, and type and text of each member."""
    fields = [F.schema_of_variant(doc).alias("root")]
    for name, kind in paths.items():
        fields.append(type_of(doc, f"$.{name}").alias(f"{name}_type"))
        fields.append(F.try_variant_get(doc, f"$.{name}", kind).alias(name))
    return F.struct(*fields)


def _root_reject(m: Column) -> Column:
    return F.when(m["root"].isNull(), "not_json").when(~m["root"].startswith("OBJECT"), "not_object")


def _bad_reasoning(m: Column) -> Column:
    return F.coalesce(m["reasoning_type"] != "STRING", F.lit(True)) | is_blank(m["reasoning"])


def parse_verdict(raw: Column) -> Column:
    """STRUCT(score_text, reasoning, reject): ``reject`` is NULL when valid."""

    def verdict(m: Column) -> Column:
        score = m["score"].try_cast("double")
        reject = (
            _root_reject(m)
            .when(~F.coalesce(m["score_type"].rlike(NUMBER_TYPES), F.lit(False)), "bad_score")
            .when((score > 1) | (score < 0), "score_range")
            .when(_bad_reasoning(m), "bad_reasoning")
        )
        return let(reject, lambda r: F.struct(
            F.when(r.isNull(), m["score"]).alias("score_text"),
            F.when(r.isNull(), m["reasoning"]).alias("reasoning"),
            r.alias("reject"),
        ))

    members = let(json_document(raw), lambda doc: _members(doc, score="string", reasoning="string"))
    return let(members, verdict)


def parse_justification(raw: Column) -> Column:
    """STRUCT(determinant_metrics, tradeoffs, reasoning, reject)."""

    def justification(m: Column) -> Column:
        listed, kind = m["determinant_metrics"], m["determinant_metrics_type"]
        reject = (
            _root_reject(m)
            .when(_bad_reasoning(m), "bad_reasoning")
            .when(kind.isNotNull() & ~kind.isin("ARRAY<STRING>", "ARRAY<VOID>"), "bad_metrics")
            .when(F.exists(listed, lambda x: x.isNull()), "bad_metrics")
            .when(m["tradeoffs_type"] != "STRING", "bad_tradeoffs")
        )
        return let(reject, lambda r: F.struct(
            F.when(r.isNull(), F.coalesce(listed, F.array().cast("array<string>"))).alias("determinant_metrics"),
            F.when(r.isNull(), F.coalesce(m["tradeoffs"], F.lit(""))).alias("tradeoffs"),
            F.when(r.isNull(), m["reasoning"]).alias("reasoning"),
            r.alias("reject"),
        ))

    members = let(json_document(raw), lambda doc: _members(
        doc, reasoning="string", determinant_metrics="array<string>", tradeoffs="string"))
    return let(members, justification)
