"""Text columns: markdown counts, triage labels, previews, content hashes."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradeloom.schema import FAILURE_KEYWORDS, NOT_JUDGED, OTHER_FAILURE

# Markdown patterns. The flags give '\n'-only line ends and
# Unicode classes.
CODE_BLOCK = r"(?s)```[^`]*```"
HEADER = r"(?mdU)^#{1,6}\s"
BOLD = r"\*\*[^*\n]+\*\*|__[^_\n]+__"
ORDERED = r"(?mdU)^\s*\d+\.\s"
UNORDERED = r"(?mdU)^\s*[-*+]\s"


def style_counts(response: Column) -> dict[str, Column]:
    """Markdown counts; fenced code is counted, then left out of the rest."""
    text = F.coalesce(response, F.lit(""))
    prose = F.regexp_replace(text, CODE_BLOCK, "")
    patterns = {"headers": HEADER, "bold": BOLD, "ordered": ORDERED, "unordered": UNORDERED}
    counts = {name: F.regexp_count(prose, F.lit(p)) for name, p in patterns.items()}
    counts["code_blocks"] = F.regexp_count(text, F.lit(CODE_BLOCK))
    return counts


# Fixed value: a fenced block that is marked as Python.
PYTHON_BLOCK = r"(?s)```python[^\n]*\n(.*?)```"


def first_python_block(response: Column) -> Column:
    """The code of the first fenced Python block; NULL without one."""
    return F.when(F.regexp_like(response, F.lit(PYTHON_BLOCK)), F.regexp_extract(response, PYTHON_BLOCK, 1))


def failure_type(score: Column, reasoning_lower: Column) -> Column:
    """Triage label from the judge's lower-cased wording; the first match wins.

    Lower-case the text in a step of its own: the keywords then share it.
    """
    label = F.when(score.isNull(), NOT_JUDGED)
    for name, keywords in FAILURE_KEYWORDS:
        hit = F.lit(False)
        for word in keywords:
            hit = hit | F.contains(reasoning_lower, F.lit(word))
        label = label.when(hit, name)
    return label.otherwise(OTHER_FAILURE)


def preview(text: Column, width: int = 55) -> Column:
    """One-line preview: line breaks collapsed, cut to ``width`` characters."""
    return F.left(F.regexp_replace(text, r"[\n\r]+", " "), F.lit(width))


# Fixed value: the characters Python's str.strip() removes.
BLANKS = (" \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
          "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")


def strip(text: Column) -> Column:
    """Without white space at both ends."""
    return F.btrim(text, F.lit(BLANKS))


def is_blank(text: Column) -> Column:
    """NULL, empty or white space only."""
    return text.isNull() | text.rlike(r"(?U)\A[\s\x1c-\x1f]*\z")


@F.pandas_udf(T.StringType())
def _nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


# Keeps the optimizer from copying the call into pushed-down filters.
_nfc = _nfc.asNondeterministic()


def normalize_content(content: Column) -> Column:
    """NFC, LF line ends, no trailing blanks per line, trimmed as a whole.

    Spark has no built-in for NFC. Plain ASCII is already in that form, so only
    the other texts travel to Python.
    """
    foreign = F.when(content.rlike(r"[^\x00-\x7F]"), content)
    text = F.coalesce(_nfc(foreign), content)
    text = F.regexp_replace(text, r"\r\n?", "\n")
    space = r"[\s\x1c-\x1f&&[^\n]]"
    return strip(F.regexp_replace(text, rf"(?U)(?<!{space}){space}++(?=\n|\z)", ""))


def content_hash(content: Column) -> Column:
    """SHA-256 of the normalised content."""
    return F.sha2(normalize_content(content), 256)
