"""Language identification in two steps: the family, then the language within it.

A text is its relative frequencies of one to three byte n-grams, hashed to
``DIM`` places, square-rooted. The family is the one with the largest margin of
one-versus-rest linear support vector machines; within the family, every pair of
languages has a machine of its own and the language with most votes wins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeloom.llm.common import LOWER, blocks, text_buffers

DIM = 4096
#: Bounds of the fit: rows, and rows per language. They hold for the fit alone; every language takes part.
MAX_ROWS, ROWS_PER_LANGUAGE = 64_000, 1000
UNKNOWN = "und"

#: Families of languages by ISO 639-1 code. A language that is not listed is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af lb fy",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk sl hr sr bs mk bg",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz ky tt",
    "indic": "hi bn ur mr ne gu pa",
    "semitic": "ar he mt am",
}
_FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}

# Bytes that are no letter of any script become one blank.
_LETTERS = np.full(256, 32, dtype=np.uint8)
_LETTERS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = LOWER[[*range(65, 91), *range(97, 123), *range(128, 256)]]


@dataclass
class LanguageModel:
    """Machines of the families and of the pairs within them; rows are weights and a bias."""

    families: list[str] = field(default_factory=list)
    languages: dict[str, list[str]] = field(default_factory=dict)
    family_machines: np.ndarray = field(default_factory=lambda: np.zeros((0, DIM + 1)))
    pair_machines: dict[str, np.ndarray] = field(default_factory=dict)

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Languages and scores of the feature rows ``x``."""
        if not self.families:
            return [UNKNOWN] * len(x), np.zeros(len(x))
        margins = x @ self.family_machines[:, :-1].T + self.family_machines[:, -1]
        best = margins.argmax(1)
        score = _share(margins, best)
        out = np.empty(len(x), dtype=object)
        for f, family in enumerate(self.families):
            at = np.flatnonzero(best == f)
            codes = self.languages[family]
            if not len(at):
                continue
            if len(codes) == 1:
                out[at] = codes[0]
                continue
            w = self.pair_machines[family]
            m = x[at] @ w[:, :-1].T + w[:, -1]
            votes, sums = np.zeros((len(at), len(codes))), np.zeros((len(at), len(codes)))
            for k, (i, j) in enumerate(combinations(range(len(codes)), 2)):
                votes[:, i] += m[:, k] > 0
                votes[:, j] += m[:, k] <= 0
                squashed = np.tanh(m[:, k])
                sums[:, i] += squashed
                sums[:, j] -= squashed
            won = (votes + sums / (4 * len(codes))).argmax(1)
            out[at] = np.array(codes, dtype=object)[won]
            score[at] *= _share(sums, won)
        return list(out), score


def _share(margins: np.ndarray, best: np.ndarray) -> np.ndarray:
    """The softmax of the chosen margin, as a confidence."""
    e = np.exp(2 * (margins - margins.max(1, keepdims=True)))
    return e[np.arange(len(e)), best] / e.sum(1)


def features(raw: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Square roots of the hashed n-gram frequencies, a row per text."""
    data = _LETTERS[raw[bounds[0] : bounds[-1]]].astype(np.uint32)
    cuts = bounds - bounds[0]
    n, rows = len(data), len(cuts) - 1
    counts = np.zeros(rows * DIM)
    if n:
        owner = np.repeat(np.arange(rows), np.diff(cuts)).astype(np.int64)
        blank = data == 32
        code = data.copy()
        for size in (1, 2, 3):
            if size > 1:
                if n < size:
                    break
                code = code[:-1] * np.uint32(0x01000193) + data[size - 1 :]
            # An n-gram stays in one text and does not begin with two blanks.
            ok = owner[: n - size + 1] == owner[size - 1 :]
            if size > 1:
                ok &= ~(blank[: n - size + 1] & blank[1 : n - size + 2])
            at = ((code * np.uint32(0x9E3779B1)) >> np.uint32(20)).astype(np.int64)
            counts += np.bincount(owner[: n - size + 1][ok] * DIM + at[ok], minlength=rows * DIM)
    counts = counts.reshape(rows, DIM)
    return np.sqrt(counts / np.maximum(counts.sum(1, keepdims=True), 1)).astype(np.float32)


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, bounds = text_buffers(batch.column(0))
        for a, b in blocks(bounds, rows=512):
            x = features(raw, bounds[a : b + 1]).astype(np.float16)
            yield pa.RecordBatch.from_arrays([batch.column(1).slice(a, b - a), pa.array([row.tobytes() for row in x], pa.binary())], names=["lang", "x"])


def _machine(x: np.ndarray, positive: np.ndarray, ridge: float = 1e-4, rounds: int = 150) -> np.ndarray:
    """Linear machine: squared hinge loss, classes weighed alike, accelerated descent."""
    y = np.where(positive, 1.0, -1.0)
    weight = np.where(positive, 0.5 / max(positive.sum(), 1), 0.5 / max((~positive).sum(), 1))
    x = np.hstack([x, np.ones((len(x), 1), dtype=x.dtype)])
    step = 1 / (2 * 2.0 + ridge)
    w = old = np.zeros(x.shape[1], dtype=np.float32)
    for t in range(rounds):
        z = w + (t / (t + 3)) * (w - old)
        slack = np.maximum(0, 1 - y * (x @ z))
        old, w = w, (z - step * (-2 * ((weight * slack * y).astype(np.float32) @ x) + ridge * z)).astype(np.float32)
    return w


def train(rows: DataFrame, per_language: int = ROWS_PER_LANGUAGE, max_rows: int = MAX_ROWS) -> LanguageModel:
    """A model fitted on ``doc_id``, ``text``, ``lang`` rows.

    Rows without a text or a language are left out. About ``per_language`` rows
    of every language take part, drawn by a hash of the id; fewer, but one at
    least, where the languages are so many that it would be over ``max_rows``. Without rows, the model answers ``und``; with one language,
    always that.
    """
    rows = rows.where("text IS NOT NULL AND lang IS NOT NULL AND trim(text) <> ''").select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) / 1_000_003
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n"), F.min(draw).alias("least")).collect()
    if not sizes:
        return LanguageModel()
    per_language = min(per_language, max(1, max_rows // len(sizes)))
    shares = rows.sparkSession.createDataFrame([(r["lang"], per_language / r["n"], r["least"]) for r in sizes], "lang string, share double, least double")
    drawn = rows.join(F.broadcast(shares), "lang").where((draw < F.col("share")) | (draw <= F.col("least")))
    found = drawn.select("text", "lang").mapInArrow(_feature_rows, "lang string, x binary").toArrow()
    pairs = sorted(zip(found["lang"].to_pylist(), found["x"].to_pylist()))
    langs = np.array([p[0] for p in pairs], dtype=object)
    x = np.frombuffer(b"".join(p[1] for p in pairs), dtype=np.float16).reshape(-1, DIM).astype(np.float32)
    model = LanguageModel()
    for code in sorted(set(langs)):
        model.languages.setdefault(_FAMILY_OF.get(code.lower(), code), []).append(code)
    model.families = sorted(model.languages)
    family = np.array([_FAMILY_OF.get(c.lower(), c) for c in langs], dtype=object)
    model.family_machines = np.array([_machine(x, family == f) if len(model.families) > 1 else np.zeros(DIM + 1) for f in model.families], dtype=np.float32)
    for f, codes in model.languages.items():
        if len(codes) > 1:
            machines = []
            for a, b in combinations(codes, 2):
                at = (langs == a) | (langs == b)
                machines.append(_machine(x[at], langs[at] == a))
            model.pair_machines[f] = np.array(machines)
    return model


def _predict(batches: Iterator[pa.RecordBatch], model: LanguageModel) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, bounds = text_buffers(batch.column(1))
        for a, b in blocks(bounds, rows=512):
            lang, score = model.predict(features(raw, bounds[a : b + 1]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array(lang, pa.string()), pa.array(score.astype(np.float64))],
                names=["doc_id", "has_letter", "lang", "score"])


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``lang_pred``, ``score`` (0 to 1) of every row, by the whole text.

    A null text or one without a letter is ``und`` with score 0. Repeated rows
    are answered each; an empty table gives an empty one. No other column is read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.withColumn("has_letter", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    schema = rows.select("doc_id", "has_letter").schema.add("lang", "string").add("score", "double")
    out = rows.mapInArrow(partial(_predict, model=model), schema)
    return out.select("doc_id", F.when(F.col("has_letter"), F.col("lang")).otherwise(UNKNOWN).alias("lang_pred"),
                      F.when(F.col("has_letter"), F.col("score")).otherwise(0.0).alias("score"))
