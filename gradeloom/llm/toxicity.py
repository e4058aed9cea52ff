"""Toxicity by a factorization machine over hashed terms.

The terms of a text are its words and their beginnings of four, five and six
bytes, each present or not. A term's hash is its place in a table of weights and
factors. The score is ``sigmoid(b + sum w_i + sum_{i<j} <v_i, v_j>)`` over the
places present: the second sum learns which terms are worse together, such as an
insult with a group's name, or harmless together.

No term is left out for what it says by itself; only places that few training
rows have stay zero. Instead the fit shrinks weights and factors: each step takes
off what a term without any meaning would gain by chance, so a long text does not
collect the noise of its many terms. A pair of words that are balanced over the
labels each, and tell together, is learned.

What reaches the driver is, per training row, the places of its terms.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradeloom.llm.common import LOWER, blocks, mix64, running_sums, runs_of, span_hashes, text_buffers

#: Bounds of the fit: labelled rows, and terms of one of them. They are the only limits, and hold for the fit alone.
MAX_ROWS, MAX_TERMS = 20_000, 4096
TABLE, MIN_ROWS_WITH_TERM, RANK = 1 << 18, 3, 4
#: Steps of a fit at least: few rows are gone through more often.
MIN_STEPS = 300
_BEGINNINGS = (4, 5, 6)
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


@dataclass
class FactorizationMachine:
    """The bias, and the weight and the factors of every place of the table."""

    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def used(self) -> np.ndarray:
        """The places whose terms count."""
        return (self.weights != 0) | (self.factors != 0).any(axis=1)

    def scores(self, rows: np.ndarray, terms: np.ndarray, n: int) -> np.ndarray:
        """Scores of ``n`` texts; (rows[i], terms[i]) says that a text has a term."""
        raw = self.bias + np.bincount(rows, weights=self.weights[terms], minlength=n) + _pair_sums(rows, self.factors[terms], n)[1]
        return 1 / (1 + np.exp(-np.clip(raw, -30, 30)))


def _pair_sums(rows: np.ndarray, factors: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row, the sum of its terms' factors and that of their products in pairs."""
    total = np.stack([np.bincount(rows, weights=factors[:, k], minlength=n) for k in range(factors.shape[1])], axis=1)
    squares = np.bincount(rows, weights=(factors**2).sum(axis=1), minlength=n)
    return total, 0.5 * ((total**2).sum(axis=1) - squares)


def term_hashes(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The terms of consecutive texts, with repeats, and the texts they are in."""
    data = LOWER[raw[bounds[0] : bounds[-1]]]
    cuts = bounds - bounds[0]
    starts, ends = runs_of(_LETTER[data], cuts)
    owner = np.searchsorted(cuts, starts, side="right") - 1
    sums = running_sums(data)
    hashes, owners = [span_hashes(sums, starts, ends)], [owner]
    for size in _BEGINNINGS:
        longer = ends - starts > size
        s = starts[longer]
        hashes.append(mix64(span_hashes(sums, s, s + size) + np.uint64(size)))
        owners.append(owner[longer])
    return np.concatenate(hashes), np.concatenate(owners)


def places(raw: np.ndarray, bounds: np.ndarray, used: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The places of the texts' terms, those ``used`` only: distinct (text, place) pairs."""
    hashes, owner = term_hashes(raw, bounds)
    at = (hashes & np.uint64(TABLE - 1)).astype(np.int64)
    if used is not None:
        owner, at = owner[used[at]], at[used[at]]
    both = np.unique(owner * TABLE + at)
    return both // TABLE, both % TABLE


def _drawn(at: np.ndarray, most: int) -> np.ndarray:
    """``most`` of a text's places, by a hash that differs from text to text."""
    if len(at) <= most:
        return at
    salt = mix64(at.astype(np.uint64)).sum(dtype=np.uint64)
    return np.sort(at[np.argsort(mix64(at.astype(np.uint64) + salt), kind="stable")[:most]])


def _term_lists(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, bounds = text_buffers(batch.column(0))
        for a, b in blocks(bounds):
            rows, at = places(raw, bounds[a : b + 1])
            lists = [_drawn(x, most) for x in np.split(at, np.searchsorted(rows, np.arange(1, b - a)))]
            ends = np.cumsum([0, *map(len, lists)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(1).slice(a, b - a), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(lists).astype(np.int32)))],
                names=["toxic", "terms"])


def _fit(lists: list[np.ndarray], labels: np.ndarray, epochs: int, shrink: float, seed: int, size: int = 128) -> FactorizationMachine:
    """Minimise the logistic loss by AdaGrad over mini-batches, with shrinkage.

    A term of ``n`` rows that has nothing to do with the label has a gradient of
    about ``sqrt(n p (1 - p))`` over all rows, and its factors as much times the
    sums they meet. Steps of less than ``shrink`` times that leave zero.
    """
    rng = np.random.RandomState(seed)
    with_term = np.zeros(TABLE, dtype=np.int64)
    for x in lists:
        with_term[x] += 1
    lists = [x[with_term[x] >= MIN_ROWS_WITH_TERM] for x in lists]
    rate, steps = float(labels.mean()), -(-len(labels) // size)
    # Shrinkage acts on the batches that have the term, so it is more in each of fewer.
    share = 1 - (1 - 1 / steps) ** np.maximum(with_term, 1)
    chance = shrink * np.sqrt(with_term * rate * (1 - rate)) / len(labels) / share
    bias, w = np.log(rate / (1 - rate)), np.zeros(TABLE)
    v = rng.normal(0, 0.02, size=(TABLE, RANK)) * (with_term >= MIN_ROWS_WITH_TERM)[:, None]
    gb, gw, gv = 1e-6, np.full(TABLE, 1e-6), np.full(TABLE, 1e-6)
    rounds = max(epochs, -(-MIN_STEPS // steps))
    for epoch in range(rounds):
        step = 0.2 / (1 + 0.3 * epoch * epochs / rounds)
        order = rng.permutation(len(labels))
        for start in range(0, len(order), size):
            some = order[start : start + size]
            at, inverse = np.unique(np.concatenate([lists[i] for i in some]), return_inverse=True)
            row = np.repeat(np.arange(len(some)), [len(lists[i]) for i in some])
            total, pairs = _pair_sums(row, v[at][inverse], len(some))
            raw = bias + np.bincount(row, weights=w[at][inverse], minlength=len(some)) + pairs
            error = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - labels[some]) / len(some)
            bias -= step * (g := error.sum()) / np.sqrt(gb := gb + g * g)
            g = np.bincount(inverse, weights=error[row], minlength=len(at))
            gw[at] += g * g
            pace = step / np.sqrt(gw[at])
            moved = w[at] - pace * g
            w[at] = np.sign(moved) * np.maximum(np.abs(moved) - pace * chance[at], 0)
            pull = error[:, None] * total
            gradient = np.stack([np.bincount(inverse, weights=pull[row, k], minlength=len(at)) for k in range(RANK)], axis=1) - g[:, None] * v[at]
            gv[at] += (gradient**2).mean(axis=1)
            pace = 0.2 * step / np.sqrt(gv[at])
            moved = v[at] - pace[:, None] * gradient
            noise = pace * chance[at] * np.sqrt((total**2).sum(axis=1).mean())
            v[at] = moved * np.maximum(1 - noise / (np.sqrt((moved**2).sum(axis=1)) + 1e-12), 0)[:, None]
    return FactorizationMachine(float(bias), w.astype(np.float32), v.astype(np.float32))


def _constant(n: int, positive: int) -> FactorizationMachine:
    """The machine for rows of one label: about its share, half without rows."""
    bias = float(np.log((positive + 0.5) / (n - positive + 0.5))) if n else 0.0
    return FactorizationMachine(bias, np.zeros(TABLE, np.float32), np.zeros((TABLE, RANK), np.float32))


def train(docs: DataFrame, labels: DataFrame, epochs: int = 10, max_rows: int = MAX_ROWS, max_terms: int = MAX_TERMS,
          shrink: float = 2.0, seed: int = 3) -> FactorizationMachine:
    """A machine fitted on the ``text`` of ``docs`` and the ``toxic`` (0 or 1) of ``labels``, by ``doc_id``.

    Null labels are left out; of several for one document the largest counts; a
    null text is an empty one. At most ``max_rows`` documents take part, those
    with the smallest hash of their id; only their ids and labels, of which there
    are no more than that, are broadcast. Of a text with more than ``max_terms``
    different terms, so many at random teach. With no rows at all, or labels of
    one kind, the machine is its bias: half, or about the share of label 1.
    """
    keys = (labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
            .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows))
    rows = docs.select("doc_id", "text").join(F.broadcast(keys), "doc_id").select(F.col("text").cast("string").alias("text"), "toxic")
    totals = keys.agg(F.count("*").alias("n"), F.sum("toxic").alias("toxic")).first()
    n, positive = int(totals["n"]), int(totals["toxic"] or 0)
    if positive in (0, n):
        return _constant(n, positive)
    found = rows.mapInArrow(partial(_term_lists, most=max_terms), "toxic int, terms array<int>").toArrow()
    lists, toxic = [], []
    for batch in found.to_batches():
        ends, at = batch["terms"].offsets.to_numpy(), batch["terms"].values.to_numpy()
        lists += [at[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
        toxic += batch["toxic"].to_pylist()
    # The order in which partitions arrive must not matter to the fit.
    order = sorted(range(len(lists)), key=lambda i: (toxic[i], hashlib.sha256(lists[i].tobytes()).digest()))
    marks = np.array([toxic[i] for i in order], dtype=float)
    if not 0 < marks.sum() < len(marks):
        return _constant(len(marks), int(marks.sum()))
    return _fit([lists[i] for i in order], marks, epochs, shrink, seed)


def _score(batches: Iterator[pa.RecordBatch], model: FactorizationMachine) -> Iterator[pa.RecordBatch]:
    used = model.used()
    for batch in batches:
        raw, bounds = text_buffers(batch.column(batch.num_columns - 1))
        scores = [np.zeros(0)]
        for a, b in blocks(bounds):
            scores.append(model.scores(*places(raw, bounds[a : b + 1], used), b - a))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(scores))], names=[*batch.schema.names, "score"])


def _with_score(rows: DataFrame) -> T.StructType:
    return T.StructType([*rows.schema.fields, T.StructField("score", T.DoubleType())])


def score_ids(docs: DataFrame, model: FactorizationMachine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``score`` (0 to 1) of every row, by the whole text.

    A null text scores as an empty one. Repeated rows are scored each; an empty
    table gives an empty one. Other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(partial(_score, model=model), _with_score(rows)).select("doc_id", "score")


def drop_toxic(docs: DataFrame, model: FactorizationMachine, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, all columns unchanged."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    rows = docs.toDF(*names)
    rows = rows.withColumn("text", F.col(names[docs.columns.index(text_col)]).cast("string"))
    scored = rows.mapInArrow(partial(_score, model=model), _with_score(rows))
    return scored.where(F.col("score") < threshold).select(*names).toDF(*docs.columns)
