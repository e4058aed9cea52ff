"""Spelling variants against all pairs of words."""

import random
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradeloom.llm.queries import QUERIES
from gradeloom.llm.spelling import misspelt, near_words, normalised, scan, variants, vocabulary, word_runs
from plain import SF, frame

LETTER = "[A-Za-zÀ-ÿ]+"


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + 1:] == b[i + 1:] if len(a) == len(b) else a[i:] == b[i + 1:]


def shortened(i, run):
    h = crc32(f"{'' if i is None else i}:{run}".encode())
    return run if h % 31 else run[: h % len(run)] + run[h % len(run) + 1:]


def runs(docs):
    return [(i, re.sub("[A-Z]", lambda m: m[0].lower(), w)) for i, text in docs for w in re.findall(LETTER, text or "")]


def counted(docs):
    out = Counter(shortened(i, w) for i, w in runs(docs))
    return {w: n for w, n in out.items() if len(w) >= 7 and n >= 2}


def plain_near(words):
    """Near words of each word, looked up among all texts one edit away."""
    gone = {}
    for w in words:
        for v in {w, *(w[:i] + w[i + 1:] for i in range(len(w)))}:
            gone.setdefault(v, set()).add(w)
    out = {w: set() for w in words}
    for group in gone.values():
        for a in group:
            out[a] |= {b for b in group if one_edit(a, b)}
    return out


def expected(words, factor=10):
    near, form = plain_near(words), {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= factor * n else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {w: (form[w], root(w), n, len(near[w]), words.get(form[w])) for w, n in words.items()}


def answers(df):
    rows = df.collect()
    out = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(out) == len(rows)
    return out


def test_query_equals_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    got = answers(QUERIES["op13_spelling_variants"](spark, "/root/testdata/sf0.01"))
    want = expected(counted([tuple(d) for d in docs]))
    assert got == want and sum(v[0] is not None for v in want.values()) > 100


def crafted(seed):
    rng = random.Random(seed)
    words = {}
    for _ in range(60):
        w = "".join(rng.choice("abé") for _ in range(rng.choice([1, 2, 3, 7, 8, 9, 12])))
        for _ in range(rng.randrange(1, 12)):
            words[w] = rng.choice([2, 3, 3, 20, 40, 200, 400, 4000])
            i, op = rng.randrange(len(w) + 1), rng.randrange(3)
            w = (w[:i] + rng.choice("abéÿ") + w[i + (op == 0):]) if op < 2 else w[:i] + w[i + 1:]
            w = w or "a"
    return words


@pytest.mark.parametrize("limit", [200_000, 3])
def test_crafted_words_and_divided_lists(spark, limit):
    words = crafted(limit) | {"a" * k: 10**k for k in range(1, 15)} | {"x" * 5000: 4, "x" * 4999 + "y": 40, "x" * 4998: 9}
    vocab = spark.createDataFrame(list(words.items()), "word string, n long").withColumn("near", F.lit(1))
    assert answers(variants(vocab, list_words=limit)) == expected(words)
    near = {r.word: (r.n_near, r.near, r.near_n) for r in near_words(vocab, list_words=limit).collect()}
    want = {w: (len(v), min(v, key=lambda x: (-words[x], x))) for w, v in plain_near(words).items() if v}
    assert near == {w: (k, v, words[v]) for w, (k, v) in want.items()}


def test_scan_in_blocks(monkeypatch):
    monkeypatch.setattr("gradeloom.llm.spelling._AT_ONCE", 7)
    words = sorted(w.encode("latin-1") for w in crafted(9))
    got = [(words[a], words[b]) for i, j in scan(words, np.zeros(len(words), int), np.zeros(len(words), int)) for a, b in zip(i, j)]
    assert len(got) == len(set(got)) and set(got) == {(a, b) for a in words for b in words if one_edit(a, b)}


def test_runs_and_edges(spark):
    texts = [(1, "Abc-Dé×ÿ 12x"), (2, None), (3, ""), (None, "ÀB αβγ é"), (1, "Abc-Dé×ÿ 12x"), (4, "q" * 100_000)]
    docs = frame(spark, texts).withColumn("word", F.lit("no")).withColumn("_run", F.lit("no"))
    got = Counter((r.doc_id, r.word) for r in word_runs(docs).collect())
    assert got == Counter(runs(texts))
    short = {r.word: r.n for r in vocabulary(misspelt(word_runs(docs)), 1, 1).where("length(word) < 9").collect()}
    assert short == {w: n for w, n in Counter(shortened(i, w) for i, w in runs(texts)).items() if 0 < len(w) < 9}
    assert variants(vocabulary(word_runs(docs.limit(0)))).count() == 0
    with pytest.raises(ValueError):
        variants(vocabulary(word_runs(docs)), factor=1)


def test_normalised(spark):
    vocab = spark.createDataFrame([("colour", 900), ("color", 50), ("colr", 4)], "word string, n long")
    rows = spark.createDataFrame([(1, "colr"), (2, "other"), (3, None)], "doc_id long, word string").withColumn("_word", F.lit(0))
    out = normalised(rows, variants(vocab))
    assert out.columns == ["doc_id", "word", "_word", "root"]
    assert {r.doc_id: r.root for r in out.collect()} == {1: "colour", 2: "other", 3: None}


def test_small_table(spark):
    assert QUERIES["op13_spelling_variants"](spark, SF).count() >= 0
