"""The pipeline stage by stage, and the registered queries."""

import zlib

import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from gradeloom.llm.common import stored
from gradeloom.llm.tokens import WORD_BPE
from plain import groups, repeated, shingles, words

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}

    clean = stored(stages["toxicity"](spark, docs, SF), "t")
    left = {r.doc_id for r in clean.collect()}
    assert clean.columns == columns and all(i in left for i, t in labels.items() if t == 0)
    assert sum(i in left for i, t in labels.items() if t == 1) <= 0.5 * sum(labels.values())

    single = stored(stages["exact_dedup"](spark, clean, SF), "t")
    first = {}
    for r in clean.orderBy("doc_id").collect():
        first.setdefault(" ".join([(r.text or "").translate({c: c + 32 for c in range(65, 91)})]), r.doc_id)
    assert single.columns == columns and {r.doc_id for r in single.collect()} == set(first.values())

    apart = stored(stages["minhash_dedup"](spark, single, SF), "t")
    root = groups({r.doc_id: shingles(r.text, 5) for r in single.collect()}, 80)
    assert apart.columns == columns and {r.doc_id for r in apart.collect()} == {i for i, x in root.items() if i == x}

    cut = stored(stages["substring_dedup"](spark, apart, SF), "t")
    before = {r.doc_id: r.text for r in apart.collect()}
    after = {r.doc_id: r for r in cut.collect()}
    assert cut.columns == columns
    starts = repeated(list(before.items()))
    assert not any(repeated([(i, r.text) for i, r in after.items()]).values())
    for i, text in before.items():
        if not starts[i] and i in after and after[i].text != text:
            assert len(words(after[i].text)) < len(words(text))  # a near copy went
        if i in after and after[i].text != text:
            assert after[i].n_chars == len(after[i].text)

    packed = stages["packing"](spark, cut, SF).collect()
    tokenizer = Tokenizer.from_file(WORD_BPE)
    pieces = {}
    for p in packed:
        pieces.setdefault(p.doc_id, []).append(p)
    assert set(pieces) == set(after)
    for i, own in pieces.items():
        ids = np.array(tokenizer.encode(after[i].text or "", add_special_tokens=False).ids + [2], dtype="<u4")
        assert sum(p.length for p in own) == len(ids)
        assert all(zlib.crc32(ids[p.start : p.start + p.length].tobytes()) == p.ids_crc32 for p in own)


def test_stages_on_odd_tables(spark):
    odd = spark.createDataFrame([(1, None, None, None, None), (2, "", None, None, 0), (3, "a b", "en", "s", 3), (3, "a b", "en", "s", 3), (4, "x " * 30_000, "en", "s", 60_000)],
                                "doc_id long, text string, lang string, source string, n_chars long")
    for docs in (odd, odd.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stored(stage(spark, docs, SF), "t")
            assert out.columns == odd.columns, name
            docs = out
        corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()


def test_queries_are_registered(spark):
    names = set(__spark_entry__.queries())
    assert {int(n[2:].split("_")[0]) for n in names if n.startswith("op")} == set(range(1, 14)) and "pipeline" in names


def test_queries_cover_every_row(spark):
    queries = __spark_entry__.queries()
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    for name in ("op1_language_id", "op3_toxicity"):
        assert queries[name](spark, SF).select(F.countDistinct("doc_id")).first()[0] == n
