"""Sharding against a plain computation of the scores."""

import math
import struct
from collections import Counter, defaultdict
from zlib import crc32

import pytest
import xxhash
from pyspark.sql import functions as F

from gradeloom.llm.queries import QUERIES
from gradeloom.llm.sharding import assign_shards, moved, numbered, write_shards
from plain import SF, frame


def place(key, shards):
    """Spark's xxhash64 chains its arguments: each hash is the seed of the next; a null keeps the seed."""
    seed = 42 if key is None else xxhash.xxh64_intdigest(str(key).encode(), 42)
    best = []
    for number, weight in shards.items():
        h = xxhash.xxh64_intdigest(struct.pack("<i", number), seed)
        best.append((-weight / math.log(((h >> 11) + 0.5) / 2**53), -number))
    return -max(best)[1]


def shards(n, weight=1.0):
    return {i: weight for i in range(n)}


def test_query_equals_plain_code(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in QUERIES["op11_sharding"](spark, SF).collect()}
    assert len(got) == len(docs)
    for d in docs:
        raw, r = (d.text or "").encode(), got[d.doc_id]
        assert (r["size"], r.text_crc32, r.law) == (len(raw) + 8, crc32(raw), "key")
        assert (r.shard, r.grown_shard) == (place(d.doc_id, shards(24)), place(d.doc_id, shards(25)))
        assert r.grown_shard in (r.shard, 24)
    slots = defaultdict(list)
    for r in got.values():
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_weights_and_moves(spark):
    docs = spark.range(40_000).withColumnRenamed("id", "doc_id")
    before, after = {1: 1.0, 2: 2.0, 7: 5.0}, {1: 1.0, 2: 2.0, 7: 5.0, 9: 2.0}
    got = assign_shards(docs, before).collect()
    assert all(r.shard == place(r.doc_id, before) for r in got[::37])
    share = Counter(r.shard for r in got)
    assert all(abs(share[s] / 40_000 - w / 8) < 0.01 for s, w in before.items())
    rows = moved(docs, before, after).collect()
    assert {r.shard_after for r in rows} == {9} and abs(len(rows) / 40_000 - 0.2) < 0.01
    fewer = moved(docs, after, before).collect()
    assert {r.shard_before for r in fewer} == {9} and len(fewer) == len(rows)


def test_hot_keys_nulls_and_repeats(spark):
    rows = [(1, "a")] * 9000 + [(None, "b")] * 300 + [(None, None), (2, ""), (3, "x" * 200_000), (3, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", F.length("text").alias("n"), F.lit("z").alias("slots"))
    out = numbered(assign_shards(docs, shards(5))).collect()
    assert Counter((r.doc_id, r.n) for r in out) == Counter((k, None if t is None else len(t)) for k, t in rows)
    seen = defaultdict(list)
    for r in out:
        assert r.shard == place(r.doc_id, shards(5))
        seen[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in seen.values())
    again = numbered(assign_shards(docs.repartition(7), shards(5))).collect()
    assert sorted(map(repr, out)) == sorted(map(repr, again))
    assert numbered(assign_shards(docs.limit(0), shards(5))).count() == 0


def test_written_shards(spark, tmp_path):
    docs = frame(spark, [(i, "t" * (i % 50)) for i in range(500)] + [(None, None), (7, "t" * 7)]).withColumn("_part", F.lit(1))
    write_shards(docs, str(tmp_path / "out"), shards(6), files=2)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert set(back.columns) == {*docs.columns, "shard"} and back.count() == 502
    assert all(r.shard == place(r.doc_id, shards(6)) for r in back.collect())
    files = back.select("shard", F.input_file_name().alias("f")).distinct().groupBy("shard").count()
    assert files.agg(F.max("count")).first()[0] <= 2


def test_refusals(spark):
    docs = frame(spark, [(1, "a")])
    for bad in ({}, {1: 0.0}, {1: -1.0}, {1: float("inf")}):
        with pytest.raises(ValueError):
            assign_shards(docs, bad)
    with pytest.raises(ValueError):
        assign_shards(docs.withColumn("Shard", F.lit(1)), {1: 1.0})
