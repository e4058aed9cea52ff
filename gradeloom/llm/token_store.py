"""Token ids in directly addressable codes.

A shard holds whole documents in ascending order of their ids. Every token id is
cut into chunks of eight bits, lowest first. Level 0 has the first chunk of every
token, level 1 the second chunk of the tokens that have one, and so on; a bitmap
per level says which tokens go on, and a directory of running counts per
``_SPAN`` bits gives the place on the next level in constant time. Any token is
read from its position alone, with no block to decode.

Shard layout, little-endian: magic ``TOKDAC1\\0``, uint64 tokens, uint32 documents,
uint32 levels; int64 ids and uint64 end positions of the documents; per level:
uint64 chunks, the chunks, the bitmap in whole bytes (bit i is bit i % 8 of byte
i / 8) and its directory (uint32 counts before each span). Shards are rows of a
Parquet table, so Spark's writers commit them to any store.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gradeloom.llm.common import blocks, partitions, ranges, text_buffers
from gradeloom.llm.tokens import WORD_BPE, encode_texts

_MAGIC, _HEAD, _SPAN = b"TOKDAC1\0", "<8sQII", 512
_ONES = np.array([bin(i).count("1") for i in range(256)], dtype=np.uint8)
#: A shard is closed by the first document that brings it to so many tokens.
SHARD_TOKENS = 1 << 20


def write_shard(doc_ids: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> bytes:
    """The bytes of one shard: documents' ids and token counts, tokens end to end."""
    levels, rest = [], ids.astype(np.uint32)
    while not levels or len(rest):
        higher = rest >> np.uint32(8)
        more = higher > 0
        bitmap = np.packbits(more, bitorder="little")
        spans = np.add.reduceat(more, np.arange(0, len(more), _SPAN), dtype=np.int64) if len(more) else np.zeros(0, dtype=np.int64)
        directory = (np.cumsum(spans) - spans).astype("<u4")
        levels.append(struct.pack("<Q", len(rest)) + (rest & np.uint32(0xFF)).astype(np.uint8).tobytes() + bitmap.tobytes() + directory.tobytes())
        rest = higher[more]
    head = struct.pack(_HEAD, _MAGIC, len(ids), len(counts), len(levels))
    return head + doc_ids.astype("<i8").tobytes() + np.cumsum(counts).astype("<u8").tobytes() + b"".join(levels)


@dataclass
class Shard:
    """A shard opened for reading; views into the bytes, nothing is decoded."""

    doc_ids: np.ndarray
    ends: np.ndarray
    chunks: list[np.ndarray]
    bitmaps: list[np.ndarray]
    directories: list[np.ndarray]

    @classmethod
    def open(cls, data: bytes) -> "Shard":
        magic, _, docs, n_levels = struct.unpack_from(_HEAD, data)
        if magic != _MAGIC:
            raise ValueError("not a token shard")
        at = struct.calcsize(_HEAD)
        out = []
        for kind in ("<i8", "<u8"):
            out.append(np.frombuffer(data, dtype=kind, count=docs, offset=at))
            at += 8 * docs
        levels = [[], [], []]
        for _ in range(n_levels):
            n = struct.unpack_from("<Q", data, at)[0]
            at += 8
            for part, (kind, count) in enumerate((("u1", n), ("u1", -(-n // 8)), ("<u4", -(-n // _SPAN)))):
                levels[part].append(np.frombuffer(data, dtype=kind, count=count, offset=at))
                at += levels[part][-1].nbytes
        return cls(*out, *levels)

    def token(self, position: int) -> int:
        """The token at a position, by one look-up per level."""
        value, shift = 0, 0
        for level, (chunks, bitmap, directory) in enumerate(zip(self.chunks, self.bitmaps, self.directories)):
            value |= int(chunks[position]) << shift
            byte = position // 8
            if not bitmap[byte] >> (position % 8) & 1:
                break
            span = position // _SPAN
            before = int(_ONES[bitmap[span * _SPAN // 8 : byte]].sum()) + int(_ONES[int(bitmap[byte]) & ((1 << position % 8) - 1)])
            position, shift = int(directory[span]) + before, shift + 8
        return value

    def tokens(self, start: int, stop: int) -> np.ndarray:
        """The tokens of a range; each level contributes one contiguous range."""
        value = np.zeros(stop - start, dtype=np.uint32)
        at = np.arange(stop - start)
        for level, (chunks, bitmap, directory) in enumerate(zip(self.chunks, self.bitmaps, self.directories)):
            if not len(at):
                break
            value[at] |= chunks[start:stop].astype(np.uint32) << np.uint32(8 * level)
            more = np.unpackbits(bitmap[start // 8 : -(-stop // 8)], bitorder="little")[start % 8 :][: stop - start].astype(bool)
            at = at[more]
            span = start // _SPAN
            if len(at):
                bits = np.unpackbits(bitmap[span * _SPAN // 8 : -(-start // 8)], bitorder="little")[: start - span * _SPAN]
                start = int(directory[span]) + int(bits.sum())
                stop = start + len(at)
        return value


def _write(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    part, number = TaskContext.get().partitionId(), 0
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def shard() -> pa.RecordBatch:
        nonlocal number
        ids, counts, tokens = (np.concatenate(x) for x in zip(*held))
        held.clear()
        number += 1
        return pa.RecordBatch.from_arrays(
            [pa.array([part]), pa.array([number - 1]), pa.array([len(tokens)]), pa.array([write_shard(ids, counts, tokens)], pa.binary())],
            names=["part", "shard", "n_tokens", "data"])

    for batch in batches:
        raw, bounds = text_buffers(batch.column(1))
        doc_ids = batch.column(0).to_numpy(zero_copy_only=False)
        for a, b in blocks(bounds):
            tokens, counts = encode_texts(raw, bounds[a : b + 1], path)
            held.append((doc_ids[a:b], counts, tokens))
            if sum(len(x[2]) for x in held) >= SHARD_TOKENS:
                yield shard()
    if held:
        yield shard()


def write_tokens(docs: DataFrame, folder: str, path: str = WORD_BPE, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the tokens of all documents, each with its end id, as shards into ``folder``.

    Documents are in ascending order of id, equal ids in the order of their
    texts' hashes; range partitions, shards in them and documents in shards keep
    that order. A null text is empty and has the end id alone. A row without an
    id is an error, as the order needs one. An empty table gives no shard.
    """
    order = [F.col("doc_id"), F.xxhash64("text")]
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.raise_error(F.lit("a document has no id")).cast("long")).alias("doc_id"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.repartitionByRange(partitions(docs.sparkSession), *order).sortWithinPartitions(*order)
    shards = rows.mapInArrow(partial(_write, path=path), "part long, shard long, n_tokens long, data binary")
    shards.write.option("compression", "none").option("parquet.block.size", 32 << 20).parquet(folder)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, number, data in zip(*(batch.column(i).to_pylist() for i in range(3))):
            shard = Shard.open(data)
            ends = shard.ends.astype(np.int64)
            starts = np.concatenate(([0], ends[:-1]))
            tokens = shard.tokens(0, int(ends[-1])).astype("<u4").tobytes()
            crc = [zlib.crc32(tokens[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist())]
            n = len(ends)
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * n, pa.int64()), pa.array([number] * n, pa.int64()), pa.array(shard.doc_ids.astype(np.int64)), pa.array(starts),
                 pa.array(ends - starts), pa.array(crc, pa.int64())],
                names=["part", "shard", "doc_id", "at", "n_tokens", "ids_crc32"])


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id``, ``start`` (tokens before it), ``n_tokens``, ``ids_crc32`` of every stored document."""
    shards = spark.read.schema("part long, shard long, n_tokens long, data binary").parquet(folder)
    sizes = shards.select("part", "shard", "n_tokens")
    of_part = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    # One row per partition of the writing job.
    parts = of_part.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before_part"))
    places = (sizes.withColumn("before", F.sum("n_tokens").over(Window.partitionBy("part").orderBy("shard")) - F.col("n_tokens"))
              .join(parts, "part").select("part", "shard", (F.col("before") + F.col("before_part")).alias("base")))
    docs = shards.select("part", "shard", "data").mapInArrow(_read, "part long, shard long, doc_id long, at long, n_tokens long, ids_crc32 long")
    return docs.join(places, ["part", "shard"]).select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
