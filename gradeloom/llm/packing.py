"""Packing documents into sequences by bounded-space online packing.

Every partition keeps at most ``WINDOWS`` open sequences. A document's tokens
beyond whole sequences go where they fit best. When they fit nowhere and no
sequence may be opened any more, the fullest one is filled up with the head of
the document and emitted; the rest is placed in the same way. Sequences that
are open at the end of a partition are packed together with those of other
partitions, in groups of ``FAN_IN`` at a time, until one group is left. What is
open then is filled in a row, and the last remainder is cut to powers of two,
which take no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeloom.llm.common import blocks, stored, text_buffers
from gradeloom.llm.tokens import WORD_BPE, encode_texts

LENGTH, WINDOWS, FAN_IN = 4096, 32, 32
#: A gap of fewer tokens is left empty rather than cutting a document for it.
LEAST_CUT = 8
_SCHEMA = ("doc_id {id}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, `offset` long, "
           "source long, open boolean, ids binary")
_NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source", "open", "ids"]


class Packer:
    """Open sequences of one partition. A piece is (doc_id, start, ids, tokens of its document)."""

    def __init__(self, first_id: int, length: int = LENGTH, windows: int = WINDOWS):
        self.length, self.windows, self._next = length, windows, first_id
        self.open: list[tuple[int, list]] = []  # tokens, pieces
        self.full: list[tuple[int, list]] = []  # sequence id, pieces

    def _emit(self, pieces: list) -> None:
        self.full.append((self._next, pieces))
        self._next += 1

    def add(self, doc_id, start: int, ids: np.ndarray, total: int) -> None:
        while len(ids) >= self.length:
            self._emit([(doc_id, start, ids[: self.length], total)])
            start, ids = start + self.length, ids[self.length :]
        while len(ids):
            best, most = -1, -1
            for i, (used, _) in enumerate(self.open):
                if used > most and used + len(ids) <= self.length:
                    best, most = i, used
            if best < 0 and len(self.open) < self.windows:
                self.open.append((len(ids), [(doc_id, start, ids, total)]))
                return
            if best >= 0:
                used, pieces = self.open[best]
                pieces.append((doc_id, start, ids, total))
                self.open[best] = (used + len(ids), pieces)
                if used + len(ids) == self.length:
                    self._emit(self.open.pop(best)[1])
                return
            fullest = max(range(len(self.open)), key=lambda i: self.open[i][0])
            used, pieces = self.open.pop(fullest)
            gap = self.length - used
            if gap >= LEAST_CUT:
                pieces.append((doc_id, start, ids[:gap], total))
                start, ids = start + gap, ids[gap:]
            self._emit(pieces)

    def finish(self) -> None:
        """Fill the open sequences in a row; cut the last remainder to powers of two."""
        pieces = [p for _, own in sorted(self.open, key=lambda x: -x[0]) for p in own]
        self.open = []
        room, held = 0, []
        left = sum(len(p[2]) for p in pieces)
        for doc_id, start, ids, total in pieces:
            while len(ids):
                if not room:
                    room = min(self.length, 1 << (left.bit_length() - 1))
                n = min(room, len(ids))
                held.append((doc_id, start, ids[:n], total))
                start, ids, room, left = start + n, ids[n:], room - n, left - n
                if not room:
                    self._emit(held)
                    held = []

    def take(self, source: int, last: bool, with_ids: bool, id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
        """Rows of the emitted sequences and, at the end, of the open ones."""
        groups = [(s, p, False) for s, p in self.full]
        self.full = []
        if last:
            groups += [(self._next + i, p, True) for i, (_, p) in enumerate(self.open)]
        rows = []
        for sequence, pieces, is_open in groups:
            offset = 0
            for doc_id, start, ids, total in pieces:
                data = ids.astype("<u4").tobytes()
                rows.append((doc_id, start, len(ids), zlib.crc32(data), total, sequence, offset, source, is_open, data if is_open or with_ids else None))
                offset += len(ids)
        for i in range(0, len(rows), 4096):
            columns = list(zip(*rows[i : i + 4096]))
            kinds = [id_type, *[pa.int64()] * 7, pa.bool_(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=_NAMES)


def _pack_texts(batches: Iterator[pa.RecordBatch], path: str, length: int, windows: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    source = TaskContext.get().partitionId()
    packer, kind = Packer(source << 32, length, windows), pa.int64()
    for batch in batches:
        kind = batch.column(0).type
        doc_ids = batch.column(0).to_pylist()
        raw, bounds = text_buffers(batch.column(1))
        for a, b in blocks(bounds):
            ids, counts = encode_texts(raw, bounds[a : b + 1], path)
            ends = np.cumsum(counts)
            for i, (end, n) in enumerate(zip(ends.tolist(), counts.tolist())):
                packer.add(doc_ids[a + i], 0, ids[end - n : end], n)
            # Open pieces must not hold the block's array.
            packer.open = [(used, [(d, s, x.copy() if x.base is not None else x, t) for d, s, x, t in own]) for used, own in packer.open]
            yield from packer.take(source, False, with_ids, kind)
    yield from packer.take(source, True, with_ids, kind)


def _pack_open(table: pa.Table, level: int, last: bool, length: int, windows: int, with_ids: bool) -> pa.Table:
    table = table.sort_by([("source", "ascending"), ("sequence_id", "ascending"), ("offset", "ascending")])
    source = table["parent"][0].as_py()
    packer, kind = Packer((level << 56) + (source << 32), length, windows), table["doc_id"].type
    for doc_id, start, total, data in zip(*(table[c].to_pylist() for c in ("doc_id", "start", "doc_tokens", "ids"))):
        packer.add(doc_id, start, np.frombuffer(data, dtype="<u4"), total)
    if last:
        packer.finish()
    batches = list(packer.take(source, True, with_ids, kind))
    kinds = [kind, *[pa.int64()] * 7, pa.bool_(), pa.binary()]
    return pa.Table.from_batches(batches, schema=pa.schema(list(zip(_NAMES, kinds))))


def _merger(level: int, last: bool, length: int, windows: int, with_ids: bool) -> Callable[[pa.Table], pa.Table]:
    def merge(table: pa.Table) -> pa.Table:
        return _pack_open(table, level, last, length, windows, with_ids)

    return merge


def pack(docs: DataFrame, path: str = WORD_BPE, length: int = LENGTH, windows: int = WINDOWS, with_ids: bool = True,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of all documents and their places in sequences of ``length`` tokens.

    Columns: ``doc_id``, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``,
    ``sequence_id``, ``offset`` and, unless ``with_ids=False``, ``ids`` (unsigned
    32-bit, little-endian). Every document has its end id, so an empty or null
    text has one token. Ids may be null or repeat; each row is packed. An empty
    table gives an empty one; other columns are not read.

    A partition is read once and packed as it is read. The open sequences that
    it leaves, ``windows`` at most, are all that is shuffled.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = _SCHEMA.format(id=rows.schema["doc_id"].dataType.simpleString())
    level = stored(rows.mapInArrow(partial(_pack_texts, path=path, length=length, windows=windows, with_ids=with_ids), schema), "packed")
    columns = [*_NAMES[:7], "ids"] if with_ids else _NAMES[:7]
    done = level.where("NOT open").select(*columns)
    highest = level.where("open").agg(F.max("source")).first()[0]
    number = 1
    while highest is not None:
        last = highest < FAN_IN
        groups = level.where("open").withColumn("parent", F.floor(F.col("source") / FAN_IN))
        merge = _merger(number, last, length, windows, with_ids)
        level = stored(groups.groupBy("parent").applyInArrow(merge, schema), f"packed{number}")
        done = done.union(level.where("NOT open").select(*columns))
        highest = None if last else highest // FAN_IN
        number += 1
    return done
