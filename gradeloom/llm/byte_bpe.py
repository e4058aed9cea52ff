"""Byte-level BPE by dynamic programming over prefixes.

For every prefix of a piece there is exactly one token that its encoding can end
with: a token that the prefix ends in and that may follow the last token of what
is before it. So one table of last tokens holds the encodings of all prefixes.
Appending extends the table; an edit keeps the part before it. Whether two tokens
may stand side by side is decided by undoing their merges across the border: if
an earlier merge would have crossed it, they may not.

A corpus is cut where no piece can cross, every different chunk is encoded once
per worker, and the tables of all new short pieces grow together, a byte at a time,
as array operations. The tokens that the prefixes of a long piece end in come from
one walk of an automaton over its bytes, and what is known of two tokens side by
side is kept, so the work on a long piece grows with its bytes.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator
from functools import cached_property, partial

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeloom.llm.common import _SPACE, blocks, ranges, running_sums, span_hashes, text_buffers, worker_cache
from gradeloom.llm.tokens import WordTable

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.tiktoken")
#: Pieces of more bytes are encoded one by one.
_TOGETHER = 48
#: Pairs of tokens whose verdict is kept; with more, the table starts anew.
_MAX_PAIRS = 1 << 20


def _merge(data: bytes, ranks: dict[bytes, int], limit: int) -> list[bytes]:
    """Merge neighbours, lowest rank first, by ranks below ``limit``."""
    parts = [data[i : i + 1] for i in range(len(data))]
    while len(parts) > 1:
        rank, at = min((ranks.get(parts[i] + parts[i + 1], limit), i) for i in range(len(parts) - 1))
        if rank >= limit:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


class Vocabulary:
    """The tokens of a rank file and the merge that makes each of them."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}
        n = max(self.ranks.values()) + 1
        self.bytes = [b""] * n
        for token, rank in self.ranks.items():
            self.bytes[rank] = token
        self.sizes = np.array([len(x) for x in self.bytes], dtype=np.int64)
        self.flat = np.frombuffer(b"".join(self.bytes), dtype=np.uint8)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.longest = int(self.sizes.max())
        hashes = span_hashes(running_sums(self.flat), self.starts, self.starts + self.sizes)
        self._order = np.argsort(hashes)
        self._hashes = hashes[self._order]
        self._sieve = np.zeros(1 << 22, dtype=bool)
        self._sieve[(hashes & np.uint64(0x3FFFFF)).astype(np.int64)] = True
        self.left, self.right = np.arange(n), np.arange(n)
        for token, rank in self.ranks.items():
            if len(token) > 1:
                parts = _merge(token, self.ranks, rank)
                if len(parts) == 2:
                    self.left[rank], self.right[rank] = self.ranks[parts[0]], self.ranks[parts[1]]
        made = np.flatnonzero(self.left != np.arange(n))
        keys = self.left[made] * n + self.right[made]
        order = np.argsort(keys)
        self._pairs, self._made = keys[order], made[order]
        self.known: dict[int, bool] = {}
        self.lengths = self.sizes.tolist()

    @cached_property
    def automaton(self) -> ahocorasick.Automaton:
        """Finds all tokens in bytes written as Latin-1 letters."""
        out = ahocorasick.Automaton()
        for token, rank in self.ranks.items():
            out.add_word(token.decode("latin-1"), rank)
        out.make_automaton()
        return out

    @cached_property
    def _merges(self) -> tuple[list[int], list[int], dict[int, int]]:
        return self.left.tolist(), self.right.tolist(), dict(zip(self._pairs.tolist(), self._made.tolist()))

    def find(self, data: np.ndarray, sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The token that the bytes [start, end) are, or -1."""
        hashes = span_hashes(sums, starts, ends)
        out = np.full(len(hashes), -1, dtype=np.int64)
        maybe = np.flatnonzero(self._sieve[(hashes & np.uint64(0x3FFFFF)).astype(np.int64)])
        if len(maybe):
            at = np.minimum(np.searchsorted(self._hashes, hashes[maybe]), len(self._hashes) - 1)
            token = self._order[at]
            sizes = self.sizes[token]
            hit = np.flatnonzero((self._hashes[at] == hashes[maybe]) & (sizes == (ends - starts)[maybe]))
            maybe, token, sizes = maybe[hit], token[hit], sizes[hit]
            differs = data[ranges(starts[maybe], sizes)] != self.flat[ranges(self.starts[token], sizes)]
            out[maybe] = token
            if differs.any():
                out[maybe[np.searchsorted(np.cumsum(sizes), np.flatnonzero(differs), side="right")]] = -1
        return out

    def pair(self, first: int, second: int) -> bool:
        """``may_follow`` of one pair of tokens, put among the ``known`` ones."""
        if len(self.known) >= _MAX_PAIRS:
            self.known.clear()
        ok = self.known[first * len(self.bytes) + second] = self._stand_apart(first, second)
        return ok

    def _stand_apart(self, a: int, b: int) -> bool:
        left, right, made = self._merges
        n, limit = len(self.bytes), 1 << 40
        while True:
            if made.get(a * n + b, limit) < limit:
                return False
            whole_a, whole_b = right[a] == a, left[b] == b
            if whole_a and whole_b:
                return True
            if whole_b or (a > b and not whole_a):
                a, limit = right[a], a
            else:
                b, limit = left[b], b + 1

    def may_follow(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Whether the encoding of both tokens' bytes is the two tokens."""
        n = len(self.bytes)
        ok = np.ones(len(first), dtype=bool)
        at, a, b = np.arange(len(first)), first.astype(np.int64), second.astype(np.int64)
        limit = np.full(len(first), 1 << 40, dtype=np.int64)
        while len(at):
            keys = a * n + b
            place = np.minimum(np.searchsorted(self._pairs, keys), len(self._pairs) - 1)
            crosses = (self._pairs[place] == keys) & (self._made[place] < limit)
            ok[at[crosses]] = False
            # Undo the later of the two merges; where it is a single byte, the other.
            from_a = a > b
            single_a, single_b = self.right[a] == a, self.left[b] == b
            use_a = (from_a & ~single_a) | (~from_a & single_b)
            limit = np.where(use_a, a, b + 1)
            done = crosses | (single_a & single_b)
            a, b = np.where(use_a, self.right[a], a), np.where(use_a, b, self.left[b])
            keep = ~done
            at, a, b, limit = at[keep], a[keep], b[keep], limit[keep]
        return ok


class PrefixEncoding:
    """The table of one piece: append to it, edit it, read its tokens."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, b"", array("i")
        self.append(data)

    def append(self, more: bytes) -> None:
        last, known, v = self.last, len(self.last), self.vocabulary
        self.data += more
        last.extend([-1] * len(more))
        sizes, verdicts, n = v.lengths, v.known, len(v.bytes)
        # A token that ends in the new bytes begins at most ``longest`` before them.
        start = max(known - v.longest + 1, 0)
        for at, token in v.automaton.iter(self.data[start:].decode("latin-1")):
            end = start + at
            if end < known or last[end] >= 0:
                continue
            before = end - sizes[token]
            if before >= 0:
                ok = verdicts.get(last[before] * n + token)
                if not (v.pair(last[before], token) if ok is None else ok):
                    continue
            last[end] = token

    def replace(self, start: int, stop: int, with_: bytes) -> None:
        """Put other bytes in place of [start, stop); what is before stays encoded."""
        rest = with_ + self.data[stop:]
        self.data, self.last = self.data[:start], self.last[:start]
        self.append(rest)

    def tokens(self, size: int | None = None) -> list[int]:
        """The encoding of the first ``size`` bytes, of all by default."""
        at, out = len(self.data) if size is None else size, []
        while at:
            out.append(self.last[at - 1])
            at -= len(self.vocabulary.bytes[out[-1]])
        return out[::-1]


def encode_pieces(vocabulary: Vocabulary, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of pieces, end to end, and the number of each piece's."""
    n = len(pieces)
    data = np.frombuffer(b"".join(pieces), dtype=np.uint8)
    sizes = np.array([len(p) for p in pieces], dtype=np.int64)
    starts = np.cumsum(sizes) - sizes
    sums = running_sums(data)
    whole = vocabulary.find(data, sums, starts, starts + sizes)
    counts = np.where(whole >= 0, 1, 0)
    own: dict[int, list[int]] = {}
    rest = np.flatnonzero(whole < 0)
    for i in rest[sizes[rest] > _TOGETHER].tolist():
        own[i] = PrefixEncoding(vocabulary, pieces[i]).tokens()
        counts[i] = len(own[i])
    rest = rest[sizes[rest] <= _TOGETHER]
    rest = rest[np.argsort(-sizes[rest], kind="stable")]
    s, z = starts[rest], sizes[rest]
    most = int(z[0]) if len(z) else 0
    last = np.full((most + 1, len(rest)), -1, dtype=np.int32)
    for end in range(1, most + 1):
        open_ = np.arange(int(np.searchsorted(-z, -end, side="right")))
        for size in range(1, min(end, vocabulary.longest) + 1):
            if not len(open_):
                break
            token = vocabulary.find(data, sums, s[open_] + end - size, s[open_] + end)
            fits = token >= 0
            if size < end:
                there = np.flatnonzero(fits)
                fits[there] = vocabulary.may_follow(last[end - size, open_[there]], token[there])
            last[end, open_[fits]] = token[fits]
            open_ = open_[~fits]
    steps, at = [], z.copy()
    active = np.arange(len(rest))
    while len(active):
        token = last[at[active], active].astype(np.int64)
        steps.append((active, token))
        at[active] -= vocabulary.sizes[token]
        active = active[at[active] > 0]
    if steps:
        who, what = (np.concatenate(x) for x in zip(*steps))
        order = np.argsort(who, kind="stable")[::-1]  # from the last token to the first, turned round
        who, what = rest[who[order]], what[order]
        counts += np.bincount(who, minlength=n)
    begin = np.cumsum(counts) - counts
    out = np.empty(int(counts.sum()), dtype=np.int32)
    out[begin[whole >= 0]] = whole[whole >= 0]
    if steps:
        run = np.flatnonzero(np.diff(who, prepend=-1) != 0)
        length = np.diff(np.append(run, len(who)))
        out[ranges(begin[who[run]], length)] = what
    for i, tokens in own.items():
        out[begin[i] : begin[i] + counts[i]] = tokens
    return out, counts


def _chunks(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of chunks: a text is cut before white space that follows
    something else, where every piece of the pattern ends."""
    cut = np.zeros(len(data) + 1, dtype=bool)
    if len(data):
        space = _SPACE[data]
        cut[1:-1] = space[1:] & ~space[:-1]
        # The bytes before may be a white-space letter beyond ASCII; no cut then.
        wide = np.flatnonzero(cut[:-1])
        wide = wide[(wide >= 2) & (data[wide - 1] >= 0x80)]
        cut[wide[np.isin(data[wide - 2], (0xC2, 0x80, 0x81, 0x9A))]] = False
        # Nor behind control characters that the pattern takes for white space.
        cut[np.flatnonzero(cut[1:] & (data < 0x20)) + 1] = False
    inner = cuts[(cuts < len(data))]
    cut[inner] = True
    starts = np.flatnonzero(cut[:-1])
    return starts, np.append(starts[1:], len(data))[: len(starts)]


def _chunk_encoder(path: str):
    vocabulary = Vocabulary(path)
    pattern = regex.compile(public_tokenizers.PATTERN)

    def encode(chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        numbers: dict[str, int] = {}
        use, n_pieces = [], []
        for raw in chunks:
            chunk = raw.decode()
            found = (chunk,) if chunk[0] == " " and chunk[1:].isalpha() else pattern.findall(chunk)
            use += [numbers.setdefault(p, len(numbers)) for p in found]
            n_pieces.append(len(found))
        ids, counts = encode_pieces(vocabulary, [p.encode() for p in numbers])
        use = np.array(use, dtype=np.int64)
        starts = np.cumsum(counts) - counts
        ends = np.concatenate(([0], np.cumsum(counts[use])))[np.cumsum(n_pieces)]
        return ids[ranges(starts[use], counts[use])], np.diff(ends, prepend=0)

    return vocabulary, encode


def encode_texts(raw: np.ndarray, bounds: np.ndarray, path: str = BYTE_BPE) -> tuple[np.ndarray, np.ndarray, Vocabulary]:
    """Tokens of consecutive texts, the number of each text's, and the vocabulary."""
    cache = worker_cache()
    if ("bytes", path) not in cache:
        vocabulary, encode = _chunk_encoder(path)
        cache["bytes", path] = vocabulary, WordTable(encode)
    vocabulary, known = cache["bytes", path]
    data = raw[bounds[0] : bounds[-1]]
    cuts = bounds - bounds[0]
    starts, ends = _chunks(data, cuts)
    ids, counts = known.encode(data, starts, ends, span_hashes(running_sums(data), starts, ends))
    before = np.concatenate(([0], np.cumsum(counts)))[np.searchsorted(starts, cuts)]
    return ids, np.diff(before), vocabulary


def decode(vocabulary: Vocabulary, ids: np.ndarray) -> bytes:
    return vocabulary.flat[ranges(vocabulary.starts[ids], vocabulary.sizes[ids])].tobytes()


def _code(batches: Iterator[pa.RecordBatch], path: str, with_ids: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, bounds = text_buffers(batch.column(1))
        for a, b in blocks(bounds):
            ids, counts, vocabulary = encode_texts(raw, bounds[a : b + 1], path)
            ends = np.cumsum(counts)
            own = [ids[e - n : e] for e, n in zip(ends.tolist(), counts.tolist())]
            packed = [x.astype("<u4").tobytes() for x in own]
            digests = [[hashlib.sha256(x).hexdigest() for x in packed], [hashlib.sha256(decode(vocabulary, x)).hexdigest() for x in own]]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(a, b - a), pa.array(counts), *map(pa.array, digests), *([pa.array(packed, pa.binary())] if with_ids else [])],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *(["ids"] if with_ids else [])])


def byte_bpe(docs: DataFrame, path: str = BYTE_BPE, with_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokens of every row's whole text and the digests of tokens and decoded bytes.

    Columns ``doc_id``, ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` and,
    unless ``with_ids=False``, ``ids`` (unsigned 32-bit, little-endian). A null
    text is an empty one and has no token. Repeated rows are encoded each; an
    empty table gives an empty one; other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return rows.mapInArrow(partial(_code, path=path, with_ids=with_ids), schema + (", ids binary" if with_ids else ""))
