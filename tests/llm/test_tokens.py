"""Tokenizers, the token store, packing and byte-level BPE against the libraries."""

import base64
import hashlib
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from gradeloom.llm import byte_bpe, packing, token_store, tokens
from gradeloom.session import scratch_path
from plain import DOCS, SF, TWINS, frame

ODD = [None, "", " ", "\n\n  a\tb ", "ΣΟΦΟΣ Σ", "a<|endoftext|>b c", "naïve café ½ x² İstanbul", "it's I'LL don't 'tis  's", "日本語 テキスト　x y", "x́ éa",
       "a\x00 b \x1c c\x1f d", "a" * 300, "=-=-" * 40, "👍🏽👩‍👩‍👧 ok", "    def f(x):\n        return x  \n\n\n", "word " * 5000, "Hello, World. ABC def ghi"]
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(byte_bpe.BYTE_BPE, "rb"))}
BYTES = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def word_ids(texts):
    tokenizer = Tokenizer.from_file(tokens.WORD_BPE)
    return [np.array(e.ids + [tokens.END_ID], dtype="<u4") for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_token_store(spark):
    rows = list(enumerate(ODD)) + [(r.doc_id + 100, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    folder = scratch_path(spark, "store")
    token_store.write_tokens(frame(spark, rows[::-1]).repartition(5), folder)
    got = sorted(token_store.read_tokens(spark, folder).collect())
    start = 0
    for r, ids in zip(got, word_ids([t for _, t in rows]), strict=True):
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_token_store_odd_tables(spark):
    folder = scratch_path(spark, "store")
    token_store.write_tokens(spark.createDataFrame([], DOCS), folder)
    assert token_store.read_tokens(spark, folder).count() == 0
    folder = scratch_path(spark, "store")
    token_store.write_tokens(frame(spark, [(1, "a"), (1, "a"), (1, "b c")]), folder)
    assert sorted(r.start for r in token_store.read_tokens(spark, folder).collect())[0] == 0
    with pytest.raises(Exception, match="has no id"):
        token_store.write_tokens(frame(spark, [(None, "a")]), scratch_path(spark, "store"))


@given(st.lists(st.integers(0, 2**31 - 1) | st.integers(0, 300), max_size=1500))
@settings(max_examples=40, deadline=None)
def test_shard_random_access(values):
    ids = np.array(values, dtype=np.uint32)
    shard = token_store.Shard.open(token_store.write_shard(np.array([7]), np.array([len(ids)]), ids))
    assert shard.tokens(0, len(ids)).tolist() == values
    for i in range(0, len(values), 97):
        assert shard.token(i) == values[i] and shard.tokens(i, min(i + 50, len(ids))).tolist() == values[i : i + 50]


@pytest.mark.parametrize("parts", [1, 40])
def test_packing(spark, parts):
    rows = list(enumerate(ODD)) + [(r.doc_id + 100, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    pieces = packing.pack(frame(spark, rows).repartition(parts)).collect()
    docs, sequences = defaultdict(list), defaultdict(list)
    for p in pieces:
        docs[p.doc_id].append(p)
        sequences[p.sequence_id].append(p)
        assert zlib.crc32(p.ids) == p.ids_crc32 and len(p.ids) == 4 * p.length
    for (i, _), ids in zip(rows, word_ids([t for _, t in rows]), strict=True):
        own = sorted(docs[i], key=lambda p: p.start)
        assert b"".join(p.ids for p in own) == ids.tobytes() and {p.doc_tokens for p in own} == {len(ids)}
    padded = 0
    for own in sequences.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 4096
        padded += 4096 - at if at & (at - 1) else 0
    assert padded <= 0.01 * 4096 * len(sequences)


def test_packing_odd_tables(spark):
    assert packing.pack(spark.createDataFrame([], DOCS)).count() == 0
    assert sum(p.length for p in packing.pack(frame(spark, [(None, "a"), (1, None), (1, None)])).collect()) == 4


def test_byte_bpe(spark):
    rows = list(enumerate(ODD)) + [(r.doc_id + 100, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {r.doc_id: r for r in byte_bpe.byte_bpe(frame(spark, rows)).collect()}
    for i, text in rows:
        ids = np.array(BYTES.encode_ordinary(text or ""), dtype="<u4")
        assert got[i].ids == ids.tobytes() and got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(ids.tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    assert byte_bpe.byte_bpe(spark.createDataFrame([], DOCS)).count() == 0


@pytest.mark.parametrize("order", [1, -1])
def test_words_of_equal_hash_keep_their_own_ids(order):
    """The table compares bytes: hashes that all collide change nothing."""
    table = tokens.WordTable(lambda words: (np.frombuffer(b"".join(words), dtype=np.uint8).astype(np.int32), np.array([len(w) for w in words])))
    own = [b"ab", b"ba", b"ab", b"abc", b"", b"ba", b"b"][::order]
    data = np.frombuffer(b"".join(own) or b"", dtype=np.uint8)
    ends = np.cumsum([len(w) for w in own])
    starts = ends - [len(w) for w in own]
    for _ in range(2):
        ids, counts = table.encode(data, starts, ends, np.zeros(len(own), dtype=np.uint64))
        assert bytes(ids.astype(np.uint8)) == data.tobytes() and counts.tolist() == [len(w) for w in own]


VOCABULARY = byte_bpe.Vocabulary(byte_bpe.BYTE_BPE)


@given(st.text(alphabet=" \n\t\r\x0b\x0c\x1c\x1f  \u0085　abcé'ts1.½Σ", max_size=40))
@settings(max_examples=300, deadline=None)
def test_byte_bpe_cuts_nowhere_inside_a_piece(text):
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    ids, counts, _ = byte_bpe.encode_texts(raw, np.array([0, len(raw)]))
    assert ids.tolist() == BYTES.encode_ordinary(text) and counts.tolist() == [len(ids)]


@given(st.text(alphabet="abcdefinorst", min_size=1, max_size=60), st.integers(0, 60), st.integers(0, 60), st.text(alphabet="abeinort", max_size=20))
@settings(max_examples=100, deadline=None)
def test_appending_and_editing_a_piece(text, a, b, new):
    data = text.encode()
    table = byte_bpe.PrefixEncoding(VOCABULARY, data[:3])
    table.append(data[3:])
    assert table.tokens() == BYTES.encode_ordinary(text)
    k = len(data) // 2
    assert table.tokens(k) == BYTES.encode_ordinary(text[:k])
    start, stop = sorted((min(a, len(data)), min(b, len(data))))
    table.replace(start, stop, new.encode())
    assert table.tokens() == BYTES.encode_ordinary(text[:start] + new + text[stop:])


@pytest.mark.parametrize("letters", ["-", "a", "=-", "abcdefghijklmnopqrstuvwxyz", "the ing er".split(), [chr(c) for c in range(0x4E00, 0x5200)]])
def test_long_pieces(letters):
    """A piece of a megabyte takes seconds, and its encoding is the library's."""
    rng = np.random.RandomState(2)

    def text(n):
        return "".join(letters[i] for i in rng.randint(0, len(letters), n))

    for n in (49, 500, 20_000):
        piece = text(n)
        raw = np.frombuffer(piece.encode(), dtype=np.uint8)
        assert byte_bpe.encode_texts(raw, np.array([0, len(raw)]))[0].tolist() == BYTES.encode_ordinary(piece)
    long = text(300_000)
    table = byte_bpe.PrefixEncoding(VOCABULARY, long.encode())
    assert b"".join(VOCABULARY.bytes[t] for t in table.tokens()) == long.encode()
    assert table.tokens(len(long[:2000].encode())) == byte_bpe.PrefixEncoding(VOCABULARY, long[:2000].encode()).tokens()
