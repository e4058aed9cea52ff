"""Token ids of whole texts by a public tokenizer file, each different word once.

The ids are those of the ``tokenizers`` library for the whole text. Its splitting
rules never join what white space parts, so a text is cut at ASCII white space
and every different word is encoded once per worker. Words of plain Latin letters
and punctuation go to the library's merges directly, many in a call; any other
word goes through its complete chain of normalizing and splitting.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import public_tokenizers
import regex
from tokenizers import Tokenizer, normalizers, pre_tokenizers

from gradeloom.llm.common import LOWER, _SPACE, ranges, running_sums, runs_of, span_hashes, worker_cache

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
END_ID = 2
#: Different words and their bytes kept per worker; with more, the worker starts a new table.
MAX_WORDS, MAX_BYTES = 600_000, 64 << 20
#: What the file's own splitting rule reads as one unit (fixed value).
_UNIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
_MARK = np.zeros(256, dtype=bool)
_MARK[[ord(c) for c in ".,;:!?"]] = True
_ASCII_LETTER = np.zeros(256, dtype=bool)
_ASCII_LETTER[[*range(65, 91), *range(97, 123)]] = True
_PLAIN = regex.compile("[!-~¡-¬®-įı-ɏ]*")


class WordTable:
    """Ids of the words met so far, end to end, and the words' bytes.

    Words are looked up by hash and then compared byte by byte with the word that
    the table has under it; words that share a hash are told apart by their bytes.
    """

    def __init__(self, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]):
        self._encode = encode
        self._clear()

    def _clear(self) -> None:
        self._number: dict[int, int] = {}
        self._others: dict[bytes, int] = {}
        self._ids, self._starts, self._counts = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self._bytes, self._begins, self._sizes = np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _add(self, words: list[bytes]) -> np.ndarray:
        """The numbers of new words."""
        ids, counts = self._encode(words)
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        numbers = np.arange(len(self._counts), len(self._counts) + len(words))
        self._starts = np.concatenate([self._starts, len(self._ids) + np.cumsum(counts) - counts])
        self._counts = np.concatenate([self._counts, counts])
        self._ids = np.concatenate([self._ids, ids])
        self._begins = np.concatenate([self._begins, len(self._bytes) + np.cumsum(sizes) - sizes])
        self._sizes = np.concatenate([self._sizes, sizes])
        self._bytes = np.concatenate([self._bytes, np.frombuffer(b"".join(words), dtype=np.uint8)])
        return numbers

    def encode(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words [start, end) one after the other, and the number of each."""
        codes, unique = pd.factorize(hashes)
        if len(self._counts) + len(unique) > MAX_WORDS or len(self._bytes) > MAX_BYTES:
            self._clear()
        number = self._number
        at = np.array([number.get(h, -1) for h in unique.tolist()], dtype=np.int64)
        new = np.flatnonzero(at < 0)
        if len(new):
            first = np.empty(len(unique), dtype=np.int64)
            first[codes[::-1]] = np.arange(len(codes))[::-1]
            text = data.tobytes()
            at[new] = self._add([text[a:b] for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist())])
            number.update(zip(unique[new].tolist(), at[new].tolist()))
        words = at[codes]
        self._tell_apart(data, starts, ends, words)
        counts = self._counts[words]
        return self._ids[ranges(self._starts[words], counts)], counts

    def _tell_apart(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, words: np.ndarray) -> None:
        """Give words whose bytes are not those of their number the number of their own."""
        sizes = ends - starts
        other = sizes != self._sizes[words]
        same = np.flatnonzero(~other)
        differs = data[ranges(starts[same], sizes[same])] != self._bytes[ranges(self._begins[words[same]], sizes[same])]
        if differs.any():
            other[same[np.searchsorted(np.cumsum(sizes[same]), np.flatnonzero(differs), side="right")]] = True
        if other.any():
            own = [data[starts[i] : ends[i]].tobytes() for i in np.flatnonzero(other).tolist()]
            fresh = [w for w in dict.fromkeys(own) if w not in self._others]
            if fresh:
                self._others.update(zip(fresh, self._add(fresh).tolist()))
            words[other] = [self._others[w] for w in own]


def _byte_letters() -> dict[int, int]:
    """The letters that byte-level files write for bytes: a rule of the file format."""
    same = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = dict(zip(same, same))
    for i, b in enumerate(x for x in range(256) if x not in out):
        out[b] = 256 + i
    out[32] = 32
    return out


def _word_encoder(path: str) -> Callable[[list[bytes]], list[np.ndarray]]:
    whole = Tokenizer.from_file(path)
    merges = Tokenizer.from_file(path)
    merges.normalizer = normalizers.Sequence([])
    merges.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    letters = _byte_letters()
    vocabulary = whole.get_vocab()
    closes = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
    closes[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def merged(pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their numbers of pieces that the splitting rule leaves whole."""
        ids, counts = [np.zeros(0, dtype=np.int32)], [np.zeros(0, dtype=np.int64)]
        for i in range(0, len(pieces), 4000):
            line = " ".join(pieces[i : i + 4000]).encode().decode("latin-1").translate(letters)
            got = np.array(merges.encode_batch_fast([line], add_special_tokens=False)[0].ids, dtype=np.int32)
            ends = np.flatnonzero(closes[got]) + 1
            if len(ends) != min(4000, len(pieces) - i):
                raise ValueError("the tokenizer file does not mark word ends")
            ids.append(got)
            counts.append(np.diff(ends, prepend=0))
        return np.concatenate(ids), np.concatenate(counts)

    def encode(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        pieces, n_pieces, odd = [], np.zeros(len(words), dtype=np.int64), []
        for i, raw in enumerate(words):
            word = raw.decode()
            if _PLAIN.fullmatch(word) and "<|" not in word:
                word = word.lower()
                if word.isalpha() or len(word) == 1:
                    pieces.append(word)
                    n_pieces[i] = 1
                else:
                    units = _UNIT.findall(word)
                    pieces += units
                    n_pieces[i] = len(units)
            else:
                odd.append((i, word))
        ids, per_piece = merged(pieces)
        ends = np.concatenate(([0], np.cumsum(per_piece)))[np.cumsum(n_pieces)]
        counts = np.diff(ends, prepend=0)
        if not odd:
            return ids, counts
        starts = ends - counts
        parts, last = [], 0
        for (i, _), got in zip(odd, whole.encode_batch_fast([w for _, w in odd], add_special_tokens=False)):
            parts += [ids[last : starts[i]], np.array(got.ids, dtype=np.int32)]
            last, counts[i] = starts[i], len(got.ids)
        return np.concatenate([*parts, ids[last:]]), counts

    return encode


def _units(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words, a last mark of punctuation by itself.

    It is parted only behind an ASCII or a Latin-1 letter, where every splitting
    rule parts it.
    """
    starts, ends = runs_of(~_SPACE[data], cuts)
    long = np.flatnonzero((ends - starts > 2) & _MARK[data[ends - 1]])
    e = ends[long]
    accented = (data[e - 3] == 0xC3) & (data[e - 2] >= 0x80) & (data[e - 2] != 0x97) & (data[e - 2] != 0xB7)
    long = long[_ASCII_LETTER[data[e - 2]] | accented]
    order = np.argsort(np.concatenate([starts, ends[long] - 1]), kind="stable")
    marks = ends[long].copy()
    ends = ends.copy()
    ends[long] -= 1
    return np.concatenate([starts, marks - 1])[order], np.concatenate([ends, marks])[order]


def encode_texts(raw: np.ndarray, bounds: np.ndarray, path: str = WORD_BPE) -> tuple[np.ndarray, np.ndarray]:
    """Ids of consecutive texts, each ending in ``END_ID``, and the number of each text's."""
    cache = worker_cache()
    if ("words", path) not in cache:
        cache["words", path] = WordTable(_word_encoder(path))
    data = raw[bounds[0] : bounds[-1]]
    if b"<|" not in data.tobytes():  # a special token's name is read before lower-casing
        data = LOWER[data]
    cuts = bounds - bounds[0]
    starts, ends = _units(data, cuts)
    ids, counts = cache["words", path].encode(data, starts, ends, span_hashes(running_sums(data), starts, ends))
    before = np.concatenate(([0], np.cumsum(counts)))[np.searchsorted(starts, cuts)]
    return np.insert(ids, before[1:], END_ID), np.diff(before) + 1
