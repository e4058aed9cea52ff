"""Spelling variants: words one edit apart, by scanning sorted word lists.

All words are compared along a sorted list. For a word, the rows of the edit matrix
against the current word of the list are kept as far as the list's next word shares
its beginning (their longest common prefix), so a row is computed once for the whole
range of words that share it; a row needs only the three cells around the diagonal.
A range whose row holds nothing below two is left out with all its words. The ranges
are taken level by level, for many words at once, as array operations.

A word need not be scanned against the whole vocabulary: two words one edit apart
share the beginning before the edit or the end behind it. Words are dealt by both
halves, as bounded lists, and a half that too many words share is divided again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeloom.llm.common import dropped, fresh, partitions, ranges, stored

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Letters of a word; all are below 256, so a word is an array of bytes.
LETTERS = "A-Za-zÀ-ÿ"
#: A list that more words share is divided again by halves of its middle.
LIST_WORDS = 200_000
#: Words of a list that are scanned at once.
_AT_ONCE = 1 << 13
_FAR = 9
_NO_BOUND = 1 << 30


def word_runs(docs: DataFrame, least: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, word) for every maximal run of letters of at least ``least`` letters, A-Z in lower case."""
    found = F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(f"[{LETTERS}]{{{least},}}"), F.lit(0))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.explode(found).alias("_run"))
    return rows.select("doc_id", F.translate("_run", _UPPER, _LOWER).alias("word"))


def vocabulary(words: DataFrame, least_length: int = 7, least_n: int = 2) -> DataFrame:
    """Different words with their number ``n``, those that are long and frequent enough."""
    return words.where(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_n)


def _dealt(words: DataFrame, sizes: Column, start: Column, end: Column, bound: Column) -> DataFrame:
    """Both halves of the middle that a list leaves open: its words share the first
    ``start`` and the last ``end`` letters, and a pair in it has its first difference
    below ``bound``. ``sizes`` is the length of the shorter word of a pair."""
    half = F.floor((sizes - start - end) / 2).cast("int")
    begins = F.struct((start + half).alias("start"), end.alias("end"), bound.alias("bound"))
    ends = F.struct(start.alias("start"), (sizes - start - half).alias("end"), (start + half).alias("bound"))
    return words.withColumn("_l", F.explode(F.array(begins, ends))).select(
        "word", "n", sizes.alias("short"), F.col("_l.start").alias("start"), F.col("_l.end").alias("end"), F.col("_l.bound").alias("bound"))


def _keyed(lists: DataFrame) -> DataFrame:
    """Adds the list's key: a hash of what its words share. Lists that meet under one key are told apart later."""
    begin, end = F.substring("word", F.lit(1), F.col("start")), F.right("word", F.col("end"))
    return lists.withColumn("list", F.xxhash64("short", "start", "end", "bound", begin, end))


def _lists(vocab: DataFrame, limit: int) -> DataFrame:
    """The vocabulary dealt to lists of at most ``limit`` words, if letters suffice to tell them apart.

    A pair is in the one list of its shorter length whose open middle holds its
    first difference.
    """
    length = F.length("word")
    both = vocab.withColumn("_c", F.explode(F.array(length, length - 1))).where("_c > 0")
    none = F.lit(0)
    lists = stored(_keyed(_dealt(both, F.col("_c"), none, none, F.lit(_NO_BOUND))), "lists")
    done = []
    while True:
        sizes = lists.groupBy("list").agg(F.count("*").alias("_n"), F.first("short").alias("_s"), F.first("start").alias("_a"), F.first("end").alias("_b"))
        large = stored(sizes.where((F.col("_n") > limit) & (F.col("_s") - F.col("_a") - F.col("_b") > 1)).select("list"), "large")
        if large.isEmpty():
            break
        done.append(lists.join(large, "list", "left_anti"))
        again = lists.join(large, "list").select("word", "n", "short", "start", "end", "bound")
        lists = stored(_keyed(_dealt(again, *(F.col(c) for c in ("short", "start", "end", "bound")))), "lists")
    for part in done:
        lists = lists.unionByName(part)
    return lists


def _letters(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Words as one array of bytes with the offsets of the words."""
    offsets = np.zeros(len(words) + 1, dtype=np.int64)
    np.cumsum([len(w) for w in words], out=offsets[1:])
    return np.frombuffer(b"".join(words), dtype=np.uint8), offsets


def _shared(words: list[bytes], lists: np.ndarray) -> np.ndarray:
    """Longest common prefix of each word with the one before it; -1 where a list begins."""
    out = np.full(len(words), -1, dtype=np.int64)
    for i in range(1, len(words)):
        if lists[i] == lists[i - 1]:  # words of a list are different and sorted
            a, b = words[i - 1], words[i]
            n = min(len(a), len(b))
            if a[:n] == b[:n]:
                out[i] = n
            else:
                low, high = 0, n  # the first low letters are equal, the first high are not
                while high - low > 1:
                    mid = (low + high) // 2
                    if a[:mid] == b[:mid]:
                        low = mid
                    else:
                        high = mid
                out[i] = low
    return out


def scan(words: list[bytes], lists: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) of words of one list that are exactly one edit apart, both ways round.

    The words of a list stand together, sorted, and share their first ``starts``
    letters. Yields blocks of pairs.
    """
    letters, offsets = _letters(words)
    letters = np.concatenate([letters, np.zeros(1, dtype=np.uint8)])
    length = np.diff(offsets)
    shared = _shared(words, lists)
    first = shared < starts  # also where a list begins, for ``shared`` is -1 there
    # Where words that share exactly so many letters with the one before them stand: the borders inside ranges.
    borders = np.sort(shared * (len(words) + 1) + np.arange(len(words)))
    begin = np.flatnonzero(first)
    own = np.cumsum(first) - 1
    for part in range(0, len(words), _AT_ONCE):
        asked = np.arange(part, min(part + _AT_ONCE, len(words)))
        yield from _scan_block(asked, letters, offsets, length, borders, begin, own, starts)


def _scan_block(asked, letters, offsets, length, borders, begin, own, starts) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    n = len(length)
    end_of_list = np.append(begin[1:], n)
    # A range is [lo, hi) of the list; all its words share the first ``depth`` letters.
    q, depth = asked, starts[asked].astype(np.int64)
    lo, hi = begin[own[q]].copy(), end_of_list[own[q]].copy()
    low = np.where(depth > 0, 1, _FAR)
    row = np.stack([low, np.zeros(len(q), dtype=np.int64), np.ones(len(q), dtype=np.int64)])
    while len(q):
        # The range's first word may end here: its distance is the cell of the asked word's length.
        ended = length[lo] == depth
        if ended.any():
            at = np.flatnonzero(ended)
            off = length[q[at]] - depth[at] + 1
            near = (off >= 0) & (off <= 2)
            at, off = at[near], off[near]
            hit = at[row[off, at] == 1]
            if len(hit):
                yield q[hit], lo[hit]
            lo = lo + ended
            alive = lo < hi
            q, depth, lo, hi, row = q[alive], depth[alive], lo[alive], hi[alive], row[:, alive]
            if not len(q):
                return
        # Divide the ranges by the next letter, at the words that share no more than ``depth`` with the one before.
        level = depth * (n + 1)
        left = np.searchsorted(borders, level + lo, side="right")
        inner = np.searchsorted(borders, level + hi, side="left") - left
        parent = np.repeat(np.arange(len(q)), inner + 1)
        head = np.cumsum(inner + 1) - (inner + 1)
        index = np.empty(len(parent), dtype=np.int64)
        index[head] = lo
        rest = np.ones(len(parent), dtype=bool)
        rest[head] = False
        index[rest] = borders[ranges(left, inner)] - level[parent[rest]]
        stop = np.append(index[1:], 0)
        stop[np.append(head[1:] - 1, len(parent) - 1)] = hi
        q, depth, row = q[parent], depth[parent], row[:, parent]
        letter = letters[offsets[index] + depth]
        room, base = length[q] - depth, offsets[q] + depth
        differs = [np.where(room > k, letters[np.minimum(base + k, len(letters) - 1)] != letter, _FAR) for k in (0, 1)]
        before = np.where(depth > 0, letters[np.maximum(base - 1, 0)] != letter, _FAR)
        b0 = np.minimum(row[0] + before, row[1] + 1)
        b0[room < 0] = _FAR
        b1 = np.minimum(np.minimum(row[1] + differs[0], row[2] + 1), b0 + 1)
        b1[room < 1] = _FAR
        b2 = np.minimum(row[2] + differs[1], b1 + 1)
        b2[room < 2] = _FAR
        row = np.minimum(np.stack([b0, b1, b2]), _FAR)
        alive = row.min(axis=0) <= 1
        q, depth, lo, hi, row = q[alive], depth[alive] + 1, index[alive], stop[alive], row[:, alive]


def _near_rows(table: pa.Table) -> pa.RecordBatch:
    """Per word of whole lists: its near words there, counted, and the best of them."""
    word, n = table.column("word").to_pylist(), table.column("n").to_pylist()
    same = list(zip(*(table.column(c).to_pylist() for c in ("list", "short", "start", "end", "bound"))))
    raw = [w.encode("latin-1") for w in word]
    spelled = [w if k[2] >= k[3] else w[::-1] for w, k in zip(raw, same)]
    take = sorted(range(len(raw)), key=lambda i: (same[i], spelled[i]))
    spelled = [spelled[i] for i in take]
    lists = np.cumsum([i > 0 and same[take[i]] != same[take[i - 1]] for i in range(len(take))])
    starts = np.array([max(same[i][2], same[i][3]) for i in take])
    count, best = np.zeros(len(raw), dtype=np.int64), {}
    for i, j in scan(spelled, lists, starts):
        for x, y in zip(i.tolist(), j.tolist()):
            x, y = take[x], take[y]
            _, short, start, end, bound = same[x]
            a, b = raw[x], raw[y]
            # The pair's own list: that of its shorter length whose middle has its first difference.
            if (min(len(a), len(b)) == short and a[:start] == b[:start] and a[len(a) - end:] == b[len(b) - end:]
                    and (bound >= _NO_BOUND or a[:bound] != b[:bound])):
                count[x] += 1
                z = best.get(x)
                if z is None or (n[y], word[z]) > (n[z], word[y]):
                    best[x] = y
    rows = np.flatnonzero(count)
    return pa.record_batch(
        [pa.array([word[i] for i in rows], pa.string()), pa.array(count[rows]),
         pa.array([-n[best[i]] for i in rows], pa.int64()), pa.array([word[best[i]] for i in rows], pa.string())],
        names=["word", "n_near", "minus_n", "near"])


def _scan_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cuts a partition, in the order of its lists, into runs of whole lists and scans them."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column("list").to_numpy()
        cut = np.flatnonzero(key[1:] != key[:-1])
        if held and key[0] != held[-1].column("list")[-1].as_py():
            cut = np.concatenate([[-1], cut])
        if len(cut) and rows + cut[-1] + 1 >= _AT_ONCE:
            at = int(cut[-1]) + 1
            yield _near_rows(pa.Table.from_batches([*held, batch.slice(0, at)]))
            held, rows, batch = [], 0, batch.slice(at)
        held.append(batch)
        rows += batch.num_rows
    if held:
        yield _near_rows(pa.Table.from_batches(held))


def near_words(vocab: DataFrame, list_words: int = LIST_WORDS) -> DataFrame:
    """Per word of ``vocab`` (word, n) with a near one: ``word``, ``n_near``, ``near`` and ``near_n``.

    Near are words that one inserted, deleted or replaced letter makes equal;
    ``near`` is the one with the largest ``n``, of equal ones the first in
    code-point order. Words are different, not null, and of the letters ``LETTERS``.
    Each pair is found in one list. A word's figures fold per list, so pairs are
    never shuffled. An empty table gives an empty one.
    """
    lists = _lists(vocab.select("word", "n"), list_words)
    dealt = lists.repartition(partitions(vocab.sparkSession), "list").sortWithinPartitions("list")
    found = dealt.mapInArrow(_scan_partition, "word string, n_near long, minus_n long, near string")
    folded = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct("minus_n", "near")).alias("_b"))
    out = stored(folded.select("word", "n_near", F.col("_b.near").alias("near"), (-F.col("_b.minus_n")).alias("near_n")), "near")
    dropped(lists)
    return out


def _roots(forms: DataFrame, max_rounds: int = 8) -> DataFrame:
    """(word, root): from word to form as long as there is one.

    A form is at least twice as frequent as its word, so no chain is longer than
    64 and none returns. Each round doubles the steps taken.
    """
    current = forms.select("word", F.col("form").alias("root"))
    for _ in range(max_rounds):
        step = current.select(F.col("word").alias("root"), F.col("root").alias("_far"))
        nxt = stored(current.join(step, "root", "left").select("word", F.coalesce("_far", "root").alias("root"), F.col("_far").isNotNull().alias("went")), "roots")
        if nxt.where("went").isEmpty():
            return nxt.select("word", "root")
        current = nxt.select("word", "root")
    raise RuntimeError(f"roots did not settle in {max_rounds} rounds")


def variants(vocab: DataFrame, factor: int = 10, list_words: int = LIST_WORDS) -> DataFrame:
    """Per word of ``vocab`` (word, n): its form, its root and its near words.

    ``form`` is the most frequent near word if that has at least ``factor`` times
    (2 or more) the word's ``n``, else null; ``form_n`` is its n. ``root`` is the
    last form of the chain, the word itself without one. ``n_near`` counts near
    words. Two rows for one word are an error of the caller's; other columns are
    not read.
    """
    if factor < 2:
        raise ValueError("factor is 2 or more")
    vocab = stored(vocab.select("word", "n"), "vocabulary")
    near = near_words(vocab, list_words)
    is_form = F.col("near_n") >= factor * F.col("n")
    known = stored(vocab.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(is_form, F.col("near")).alias("form"),
        F.when(is_form, F.col("near_n")).alias("form_n")), "forms")
    dropped(near)
    dropped(vocab)
    roots = _roots(known.where("form IS NOT NULL"))
    return known.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def normalised(words: DataFrame, found: DataFrame, word_col: str = "word", out: str = "root") -> DataFrame:
    """``words`` with the root of each word; a word outside the vocabulary is its own root."""
    key = fresh(words, "_word")
    return words.join(found.select(F.col("word").alias(key), F.col("root").alias(fresh(words, "_root"))), F.col(word_col) == F.col(key), "left").select(
        *words.columns, F.coalesce(fresh(words, "_root"), word_col).alias(out))


def misspelt(words: DataFrame, every: int = 31) -> DataFrame:
    """(doc_id, word) rows with planted errors: one letter less where ``every`` divides
    the crc32 of ``doc_id:word``, at that number modulo the length. A null id is an empty text."""
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("word")))
    rows = words.withColumn("_h", h)
    at = (F.col("_h") % F.length("word")).cast("int")
    shorter = F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.length("word")))
    return rows.select("doc_id", F.when(F.col("_h") % every == 0, shorter).otherwise(F.col("word")).alias("word"))
