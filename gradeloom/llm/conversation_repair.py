"""Cheapest repairs of conversations, by a dynamic program with checkpoints.

A conversation is in order when the initials of its roles read ``(s?(ua)+)?``: an
optional system message, then user and assistant in turn. Each row is kept (cost
0), given the role user or assistant (2) or deleted (3, the only choice for a blank
or repeated row); messages without text may be inserted anywhere (2 each); a
truncated row that stays costs 1 more. Of the cheapest repairs the one whose edits,
written as K, R, D and I, come first in ASCII is made.

The program runs backward over the rows with a vector of four costs, one per state
of the pattern. Only the vectors at checkpoints are stored: between the pieces of a
conversation as rows of a table, inside a piece at every square-root-th row. The
walk forward takes the blocks between checkpoints one after the other, computes
the vectors of a block again and follows the tight edits.

Pieces are cut where a global sort by (conversation, turn) is cut, so a conversation
that holds a third of all rows is spread over a third of the tasks. What a piece
does to the costs is a 4 x 4 matrix, and pieces meet as rows of such matrices.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import groupby
from math import inf, isqrt

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradeloom.llm.common import partitions, stored

# States of the pattern: nothing yet, after the system message, after a user, after an assistant.
_FINAL = (0.0, 4.0, 2.0, 0.0)  # costs at the end: what is missing is inserted
_NEXT = (2, 2, 3, 2)  # the state after an inserted or renamed message
_KEEP = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None)}
_FORCED, _TRUNCATED = "D", "t"
_BLANK_CHARS = r"[^\x20\x09-\x0D]"


def _edit_costs(after: tuple, code: str) -> Iterator[tuple[tuple, ...]]:
    """Per state the costs of D, K and R for a row of this kind, given the costs behind it."""
    extra = 1 if code.endswith(_TRUNCATED) else 0
    keep = _KEEP.get(code[:1], (None,) * 4)
    for s in range(4):
        if code == _FORCED:
            yield after[s] + 3, inf, inf
        else:
            yield after[s] + 3, inf if keep[s] is None else after[keep[s]] + extra, after[_NEXT[s]] + 2 + extra


@lru_cache(maxsize=1 << 16)
def _before(after: tuple, code: str) -> tuple[tuple, float]:
    """Costs before a row of kind ``code``, as (vector with minimum 0, what was taken off)."""
    own = [min(x) for x in _edit_costs(after, code)]
    closed = [min(own[s], own[_NEXT[s]] + 2, own[_NEXT[_NEXT[s]]] + 4) for s in range(4)]
    least = min(closed)
    return tuple(x - least for x in closed), least


def _backward(codes: list[str], end: tuple) -> tuple[tuple, float]:
    """Costs before the first row, as a vector and what was taken off it."""
    vector, taken = end, 0.0
    for code in reversed(codes):
        vector, least = _before(vector, code)
        taken += least
    return vector, taken


def _matrix(codes: list[str]) -> list[float]:
    """Costs from each state before the rows to each state behind them, row by row."""
    columns = []
    for e in range(4):
        vector, taken = _backward(codes, tuple(0.0 if s == e else inf for s in range(4)))
        columns.append([x + taken for x in vector])
    return [columns[e][s] for s in range(4) for e in range(4)]


def _walk(codes: list[str], end: tuple, state: int) -> Iterator[tuple[str, int]]:
    """Per row: its tight edits, ASCII-least, and the state behind it.

    ``end`` has the costs behind the last row, ``state`` is that before the first.
    """
    n = len(codes)
    step = isqrt(n) + 1
    marks = {n: end}
    vector = end
    for i in range(n - 1, -1, -1):
        vector, _ = _before(vector, codes[i])
        if i % step == 0:
            marks[i] = vector
    for start in range(0, n, step):
        stop = min(start + step, n)
        vectors = [marks[stop]]
        for i in range(stop - 1, start - 1, -1):
            vectors.append(_before(vectors[-1], codes[i])[0])
        for i in range(start, stop):
            here, after = vectors[stop - i], vectors[stop - i - 1]
            least, edits = _before(after, codes[i])[1], ""
            costs = list(_edit_costs(after, codes[i]))
            while True:
                best = here[state] + least
                delete, keep, rename = costs[state]
                if delete == best:
                    edits += "D"
                elif here[_NEXT[state]] + least + 2 == best:
                    edits, state = edits + "I", _NEXT[state]
                    continue
                elif keep == best:
                    edits, state = edits + "K", _KEEP[codes[i][0]][state]
                elif rename == best:
                    edits, state = edits + "R", _NEXT[state]
                else:
                    raise AssertionError("no tight edit")
                break
            yield edits, state


def _runs(batches: Iterator[pa.RecordBatch], columns: list[str], keys: int) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """Consecutive rows with equal first ``keys`` columns."""
    rows = (row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in columns)))
    return groupby(rows, key=lambda row: row[:keys])


def _in_batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 8192) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
            held = []
    if held:
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)


def _streamed(df: DataFrame, rows: Callable, out: str) -> DataFrame:
    """``rows`` over the partitions of ``df``, batch by batch; ``out`` is the schema made."""
    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = T.StructType.fromDDL(out)
    schema = to_arrow_schema(kinds)
    return df.mapInArrow(lambda batches: _in_batches(rows(batches), schema), kinds)


def _conversation(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """Rows as (conv, at, role, text): keys in structs, so that null is a value like any other."""
    return turns.select(
        F.struct(F.col(conv_col).alias("id")).alias("conv"), F.struct(F.col(turn_col).cast("long").alias("turn")).alias("at"),
        F.coalesce(F.col(role_col), F.lit(" ")).alias("role"), F.coalesce(F.col(text_col), F.lit(" ")).alias("text"))


_KEY = ["conv", "at", "role", "digest"]


def _lines(rows: DataFrame) -> DataFrame:
    """Different rows of each conversation with their number of copies, faults and piece.

    Texts are left behind: a digest stands for them. A row is repeated when an
    earlier turn has its role and text; the other copies of a row are repeats too.
    """
    digest = F.sha2("text", 256).alias("digest")
    solid = F.rtrim(F.translate(F.col("text"), "\t\n\x0b\x0c\r", "     "))
    marks = [(solid == "").alias("blank"), F.coalesce(~F.right(solid, F.lit(1)).isin(".", "!", "?"), F.lit(True)).alias("open")]
    folded = rows.select("conv", "at", "role", digest, *marks).groupBy(*_KEY, "blank", "open").agg(F.count("*").alias("n"))
    first = folded.groupBy("conv", "role", "digest").agg(F.min("at").alias("at")).withColumn("is_first", F.lit(True))
    marked = folded.join(first, _KEY, "left").select(
        *_KEY, "n", F.when(F.col("blank"), "blank").when(F.col("is_first").isNull(), "duplicate")
        .when(F.col("open"), "truncated").alias("fault"))
    order = ["conv", "at", "role", "digest"]
    cut = marked.repartitionByRange(partitions(rows.sparkSession), *order).sortWithinPartitions(*order)
    return stored(cut.withColumn("piece", F.spark_partition_id()), "lines")


def _sorted_pieces(lines: DataFrame, *more: str) -> DataFrame:
    """Lines dealt by piece and in order, flat for Arrow."""
    dealt = lines.repartition(partitions(lines.sparkSession), "conv", "piece").sortWithinPartitions("conv", "piece", "at", "role", "digest")
    return dealt.select(F.col("conv.id").alias("conv"), "piece", F.col("at.turn").alias("turn"), "role", "digest", "n", "fault", *more)


_FIELDS = ["conv", "piece", "turn", "role", "digest", "n", "fault"]


def _codes(run: list[tuple]) -> list[str]:
    """The kind of each line for the program; copies after the first are counted apart."""
    out = []
    for _, _, _, role, _, _, fault, *_ in run:
        if fault in ("blank", "duplicate"):
            out.append(_FORCED)
        else:
            initial = role[:1] if role[:1] in _KEEP else "x"
            out.append(initial + (_TRUNCATED if fault == "truncated" else ""))
    return out


_LEGAL = ("su", "ua", "au")


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Per piece: its cost matrix and what adds up to the figures of a conversation."""
    for (conv, piece), group in _runs(batches, _FIELDS, 2):
        run = list(group)
        counts = dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        illegal, copies, turns, before = 0, 0, 0, None
        for _, _, turn, role, _, n, fault in run:
            if fault == "blank":
                counts["blank"] += n
            else:
                counts["duplicate"] += n if fault == "duplicate" else n - 1
                counts["truncated"] += fault == "truncated"
            copies += n - 1
            initial = role[:1]
            illegal += (n - 1) + (before is not None and before[1] + initial not in _LEGAL)
            turns += turn is not None and (before is None or before[0] != turn)
            before = turn, initial
        known = [r[2] for r in run if r[2] is not None]
        matrix = [x if x < inf else None for x in (y + 3 * copies for y in _matrix(_codes(run)))]
        yield (conv, piece, matrix, *counts.values(), illegal, turns, known[0] if known else None,
               known[-1] if known else None, run[0][3][:1], run[-1][3][:1])


_MEASURED = ("piece int, matrix array<double>, blank long, duplicate long, truncated long, illegal long, turns long, "
             "first_turn long, last_turn long, first_initial string, last_initial string")


def _join_up(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Per piece, last first: the costs behind it; on the first piece the whole conversation's figures."""
    fields = ["conv", *[f.split()[0] for f in _MEASURED.split(", ")]]
    for (conv,), group in _runs(batches, fields, 1):
        vector, taken, last, later, sums = _FINAL, 0.0, True, None, [0] * 5
        held = None
        for _, piece, matrix, *figures in group:
            if held is not None:
                yield (conv, *held, None, None, None, None, None, None)
            turns, low, high, first, end = figures[4:]
            sums = [a + b for a, b in zip(sums, figures[:5])]
            if later is not None:
                sums[3] += end + later[1] not in _LEGAL
                sums[4] -= high is not None and high == later[0]
            top = high if later is None or later[2] is None else later[2]
            held = piece, list(vector), last, False
            costs = [min((inf if (m := matrix[4 * s + e]) is None else m) + vector[e] for e in range(4)) for s in range(4)]
            least = min(costs)
            vector, taken, last = tuple(x - least for x in costs), taken + least, False
            later = (low if low is not None else later[0] if later else None), first, top
        blank, duplicate, truncated, illegal, turns = sums
        gaps = 0 if later[2] is None else later[2] - later[0] + 1 - turns
        yield conv, held[0], held[1], held[2], True, gaps, blank, duplicate, truncated, illegal, int(vector[0] + taken)


_JOINED = ("piece int, costs array<double>, is_last boolean, is_first boolean, gaps long, blank long, duplicate long, "
           "truncated long, illegal long, cost long")


def _exits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Per piece: the state behind it for each state before it."""
    for (conv, piece), group in _runs(batches, [*_FIELDS, "costs"], 2):
        run = list(group)
        codes, end = _codes(run), tuple(run[0][7])
        out = []
        for state in range(4):
            for _, state in _walk(codes, end, state):
                pass
            out.append(state)
        yield conv, piece, out


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Per piece, first first: the state before it."""
    for (conv,), group in _runs(batches, ["conv", "piece", "exits"], 1):
        state = 0
        for _, piece, exits in group:
            yield conv, piece, state
            state = exits[state]


def _made(edits: str, states: list[int]) -> list[dict]:
    """The messages that the edits of a line leave: role (null: its own) and whether the text is its own."""
    return [{"role": None if e == "K" else "user" if s == 2 else "assistant", "own": e != "I"}
            for e, s in zip(edits, states) if e != "D"]


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Per line: its edits, its copies' deletion included, and the messages that they leave."""
    for (conv, piece), group in _runs(batches, [*_FIELDS, "costs", "is_last", "entry"], 2):
        run = list(group)
        codes, state, is_last = _codes(run), run[0][9], run[0][8]
        for i, (edits, after) in enumerate(_walk(codes, tuple(run[0][7]), state)):
            states = [state]
            for e in edits[:-1]:
                states.append(_NEXT[states[-1]])
            states = [*states[1:], after]
            state, tail = after, ""
            edits += "D" * (run[i][5] - 1)
            states += [after] * (run[i][5] - 1)
            if is_last and i == len(run) - 1:
                while state in (1, 2):
                    state, tail = _NEXT[state], tail + "I"
                    states.append(state)
            _, _, turn, role, digest, *_ = run[i]
            yield conv, piece, i, turn, role, digest, edits + tail, _made(edits + tail, states)


_EDITED = ("piece int, pos long, turn long, role string, digest string, edits string, "
           "made array<struct<role:string,own:boolean>>")


def repair(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
           text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The figures of each conversation and the edits of its lines.

    The first frame has per conversation ``conv_col``, ``gaps`` (missing turn
    numbers between the smallest and the largest), ``blank``, ``duplicate``,
    ``truncated`` (rows by their first fault), ``illegal`` (neighbours whose
    initials are not su, ua or au) and ``cost``. The second has per different row
    ``conv_col``, ``piece`` and ``pos`` (its place), ``turn``, ``role``, ``text``
    (null if no message with it stays), ``edits`` and ``made``, the messages left.

    Rows are taken by turn, nulls first, then by role and by the SHA-256 of the text;
    equal rows stand together and all but the first are repeats. Null roles and
    texts count as one space, a null conversation id is an id. An initial other
    than s, u and a, an empty role's too, is never kept. Other columns are not
    read; an empty table gives empty frames.
    """
    kind = dict(turns.dtypes)[conv_col]
    rows = _conversation(turns, conv_col, turn_col, role_col, text_col)
    lines = _lines(rows)
    measured = _streamed(_sorted_pieces(lines), _measure, f"conv {kind}, {_MEASURED}")
    n = partitions(turns.sparkSession)
    key = F.struct(F.col("conv").alias("id")).alias("conv")
    backward = measured.repartition(n, "conv").sortWithinPartitions("conv", F.desc("piece"))
    joined = stored(_streamed(backward, _join_up, f"conv {kind}, {_JOINED}"), "joined")
    checks = joined.select(key, "piece", "costs", "is_last", "is_first")
    split = checks.where("NOT (is_first AND is_last)").select("conv", "piece", "costs")
    exits = _streamed(_sorted_pieces(lines.join(split, ["conv", "piece"]), "costs"), _exits, f"conv {kind}, piece int, exits array<int>")
    forward = exits.repartition(n, "conv").sortWithinPartitions("conv", "piece")
    entries = _streamed(forward, _entries, f"conv {kind}, piece int, entry int").select(key, "piece", "entry")
    entered = checks.join(entries, ["conv", "piece"], "left").withColumn("entry", F.coalesce("entry", F.lit(0)))
    told = lines.join(entered.drop("is_first"), ["conv", "piece"])
    edited = _streamed(_sorted_pieces(told, "costs", "is_last", "entry"), _edited, f"conv {kind}, {_EDITED}")
    named = edited.select(key, F.struct("turn").alias("at"), "role", "digest", "piece", "pos", "edits", "made",
                          F.exists("made", lambda m: m["own"]).alias("stays"))
    texts = rows.withColumn("digest", F.sha2("text", 256)).groupBy(*_KEY).agg(F.first("text").alias("text"))
    log = named.join(texts, _KEY).select(
        F.col("conv.id").alias(conv_col), "piece", "pos", "at.turn", "role", F.when(F.col("stays"), F.col("text")).alias("text"), "edits", "made")
    figures = joined.where("is_first").select(
        F.col("conv").alias(conv_col), "gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return figures, log


def messages(log: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """The repaired conversations: conversation, ``piece``, ``pos``, ``sub`` (the order), ``role``, ``text``."""
    rows = log.select(conv_col, "piece", "pos", "role", "text", F.posexplode("made").alias("sub", "m"))
    return rows.select(conv_col, "piece", "pos", "sub", F.coalesce("m.role", "role").alias("role"),
                       F.when(F.col("m.own"), F.col("text")).otherwise("").alias("text"))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for (conv,), group in _runs(batches, ["conv", "role", "text", "edits", "made"], 1):
        audit, sha, begun = [], hashlib.sha256(), False
        for _, role, text, edits, made in group:
            audit.append(edits)
            for m in made:
                if begun:
                    sha.update(b"\n")
                begun = True
                sha.update(f"{m['role'] or role}:{text if m['own'] else ''}".encode())
        yield conv, "".join(audit), sha.hexdigest()


def digests(log: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """Per conversation ``audit``, all its edits in order, and ``repaired_sha256``.

    The hash is that of the repaired ``role:text``, joined by line feeds. It has to
    be taken in order, so a conversation streams through one task; the task holds
    a batch of rows and the audit.
    """
    kind = dict(log.dtypes)[conv_col]
    in_order = log.withColumnRenamed(conv_col, "conv").repartition(partitions(log.sparkSession), "conv").sortWithinPartitions("conv", "piece", "pos")
    return _streamed(in_order, _hashed, f"{conv_col} {kind}, audit string, repaired_sha256 string")


def damaged(turns: DataFrame) -> DataFrame:
    """Rows of (conv_id, turn, role, text) with planted faults, chosen by the crc32 of ``conv_id:turn``.

    Of 20 remainders, 0 drops the row, 1 empties its text, 2 removes its ``.!?``, 3
    repeats it and 4 makes the role user. Nulls count as one space.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20
    rows = turns.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), fault.alias("_fault")).where("_fault <> 0")
    text = F.when(F.col("_fault") == 1, "").when(F.col("_fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.when(F.col("_fault") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.select("conv_id", "turn", F.when(F.col("_fault") == 4, "user").otherwise(F.col("role")).alias("role"),
                       text.alias("text"), F.explode(copies).alias("_copy")).drop("_copy")


def conversation_digests(turns: DataFrame, rows: DataFrame) -> DataFrame:
    """One row per conversation of ``turns``: figures, audit and hash of the repair of ``rows``.

    A conversation without rows has zeros, an empty audit and the hash of nothing.
    """
    figures, log = repair(rows)
    key = F.struct("conv_id").alias("k")
    done = figures.select(key, "gaps", "blank", "duplicate", "truncated", "illegal", "cost").join(
        digests(log).select(key, "audit", "repaired_sha256"), "k")
    whole = turns.select(key).distinct().join(done, "k", "left")
    zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return whole.select("k.conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"),
                        F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))
