"""Conversation repair against a plain dynamic program over whole strings."""

import hashlib
import random
from collections import Counter
from zlib import crc32

import pytest

from gradeloom.llm.conversation_repair import conversation_digests, damaged, messages, repair
from gradeloom.llm.queries import QUERIES
from plain import SF

TURNS = "conv_id long, turn long, role string, text string"
SPACE = " \t\n\x0b\x0c\r"


def harmed(rows):
    out = []
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        role, text = " " if role is None else role, " " if text is None else text
        n = crc32(key.encode()) % 20
        if n == 0:
            continue
        text = "" if n == 1 else text.translate({ord(c): None for c in ".!?"}) if n == 2 else text
        out += [(conv, turn, "user" if n == 4 else role, text)] * (2 if n == 3 else 1)
    return out


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        own = text.strip(SPACE)
        out.append("blank" if not own else "duplicate" if (role, text) in seen else "truncated" if own[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def cheapest(rows, found):
    """(cost, audit) and the messages left, from the suffixes of the rows."""
    step = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    turn = {0: "u", 1: "u", 2: "a", 3: "u"}
    names = {"u": "user", "a": "assistant"}
    best = {s: c for s, c in zip(range(4), [(0, "", ()), (4, "II", (":user", ":assistant")), (2, "I", (":assistant",)), (0, "", ())])}
    best = {s: (c, a, tuple((m[1:], "") for m in ms)) for s, (c, a, ms) in best.items()}
    for (_, _, role, text), fault in reversed(list(zip(rows, found))):
        own = {}
        for s in range(4):
            c, a, m = best[s]
            ways = [(c + 3, "D" + a, m)]
            if fault not in ("blank", "duplicate"):
                extra = fault == "truncated"
                if (s, role[:1]) in step:
                    c, a, m = best[step[s, role[:1]]]
                    ways.append((c + extra, "K" + a, ((role, text), *m)))
                c, a, m = best[step[s, turn[s]]]
                ways.append((c + 2 + extra, "R" + a, ((names[turn[s]], text), *m)))
            own[s] = min(ways)
        for _ in range(3):
            for s in range(4):
                c, a, m = own[step[s, turn[s]]]
                own[s] = min(own[s], (c + 2, "I" + a, ((names[turn[s]], ""), *m)))
        best = own
    return best[0]


def expected(rows, ids):
    out = {}
    for conv in ids:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (
            r[1] is not None, r[1] or 0, r[2].encode(), hashlib.sha256(r[3].encode()).hexdigest()))
        found = faults(own)
        cost, audit, left = cheapest(own, found)
        turns = {r[1] for r in own} - {None}
        initials = [r[2][:1] for r in own]
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(found.count(f) for f in ("blank", "duplicate", "truncated")),
                     sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit,
                     hashlib.sha256("\n".join(f"{r}:{t}" for r, t in left).encode()).hexdigest())
    return out


FIELDS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def answers(df):
    rows = df.collect()
    out = {r.conv_id: tuple(r[f] for f in FIELDS) for r in rows}
    assert len(out) == len(rows)
    return out


def random_turns(rng, conv, n):
    roles = ["user", "assistant", "system", "tool", "", "User", None, "summary", "user", "assistant"]
    texts = ["a.", "b", "é!", " ", "", None, "c?\n ", "d.x", "　", "a."]
    return [(conv, rng.choice([t, t, t, None, t // 2]), rng.choice(roles), rng.choice(texts) if rng.random() < 0.5 else f"t{rng.random()}.")
            for t in range(n)]


def test_query_equals_plain_code(spark):
    turns = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = answers(QUERIES["op12_conversation_repair"](spark, SF))
    assert got == expected(harmed(turns), {r[0] for r in turns})


def test_random_conversations(spark):
    rng = random.Random(5)
    turns = [t for conv in [*range(80), None] for t in random_turns(rng, conv, rng.randrange(1, 9))]
    turns += [(900, None, "user", "x."), (901, 3, "user", "a." * 60_000), (901, 9, "assistant", "z"), *[(902, 1, "user", "same.")] * 40]
    df = spark.createDataFrame(turns, TURNS)
    assert answers(conversation_digests(df, damaged(df))) == expected(harmed(turns), {t[0] for t in turns})
    plain = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in turns]
    assert answers(conversation_digests(df, df)) == expected(plain, {t[0] for t in turns})


@pytest.mark.parametrize("seed", [1, 2])
def test_hot_conversation_in_pieces(spark, seed):
    rng = random.Random(seed)
    turns = random_turns(rng, 7, 700) + [(7, 5000, "user", "end.")] * 30 + random_turns(rng, 8, 30) + random_turns(rng, 9, 3)
    df = spark.createDataFrame(turns, TURNS)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        figures, log = repair(damaged(df))
        assert log.where("conv_id = 7").agg({"piece": "max"}).first()[0] - log.where("conv_id = 7").agg({"piece": "min"}).first()[0] >= 8
        assert answers(conversation_digests(df, damaged(df))) == expected(harmed(turns), {7, 8, 9})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_messages_and_names(spark):
    rows = [("x", 1, "system", "s."), ("x", 2, "assistant", "hi."), ("y", 1, "user", "q."), ("y", 1, "user", "q.")]
    df = spark.createDataFrame(rows, "name string, n int, who string, what string").selectExpr("*", "1 AS conv", "2 AS text", "3 AS piece")
    figures, log = repair(df, "name", "n", "who", "what")
    left = [tuple(r)[-2:] for r in messages(log, "name").orderBy("name", "piece", "pos", "sub").collect()]
    assert left == [("system", "s."), ("user", ""), ("assistant", "hi."), ("user", "q."), ("assistant", "")]
    assert Counter((r.name, r.cost) for r in figures.collect()) == Counter([("x", 2), ("y", 5)])
    figures, log = repair(df.limit(0), "name", "n", "who", "what")
    assert figures.count() == 0 and messages(log, "name").count() == 0
    empty = spark.createDataFrame([], TURNS)
    assert conversation_digests(empty, damaged(empty)).count() == 0
