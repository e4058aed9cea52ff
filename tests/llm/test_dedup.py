"""Exact, near and substring deduplication against plain code."""

import hashlib
import math
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from gradeloom.llm import substring_dedup
from gradeloom.llm.exact_dedup import drop_exact, exact_groups
from gradeloom.llm.graph import components
from gradeloom.llm.minhash_dedup import drop_near, near_groups
from gradeloom.llm.substring_dedup import _of_several, cut_repeats, matching_spans, repeats
from plain import DOCS, SF, TWINS, frame, groups, repeated, shingles, words


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))


def edited(rng, text, n):
    own = text.split()
    for _ in range(n):
        own[rng.randrange(len(own))] = "zz" + str(rng.randrange(1000))
    return " ".join(own)


def test_exact_groups(spark):
    rows = [(3, "Ab c"), (1, "aB C"), (2, None), (9, ""), (5, "É"), (6, "é"), (7, "aB C"), (7, "aB C"), (8, "x" * 50_000)]
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_groups(frame(spark, rows), keep="max").collect()}
    assert got == {(3, 7, 4, False), (1, 7, 4, False), (7, 7, 4, True), (2, 9, 2, False), (9, 9, 2, True), (5, 5, 1, True), (6, 6, 1, True), (8, 8, 1, True)}
    sha = {r.doc_id: r.text_sha256 for r in exact_groups(frame(spark, rows)).collect()}
    assert sha[1] == hashlib.sha256(b"ab c").hexdigest() and sha[2] == hashlib.sha256(b"").hexdigest()


def test_drop_exact_keeps_columns_and_one_row(spark):
    rows = frame(spark, [(3, "Ab c"), (1, "aB C"), (1, "aB C"), (4, None), (5, "")]).withColumn("_norm", F.lit(1)).withColumn("_id", F.lit(2))
    out = drop_exact(rows)
    assert out.columns == rows.columns and sorted(r.doc_id for r in out.collect()) == [1, 4]
    assert drop_exact(rows.limit(0)).count() == 0


def test_components(spark):
    edges = [(5, 4), (4, 3), (3, 9), (20, 21), (21, 20), (7, 7)] + [(100 + i, 101 + i) for i in range(40)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in (3, 4, 5, 9)} == {3} and got[21] == 20 and got[7] == 7 and got[140] == 100
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_groups_equal_all_pairs(spark):
    rng = random.Random(2)
    base = sentence(rng, 120)
    texts = [(i, edited(rng, base, rng.randrange(9))) for i in range(60)]
    texts += [(100 + i, sentence(rng, rng.randrange(1, 40))) for i in range(40)]
    texts += [(200, None), (201, ""), (202, " \n"), (203, "one two"), (204, "ONE two"), (205, "one two three"), (206, "ab " * 4000), (207, "ab " * 3000)]
    for size in (4, 5):
        got = near_groups(frame(spark, texts), size=size).collect()
        sets = {i: shingles(t, size) for i, t in texts}
        assert {r.doc_id: r.component_id for r in got} == groups(sets, 80)
        assert all(r.n_shingles == len(sets[r.doc_id]) and r.kept == (r.doc_id == r.component_id) for r in got)


def test_words_made_to_collide_link_nothing(spark):
    """Two words whose polynomial hashes are equal are two words."""
    rng = random.Random(6)
    own = [TWINS[0] if rng.random() < 0.5 else "q" + str(i) for i in range(60)]
    texts = [(1, TWINS[0]), (2, TWINS[1]), (3, " ".join(own)), (4, " ".join(TWINS[1] if w == TWINS[0] else w for w in own)), (5, TWINS[0])]
    assert {r.doc_id: r.component_id for r in near_groups(frame(spark, texts), size=4).collect()} == {1: 1, 2: 2, 3: 3, 4: 4, 5: 1}
    assert repeats(frame(spark, texts[2:4])).count() == 0


def test_near_groups_join_chains_past_the_hubs(spark):
    """Neighbours of a chain are linked, others are not: hubs alone do not join it."""
    rng = random.Random(12)
    own = sentence(rng, 700).split()
    texts = [(i, " ".join(own[5 * i : 5 * i + 100])) for i in rng.sample(range(120), 120)]
    sets = {i: shingles(t, 4) for i, t in texts}
    want = groups(sets, 80)
    assert len(set(want.values())) < 10
    for hubs in (1, 3):
        assert {r.doc_id: r.component_id for r in near_groups(frame(spark, texts), size=4, hubs=hubs).collect()} == want


def test_near_groups_on_given_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sets = {r.doc_id: shingles(r.text, 4) for r in docs.collect()}
    assert {r.doc_id: r.component_id for r in near_groups(docs, size=4).collect()} == groups(sets, 80)


def test_drop_near(spark):
    rng = random.Random(3)
    base = sentence(rng, 100)
    docs = frame(spark, [(2, base), (5, edited(rng, base, 1)), (6, sentence(rng, 50)), (7, None), (8, ""), (None, base)]).withColumn("rep", F.lit(1)).withColumn("node", F.lit(1))
    out = drop_near(docs)
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} == {2, 6, 7, 8, None}
    assert drop_near(docs.limit(0)).count() == 0


def test_repeats_find_planted_passages(spark):
    rng = random.Random(4)
    passage, other = sentence(rng, 60), sentence(rng, 55)
    line = sentence(rng, 20)
    texts = [(1, f"{sentence(rng, 30)} {passage} {sentence(rng, 80)}"), (2, sentence(rng, 300)), (3, f"{passage.upper()}\n{sentence(rng, 10)}"),
             (4, f"{sentence(rng, 90)} {edited(rng, passage, 1)}"), (5, f"{line} {sentence(rng, 60)}"), (6, f"{line} {sentence(rng, 60)}"),
             (7, other), (8, other), (9, None), (10, ""), (11, sentence(rng, 49)), (12, f"{passage} {passage}")]
    rows = repeats(frame(spark, texts)).collect()
    assert {r.doc_id for r in rows} == {3, 4, 8, 12}
    assert {r.first_doc_id for r in rows if r.doc_id != 8} == {1}
    covered = {i: set() for i, _ in texts}
    for r in rows:
        covered[r.doc_id].update(range(r.start_word, r.start_word + r.n_words))
    for i, starts in repeated(texts).items():
        assert all(covered[i] >= set(range(a, a + 50)) for a in starts)
    out = {r.doc_id: r for r in cut_repeats(frame(spark, texts), repeats(frame(spark, texts)), length_col="n_chars").collect()}
    assert set(out) == {1, 2, 3, 4, 5, 6, 7, 9, 10, 11} and len(words(out[3].text)) == 10
    assert out[1].text == texts[0][1] and out[3].n_chars == len(out[3].text)


def test_repeats_on_given_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    covered = {i: set() for i, _ in texts}
    for r in repeats(docs).collect():
        covered[r.doc_id].update(range(r.start_word, r.start_word + r.n_words))
    exact = repeated(texts)
    assert all(covered[i] for i, starts in exact.items() if starts)
    missed = sum(not covered[i] >= set(range(a, a + 50)) for i, starts in exact.items() for a in starts)
    assert missed <= 0.01 * sum(map(len, exact.values()))
    assert repeats(spark.createDataFrame([], DOCS)).count() == 0


def test_repeats_meet_members_that_are_settled(spark):
    """The third document shares its passage with the second, which the first settles."""
    rng = random.Random(6)
    texts = []
    for i in range(0, 120, 3):
        before, passage, behind = sentence(rng, 40), sentence(rng, 48), sentence(rng, 6)
        texts += [(i, f"{before} {passage} {sentence(rng, 60)}"), (i + 1, f"{before} {passage} {behind} {sentence(rng, 60)}"),
                  (i + 2, f"{sentence(rng, 60)} {passage} {behind} {sentence(rng, 60)}")]
    # The first document has the passage twice, each time with other words around it.
    for i in range(200, 280, 2):
        passage, behind = sentence(rng, 48), sentence(rng, 6)
        texts += [(i, f"{sentence(rng, 60)} {passage} {sentence(rng, 60)} {passage} {behind}"), (i + 1, f"{sentence(rng, 60)} {passage} {behind} {sentence(rng, 60)}")]
    covered = {i: set() for i, _ in texts}
    for r in repeats(frame(spark, texts)).collect():
        covered[r.doc_id].update(range(r.start_word, r.start_word + r.n_words))
    assert all(covered[i] >= set(range(a, a + 50)) for i, starts in repeated(texts).items() for a in starts)


def test_a_common_passage_in_many_surroundings_makes_no_pairs(spark, monkeypatch):
    rng = random.Random(8)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    common, n = words(70), 60
    texts = [(i, " ".join([*words(40), *common, *words(40)])) for i in range(n)]
    lines = []

    def counted(df, name, real=substring_dedup.stored):
        out = real(df, name)
        if name.endswith("-lines"):
            lines.append(out.count())
        return out

    monkeypatch.setattr(substring_dedup, "stored", counted)
    found = {r.doc_id: (r.start_word, r.n_words, r.first_doc_id) for r in repeats(frame(spark, texts)).collect()}
    assert len(found) == n - 1 and set(found.values()) == {(40, 70, 0)}
    assert sum(lines) <= 4 * n  # before: some n * n / 2


def test_repeats_miss_no_exact_passage(spark):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    covered = {i: set() for i, _ in texts}
    for r in repeats(frame(spark, texts)).collect():
        covered[r.doc_id].update(range(r.start_word, r.start_word + r.n_words))
    assert all(covered[i] >= set(range(a, a + 50)) for i, starts in repeated(texts).items() for a in starts)

def test_repeats_find_passages_with_a_word_more_or_less(spark):
    rng = random.Random(9)
    for kind in ("changed", "inserted", "deleted"):
        texts = []
        for i in range(0, 200, 2):
            own = sentence(rng, 50 + (kind == "deleted")).split()
            at = rng.randrange(5, 45)
            copy = own[:at] + ([] if kind == "deleted" else ["zz"]) + own[at + (kind != "inserted") :]
            texts += [(i + j, f"{sentence(rng, 60)} {' '.join(w)} {sentence(rng, 60)}") for j, w in enumerate((own, copy))]
        assert len({r.doc_id for r in repeats(frame(spark, texts)).collect()}) >= 95, kind



def spans_of(pairs, t, similarity):
    """matching_spans over (x, y, line) triples, per triple."""
    column = lambda k: pa.array([np.asarray(p[k]).astype("<u4").tobytes() for p in pairs], pa.binary())
    out = [[] for _ in pairs]
    for i, *span, _, _ in zip(*matching_spans(column(0), column(1), np.array([p[2] for p in pairs]), t, similarity)):
        out[i].append(tuple(int(v) for v in span))
    return out


def plain_spans(x, y, line, t, similarity):
    place = []
    for i, token in enumerate(x):
        near = [j for j, other in enumerate(y) if other == token and abs(j - i - line) <= t]
        place.append(min(near, key=lambda j: (abs(j - i - line), -j), default=None))
    need = math.ceil(2 * t * similarity / (1 + similarity) - 1e-9)
    covered = set()
    if len(y) >= t:
        for a in range(len(x) - t + 1):
            if sum(p is not None for p in place[a : a + t]) >= need:
                covered |= set(range(a, a + t))
    out = []
    for a in sorted(covered):
        if a - 1 not in covered:
            b = a
            while b + 1 in covered:
                b += 1
            hits = [i for i in range(a, b + 1) if place[i] is not None]
            out.append((hits[0], hits[-1], place[hits[0]]))
    return out


def test_matching_spans_follow_the_line():
    x = np.arange(100, 200)
    y = np.concatenate([np.arange(5), x[20:90]])
    assert spans_of([(x, y, 5 - 20), (x, y[:30], 5 - 20), (x, [], 0), ([], y, 0)], 46, 0.8) == [[(20, 89, 5)], [], [], []]
    assert spans_of([], 46, 0.8) == []


def test_matching_spans_of_many_lines_equal_plain_code():
    rng = random.Random(4)
    pairs = []
    for _ in range(300):
        x = [rng.randrange(rng.choice([3, 50, 2**32 - 1])) for _ in range(rng.randrange(60))]
        y = [rng.randrange(9) for _ in range(rng.randrange(20))] + [t if rng.random() < 0.9 else rng.randrange(99) for t in x[rng.randrange(9):]]
        if rng.random() < 0.5 and y:
            y.insert(rng.randrange(len(y)), 7)
        pairs.append((x, y, rng.randrange(-12, 20)))
    for t in (5, 12):
        want = [plain_spans(*p, t, 0.8) for p in pairs]
        assert spans_of(pairs, t, 0.8) == want and sum(map(len, want)) > 60


def test_keys_of_one_document_go_wherever_batches_are_cut():
    rng = random.Random(8)
    rows = sorted((rng.randrange(40), rng.choice([1, 1, 1, 2, 3])) for _ in range(90))
    rows += [(50, d) for d in (4, 4, 4, 4, 5)] + [(51, 4)] * 6 + [(52, 4)] * 3 + [(53, 1), (53, 2)]
    want = [r for r in rows if len({d for k, d in rows if k == r[0]}) > 1]
    for size in (1, 2, 3, 7, 1000):
        batches = [pa.record_batch([pa.array([k for k, _ in part]), pa.array([d for _, d in part])], names=["key", "doc_id"])
                   for part in (rows[i : i + size] for i in range(0, len(rows), size))]
        got = [(k, d) for b in _of_several(iter(batches)) for k, d in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
        assert got == want

