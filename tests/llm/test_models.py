"""Language identification, toxicity and main-text extraction."""

import random
import re

import numpy as np
from pyspark.sql import functions as F

from gradeloom.llm import html_extract, language_id, toxicity
from gradeloom.llm.dom import Page
from plain import DOCS, SF, frame

SF2 = "/root/testdata/sf0.01"


def test_languages_held_out(spark):
    docs = spark.read.parquet(f"{SF2}/documents.parquet")
    test = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = language_id.train(docs.where(~test))
    assert model.families == ["germanic", "romance"]
    got = language_id.identify(docs.where(test), model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r.lang_pred == r.lang for r in got]) > 0.97 and all(0 <= r.score <= 1 for r in got)
    odd = frame(spark, [(1, None), (2, ""), (3, "12 !?"), (4, "der und die " * 20_000)])
    assert {r.doc_id: r.lang_pred for r in language_id.identify(odd, model).collect()} == {1: "und", 2: "und", 3: "und", 4: "de"}
    assert language_id.identify(odd.limit(0), model).count() == 0


def test_languages_without_or_with_one_language(spark):
    empty = spark.createDataFrame([], DOCS)
    rows = frame(spark, [(1, "some text"), (2, None)])
    assert {r.lang_pred for r in language_id.identify(rows, language_id.train(empty)).collect()} == {"und"}
    assert {r.lang_pred for r in language_id.identify(rows, language_id.train(rows)).collect()} == {"en", "und"}


def test_every_language_is_learned(spark):
    rng = random.Random(5)
    words = {f"x{i:02d}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(4)] for i in range(68)}
    rows = [(10 * i + k, " ".join(rng.choice(words[lang]) for _ in range(20)), lang, "s", 1) for i, lang in enumerate(words) for k in range(3)]
    docs = spark.createDataFrame(rows, DOCS)
    got = {r.doc_id: r.lang_pred for r in language_id.identify(docs, language_id.train(docs)).collect()}
    assert got == {r[0]: r[2] for r in rows}


def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    test = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = toxicity.train(docs, labels.where(~test))
    got = toxicity.score_ids(docs, model).join(labels.where(test), "doc_id").collect()
    said = [(r.toxic, r.score >= 0.5) for r in got]
    assert said.count((0, True)) <= 3 and said.count((1, False)) <= 0.2 * sum(t for t, _ in said)


def test_machine_learns_a_pair(spark):
    """Two words are harmless each and toxic together; a linear score cannot say that."""
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(1200):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        text = " ".join([f"w{rng.randrange(30)}" for _ in range(6)] + ["clod"] * a + ["folk"] * b)
        rows.append((i, text))
        labels.append((i, int(a and b)))
    docs, marks = frame(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(docs, marks, epochs=25)
    score = {r.doc_id: r.score for r in toxicity.score_ids(frame(spark, [(1, "clod w1"), (2, "folk w2"), (3, "clod folk"), (4, None), (5, "")]), model).collect()}
    assert score[3] > 0.5 > max(score[1], score[2]) and score[4] == score[5] < 0.5
    kept = toxicity.drop_toxic(frame(spark, [(1, "clod w1"), (3, "clod folk"), (4, None)]).withColumn("score", F.lit(9)), model)
    assert {(r.doc_id, r.score) for r in kept.collect()} == {(1, 9), (4, 9)}


def test_machine_learns_a_pair_of_balanced_words(spark):
    """The label is one if a text has exactly one of two words; neither tells anything alone."""
    rng = random.Random(4)

    def text(a, b):
        own = [f"w{rng.randrange(30)}" for _ in range(6)] + ["clod"] * a + ["folk"] * b
        rng.shuffle(own)
        return " ".join(own)

    marks = [(rng.random() < 0.5, rng.random() < 0.5) for _ in range(4000)]
    docs = frame(spark, [(i, text(a, b)) for i, (a, b) in enumerate(marks)])
    labels = spark.createDataFrame([(i, int(a != b)) for i, (a, b) in enumerate(marks) if i < 3000], "doc_id long, toxic int")
    score = {r.doc_id: r.score for r in toxicity.score_ids(docs, toxicity.train(docs, labels)).collect()}
    assert np.mean([(score[i] >= 0.5) == (marks[i][0] != marks[i][1]) for i in range(3000, 4000)]) > 0.9


def test_machine_scores_are_the_sum_over_pairs(spark):
    """The scores of odd texts against the formula, pair by pair; repeated rows score alike."""
    rng = np.random.RandomState(8)
    model = toxicity.FactorizationMachine(-0.5, rng.normal(0, 0.3, toxicity.TABLE).astype(np.float32), rng.normal(0, 0.3, (toxicity.TABLE, toxicity.RANK)).astype(np.float32))
    texts = [None, "", "Clod folk", "clod, FOLK clod", "idiotic İstanbul naïve 12", "a b " * 50_000 + "c", "clod, FOLK clod"]

    def plain(text):
        words = [w for w in re.split(rb"[^0-9A-Za-z\x80-\xff]+", (text or "").encode()) if w]
        raw = np.frombuffer(b" ".join(words), dtype=np.uint8)
        own = sorted(set(toxicity.places(raw, np.array([0, len(raw)]))[1].tolist()))
        z = model.bias + sum(float(model.weights[i]) for i in own)
        z += sum(float(model.factors[i].astype(float) @ model.factors[j].astype(float)) for n, i in enumerate(own) for j in own[n + 1 :])
        return 1 / (1 + np.exp(-z))

    got = {r.doc_id: r.score for r in toxicity.score_ids(frame(spark, list(enumerate(texts))), model).collect()}
    assert all(abs(got[i] - plain(t)) < 1e-5 for i, t in enumerate(texts)) and got[3] == got[6] and abs(got[2] - got[3]) < 1e-9


def test_long_texts_teach_with_drawn_terms(spark):
    texts = [(i, " ".join(f"x{i}y{k}" for k in range(300)) + (" clod" if i % 2 else " fine")) for i in range(40)]
    docs, labels = frame(spark, texts), spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    assert len(toxicity._drawn(np.arange(1000), 64)) == 64 and toxicity._drawn(np.arange(10), 64).tolist() == list(range(10))
    assert not np.array_equal(toxicity._drawn(np.arange(1000), 64), toxicity._drawn(np.arange(1, 1001), 64))
    for most in (64, 4096):
        model = toxicity.train(docs.repartition(3), labels, max_terms=most)
        again = toxicity.train(docs.repartition(7), labels, max_terms=most)
        assert model.bias == again.bias and np.array_equal(model.weights, again.weights) and np.array_equal(model.factors, again.factors)


def test_toxicity_without_labels(spark):
    docs = frame(spark, [(1, "a"), (2, None)])
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in toxicity.score_ids(docs, toxicity.train(docs, none)).collect()} == {0.5}
    one = spark.createDataFrame([(1, 0), (2, 0), (2, None)], "doc_id long, toxic int")
    assert all(r.score < 0.5 for r in toxicity.score_ids(docs, toxicity.train(docs, one)).collect())
    assert toxicity.score_ids(docs.limit(0), toxicity.train(docs, one)).count() == 0


def test_page_reader():
    page = Page("<div class='a b-c'><p>x<b>y</b><p>z &amp; w<!-- <p> --><script>var t='</p>';</script></div>tail<br>end")
    assert page.tags == ["#page", "div", "p", "b", "p", "script", "br"] and page.tokens[1] == ("a", "b", "c")
    assert html_extract.text_of(page, [t != "script" for t in page.tags]) == "xy z & w tail end"
    assert Page("a < b and <i").texts and Page("").tags == ["#page"]


def test_size_of_a_page_changes_no_description():
    deep = "".join(f'<div class="{chr(97 + i % 26)}{chr(97 + i // 26)}q">' for i in range(80))
    page = Page(f"<div class='comments'>{deep}<p>x</p>")
    _, marks, _ = html_extract.describe(page)
    place = html_extract._PLACES + html_extract.zlib.crc32(b"comments") % html_extract._PLACES
    assert {e for e, at in marks if at == place} >= set(range(2, len(page.tags)))
    rows, _, _ = html_extract.describe(Page("<div>" + "<p>a</p><h2>b</h2>" * 30 + "</div>"))
    assert {r[17] for r in rows[2:]} == {30}


def test_decoding_keeps_nothing_in_what_is_dropped():
    page = Page("<div><p>a</p></div><div><p>b</p></div>")
    kept = html_extract.decide(page, np.array([0, -9, 3, 5, -1]), [False] * 5)
    assert kept == [True, False, False, True, False]


def test_main_text(spark):
    pages = spark.read.parquet(f"{SF2}/pages.parquet")
    model = html_extract.train(pages)
    got = {r.page_id: r for r in html_extract.extract(pages, model).collect()}
    right = 0
    for r in pages.collect():
        page = Page(r.html)
        state = [False] * len(page.tags)
        for e in range(1, len(page.tags)):
            state[e] = state[page.parents[e]] or page.tags[e] == "article"
        state[0] = False
        right += html_extract.text_of(page, state) == got[r.page_id].text
        assert got[r.page_id].n_chars == len(got[r.page_id].text)
    assert right >= 0.98 * len(got)
    para = "A long paragraph of the story, with commas, and so on. It has a second sentence as well, which says more."
    html = (f'<html><body><div class="topnav"><a href="#">Home</a> <a href="#">News</a></div><div class="post-content"><h1>Head</h1><p>{para}</p><p>{para}</p></div>'
            f'<div class="sidebar"><ul><li><a href="#">Other</a><li><a href="#">More</a></ul></div><div id="comments"><div class="comment"><p>{para}</p></div></div></body></html>')
    odd = spark.createDataFrame([(1, "u", html, 5), (2, None, None, 5), (3, "u", "", 5), (4, "u", "<" * 2000, 5)], "page_id long, url string, html string, text int")
    texts = {r.page_id: r.text for r in html_extract.extract(odd, model).collect()}
    assert texts[1] == f"Head {para} {para}" and texts[2] == texts[3] == ""
    assert html_extract.extract(odd.limit(0), model).count() == 0
