"""Main text of web pages by gradient-boosted trees over the elements.

Every element is described by the text, links and markup in its subtree, its
depth, its place among its siblings, its tag and the words of its own attributes
and of those around it.
Boosted trees give the probability that it holds main text. The choice for the
whole page is the most probable one in which nothing is kept inside what is
dropped, found from the leaves to the root.

The trees learn from a bounded sample of the given pages: from the parts that the
pages' own markup names (article, navigation, footer), and from the same texts
set into other layouts, where the parts are told by attribute words and shape
alone, so that pages without such markup are read as well.
"""

from __future__ import annotations

import random
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeloom.llm.dom import BLOCKS, HIDDEN, Page

#: Bounds of the fit: pages and characters of each that take part. They hold for the fit alone.
SAMPLE_PAGES, SAMPLE_CHARS, LAYOUTS = 200, 20_000, 3
_TREES, _DEPTH, _BINS, _PLACES = 60, 5, 24, 2048
_TAGS = "a article aside b blockquote body button dd div dl dt em fieldset figcaption figure footer form h1 h2 h3 header hr html i img input label li main nav ol p pre section select small span strong table td th tr ul".split()
_TAG_AT = {t: i for i, t in enumerate(_TAGS)}
_NUMBERS = 20


def describe(page: Page, wanted: int = -1) -> tuple[np.ndarray, list[tuple[int, int]], list[bool]]:
    """Numbers of every element, its (element, place) marks, and which are hidden.

    Words around an element are marked at the places that are bits of ``wanted``.
    """
    tags, parents, n = page.tags, page.parents, len(page.tags)
    own, links, stops, before = [0] * n, [0] * n, [0] * n, [0] * n
    hidden = [False] * n
    depth, in_link = [0] * n, [False] * n
    for e in range(1, n):
        p = parents[e]
        depth[e] = depth[p] + 1
        hidden[e] = hidden[p] or tags[e] in HIDDEN
        in_link[e] = in_link[p] or tags[e] == "a"
    total = 0
    starts = [-1] * n
    for e, text in page.texts:
        if hidden[e]:
            continue
        size = len(text.strip())
        if not size:
            continue
        own[e] += size
        if in_link[e]:
            links[e] += size
        stops[e] += sum(map(text.count, ".,;:!?"))
        up = e
        while up >= 0 and starts[up] < 0:
            starts[up] = total
            up = parents[up]
        total += size
    text, inside, paragraphs, fields, items, blocks = own[:], [1] * n, [0] * n, [0] * n, [0] * n, [0] * n
    children: list[list[int]] = [[] for _ in range(n)]
    for e in range(n - 1, 0, -1):
        p, tag = parents[e], tags[e]
        paragraphs[e] += tag == "p"
        fields[e] += tag in ("input", "form", "button", "select", "textarea", "label")
        items[e] += tag == "li"
        blocks[e] += tag in BLOCKS
        for column in (text, links, stops, inside, paragraphs, fields, items, blocks):
            column[p] += column[e]
        children[p].append(e)
    rows = np.zeros((n, _NUMBERS))
    marks: list[tuple[int, int]] = []
    for p in range(n):
        own_children = children[p][::-1]
        count = len(own_children)
        alike = Counter(tags[c] for c in own_children)
        for i, e in enumerate(own_children):
            t = text[e]
            rows[e] = (depth[e], t, own[e], links[e] / (t + 1), inside[e], t / inside[e], i, count, count - i, t / (text[p] + 1), t / (total + 1),
                       stops[e] / (t + 1), t / (blocks[e] + 1), paragraphs[e], fields[e], text[own_children[i - 1]] if i else -1,
                       text[own_children[i + 1]] if i + 1 < count else -1, alike[tags[e]], items[e], starts[e] / (total + 1))
    # The words around an element as bits, which it hands on; equal ones are listed once.
    above = [0] * n
    listed: dict[int, list[int]] = {}
    for e in range(1, n):
        marks.append((e, _TAG_AT.get(tags[e], len(_TAGS))))
        marks.append((e, 64 + _TAG_AT.get(tags[parents[e]], len(_TAGS))))
        for word in page.tokens[e]:
            marks.append((e, 128 + zlib.crc32(word.encode()) % (_PLACES - 128)))
        outer = above[parents[e]]
        for word in page.tokens[parents[e]]:
            outer |= 1 << zlib.crc32(word.encode()) % _PLACES & wanted
        above[e] = outer
        if outer not in listed:
            listed[outer] = [_PLACES + i for i, bit in enumerate(reversed(f"{outer:b}")) if bit == "1"]
        marks.extend((e, place) for place in listed[outer])
    return rows, marks, hidden


@dataclass
class BoostedTrees:
    """Complete binary trees: feature, threshold and value of every node."""

    places: np.ndarray
    base: float = 0.0
    features: list[np.ndarray] = field(default_factory=list)
    thresholds: list[np.ndarray] = field(default_factory=list)
    values: list[np.ndarray] = field(default_factory=list)

    def matrix(self, rows: np.ndarray, marks: list[tuple[int, int]]) -> np.ndarray:
        x = np.zeros((len(rows), _NUMBERS + len(self.places)))
        x[:, :_NUMBERS] = rows
        if marks and len(self.places):
            e, place = np.array(marks).T
            at = np.minimum(np.searchsorted(self.places, place), len(self.places) - 1)
            hit = self.places[at] == place
            x[e[hit], _NUMBERS + at[hit]] = 1
        return x

    def logits(self, x: np.ndarray) -> np.ndarray:
        out, line = np.full(len(x), self.base), np.arange(len(x))
        for f, t, v in zip(self.features, self.thresholds, self.values):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(_DEPTH):
                node = 2 * node + 1 + (x[line, f[node]] > t[node])
            out += v[node]
        return out


def boost(model: BoostedTrees, x: np.ndarray, y: np.ndarray, trees: int = _TREES, rate: float = 0.2, ridge: float = 1.0) -> BoostedTrees:
    """Fit the trees to labels by second-order steps of the logistic loss."""
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, _BINS + 1)[1:-1])) if j < _NUMBERS else np.array([0.5]) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)])
    model.base = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    out = np.full(len(y), model.base)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-out))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        size = 2 ** (_DEPTH + 1) - 1
        feature, threshold, value = np.zeros(size, dtype=np.int64), np.full(size, np.inf), np.zeros(size)
        node = np.zeros(len(y), dtype=np.int64)
        for level in range(_DEPTH):
            first, wide = 2**level - 1, 2**level
            local = node - first
            best = np.full(wide, 1e-3)
            for j, c in enumerate(cuts):
                bins = len(c) + 1
                at = local * bins + binned[j]
                sg = np.bincount(at, weights=g, minlength=wide * bins).reshape(wide, bins).cumsum(1)
                sh = np.bincount(at, weights=h, minlength=wide * bins).reshape(wide, bins).cumsum(1)
                tg, th = sg[:, -1:], sh[:, -1:]
                gain = sg**2 / (sh + ridge) + (tg - sg) ** 2 / (th - sh + ridge) - tg**2 / (th + ridge)
                gain[:, -1] = 0
                top = gain.argmax(1)
                top_gain = gain[np.arange(wide), top]
                better = top_gain > best
                best[better] = top_gain[better]
                feature[first : first + wide][better] = j
                threshold[first : first + wide][better] = c[np.minimum(top, len(c) - 1)][better]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > threshold[node])
        sg, sh = np.bincount(node, weights=g, minlength=size), np.bincount(node, weights=h, minlength=size)
        value = -rate * sg / (sh + ridge)
        out += value[node]
        model.features.append(feature)
        model.thresholds.append(threshold)
        model.values.append(value)
    return model


def decide(page: Page, logits: np.ndarray, hidden: list[bool]) -> list[bool]:
    """The most probable choice in which a dropped element keeps nothing inside."""
    n = len(page.tags)
    keep, drop = -np.logaddexp(0, -logits), -np.logaddexp(0, logits)
    keep[0] = 0.0
    with_inner, without = keep.tolist(), drop.tolist()
    for e in range(n - 1, 0, -1):
        p = page.parents[e]
        without[p] += without[e]
        with_inner[p] += max(with_inner[e], without[e]) if not hidden[e] else without[e]
    kept = [True] + [False] * (n - 1)
    for e in range(1, n):
        kept[e] = kept[page.parents[e]] and not hidden[e] and with_inner[e] > without[e]
    return kept


def text_of(page: Page, kept: list[bool]) -> str:
    """Texts of the kept elements; blocks part words, white space is one space."""
    out = []
    for i, (e, text) in enumerate(page.texts):
        if i in page.breaks:
            out.append(" ")
        if kept[e]:
            out.append(text)
        elif out and out[-1] != " ":
            out.append(" ")
    return " ".join("".join(out).split())


# Layouts for the fit. Attribute words name the usual parts of a page.
_PARTS = {
    "menu": "nav menu navbar navigation topnav links breadcrumb breadcrumbs pagination pager tabs toc",
    "header": "header masthead branding banner top site logo topbar",
    "footer": "footer colophon bottom copyright legal credits foot",
    "side": "sidebar aside widget related recommended popular trending secondary rail more teaser",
    "advert": "ad ads advert advertisement sponsor sponsored promo promotion adsense banner",
    "notice": "cookie consent notice alert gdpr popup modal overlay paywall banner message",
    "form": "form newsletter subscribe signup login search contact poll",
    "share": "share social sharing follow buttons toolbar meta tags byline",
    "comments": "comments comment replies reply respond discussion disqus responses thread",
}
_MAIN = "article content main post entry story body text page maincontent single prose"
_WRAP = "container wrapper inner row col grid layout box section holder"


def _layout(rng: random.Random, title: str, paragraphs: list[str], filler: list[str]) -> str:
    """A page with the given main text in a random layout; data-y marks the parts."""

    def pick(words: str) -> str:
        name = rng.choice(words.split())
        return name if rng.random() < 0.6 else f"{name}{rng.choice('-_')}{rng.choice(_WRAP.split())}" if rng.random() < 0.6 else f"{rng.choice(['c', 'm', 'site', 'js', 'the'])}-{name}"

    def open_(tag: str, words: str, y: int | None) -> str:
        attribute = rng.choice(["class", "class", "class", "id"])
        named = f' {attribute}="{pick(words)}"' if words and rng.random() < 0.93 else ""
        return f"<{tag}{named}" + (f' data-y="{y}"' if y is not None else "") + ">"

    def some(low: int, high: int) -> str:
        words = rng.choice(filler).split() or ["x"]
        at = rng.randrange(len(words))
        return " ".join((words[at:] + words)[: rng.randint(low, high)])

    def part(kind: str) -> str:
        semantic = {"menu": "nav", "header": "header", "footer": "footer", "side": "aside", "form": "form", "comments": "section"}.get(kind, "div")
        tag = semantic if rng.random() < 0.4 else rng.choice(["div", "div", "section", "ul" if kind == "menu" else "div"])
        out = [open_(tag, _PARTS[kind], 0)]
        if kind in ("menu", "share") or (kind in ("side", "header", "footer") and rng.random() < 0.6):
            items = "".join(f'<li><a href="#">{some(1, 4)}</a></li>' if rng.random() < 0.8 else f'<a href="#">{some(1, 3)}</a> ' for _ in range(rng.randint(2, 9)))
            out.append(items if tag == "ul" else f"<ul>{items}</ul>")
        if kind in ("advert", "notice", "footer", "header", "side"):
            inner = rng.choice(["p", "div", "span", ""])
            line = some(3, 30)
            out.append(f"<{inner}>{line}</{inner}>" if inner else line)
        if kind == "form":
            out.append(f"<label>{some(1, 4)}</label><input><p>{some(3, 15)}</p><button>{some(1, 2)}</button>")
        if kind == "comments":
            out.append(f"<h3>{some(1, 3)}</h3>" if rng.random() < 0.7 else "")
            for _ in range(rng.randint(1, 6)):
                inner = rng.choice(["p", "div", "p"])
                item = rng.choice(["li", "div", "article"])
                out.append(open_(item, _PARTS["comments"], None) + f"<{inner}>{some(4, 60)}</{inner}></{item}>")
        return "".join(out) + f"</{tag}>"

    def maybe(kinds: str, share: float) -> str:
        return "".join(part(k) for k in kinds.split() if rng.random() < share)

    main = []
    title = " ".join(title.split()[: rng.choice([1, 2, 4, 8, 30])])
    if title:
        heading = rng.choice(["h1", "h1", "h2"])
        head = f"<{heading}>{title}</{heading}>"
        main.append(f"<header>{head}</header>" if rng.random() < 0.2 else head)
    for text in paragraphs:
        shape = rng.random()
        if shape < 0.75:
            main.append(f"<p>{text}</p>" if rng.random() < 0.7 else f"<p><b>{text[: len(text) // 3]}</b>{text[len(text) // 3 :]}</p>")
        elif shape < 0.85:
            main.append(f"<div>{text}</div>")
        elif shape < 0.9:
            main.append("<ul>" + "".join(f"<li>{s}</li>" for s in text.split(". ")) + "</ul>")
        elif shape < 0.95:
            main.append(f"<blockquote><p>{text}</p></blockquote>")
        else:
            main.append(f"<h2>{text[:40]}</h2><p>{text}</p>")
        if rng.random() < 0.12:
            main.append(part(rng.choice(["advert", "share", "form", "side", "notice"])))
    tag = rng.choice(["article", "main", "div", "div", "section", "td"])
    if rng.random() < 0.1:  # no element around the text
        bare = "".join(f'<p data-y="1">{text}</p>' for text in paragraphs)
        return "<body>" + maybe("notice menu", 0.5) + bare + maybe("form footer", 0.5) + "</body>"
    inner = open_(tag, _MAIN, 1) + maybe("share", 0.2) + "".join(main) + maybe("share advert comments", 0.25) + f"</{tag}>"
    for _ in range(rng.randint(0, 3)):
        inner = open_("div", _WRAP if rng.random() < 0.7 else _MAIN, 2) + maybe("menu side advert", 0.15) + inner + maybe("side advert comments form", 0.2) + "</div>"
    return (f"<html><head><title>{title}</title></head><body>" + maybe("notice header menu advert", 0.55) + inner + maybe("comments side form notice advert footer", 0.5) + "</body></html>")


def _own_labels(page: Page) -> np.ndarray | None:
    """Labels that a page's own markup gives; None if it names no article.

    1 is in or around the main text, 0 beside it; comments and the like inside an
    article are named by their attributes.
    """
    names = {"nav", "footer", "aside", "form", "script", "style", "head", "noscript"}
    words = {w for key in ("menu", "footer", "side", "advert", "notice", "form", "comments") for w in _PARTS[key].split()} - {"top", "more", "foot", "bottom", "message", "links"}
    n = len(page.tags)
    state = np.zeros(n, dtype=np.int64)  # 1 inside an article, -1 inside something else
    for e in range(1, n):
        above = state[page.parents[e]]
        tag = page.tags[e]
        if above == -1 or tag in names or (tag == "header" and above != 1) or words & set(page.tokens[e]):
            state[e] = -1
        elif above == 1 or tag in ("article", "main"):
            state[e] = 1
    if not (state == 1).any():
        return None
    label = (state == 1).astype(np.int64)
    for e in range(n - 1, 0, -1):
        if label[e] and state[page.parents[e]] == 0:
            label[page.parents[e]] = 1
    return label


def _layout_labels(page: Page) -> np.ndarray:
    n = len(page.tags)
    state = [None] * n
    for e in range(1, n):
        state[e] = page.marks[e] if page.marks[e] in ("0", "1") else state[page.parents[e]]
    label = np.array([s == "1" for s in state], dtype=np.int64)
    for e in range(n - 1, 0, -1):
        if label[e] and state[page.parents[e]] is None:
            label[page.parents[e]] = 1
    return label


def _examples(batches: Iterator[pa.RecordBatch], layouts: int) -> Iterator[pa.RecordBatch]:
    """Described and labelled elements of the sampled pages and of their layouts."""
    for batch in batches:
        for page_id, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            page = Page((source or "")[:SAMPLE_CHARS])
            labels = _own_labels(page)
            # Twice, as the layouts are several.
            cases = [] if labels is None else [(page, labels)] * 2
            by_element: dict[int, str] = {}
            for e, text in page.texts:
                if not any(page.tags[x] in HIDDEN for x in _line(page, e)):
                    by_element[e] = by_element.get(e, "") + " " + text
            main = [" ".join(t.split()) for e, t in by_element.items() if labels is None or labels[e]]
            rest = [" ".join(t.split()) for e, t in by_element.items() if labels is not None and not labels[e]]
            main = [t.replace("<", "&lt;") for t in main if len(t) > 1]
            filler = [t.replace("<", "&lt;") for t in rest + main if t] or ["a page of text"]
            rng = random.Random(zlib.crc32(str(page_id).encode()))
            for _ in range(layouts if main else 0):
                paragraphs = main[1:][: rng.choice([1, 3, 8, 30])] or main
                made = Page(_layout(rng, main[0] if rng.random() < 0.8 else "", paragraphs, filler))
                cases.append((made, _layout_labels(made)))
            for case, label in cases:
                rows, marks, hidden = describe(case)
                use = [e for e in range(1, len(hidden)) if not hidden[e] and rows[e, 1] > 0]
                places: dict[int, list[int]] = {}
                for e, place in marks:
                    places.setdefault(e, []).append(place)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([page_id] * len(use), batch.schema.field(0).type), pa.array(label[use]), pa.array(rows[use].tolist(), pa.list_(pa.float64())),
                     pa.array([places.get(e, []) for e in use], pa.list_(pa.int32()))],
                    names=["page_id", "label", "numbers", "places"])


def _line(page: Page, e: int) -> list[int]:
    out = []
    while e > 0:
        out.append(e)
        e = page.parents[e]
    return out


def train(pages: DataFrame, sample: int = SAMPLE_PAGES, layouts: int = LAYOUTS) -> BoostedTrees:
    """Trees fitted on a sample of ``page_id``, ``html`` rows.

    The ``sample`` pages with the smallest hash of their id take part, with at
    most ``SAMPLE_CHARS`` characters each. Without any text, the trees are empty
    and the decision falls to keeping everything that may be text.
    """
    ids = pages.where("html IS NOT NULL").select("page_id").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(sample)
    rows = pages.select("page_id", F.col("html").cast("string").alias("html")).join(F.broadcast(ids), "page_id")
    kind = rows.schema["page_id"].dataType.simpleString()
    found = rows.mapInArrow(partial(_examples, layouts=layouts), f"page_id {kind}, label long, numbers array<double>, places array<int>").toArrow()
    if not len(found):
        return BoostedTrees(np.zeros(0, dtype=np.int64), 1.0)
    keys = [str(x) for x in found["page_id"].to_pylist()]
    numbers = np.array(found["numbers"].to_pylist())
    order = np.lexsort([*numbers.T[::-1], np.array(keys)])
    places = found["places"].to_pylist()
    used, counts = np.unique(np.concatenate([np.array(p, dtype=np.int64) for p in places]), return_counts=True)
    model = BoostedTrees(used[counts >= 8])
    marks = [(i, p) for i, own in enumerate(places) for p in own]
    x = model.matrix(numbers, marks)[order]
    return boost(model, x, found["label"].to_numpy()[order].astype(float))


def _extract(batches: Iterator[pa.RecordBatch], model: BoostedTrees) -> Iterator[pa.RecordBatch]:
    wanted = sum(1 << int(p) - _PLACES for p in model.places if p >= _PLACES)
    for whole in batches:
        for start in range(0, whole.num_rows, 256):
            batch = whole.slice(start, 256)
            pages, parts, base, marks, hidden = [], [], 0, [], []
            for source in batch.column(2).to_pylist():
                page = Page(source or "")
                rows, own, hid = describe(page, wanted)
                marks += [(e + base, p) for e, p in own]
                pages.append(page)
                parts.append(rows)
                hidden.append(hid)
                base += len(rows)
            logits = np.split(model.logits(model.matrix(np.concatenate(parts), marks)), np.cumsum([len(p) for p in parts])[:-1])
            texts = [text_of(p, decide(p, x, h)) for p, x, h in zip(pages, logits, hidden)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, model: BoostedTrees) -> DataFrame:
    """``page_id``, ``url``, ``text``, ``n_chars`` (code points) of every page.

    A null page is an empty one with empty text. Repeated rows are read each; an
    empty table gives an empty one. Other columns are not read.
    """
    rows = pages.select("page_id", "url", F.col("html").cast("string").alias("html"))
    schema = f"page_id {rows.schema['page_id'].dataType.simpleString()}, url {rows.schema['url'].dataType.simpleString()}, text string, n_chars long"
    return rows.mapInArrow(partial(_extract, model=model), schema)
