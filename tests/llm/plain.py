"""Plain Python versions of the operators, for small tables."""

import re

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"


def _twins(doublings=10):
    """Two words whose hashes by any polynomial modulo a power of two are equal."""
    one, two = "a", "b"
    for _ in range(doublings):
        one, two = one + two, two + one
    return one, two


TWINS = _twins()


def frame(spark, texts, **extra):
    """A documents table of (id, text) pairs."""
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in texts], DOCS)


def words(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [w for w in re.split("[ \t\n\r\x0b\x0c]+", lower) if w]


def shingles(text, size):
    own = words(text)
    if len(own) < size:
        return frozenset([tuple(own)] if own else [])
    return frozenset(zip(*(own[i:] for i in range(size))))


def groups(sets, percent):
    """The smallest id that links lead to, by comparing all pairs."""
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * len(sets[a] | sets[b]):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def repeated(texts, size=50):
    """Per id, the starts of word runs of ``size`` that an earlier id has too."""
    seen, out = {}, {}
    for i, text in sorted(texts):
        own = words(text)
        out[i] = []
        for a in range(len(own) - size + 1):
            run = tuple(own[a : a + size])
            if seen.setdefault(run, i) != i:
                out[i].append(a)
    return out
