"""A small tolerant HTML reader: elements as parallel lists, in page order."""

from __future__ import annotations

import html
import re

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: Elements whose characters are never text of the page.
HIDDEN = frozenset("head script style template noscript svg math object iframe select option button textarea title datalist".split())
BLOCKS = frozenset("""address article aside blockquote body br dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6
header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul""".split())
# What a new element closes, up to the element that bounds the search.
_CLOSES = {"li": ("li", ("ul", "ol")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)),
           "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",)),
           "tbody": ("thead tbody tr td th", ("table",)), "tfoot": ("thead tbody tr td th", ("table",))}
_MARKUP = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<[!?/][^>]*>""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/>]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""")
_TOKEN = re.compile(r"[a-z]+")


class Page:
    """Elements of a page: tag, parent, attribute tokens, and its texts with their elements.

    ``texts`` has (element, characters) in page order; ``breaks`` has the number of
    texts before every block border.
    """

    def __init__(self, source: str):
        self.tags, self.parents, self.tokens, self.marks = ["#page"], [-1], [()], [None]
        self.texts: list[tuple[int, str]] = []
        self.breaks: set[int] = set()
        self._stack = [0]
        self._read(source)

    def _text(self, data: str) -> None:
        if data:
            self.texts.append((self._stack[-1], html.unescape(data) if "&" in data else data))

    def _close(self, depth: int) -> None:
        for element in self._stack[depth:]:
            if self.tags[element] in BLOCKS:
                self.breaks.add(len(self.texts))
        del self._stack[depth:]

    def _open(self, tag: str, attributes: str) -> None:
        tags = self.tags
        if tag in _CLOSES:
            closed, bounds = _CLOSES[tag]
            for depth in range(len(self._stack) - 1, 0, -1):
                name = tags[self._stack[depth]]
                if name in bounds:
                    break
                if name in closed.split():
                    self._close(depth)
                    if tag in ("li", "dt", "dd", "td", "th", "option"):
                        break
        elif tag in BLOCKS and tag != "br":
            for depth in range(len(self._stack) - 1, 0, -1):
                name = tags[self._stack[depth]]
                if name == "p":
                    self._close(depth)
                    break
                if name in BLOCKS:
                    break
        words, mark = [], None
        if attributes.strip("/ \t\r\n"):
            for m in _ATTRIBUTE.finditer(attributes):
                name = m[1].lower()
                if name in ("class", "id", "role", "itemprop"):
                    words += _TOKEN.findall((m[2] or m[3] or m[4] or "").lower())
                elif name == "data-y":
                    mark = m[2]
        tags.append(tag)
        self.parents.append(self._stack[-1])
        self.tokens.append(tuple(words))
        self.marks.append(mark)
        if tag in BLOCKS:
            self.breaks.add(len(self.texts))
        if tag not in _VOID and not attributes.endswith("/"):
            self._stack.append(len(tags) - 1)

    def _end(self, tag: str) -> None:
        for depth in range(len(self._stack) - 1, 0, -1):
            name = self.tags[self._stack[depth]]
            if name == tag:
                self._close(depth)
                return
            if name in BLOCKS and tag not in BLOCKS:
                return

    def _read(self, source: str) -> None:
        at = 0
        while True:
            m = _MARKUP.search(source, at)
            if m is None:
                self._text(source[at:])
                break
            self._text(source[at : m.start()])
            at = m.end()
            if m[2] is None:
                continue
            tag = m[2].lower()
            if m[1]:
                self._end(tag)
                continue
            self._open(tag, m[3])
            if tag in _RAW:
                end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(source, at)
                self._text(source[at : end.start() if end else len(source)])
                at = end.end() if end else len(source)
                self._end(tag)
        self._close(1)
