"""Web pages as trees of block elements, with the text that stands between their borders.

A small reader of tag soup: end tags may lack, be too many or cross, attributes may be quoted or not, comments and scripts
may never end. It keeps what the extraction of text needs: block elements with the words of their class, id and role, and
runs of text between block borders, each with the share that is linked. It reads a page once, without recursion.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass, field

_ATTRIBUTES = r"""(?:[\s/]+|[^\s/>=][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>]*+))?+|=)*+"""
_TOKEN = re.compile(
    rf"<!--(?:-?>|.*?(?:--!?>|\Z))|<(?:[!?]|/(?![a-zA-Z]))[^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)({_ATTRIBUTES})(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([^\s/>=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")
_NAME_WORD = re.compile(r"[a-z]+|[A-Z][a-z]*|[A-Z]+(?![a-z])")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Their content is no markup and no text of the page.
RAW = frozenset("iframe noembed noframes noscript script style textarea title xmp".split())
# Their content is markup, but not shown as text.
UNSHOWN = frozenset("audio button canvas datalist head math object option select svg template video".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table "
    "tbody td tfoot th thead tr ul".split()
)
# A start tag of the key ends open elements of the names beside it, up to an element that holds them.
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
}
# These do not end an open paragraph around them.
_IN_PARAGRAPH = frozenset("tbody thead tfoot tr td th caption li dt dd legend summary html body".split())


@dataclass
class Node:
    """A block element, or (``tag`` empty) a run of text. Parents come before their children."""

    parent: int
    tag: str = ""
    words: tuple[str, ...] = ()
    text: str = ""
    linked: int = 0


@dataclass
class Page:
    title: str = ""
    nodes: list[Node] = field(default_factory=list)


def _name_words(attributes: str) -> tuple[str, ...]:
    """Words of class, id and role in lower case, and ``hidden`` for what is not shown."""
    words: list[str] = []
    for name, *values in _ATTRIBUTE.findall(attributes):
        value, name = "".join(values), name.lower()
        if name in ("class", "id", "role"):
            words += [word.lower() for word in _NAME_WORD.findall(html.unescape(value))]
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and _HIDDEN.search(value):
            words.append("hidden")
    return tuple(dict.fromkeys(words))


class _Reader:
    def __init__(self) -> None:
        self.page = Page(nodes=[Node(-1, "html")])
        # Open elements: name, and the node for block elements (-1: inline).
        self.open: list[tuple[str, int]] = [("html", 0)]
        self.times = Counter(("html",))
        self.blocks = [0]
        self.links = self.unshown = 0
        self.pieces: list[str] = []
        self.linked = 0

    def text(self, raw: str) -> None:
        if self.unshown or not raw:
            return
        text = html.unescape(raw) if "&" in raw else raw
        self.pieces.append(text)
        if self.links:
            self.linked += len("".join(text.split()))

    def border(self) -> None:
        """End the run of text at a border of blocks."""
        if self.pieces:
            text = " ".join("".join(self.pieces).split())
            if text:
                self.page.nodes.append(Node(self.blocks[-1], text=text, linked=self.linked))
            self.pieces, self.linked = [], 0

    def pop(self, depth: int) -> None:
        """Close all open elements from ``depth`` on."""
        closed = self.open[depth:]
        del self.open[depth:]
        self.times.subtract(name for name, _ in closed)
        inner = sum(node >= 0 for _, node in closed)
        if inner:
            self.border()
            del self.blocks[-inner:]
        self.links -= sum(name == "a" for name, _ in closed)
        self.unshown -= sum(name in UNSHOWN for name, _ in closed)

    def close_nearest(self, names: set[str] | frozenset[str], within: set[str] | frozenset[str]) -> None:
        """Close the outermost open element of ``names`` that no element of ``within`` encloses from inside."""
        found = 0
        if not any(self.times[name] for name in names):
            return
        for depth in range(len(self.open) - 1, 0, -1):
            name = self.open[depth][0]
            if name in within:
                break
            if name in names:
                found = depth
        if found:
            self.pop(found)

    def start(self, name: str, attributes: str) -> None:
        if name in ("html", "body"):
            if name == "body":
                self.close_nearest({"head"}, set())
            return
        if name == "br":
            self.text(" ")
        if name in _ENDS:
            self.close_nearest(*_ENDS[name])
        if name in BLOCK:
            if name not in _IN_PARAGRAPH:
                self.close_nearest({"p"}, {"td", "th", "caption", "table", "object", "button"})
            self.close_nearest({"head"}, set())
            self.border()
            if name in VOID:
                return
            self.page.nodes.append(Node(self.blocks[-1], name, _name_words(attributes) if attributes else ()))
            self.blocks.append(len(self.page.nodes) - 1)
            self.open.append((name, self.blocks[-1]))
            self.times[name] += 1
        elif name not in VOID:
            if name == "a":
                self.close_nearest({"a"}, BLOCK)
                self.links += 1
            self.unshown += name in UNSHOWN
            self.open.append((name, -1))
            self.times[name] += 1

    def end(self, name: str) -> None:
        if name == "br":
            self.text(" ")
        if name in ("html", "body") or name in VOID or not self.times[name]:
            return
        crossed = False
        for depth in range(len(self.open) - 1, 0, -1):
            other, node = self.open[depth]
            if other == name and crossed:
                # A link that ends inside a block it does not hold: the block stays open.
                del self.open[depth]
                self.times[name] -= 1
                self.links -= 1
                return
            if other == name:
                self.pop(depth)
                return
            if name == "a" and node >= 0:
                crossed = True
                continue
            # An inline end tag does not close blocks, and none in a cell closes its table's surroundings.
            if node >= 0 and name not in BLOCK and name not in UNSHOWN or other == "table" and name not in ("table", "article"):
                return


def read_page(text: str) -> Page:
    """The tree of a page; an empty text has a root only."""
    reader, at = _Reader(), 0
    while found := _TOKEN.search(text, at):
        reader.text(text[at : found.start()])
        at = found.end()
        slash, name, attributes = found.groups()
        if name is None:
            continue
        name = name.lower()
        if slash:
            reader.end(name)
        elif name in RAW:
            close = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>?", re.I).search(text, at)
            if name == "title" and not reader.page.title:
                reader.page.title = " ".join(html.unescape(text[at : close.start() if close else len(text)]).split())
            at = close.end() if close else len(text)
        else:
            reader.start(name, attributes)
    reader.text(text[at:])
    reader.border()
    return reader.page
