"""A tolerant HTML reader: block elements and text runs of one page.

Inline elements belong to the run they stand in, so a run is what a reader
sees as one block of text. Scripts, styles, titles, comments and the like have
no visible text and leave nothing. Unclosed elements end where the usual rules
end them (a new paragraph ends the one before, an outer end tag ends all inner
elements); stray end tags are ignored; an unclosed page is a page. A quoted
string stands right after ``=``; any other quote in a tag is an ordinary
character. Only raw text (scripts, styles and the like) goes on to the end of
the page when it is not closed: svg and math end at the next HTML element or
outer end tag, of other unseen elements the start tag is ignored.
"""
from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass, field

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)"
    r"(?P<attrs>(?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>]*+))?+)*+)>", re.S)
_ATTR = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

UNSEEN = frozenset("script style title template noscript svg math iframe object canvas audio video select textarea".split())
RAW = frozenset("script style title textarea iframe".split())  # text up to their own end tag, whatever stands in it
# HTML elements that end svg and math, and elements of svg and math with HTML inside
_BREAKOUT = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing "
                      "menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var "
                      "article aside footer header main nav section".split())
_HOLDS_HTML = frozenset("foreignobject desc title mi mo mn ms mtext annotation-xml".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark nobr q rp rt ruby s samp "
                   "small span strike strong sub sup time tt u var wbr".split())
# an element of the first kind ends open ones of the second, up to an element of the third
_ENDS = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"),
         "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "thead": ("tbody", "tfoot"),
         "tbody": ("thead", "tbody"), "tfoot": ("tbody",)}
_WALLS = {"li": frozenset(("ul", "ol")), "dt": frozenset(("dl",)), "dd": frozenset(("dl",)), "tr": frozenset(("table",)),
          "td": frozenset(("table",)), "th": frozenset(("table",)), "option": frozenset(("select",)),
          "thead": frozenset(("table",)), "tbody": frozenset(("table",)), "tfoot": frozenset(("table",))}
TEXT = "#text"


@dataclass
class Page:
    """Nodes in page order; node 0 is the page itself. A run's text is in ``text``, others have ""."""
    tag: list[str] = field(default_factory=lambda: ["#page"])
    parent: list[int] = field(default_factory=lambda: [-1])
    tokens: list[tuple[str, ...]] = field(default_factory=lambda: [()])
    text: list[str] = field(default_factory=lambda: [""])
    linked: list[int] = field(default_factory=lambda: [0])  # characters of a run that are link text

    def add(self, tag: str, parent: int, tokens: tuple[str, ...] = (), text: str = "", linked: int = 0) -> int:
        self.tag.append(tag)
        self.parent.append(parent)
        self.tokens.append(tokens)
        self.text.append(text)
        self.linked.append(linked)
        return len(self.tag) - 1


def attribute_tokens(tag: str, attrs: str) -> tuple[str, ...]:
    """The tag and the words of class, id and role."""
    out = ["<" + tag]
    if "=" in attrs:
        for values in _ATTR.findall(attrs):
            out += [w.lower() for w in _WORD.findall(values[0] or values[1] or values[2])]
    return tuple(dict.fromkeys(out))


def _foreign_end(source: str, at: int, tag: str, open_tags: dict[str, int]) -> int:
    """Where the svg or math whose start tag ends at ``at`` ends."""
    own: Counter[str] = Counter()
    holds = 0
    first = None  # HTML that ends it if what holds HTML is never closed
    for m in _TOKEN.finditer(source, at):
        if m["tag"] is None:
            continue
        t = m["tag"].lower()
        if m["end"]:
            if own[t]:
                own[t] -= 1
                holds -= t in _HOLDS_HTML
            elif t == tag:
                return m.end()
            elif not holds and (t in INLINE or t in ("p", "br") or open_tags.get(t)):
                return m.start()
        elif t in _BREAKOUT:
            if not holds:
                return m.start()
            first = m.start() if first is None else first
        elif not m["attrs"].endswith("/"):
            own[t] += 1
            holds += t in _HOLDS_HTML
    return len(source) if first is None else first


def parse(source: str) -> Page:
    """The block tree of a whole page (iterative, any depth)."""
    page = Page()
    stack: list[tuple[str, int]] = [("#page", 0)]
    open_tags: dict[str, int] = {}
    pieces: list[str] = []
    links = linked = 0
    unclosed: set[str] = set()  # unseen elements without an end tag in the rest of the page

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                page.add(TEXT, stack[-1][1], text=text, linked=min(linked, len(text)))
            pieces.clear()
        linked = 0

    def pop() -> str:
        tag = stack.pop()[0]
        open_tags[tag] -= 1
        return tag

    def say(raw: str) -> None:
        nonlocal linked
        if raw:
            piece = html.unescape(raw) if "&" in raw else raw
            pieces.append(piece)
            if links:
                linked += len(piece.strip())

    at, size = 0, len(source)
    while at < size:
        m = _TOKEN.search(source, at)
        if m is None:
            say(source[at:])
            break
        if m.start() > at:
            say(source[at:m.start()])
        at = m.end()
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if m["end"]:
            if tag == "a":
                links = max(0, links - 1)
            elif tag == "br":
                pieces.append(" ")
            elif tag not in INLINE and open_tags.get(tag):
                flush()
                while pop() != tag:
                    pass
            elif tag == "p":
                flush()
            continue
        closed = m["attrs"].endswith("/")
        if tag in UNSEEN:
            if tag in ("svg", "math"):
                at = at if closed else _foreign_end(source, at, tag, open_tags)
            elif tag not in unclosed and (not closed or tag in ("script", "style", "title", "textarea")):
                end = re.compile(rf"</{tag}(?:[\s/][^>]*+)?>", re.I).search(source, at)
                if end or tag in RAW:
                    at = end.end() if end else size
                else:
                    unclosed.add(tag)
            if tag not in ("svg", "math"):
                flush()
        elif tag == "a":
            links += not closed
        elif tag == "br":
            pieces.append(" ")
        elif tag in VOID:
            if tag == "hr":
                flush()
        elif tag not in INLINE:
            flush()
            # a block start ends an open paragraph; list items, cells and the like end their own kind
            for kind in (_ENDS.get(tag, ()) if tag != "p" else ()) + ("p",):
                if open_tags.get(kind):
                    wall = _WALLS.get(tag, frozenset()) if kind != "p" else frozenset(("table", "td", "th", "button"))
                    for i in range(len(stack) - 1, 0, -1):
                        if stack[i][0] == kind:
                            while len(stack) > i:
                                pop()
                            break
                        if stack[i][0] in wall:
                            break
            if not closed:
                node = page.add(tag, stack[-1][1], attribute_tokens(tag, m["attrs"]))
                stack.append((tag, node))
                open_tags[tag] = open_tags.get(tag, 0) + 1
    flush()
    return page
