"""HTML cut into leaf blocks: runs of text between block-level tags, each with the path of its open elements."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

#: Elements of HTML by what they do to the text around them.
BREAKING = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section "
    "select summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNREAD = frozenset("script style noscript template iframe svg math object canvas textarea head".split())
#: An element that a new one of the second kind ends, though its own end tag is missing.
IMPLIED = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPES = frozenset("article aside blockquote body div fieldset footer form header main nav section table td th ul ol dl li".split())

#: Open elements that are kept track of; deeper ones are taken as text of the deepest, as browsers cap the depth.
DEEPEST = 256

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>",
    re.S,
)
_NAMES = re.compile(r"(?:^|\s)(?:class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_UNCLOSED = re.compile(r"<!--|<!\[CDATA\[")
_WORD = re.compile(r"[a-z0-9]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


@dataclass
class Element:
    tag: str
    names: tuple[str, ...]


@dataclass
class Block:
    text: str
    path: tuple[Element, ...]
    linked: int  # characters inside links


def element_names(attributes: str) -> tuple[str, ...]:
    """The words of class, id, role and itemprop, lower-cased."""
    if "=" not in attributes:
        return ()
    values = (a or b or c for a, b, c in _NAMES.findall(attributes))
    return tuple(w for v in values for w in _WORD.findall(_CAMEL.sub(" ", v).lower()))


class _Reader:
    def __init__(self) -> None:
        self.stack: list[Element] = []
        self.parts: list[str] = []
        self.linked = self.links = 0
        self.path: tuple[Element, ...] = ()
        self.open_path: tuple[Element, ...] | None = ()  # of the stack, until it changes
        self.blocks: list[Block] = []

    def text(self, raw: str) -> None:
        if not raw:
            return
        plain = html.unescape(raw) if "&" in raw else raw
        if not any(self.parts) or not self.path:
            if plain.isspace():
                self.parts.append(" ") if self.parts else None
                return
            if self.open_path is None:
                self.open_path = tuple(self.stack)
            self.path = self.open_path
        self.parts.append(plain)
        if self.links:
            self.linked += len(plain)

    def cut(self) -> None:
        line = " ".join("".join(self.parts).split())
        if line:
            self.blocks.append(Block(line, self.path, self.linked))
        self.parts, self.linked, self.path = [], 0, ()

    def pop_to(self, place: int) -> None:
        for e in self.stack[place:]:
            self.links -= e.tag == "a"
        del self.stack[place:]
        self.open_path = None

    def open(self, tag: str, attributes: str) -> None:
        if tag in BREAKING:
            self.cut()
            self.imply(tag)
        if tag in VOID or len(self.stack) >= DEEPEST:
            return
        self.open_path = None
        self.stack.append(Element(tag, element_names(attributes)))
        self.links += tag == "a"

    def imply(self, tag: str) -> None:
        ends = {"p"} | IMPLIED.get(tag, set())
        for place in range(len(self.stack) - 1, -1, -1):
            if self.stack[place].tag in ends:
                self.pop_to(place)
                if tag not in IMPLIED:
                    return
            elif self.stack[place].tag in _SCOPES:
                return

    def close(self, tag: str) -> None:
        if tag in BREAKING:
            self.cut()
        for place in range(len(self.stack) - 1, -1, -1):
            if self.stack[place].tag == tag:
                self.pop_to(place)
                return
            if tag not in BREAKING and self.stack[place].tag in BREAKING:
                return


def read_blocks(page: str | None) -> list[Block]:
    """The leaf blocks of a page in order; none for null or empty text. White space inside a block is one blank; what
    stands in scripts, styles, comments and the head isn't text. Unclosed and stray tags are borne; the time is linear
    in the page's length."""
    reader, at = _Reader(), 0
    page = page or ""
    last, heads = page.rfind(">") + 1, True  # no tag ends behind; whether an end of the head may follow
    while True:
        found = _TAG.search(page, at, last)
        if found is None:
            break
        reader.text(page[at : found.start()])
        at = found.end()
        if found[0].startswith(("<!--", "<![CDATA[")) and not found[0].endswith(("-->", "]]>")):
            at = len(page)
            break
        end, tag = found[1] if found[2] else found[4], (found[2] or found[5] or "").lower()
        if not tag:
            continue
        if tag == "br":
            reader.text(" ")
        elif end:
            reader.close(tag)
        elif tag in UNREAD and not (found[3] or found[6] or "").rstrip().endswith("/"):
            if tag == "head":
                reader.cut()
            if tag == "head" and not heads:
                continue
            stop = re.compile(rf"</{re.escape(tag)}\s{{0,99}}>", re.I).search(page, at)
            if tag == "head" and stop is None:
                stop = re.compile(r"(?=<body[\s>])", re.I).search(page, at)
                at, heads = stop.end() if stop else at, stop is not None
            else:
                at = stop.end() if stop else len(page)
        else:
            reader.open(tag, found[3] or found[6] or "")
    unclosed = _UNCLOSED.search(page, at)
    reader.text(page[at : unclosed.start() if unclosed else len(page)])
    reader.cut()
    return reader.blocks
