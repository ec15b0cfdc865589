"""HTML to leaf blocks: for each run of text between block tags, its text, link share and path of open elements."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

#: elements that end a block of text (fixed values of the HTML standard's flow and table content)
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol optgroup option p pre section "
    "select summary table tbody td textarea tfoot th thead title tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: elements without text of their own; the text in ``svg``, ``math``, ``object``, ``iframe`` and the like is read as any other
RAW_TAGS = frozenset("script style template".split())
#: a start tag that ends an open element of these names in the same container
IMPLIED_END = {
    "p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"},
    "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}, "body": {"head", "title"},
}
_CONTAINERS = frozenset("article aside body div footer form header html main nav section table ul ol dl td th blockquote figure fieldset".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)",
    re.S,
)
_ATTR = re.compile(r"""(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_NAME = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")


@dataclass
class Leaf:
    text: str
    path: tuple[str, ...]
    linked: int = 0


@dataclass
class _Open:
    tag: str
    names: tuple[str, ...]
    path: tuple[str, ...] = field(default=())


def _names(tag: str, attrs: str) -> tuple[str, ...]:
    """The element's tag and the words of its class, id and role."""
    out = [tag]
    if attrs:
        for m in _ATTR.finditer(attrs):
            key = m.group(1).lower()
            value = (m.group(2) or m.group(3) or m.group(4) or "").lower()
            if key == "hidden" or (key == "aria-hidden" and value == "true"):
                out.append(".hidden")
            elif key in ("class", "id", "role"):
                out.extend("." + w for w in _NAME.findall(value))
    return tuple(out)


def leaf_blocks(page: str) -> list[Leaf]:
    """Non-empty text blocks in page order. Scripts, styles and comments never enter a block; ``<br>`` is white space."""
    leaves: list[Leaf] = []
    stack: list[_Open] = [_Open("", ())]
    buf: list[str] = []
    linked = 0
    in_link = 0

    def end_block() -> None:
        nonlocal linked
        if buf:
            text = _SPACE.sub(" ", html.unescape("".join(buf))).strip()
            if text:
                leaves.append(Leaf(text, stack[-1].path, min(linked, len(text))))
            buf.clear()
        linked = 0

    def text_at(lo: int, hi: int) -> None:
        nonlocal linked
        if hi > lo:
            buf.append(page[lo:hi])
            if in_link:
                linked += hi - lo

    def push(tag: str, attrs: str) -> None:
        names = _names(tag, attrs)
        # inline elements leave no trace in the path
        path = stack[-1].path + names if tag in BLOCK_TAGS or len(names) > 1 else stack[-1].path
        stack.append(_Open(tag, names, path))

    at = 0
    while True:
        m = _TOKEN.search(page, at)
        if m is None:
            text_at(at, len(page))
            break
        text_at(at, m.start())
        at = m.end()
        tag = (m.group(2) or "").lower()
        if not tag:
            continue
        if m.group(1):
            if tag == "a" and in_link:
                in_link -= 1
            if tag in BLOCK_TAGS:
                end_block()
            depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag), 0)
            if depth:
                # an inline end tag doesn't close blocks around it
                if tag in BLOCK_TAGS or all(o.tag not in BLOCK_TAGS for o in stack[depth + 1 :]):
                    del stack[depth:]
            continue
        if tag in RAW_TAGS and not m.group(3).rstrip().endswith("/"):
            close = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = close.end() if close else len(page)
            continue
        if tag in BLOCK_TAGS:
            end_block()
            ends = IMPLIED_END.get(tag, {"p"} if tag not in ("html", "head") else set())
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in ends:
                    del stack[i:]
                elif stack[i].tag in _CONTAINERS:
                    break
        elif tag == "br":
            buf.append(" ")
        if tag in VOID_TAGS:
            continue
        if tag == "a":
            in_link += 1
        push(tag, m.group(3))
    end_block()
    return leaves
