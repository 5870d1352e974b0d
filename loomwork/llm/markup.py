"""A page's markup as a tree of labelled elements and its text as blocks, in one linear pass that forgives bad markup."""

from __future__ import annotations

import html
import re
from collections.abc import Callable
from dataclasses import dataclass, field

import xxhash

#: Comments, tags and declarations. Quotes count only after an equals sign; what is never closed reaches to the end.
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]+|=\s*"[^"]*(?:"|\Z)|=\s*'[^']*(?:'|\Z)|=)*+)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"?|'([^']*)'?|([^\s>]+)))?""")
DIGITS = re.compile(r"\d{3,}")

# fixed values: element kinds of the HTML standard
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes noscript template".split())
BLOCK = set(
    "html head body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol optgroup option p pre search section select summary table caption tbody td tfoot th thead tr ul".split()
)
IN_HEAD = set("html head title base link meta style script noscript template".split())
CLOSES_P = BLOCK - set("html head body td th tr tbody thead tfoot caption option optgroup legend summary".split())
#: element -> (those that its start ends, those beyond which none is ended)
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"tr"}, {"table", "tbody", "thead", "tfoot"}),
    "tbody": ({"tbody", "thead", "tfoot"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot"}, {"table"}),
    "option": ({"option"}, {"select"}),
    "body": ({"head"}, {"html"}),
}


@dataclass(slots=True)
class Element:
    name: str
    parent: int  # number of the element around it, -1 for the root
    label: str  # name, id, classes and role, long numbers in them as one sign
    path: int  # hash of the labels from the root
    attributes: dict = field(default_factory=dict)


@dataclass(slots=True)
class Block:
    text: str
    element: int
    linked: int  # characters within links


def signed(h: int) -> int:
    return h - (1 << 64) if h >= 1 << 63 else h


def path_of(parent: int, label: str) -> int:
    return signed(xxhash.xxh3_64_intdigest(label.encode("utf-8", "surrogatepass"), seed=parent & ((1 << 64) - 1)))


def attributes(text: str) -> dict:
    out: dict = {}
    for name, a, b, c in ATTRIBUTE.findall(text):
        out.setdefault(name.lower(), html.unescape(a or b or c))
    return out


def label_of(name: str, at: dict) -> str:
    parts = [name, at.get("id", ""), " ".join(sorted(at.get("class", "").split())), at.get("role", "")]
    return DIGITS.sub("0", "\x1f".join(parts))


def parse(page: str | None, mute: Callable[[Element], bool] = lambda e: False) -> tuple[list[Element], list[Block]]:
    """Elements in order of their starts (the first is the page itself) and non-empty text blocks in page order.

    Text in inline elements for which `mute` holds is left out of the block around them.

    Character references are decoded, runs of white space become one space, blocks end where block elements start or end.
    Scripts, styles, comments and other raw text are no text. Null is an empty page.
    """
    elements = [Element("", -1, "", 0)]
    blocks: list[Block] = []
    stack, text, linked, links, muted = [0], [], 0, 0, set()
    page = page or ""

    def flush() -> None:
        nonlocal linked
        if text:
            whole = " ".join("".join(text).split())
            if whole:
                holder = next(i for i in reversed(stack) if elements[i].name in BLOCK or i == 0)
                blocks.append(Block(whole, holder, linked))
            text.clear()
            linked = 0

    def leave(depth: int) -> None:
        nonlocal links
        for i in stack[depth:]:
            links -= elements[i].name == "a"
            muted.discard(i)
        del stack[depth:]

    at, end = 0, len(page)
    while at < end:
        m = TOKEN.search(page, at)
        stop = m.start() if m else end
        if stop > at and not muted:
            piece = html.unescape(page[at:stop])
            text.append(piece)
            linked += len(piece) if links else 0
        if not m:
            break
        at = max(m.end(), stop + 1)
        if not m[2]:
            continue
        name = m[2].lower()
        if name == "br":
            text.append(" ")
            continue
        if name in BLOCK:
            flush()
        if m[1]:
            depth = next((d for d in range(len(stack) - 1, 0, -1) if elements[stack[d]].name == name), 0)
            if depth and name not in BLOCK and any(elements[i].name in BLOCK for i in stack[depth + 1 :]):
                links -= name == "a"
                muted.discard(stack[depth])
                del stack[depth]
            elif depth:
                leave(depth)
            continue
        if name not in IN_HEAD and elements[stack[-1]].name == "head":
            leave(len(stack) - 1)
        if name in CLOSES_P:
            depth = next((d for d in range(len(stack) - 1, 0, -1) if elements[stack[d]].name == "p"), 0)
            if depth:
                leave(depth)
        if name in IMPLIED:
            ended, beyond = IMPLIED[name]
            for d in range(len(stack) - 1, 0, -1):
                if elements[stack[d]].name in beyond:
                    break
                if elements[stack[d]].name in ended:
                    leave(d)
                    break
        had = attributes(m[3]) if m[3].strip(" /\t\n\r\f") else {}
        label = label_of(name, had)
        up = stack[-1]
        elements.append(Element(name, up, label, path_of(elements[up].path, label), had))
        if name in RAW:
            close = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)", re.I).search(page, at)
            at = close.start() if close else end
            tail = page.find(">", at)
            at = end if tail < 0 else tail + 1
        elif name not in VOID:
            stack.append(len(elements) - 1)
            links += name == "a"
            if name not in BLOCK and mute(elements[-1]):
                muted.add(len(elements) - 1)
    flush()
    return elements, blocks
