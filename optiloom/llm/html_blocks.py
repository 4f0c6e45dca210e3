"""Splits raw HTML into leaf blocks of text with the path of tags that leads to each."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

#: Elements that start a new block of text.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html label legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
#: Elements without content; elements of raw text, which is never text of the page (of these, all but
#: code are taken as ordinary elements where their end tag is missing); and elements in which "/>" ends an element.
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TAGS = frozenset("script style iframe noembed noframes textarea title xmp".split())
CODE_TAGS = frozenset("script style".split())
FOREIGN_TAGS = frozenset("svg math".split())
#: Opening one of these closes an open element of the same family, up to the nearest of its containers.
_FAMILIES = {"p": (("p",), ()), "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",))}
#: Outside quotes a tag holds no "<", so a tag that never ends is read once and taken as text.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^<>]*>|</?([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^<>\"']|\"[^\"]*+\"|'[^']*+')*+)>", re.S)
_NAME = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PART = re.compile(r"[a-z]+")
#: Outermost and innermost open elements on a block's path; that of a block which lies deeper leaves out those between.
OUTER, INNER = 24, 40
_SPACE = re.compile(r"\s+")


@dataclass
class Block:
    """Text, path (tags and words of their classes, outermost first), and the characters inside links."""

    text: str
    path: tuple[str, ...]
    linked: int


def _names(tag: str, attributes: str) -> tuple[str, ...]:
    found = [tag]
    for m in _NAME.finditer(attributes):
        found += ["." + x for x in _PART.findall((m[1] or m[2] or m[3] or "").lower())]
    return tuple(found)


def split_blocks(page: str) -> list[Block]:
    """Leaf blocks in page order; blocks without text are left out."""
    stack: list[tuple[str, tuple[str, ...]]] = []
    out: list[Block] = []
    parts: list[str] = []
    links = linked = foreign = at = 0

    def close() -> None:
        nonlocal linked
        if parts:
            text = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
            if text:
                held = stack if len(stack) <= OUTER + INNER else stack[:OUTER] + stack[-INNER:]
                out.append(Block(text, tuple(x for _, names in held for x in names), linked))
            parts.clear()
        linked = 0

    def pop_to(depth: int) -> None:
        nonlocal links, foreign
        for tag, _ in stack[depth:]:
            links -= tag == "a"
            foreign -= tag in FOREIGN_TAGS
        del stack[depth:]

    while m := _TOKEN.search(page, at):
        if m.start() > at:
            parts.append(page[at : m.start()])
            linked += (m.start() - at) if links else 0
        at = m.end()
        if not m[1]:
            continue
        tag = m[1].lower()
        closing = page[m.start() + 1] == "/"
        if not closing and m[0].endswith("/>") and (tag in FOREIGN_TAGS or foreign):
            continue
        if tag in RAW_TAGS and not closing:
            end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
            if end or tag in CODE_TAGS:
                close() if tag in BLOCK_TAGS else None
                at = end.end() if end else len(page)
                continue
        block = tag in BLOCK_TAGS
        if tag == "head":  # not on any path, so that it needs no end tag
            close()
            continue
        if block:
            close()
        elif tag == "br":
            parts.append(" ")
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    pop_to(k)
                    break
                if not block and stack[k][0] in BLOCK_TAGS:
                    break
        elif tag not in VOID_TAGS:
            if tag in _FAMILIES or block:
                same, stops = _FAMILIES.get(tag, (("p",), ()))
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] in same:
                        pop_to(k)
                        break
                    if stack[k][0] in stops or (stack[k][0] in BLOCK_TAGS and stack[k][0] not in ("td", "th", "dt", "dd")):
                        break
            stack.append((tag, _names(tag, m[2])))
            links += tag == "a"
            foreign += tag in FOREIGN_TAGS
    if at < len(page):
        parts.append(page[at:])
    close()
    return out
