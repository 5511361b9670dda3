"""Leaf blocks of HTML pages: runs of text between block-level tags, with the elements around them."""

from __future__ import annotations

import re
from dataclasses import dataclass
from html import unescape

# Fixed values of HTML: which elements hold raw text, stand alone, start blocks, or end others when they start.
RAW = {"script", "style", "title", "textarea", "noscript", "template", "iframe", "xmp", "noembed", "noframes"}
SKIPPED = {"script", "style", "title", "noscript", "template", "iframe", "noembed", "noframes", "svg", "math", "head", "object", "canvas", "audio", "video"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd",
    "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
PARAGRAPH_ENDS = {
    "address", "article", "aside", "blockquote", "center", "details", "dialog", "dir", "div", "dl", "dd", "dt", "fieldset", "figcaption", "figure",
    "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "td", "th", "tr", "ul"}
SAME_ENDS = {"li": ("ul", "ol", "menu"), "dd": ("dl",), "dt": ("dl",), "td": ("table",), "th": ("table",), "tr": ("table",), "option": ("select",)}
SIBLINGS = {"dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}}
SCOPES = {"table", "td", "th", "button", "object", "html", "body"}

TAG = re.compile(
    r"""<(?:!--.*?(?:-->|\Z)|[!?][^>]*+(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+|[^>]*+)(?:>|\Z))""", re.DOTALL)
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.IGNORECASE)
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass(slots=True)
class Block:
    """One leaf block: its text, how many characters of it are links, and the block-level elements around it, outermost first."""

    text: str
    linked: int
    path: tuple[str, ...]


def element(name: str, attributes: str) -> str:
    """``tag`` or ``tag word word``: the words of its class, id and role."""
    if not attributes or "=" not in attributes:
        return name
    words = []
    for match in ATTRIBUTE.finditer(attributes):
        words += [w.lower() for w in NAME_PART.findall(match[2] or match[3] or match[4] or "")]
    return " ".join([name, *dict.fromkeys(words)]) if words else name


def leaf_blocks(page: str) -> list[Block]:
    """Blocks with text in page order. Tags that are cut off at the end of the page count as ended."""
    blocks: list[Block] = []
    names: list[str] = []
    path: list[str] = []
    parts: list[str] = []
    linked, links, skipped, at = 0, 0, 0, 0
    where: tuple[str, ...] = ()

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(parts).split())
        if text:
            blocks.append(Block(text, linked, where))
        parts.clear()
        linked = 0

    def close(index: int) -> None:
        nonlocal links, skipped
        for gone in names[index:]:
            links -= gone == "a"
            skipped -= gone in SKIPPED
        del names[index:], path[index:]

    def text(piece: str) -> None:
        nonlocal linked, where
        if skipped or not piece:
            return
        if "&" in piece:
            piece = unescape(piece)
        if not parts or where == ():
            where = tuple(p for n, p in zip(names, path) if n not in INLINE)
        parts.append(piece)
        if links:
            linked += len(piece.strip())

    size = len(page)
    while at < size:
        match = TAG.search(page, at)
        if match is None:
            text(page[at:])
            break
        text(page[at:match.start()])
        at = match.end()
        name = match[2]
        if name is None:
            continue
        name = name.lower()
        if name not in INLINE:
            flush()
        elif name == "br":
            parts.append(" ") if parts else None
        if match[1]:
            if name in names:
                close(len(names) - 1 - names[::-1].index(name))
            continue
        if name == "body" or skipped and "head" in names and name in PARAGRAPH_ENDS:
            if "head" in names:
                close(names.index("head"))
        if name in PARAGRAPH_ENDS and "p" in names:
            i = len(names) - 1 - names[::-1].index("p")
            if not SCOPES.intersection(names[i + 1:]):
                close(i)
        if name in SAME_ENDS:
            for i in range(len(names) - 1, -1, -1):
                if names[i] in SIBLINGS.get(name, {name}):
                    close(i)
                    break
                if names[i] in SAME_ENDS[name]:
                    break
        if name in VOID:
            continue
        names.append(name)
        path.append(element(name, match[3]))
        links += name == "a"
        skipped += name in SKIPPED
        if name in RAW:
            end = re.compile(f"</{name}(?=[\\s/>])", re.IGNORECASE).search(page, at)
            content, at = page[at:end.start() if end else size], end.start() if end else size
            if name == "textarea":
                text(content)
    flush()
    return blocks
