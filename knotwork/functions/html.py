"""Paragraphs and info boxes of HTML pages, with the standard library's parser."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql.functions import pandas_udf

from knotwork.functions.text import markup

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_CLOSES = {"p": {"p"}, "li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
_OPAQUE = {"script", "style"}
_BLOCKS = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())


class Node:
    """An element: name, attributes, and children that are nodes or strings."""

    __slots__ = ("attrs", "children", "name")

    def __init__(self, name: str, attrs: dict[str, str]):
        self.name, self.attrs, self.children = name, attrs, []

    def walk(self) -> Iterator[Node]:
        for c in self.children:
            if isinstance(c, Node):
                yield c
                yield from c.walk()

    def text(self) -> str:
        return "".join(c if isinstance(c, str) else c.text() for c in self.children if isinstance(c, str) or c.name not in _OPAQUE)

    def strings(self) -> Iterator[str]:
        for c in self.children:
            if isinstance(c, str):
                yield c
            elif c.name not in _OPAQUE:
                yield from c.strings()

    def find(self, name: str) -> Node | None:
        return next((n for n in self.walk() if n.name == name), None)

    def fits(self, selector: str) -> bool:
        """A simple selector: name, .class, #id or name.class."""
        m = re.fullmatch(r"([\w-]*)(?:([.#])([\w-]+))?", selector)
        if not m or (m[1] and self.name != m[1]):
            return False
        return not m[2] or (self.attrs.get("id") == m[3] if m[2] == "#" else m[3] in self.attrs.get("class", "").split())

    def select(self, selector: str) -> list[Node]:
        """Nodes that fit the last simple selector under nodes that fit the ones before."""
        scope: list[Node] = [self]
        for part in selector.split():
            seen: set[int] = set()
            scope = [n for s in scope for n in s.walk() if n.fits(part) and not (id(n) in seen or seen.add(id(n)))]
        return scope


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("", {})
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        ends = _CLOSES.get(tag, set()) | ({"p"} if tag in _BLOCKS else set())
        if self.open[-1].name in ends:
            self.open.pop()
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].children.append(node)
        if tag not in _VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.open[-1].children.append(Node(tag, {k: v or "" for k, v in attrs}))

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].name == tag:
                del self.open[k:]
                return

    def handle_data(self, data):
        self.open[-1].children.append(data)


def parse(html: str | None) -> Node:
    b = _Builder()
    b.feed(html or "")
    b.close()
    return b.root


def link(node: Node, base: str) -> str | None:
    """A mention's markup for an anchor that has both text and target."""
    name, href = node.text().strip(), node.attrs.get("href")
    return markup(name, f"({urljoin(base, href)})") if name and href else None


def _pieces(node: Node, base: str) -> list[str]:
    """The direct children as text; anchors without text or target are left out."""
    out = []
    for c in node.children:
        piece = c.strip() if isinstance(c, str) else link(c, base) if c.name == "a" else c.text().strip()
        if piece:
            out.append(piece)
    return out


def _tidy(pieces: list[str]) -> str:
    return re.sub(r"\[\d+\]", "", re.sub(r"\s+", " ", " ".join(pieces).strip()))


def paragraphs(html: str | None, base: str, selector: str = "#mw-content-text p") -> list[str]:
    """Texts of the selected paragraphs, mentions marked up; empty ones are dropped."""
    texts = (_pieces(p, base) for p in parse(html).select(selector))
    return [_tidy(t) for t in texts if t]


def _deep(node: Node, base: str) -> list[str]:
    """All content of a cell: lists, divs and spans are entered, other elements give their text."""
    out: list[str] = []
    for c in node.children:
        if isinstance(c, str):
            out.extend([c.strip()] if c.strip() else [])
        elif c.name == "a":
            out.extend(filter(None, [link(c, base)]))
        elif c.name == "br":
            out.append(" ")
        elif c.name in ("ul", "ol"):
            for item in c.walk():
                if item.name == "li":
                    out += [*_deep(item, base), " "]
        elif c.name in ("div", "span"):
            out += _deep(c, base)
        elif c.text().strip():
            out.append(c.text().strip())
    return out


def infobox(html: str | None, base: str, selector: str = ".vcard") -> list[tuple[str, str]]:
    """(key, value) in order. A row with a head alone has no value, one with a cell alone goes on with the last value; a key's further uses are numbered."""
    box = next(iter(parse(html).select(selector)), None)
    out: dict[str, str] = {}
    seen: dict[str, int] = {}
    for row in box.select("tr") if box else []:
        th, td = row.find("th"), row.find("td")
        if th is None:
            more = _tidy(_pieces(td, base)) if td is not None and out else ""
            if more:
                last = next(reversed(out))
                out[last] = f"{out[last]} {more}" if out[last] else more
            continue
        key = "".join(s.strip() for s in th.strings())
        if not key:
            continue
        seen[key] = seen.get(key, 0) + 1
        name = key if seen[key] == 1 else f"{key} ({seen[key]})"
        if td is None:
            out.setdefault(name, "")
        else:
            out[name] = _tidy(_deep(td, base))
    return list(out.items())


def paragraphs_udf(base: str, selector: str = "#mw-content-text p"):
    """html -> array<string>."""

    @pandas_udf("array<string>")
    def run(pages: pd.Series) -> pd.Series:
        return pages.map(lambda h: paragraphs(h, base, selector))

    return run


def infobox_udf(base: str, selector: str = ".vcard"):
    """html -> array<struct<key, value>>."""

    @pandas_udf("array<struct<key:string,value:string>>")
    def run(pages: pd.Series) -> pd.Series:
        return pages.map(lambda h: [{"key": k, "value": v} for k, v in infobox(h, base, selector)])

    return run
