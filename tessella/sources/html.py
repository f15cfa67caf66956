"""Taxonomy entries from saved HTML pages: tables under headings, and nested lists."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

_SPACE = re.compile(r"\s+")
_NOTE = re.compile(r"\[\d+\]")
_VOID = {"br", "img", "hr", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"}


class _Node:
    __slots__ = ("tag", "attrs", "parent", "children")

    def __init__(self, tag: str, attrs: dict, parent: "_Node | None"):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def below(self) -> list["_Node"]:
        """All nodes under this one, in document order; by a stack, as pages nest deeper than calls may."""
        out, todo = [], [c for c in reversed(self.children) if isinstance(c, _Node)]
        while todo:
            out.append(todo.pop())
            todo += [c for c in reversed(out[-1].children) if isinstance(c, _Node)]
        return out

    def find(self, tag: str) -> list["_Node"]:
        return [n for n in self.below() if n.tag == tag]

    def direct(self, tag: str) -> list["_Node"]:
        return [c for c in self.children if isinstance(c, _Node) and c.tag == tag]

    def text(self, without: str = "") -> str:
        out, todo = [], self.children[::-1]
        while todo:
            c = todo.pop()
            if isinstance(c, str):
                out.append(c)
            elif c.tag != without:
                todo += c.children[::-1]
        return "".join(out)


class _Tree(HTMLParser):
    """A forgiving tree: an end tag closes up to its start tag, li, td, th, tr and p close their like."""

    _closes = {"li": ("li",), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr", "td", "th"), "p": ("p",)}
    _bounds = {"ul", "ol", "table", "body", "div"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = _Node("", {}, None)

    def handle_starttag(self, tag, attrs):
        closed = self._closes.get(tag)
        node = self.at
        while closed and node.parent is not None and node.tag not in self._bounds:
            if node.tag in closed:
                self.at = node.parent
            node = node.parent
        new = _Node(tag, dict(attrs), self.at)
        self.at.children.append(new)
        if tag not in _VOID:
            self.at = new

    def handle_endtag(self, tag):
        node = self.at
        while node.parent is not None and node.tag != tag:
            node = node.parent
        if node.parent is not None:
            self.at = node.parent

    def handle_data(self, data):
        self.at.children.append(data)


#: Text, or a tag with quoted attributes; the rest of HTML is the standard parser's, as is what stands in elements whose content is no markup.
_SIMPLE = re.compile(r"""([^<&]+)|<(/?)([a-zA-Z][a-zA-Z0-9]*)((?:[ \t\r\n]+[a-zA-Z][a-zA-Z0-9_-]*=(?:'[^'<>&]*'|"[^"<>&]*"))*)[ \t\r\n]*(/?)>""")
_ATTRIBUTE = re.compile(r"""([a-zA-Z][a-zA-Z0-9_-]*)=(?:'([^']*)'|"([^"]*)")""")
_RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "noscript", "plaintext"}


def _simple(html: str) -> _Tree | None:
    """The tree of a page of plain tags and text alone, without the parser; None for any other page."""
    t, at = _Tree(), 0
    start, end, data = t.handle_starttag, t.handle_endtag, t.handle_data
    for m in _SIMPLE.finditer(html):
        if m.start() != at:
            return None
        at = m.end()
        text, slash, tag, attrs, own = m.groups()
        if text is not None:
            data(text)
            continue
        tag = tag.lower()
        if tag in _RAW or slash and (attrs or own):
            return None
        if slash:
            end(tag)
            continue
        start(tag, [(k.lower(), a or b) for k, a, b in _ATTRIBUTE.findall(attrs)] if attrs else ())
        if own:
            end(tag)
    return t if at == len(html) else None


def parse(html: str) -> _Node:
    t = _simple(html or "")
    if t is None:
        t = _Tree()
        t.feed(html)
        t.close()
    return t.root


def clean(s: str) -> str:
    s = _SPACE.sub(" ", re.sub(r"\[\d+\]", "", s)).strip()
    return s[:1].upper() + s[1:].lower()


def title_and_description(s: str) -> tuple[str, str]:
    parts = re.split(r"\s+[-–—]\s+", s, maxsplit=1)
    return clean(parts[0]), clean(parts[1]) if len(parts) > 1 else ""


def tables(html: str) -> list[tuple]:
    """(section, section description, name, description) of each row with two cells of the n-th wikitable, under the n-th h3; the shorter list ends it."""
    order = parse(html).below()
    place = {id(n): i for i, n in enumerate(order) if n.tag == "h3"}
    heads = [n for n in order if n.tag == "h3"]
    found = [n for n in order if n.tag == "table" and "wikitable" in (n.attrs.get("class") or "").split()]
    out = []
    for h, t in zip(heads, found):
        after = next((n for n in order[place[id(h)] + 1 :] if n.tag == "p"), None)
        about = _SPACE.sub(" ", after.text()).strip() if after else ""
        head = _SPACE.sub(" ", h.text()).strip()
        for row in t.find("tr"):
            cells = row.direct("td")
            if len(cells) >= 2:
                out.append((head, about, *(_SPACE.sub(" ", _NOTE.sub("", c.text())).strip() for c in cells[:2])))
    return out


def nested_list(html: str, first: str | None = "Imperative") -> list[tuple]:
    """(name, description, parent, depth, ordinal) of the items of the first list whose first item's name is `first` (any list, if None); item texts leave nested lists out."""
    out: list[tuple] = []

    def name_of(li: _Node) -> tuple[str, str]:
        return title_and_description(_SPACE.sub(" ", li.text("ul")).strip())

    for ul in parse(html).find("ul"):
        items = ul.direct("li")
        if items and (first is None or name_of(items[0])[0] == first):
            todo = [(li, None, 0) for li in reversed(items)]
            while todo:
                li, parent, depth = todo.pop()
                name, about = name_of(li)
                out.append((name, about, parent, depth, len(out)))
                todo += [(x, name, depth + 1) for inner in reversed(li.direct("ul")) for x in reversed(inner.direct("li"))]
            break
    return out


def extract_tables(pages: DataFrame) -> DataFrame:
    """page_id, section, section_description, name, description for every page (page_id, html)."""

    names = ["page_id", "section", "section_description", "name", "description"]

    def rows(batches):
        for b in batches:
            for k in range(0, b.num_rows, 512):  # a page may have many rows
                part = b.slice(k, 512)
                got = [(i, *r) for i, h in zip(part.column("page_id").to_pylist(), part.column("html").to_pylist()) for r in tables(h)]
                if got:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if j else pa.int64()) for j, c in enumerate(zip(*got))], names)

    return pages.select("page_id", "html").mapInArrow(rows, "page_id long, section string, section_description string, name string, description string")


def extract_list(pages: DataFrame, first: str | None = "Imperative") -> DataFrame:
    """page_id, name, description, parent, depth, ordinal for every page (page_id, html)."""

    def rows(batches):
        for b in batches:
            got = [(i, *r) for i, h in zip(b["page_id"], b["html"]) for r in nested_list(h, first)]
            yield pd.DataFrame(got, columns=["page_id", "name", "description", "parent", "depth", "ordinal"]).astype({"depth": "int32", "ordinal": "int32"})

    return pages.select("page_id", "html").mapInPandas(rows, "page_id long, name string, description string, parent string, depth int, ordinal int")
