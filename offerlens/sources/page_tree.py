"""Tolerant reading of one HTML page: elements with text ranges, and a few selector forms.

Runs inside Python workers on one page at a time and returns plain strings; all rules about what the
strings mean are columns in ``offerlens.sources.pages``.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from html.parser import HTMLParser

# Elements without content, and elements whose text is not shown.
VOID = {
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr",
}
HIDDEN = {"script", "style", "template", "rt", "rp"}

# Raw fields that hold a list of texts.
LIST_FIELDS = [
    "crumb_texts", "bullet_texts", "box_texts", "gallery_links", "merchant_texts", "return_texts",
]


class Node:
    __slots__ = ("tag", "attrs", "classes", "place", "last", "parent", "start", "end")

    def __init__(self, tag, attrs, place, parent, start):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.place, self.last = place, place  # own position and that of the last element inside
        self.start, self.end = start, start  # text pieces inside
        self.classes = attrs.get("class", "").split()


class PageTree(HTMLParser):
    """Elements in document order; the text of an element is a slice of ``pieces``.

    An end tag closes up to the nearest open element of its name and is ignored if there is none;
    open elements last to the end of the page.
    """

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.nodes: list[Node] = []
        self.pieces: list[str] = []
        self.by_key: dict[str, list[int]] = {}
        self._open: list[int] = []
        self._hidden = 0
        self._buffer: list[str] = []
        self.feed(html)
        self.close()
        self._flush()
        while self._open:
            self._shut()

    def _flush(self):
        if self._buffer:
            text = "".join(self._buffer).strip()
            self._buffer = []
            if text and not self._hidden:
                self.pieces.append(text)

    def _shut(self):
        node = self.nodes[self._open.pop()]
        node.end, node.last = len(self.pieces), len(self.nodes) - 1
        self._hidden -= node.tag in HIDDEN

    def handle_starttag(self, tag, attrs):
        self._flush()
        place = len(self.nodes)
        node = Node(
            tag, {k: v or "" for k, v in attrs}, place, self._open[-1] if self._open else -1, len(self.pieces)
        )
        self.nodes.append(node)
        for key in (tag, "#" + node.attrs.get("id", ""), *("." + c for c in node.classes)):
            self.by_key.setdefault(key, []).append(place)
        if tag not in VOID:
            self._open.append(place)
            self._hidden += tag in HIDDEN

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self._shut()

    def handle_endtag(self, tag):
        self._flush()
        if any(self.nodes[i].tag == tag for i in self._open):
            while self.nodes[self._open[-1]].tag != tag:
                self._shut()
            self._shut()

    def handle_data(self, data):
        self._buffer.append(data)

    def handle_comment(self, data):
        self._flush()

    handle_decl = handle_pi = unknown_decl = handle_comment

    def text(self, node: Node, sep: str = "") -> str:
        return sep.join(self.pieces[node.start : node.end])

    def ancestors(self, node: Node):
        while node.parent >= 0:
            node = self.nodes[node.parent]
            yield node

    def select(self, selector: str, within: Node | None = None) -> list[Node]:
        """Matching elements in document order, optionally only those inside one element."""
        found = set()
        for chain in compile_selector(selector):
            last = chain[-1][1]
            places = self.by_key.get(last.index_key, [])
            if within is not None:
                places = places[bisect_right(places, within.place) : bisect_right(places, within.last)]
            for place in places:
                node = self.nodes[place]
                if place not in found and last.fits(node) and self._chain_fits(node, chain, len(chain) - 1):
                    found.add(place)
        return [self.nodes[i] for i in sorted(found)]

    def _chain_fits(self, node: Node, chain, at: int) -> bool:
        if at == 0:
            return True
        direct, above = chain[at][0], chain[at - 1][1]
        for ancestor in self.ancestors(node):
            if above.fits(ancestor) and self._chain_fits(ancestor, chain, at - 1):
                return True
            if direct:
                return False
        return False


_PART = re.compile(r"#([\w-]+)|\.([\w-]+)|\[([\w-]+)(\*?=)[\"']([^\"']*)[\"']\]|:not\(\.([\w-]+)\)|([\w]+)")


class Compound:
    """One step of a selector: tag, id, classes, attribute tests and excluded classes."""

    def __init__(self, text: str):
        self.tag = self.id = None
        self.classes, self.tests, self.excluded = [], [], []
        for m in _PART.finditer(text):
            ident, cls, attr, op, value, no, tag = m.groups()
            if ident:
                self.id = ident
            elif cls:
                self.classes.append(cls)
            elif attr:
                self.tests.append((attr, op == "*=", value))
            elif no:
                self.excluded.append(no)
            else:
                self.tag = tag
        self.index_key = "#" + self.id if self.id else "." + self.classes[0] if self.classes else self.tag

    def fits(self, node: Node) -> bool:
        return (
            (self.tag is None or node.tag == self.tag)
            and (self.id is None or node.attrs.get("id") == self.id)
            and all(c in node.classes for c in self.classes)
            and not any(c in node.classes for c in self.excluded)
            and all(
                (v in node.attrs.get(a, "")) if part else node.attrs.get(a) == v for a, part, v in self.tests
            )
        )


_COMPILED: dict[str, list] = {}


def compile_selector(selector: str):
    """Comma list of steps joined by blanks (inside) or ``>`` (directly inside)."""
    if selector in _COMPILED:
        return _COMPILED[selector]
    chains = []
    for alternative in selector.split(","):
        chain, direct = [], False
        for step in alternative.split():
            if step == ">":
                direct = True
            else:
                chain.append((direct, Compound(step)))
                direct = False
        chains.append(chain)
    _COMPILED[selector] = chains
    return chains


def read_fields(html: str, table: dict) -> dict:
    """Raw strings of one page as listed in a selector table."""
    tree = PageTree(html)
    out: dict = {f: [] for f in LIST_FIELDS}

    def first(selector):
        return next(iter(tree.select(selector)), None)

    for name, (selector, sep) in table["TEXT"].items():
        node = first(selector)
        out[name] = None if node is None else tree.text(node, sep)
    for name, selector in table["TEXTS"].items():
        out[name] = [tree.text(n) for n in tree.select(selector)]
    for selector, names in table["ATTRS"].values():
        node = first(selector)
        for name, attr in names.items():
            out[name] = None if node is None else node.attrs.get(attr)
    for name, (selector, attr) in table["LINKS"].items():
        out[name] = [n.attrs.get(attr, "") for n in tree.select(selector)]
    for name, (box, selector) in table["INSIDE"].items():
        node = first(box)
        out[name] = [] if node is None else [tree.text(n) for n in tree.select(selector, node)]
    out["prime_mark"] = any(tree.select(s) for s in table["FLAGS"].values())

    containers, mark, longest = table.get("BLOCKS", ({"div", "section", "table"}, None, 0))
    rows = []
    for variant, (selector, cells, others, key, value) in table["ROWS"].items():
        for row in tree.select(selector):
            texts = lambda s: [tree.text(n) for n in tree.select(s, row)] if s else []
            one = lambda s: next(iter(texts(s)), None)
            section = next((a.place for a in tree.ancestors(row) if a.tag in containers), -1)
            rows.append(
                {
                    "variant": variant, "section": section, "cells": texts(cells), "others": texts(others),
                    "key": one(key), "value": one(value),
                }
            )
    out["spec_rows"] = rows

    blocks = {}
    for i, piece in enumerate(tree.pieces if mark else []):
        if mark in piece:
            for node in tree.nodes:
                if node.tag in containers and node.start <= i < node.end and node.place not in blocks:
                    text = tree.text(node, "\n")
                    if len(text) < longest:
                        blocks[node.place] = text
    out["blocks"] = [{"section": k, "text": v} for k, v in sorted(blocks.items())]
    return out
